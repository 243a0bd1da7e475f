"""Filters, counts, groups, facets and pages over published signals."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.plans.shared import ranged

PAGE = 25


def search(rows: DataFrame, text: str = "", columns: tuple[str, ...] = ("url", "domain", "brand", "country", "host"), listed: str | None = "sources", facets: dict[str, str] | None = None, least: int = 0, confidence: str = "confidence") -> DataFrame:
    """Rows that hold ``text`` in any column or list entry and agree with every facet; ``all`` turns a facet off."""
    wanted = F.lit(text.strip().lower())
    held = lambda c: F.coalesce(F.contains(F.lower(c), wanted), F.lit(False))
    hit = F.lit(not text.strip())
    for c in columns:
        hit = hit | held(F.col(c))
    if listed:
        hit = hit | F.coalesce(F.exists(listed, lambda s: F.contains(F.lower(s), wanted)), F.lit(False))
    for name, value in (facets or {}).items():
        if value != "all":
            hit = hit & (F.array_contains(name, value) if name == listed else F.coalesce(F.col(name) == value, F.lit(False)))
    return rows.where(hit & (F.col(confidence) >= least) if confidence in rows.columns else hit)


def search_joined(rows: DataFrame, text: str, columns: tuple[str, ...] = ("domain", "brand"), listed: str = "sources") -> DataFrame:
    """Rows whose joined columns and list hold ``text``."""
    whole = F.concat_ws(" ", *columns, listed)
    return rows.where(F.contains(F.lower(whole), F.lit(text.strip().lower())))


def metrics(rows: DataFrame, status: str = "status", confidence: str = "confidence", brand: str = "brand", country: str = "country") -> DataFrame:
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(status) == "active").alias("active"),
        F.count_if(F.col(confidence) >= 80).alias("high_confidence"),
        F.count_distinct(named(brand)).alias("brands"),
        F.count_distinct(named(country)).alias("countries"),
    )


def top_groups(rows: DataFrame, column: str, most: int = 5) -> DataFrame:
    name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown")).alias("name")
    return rows.groupBy(name).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(most)


def bars(groups: DataFrame) -> DataFrame:
    """Groups with their share of the largest, for a chart."""
    largest = groups.agg(F.greatest(F.max("count"), F.lit(1)).alias("largest"))
    return groups.crossJoin(F.broadcast(largest)).withColumn("share", F.col("count") / F.col("largest")).drop("largest")


def facets(rows: DataFrame, column: str, listed: bool = False) -> DataFrame:
    """Distinct values of a column in the order of a reader's language: letters before case and accents."""
    value = F.explode(column) if listed else F.col(column)
    return rows.select(value.alias("value")).where("value is not null and value <> ''").distinct().orderBy(collated("value"), "value")


def collated(column: str, collation: str = "UNICODE") -> Column:
    return F.collate(F.col(column), collation)


def source_counts(rows: DataFrame, listed: str = "sources") -> DataFrame:
    return rows.select(F.explode(F.array_distinct(listed)).alias("source")).groupBy("source").agg(F.count("*").alias("records"))


def state_counts(states: DataFrame) -> DataFrame:
    """How many sources are healthy, partial or skipped; one row, zeros included."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("healthy", "partial", "skipped")])


def history_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("observationCount"), F.lit(0)).alias("observations"), F.coalesce(F.sum(F.size("statusTransitions")), F.lit(0)).alias("transitions"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` from 1 on, of the rows in an order; offset and limit need no global window."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(count: int, size: int = PAGE) -> int:
    return max(1, ceil(count / size))


def newest_within(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows over all partitions together, as a running limit over files would keep."""
    return rows.orderBy(*order).limit(most)


def within_budget(rows: DataFrame, size: Column, budget: int, order: list[Column], used: str | None = None) -> DataFrame:
    """The longest prefix in ``order`` whose sizes add up to ``budget`` at most.

    Prefix sums are taken per range of the order, with the ranges' totals added
    before, so no task holds all rows.  ``used`` names a column for the sums.
    """
    held = ranged(rows.withColumn("_size", size.cast("long")), *order)
    totals = held.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    # As many rows as there are ranges.
    before = totals.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    running = F.col("_before") + F.sum("_size").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = held.join(before.where(F.col("_before") <= budget), "_range").withColumn("_used", running).where(F.col("_used") <= budget)
    return (kept.withColumn(used, F.col("_used")) if used else kept).drop("_size", "_range", "_before", "_used")
