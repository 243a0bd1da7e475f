"""Normalising raw signals and merging them per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.functions.text import clean_text, safe_host
from vigilframe.functions.urls import safe_url, specificity
from vigilframe.plans.shared import cut, ranged, tasks


def prepare(raw: DataFrame, now: Column, screenshot: Column | None = None, reference: Column | None = None) -> DataFrame:
    """Raw signals (with their order in ``seq``) in published form; unusable rows go.

    The rows are dealt by ``seq`` first, so that reading few large files does not bound
    the number of tasks; a ``brand_evidence`` that the rows have is kept.

    ``screenshot`` and ``reference``: expressions for the allow-listed addresses.
    """
    # Exploded, as what a generator gives is computed once, however often filters and columns name it.
    rows = raw.repartition(tasks(raw.sparkSession), "seq").select("*", F.explode(F.array(safe_url(F.col("url")))).alias("safe")).withColumn("source", clean_text(F.col("source"), 80))
    rows = rows.where(F.col("safe.key").isNotNull() & F.col("source").isNotNull())
    last = S.parsed_time(F.col("last_seen"), now)
    rows = rows.withColumn("lastSeen", F.when(last > now + F.expr("interval 5 minutes"), now).otherwise(last))
    rows = rows.withColumn("firstSeen", F.least("lastSeen", S.parsed_time(F.col("first_seen"), F.col("lastSeen"))))
    text = lambda name, n: clean_text(F.col(name), n).alias(name)
    nothing = F.lit(None).cast("string")
    return rows.select(
        "seq",
        S.short_id(F.lower("safe.display_domain")).alias("id"),
        F.col("safe.display_url").alias("url"),
        F.col("safe.display_domain").alias("domain"),
        "firstSeen",
        "lastSeen",
        F.array("source").alias("sources"),
        S.status(F.col("status")).alias("status"),
        text("brand", 120),
        text("country", 80),
        safe_host(F.col("host")).alias("host"),
        (nothing if screenshot is None else screenshot).alias("screenshotUrl"),
        (nothing if reference is None else reference).alias("referenceUrl"),
        S.hashes(F.col("hashes")).alias("hashes"),
        (F.col("brand_evidence") if "brand_evidence" in raw.columns else F.array()).cast("array<string>").alias("brandEvidence"),
        S.reasons(F.col("reason_codes")).alias("reasonCodes"),
        S.confidence(F.col("confidence")).alias("confidence"),
    )


FILLED = ("country", "host", "screenshotUrl", "referenceUrl")
#: Lists of a signal and how many of their distinct entries stay, the first ones in order.
LISTS = {"hashes": 8, "brandEvidence": 64, "reasonCodes": 16}


def _first_entries(rows: DataFrame) -> DataFrame:
    """Per id its ``LISTS``: distinct entries, reduced to the first ones before they are collected."""
    def listed(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("list"), i.alias("pos"), x.alias("entry")))

    each = rows.select("id", "seq", F.explode(F.concat(*map(listed, LISTS))).alias("e")).select("id", "seq", "e.*")
    entries = each.groupBy("id", "list", "entry").agg(F.min(F.struct("seq", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("id", "list").orderBy("at"))
    most = F.coalesce(*[F.when(F.col("list") == c, n) for c, n in LISTS.items()])
    chosen = entries.withColumn("place", place).where(F.col("place") <= max(LISTS.values())).where(F.col("place") <= most)
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("place", "entry")))), lambda x: x["entry"]).alias(c)
    return chosen.groupBy("id").agg(*[of(c) for c in LISTS])


def merge(signals: DataFrame, most: int | None = None) -> DataFrame:
    """One row per ``id``; rows of an id count in the order of ``seq``.

    Ids with two brands go.  A filled column takes the value of the last row that
    was newer than all before it, or that came when there was no value yet.  What
    was before a row comes from totals of the ranges of ``seq`` before its own, and
    lists are reduced before they are collected, so no task holds all rows of an id.
    """
    # Cut before it is ranged, as finding the ranges reads the rows once more.
    held = ranged(cut(signals), "seq")
    spans = held.groupBy("id", "_range").agg(F.max("lastSeen").alias("_last"), *[F.count(c).alias(f"_n_{c}") for c in FILLED])
    earlier = Window.partitionBy("id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("id", "_range", F.max("_last").over(earlier).alias("_earlier"), *[F.coalesce(F.sum(f"_n_{c}").over(earlier), F.lit(0)).alias(f"_had_{c}") for c in FILLED])
    before = Window.partitionBy("id", "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = held.join(spans, ["id", "_range"]).withColumn("_newest", F.greatest("_earlier", F.max("lastSeen").over(before)))
    newer = F.col("_newest").isNull() | (F.col("lastSeen") > F.col("_newest"))
    rows = rows.withColumns({f"_take_{c}": F.col(c).isNotNull() & (newer | (F.col(f"_had_{c}") + F.count(c).over(before) == 0)) for c in FILLED})
    brand = F.nullif(F.col("brand"), F.lit(""))
    main = rows.groupBy("id").agg(
        F.max_by("url", F.struct(specificity(F.col("url")), -F.col("seq"))).alias("url"),
        F.min_by("domain", "seq").alias("domain"),
        F.min("firstSeen").alias("firstSeen"),
        F.max("lastSeen").alias("lastSeen"),
        F.max_by("status", F.struct("lastSeen", S.priority(F.col("status")), -F.col("seq"))).alias("status"),
        F.max(brand).alias("brand"),
        F.min(brand).alias("_brand"),
        *[F.max_by(c, F.when(F.col(f"_take_{c}"), F.col("seq"))).alias(c) for c in FILLED],
        F.max("confidence").alias("confidence"),
    )
    sources = held.select("id", F.explode("sources").alias("s")).groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    out = main.where("brand is null or brand = _brand").join(sources, "id", "left").join(_first_entries(held), "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("sources", *LISTS)})
    out = out.select("id", "url", "domain", "firstSeen", "lastSeen", "sources", "status", "brand", *FILLED, *LISTS, "confidence")
    return out if most is None else out.orderBy(F.desc("lastSeen"), F.desc("firstSeen"), "id").limit(most)
