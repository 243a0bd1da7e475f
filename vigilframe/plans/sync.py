"""Synchronising all sources into one published snapshot and its history."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vigilframe.functions.text import refang
from vigilframe.functions.urls import url_host
from vigilframe.operators import history, matching, merge, review
from vigilframe.plans.shared import cut, once


@dataclass(frozen=True)
class Settings:
    """Limits of a synchronisation, with their ranges."""

    max_signals: int = 2_500
    retain_days: int = 7
    min_signals: int = 0
    min_retained_percent: int = 25
    detail_days: int = 30
    summary_days: int = 730
    history_signals: int = 5_000

    #: The ranges that settings are held to.
    RANGES = {"max_signals": (1, 25_000), "retain_days": (1, 90), "min_signals": (0, 25_000), "min_retained_percent": (0, 100), "detail_days": (7, 90), "summary_days": (30, 3_650), "history_signals": (1, 25_000)}

    @staticmethod
    def of(values: dict[str, str]) -> Settings:
        """From texts: what is no integer counts as not given, what is out of range is clamped."""
        out = {}
        for name, (low, high) in Settings.RANGES.items():
            try:
                out[name] = min(high, max(low, int(values[name].strip())))
            except (KeyError, ValueError):
                continue
        return Settings(**out)


def union(sources: list[DataFrame]) -> DataFrame:
    """Raw signals of all sources; ``seq`` goes on in the order of the list."""
    out = None
    for number, rows in enumerate(sources):
        some = rows.withColumn("seq", F.col("seq").cast("long") + F.lit(number << 40))
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def retained(old: DataFrame, now: Column, days: int, known: list[str], attempted: list[str], completed: list[str]) -> DataFrame:
    """Rows of the last snapshot that go on: recent, and of sources that were asked but did not answer."""
    carried = [s for s in known if s in attempted and s not in completed]
    rows = old.where(F.col("lastSeen").between(now - F.make_interval(days=F.lit(days)), now + F.expr("interval 5 minutes")))
    kept = F.array_intersect("sources", F.array(*[F.lit(s) for s in carried]).cast("array<string>"))
    return rows.withColumn("sources", kept).where(F.size("sources") > 0).withColumn("hashes", F.array().cast("array<string>"))


def check_size(rows: int, previous: int | None, settings: Settings, allow_small: bool = False) -> None:
    """A snapshot must not shrink below its floor and a share of the recent one."""
    floor = max(settings.min_signals, ceil((previous or 0) * settings.min_retained_percent / 100))
    if rows < floor and not allow_small:
        raise ValueError(f"{rows} signals, fewer than the floor of {floor}")


@dataclass(frozen=True)
class Result:
    """A snapshot, the events of its publication, the prepared rows and, per named source, what became of its rows."""

    snapshot: DataFrame
    events: DataFrame
    prepared: DataFrame
    counts: DataFrame | None = None


def exclusion_note(note: Column, excluded: Column) -> Column:
    """A source's note with the number of rows that the scope left out, if any."""
    some = F.concat(excluded.cast("string"), F.when(excluded == 1, " non-registry target excluded").otherwise(" non-registry targets excluded"))
    return F.when(excluded > 0, F.concat_ws("; ", F.nullif(note, F.lit("")), some)).otherwise(note)


def _counted(rows: DataFrame, sources: list[str], name: str) -> tuple[DataFrame, Observation]:
    """``rows`` and what will tell, once they are computed, how many each source has."""
    seen = Observation(name)
    return rows.observe(seen, *[F.count_if(F.col("source").eqNullSafe(F.lit(s))).alias(f"n{i}") for i, s in enumerate(sources)]), seen


def synchronise(
    raw: DataFrame,
    registry: matching.Registry,
    suppressions: DataFrame,
    now: Column,
    old: DataFrame | None = None,
    previous: DataFrame | None = None,
    settings: Settings = Settings(),
    sources: list[str] | None = None,
) -> Result:
    """Scope, normalise, suppress and merge raw signals, and derive the events.

    ``screenshot_url`` and ``reference_url`` of the rows must be allow-listed before
    (``urls.allowed_report``).  ``old``: rows that ``retained`` kept; they count after all new ones.
    ``previous(id, latestStatus)``: statuses of the history.  ``sources``: names whose
    accepted and excluded rows are counted, in the pass that filters them.
    """
    spark = raw.sparkSession
    hosted = lambda rows: once(rows, "_host", url_host(F.col("url"))).where("_host is not null")
    pairs = cut(hosted(raw).select("_host", "brand").distinct())
    matches = cut(matching.score(pairs, registry, "_host"))
    counted, before = _counted(raw, sources, "before") if sources else (raw, None)
    scoped = matching.scope(hosted(counted), matches, registry, "_host", "brand", pairs)
    reports = [F.col(c) if c in raw.columns else None for c in ("screenshot_url", "reference_url")]
    kept = review.drop_suppressed(merge.prepare(scoped, now, *reports), suppressions)
    if not sources:
        prepared, counts = cut(kept), None
    else:
        kept, after = _counted(kept.withColumn("source", F.get("sources", F.lit(0))), sources, "after")
        prepared = cut(kept).drop("source")
        told = [(s, after.get[f"n{i}"], before.get[f"n{i}"] - after.get[f"n{i}"]) for i, s in enumerate(sources)]
        counts = spark.createDataFrame(told, "source string, accepted long, excluded long").withColumn("note", exclusion_note(F.lit(None).cast("string"), F.col("excluded")))
    rows = prepared
    if old is not None:
        named = old.withColumn("_host", refang(F.col("domain")))
        pairs = cut(named.select("_host", "brand").distinct())
        past = matching.scope(named, cut(matching.score(pairs, registry, "_host")), registry, "_host", "brand", pairs)
        rows = rows.unionByName(review.drop_suppressed(past, suppressions).drop("_host").withColumn("seq", F.lit(1 << 60)), allowMissingColumns=True)
    snapshot = cut(merge.merge(rows, settings.max_signals))
    known = previous if previous is not None else spark.createDataFrame([], "id string, latestStatus string")
    return Result(snapshot, history.build_events(prepared, snapshot, known), prepared, counts)


def source_states(names: list[str], results: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All sources with their state and how many published rows they stand behind; unasked ones are skipped."""
    from vigilframe.operators.views import source_counts

    listed = results.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, source string")
    return listed.join(results, "source", "left").join(source_counts(snapshot), "source", "left").select("place", "source", F.coalesce("state", F.lit("skipped")).alias("state"), F.coalesce("records", F.lit(0)).alias("records"))
