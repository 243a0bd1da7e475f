"""The event log of signals: deriving events, folding them, compaction under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions import signals as S

TRANSITIONS, RECENT, MOST_COUNT = 16, 64, 2_147_483_647
EVENT = ("eventId", "signalId", "eventType", "observedAt", "domain", "brand", "sources", "status", "previousStatus", "confidence", "reasonCodes")
FOLDED = ("id", "domain", "brand", "firstSeen", "lastSeen", "observationCount", "sources", "latestStatus", "statusObservedAt", "reasonCodes", "statusTransitions", "recentEventIds")


def _events(rows: DataFrame, kind: str, at: Column, previous: Column, extra: Column) -> DataFrame:
    codes = S.reasons(F.array_compact(F.concat(F.coalesce("reasonCodes", F.array().cast("array<string>")), F.array(extra))))
    out = rows.select(
        F.col("id").alias("signalId"),
        F.lit(kind).alias("eventType"),
        at.alias("observedAt"),
        "domain",
        "brand",
        F.array_sort(F.array_distinct("sources")).alias("sources"),
        "status",
        previous.alias("previousStatus"),
        "confidence",
        codes.alias("reasonCodes"),
    ).where("brand is not null and brand <> '' and size(reasonCodes) > 0")
    identity = S.event_id(signal=F.col("signalId"), kind=F.col("eventType"), at=S.shown_time(F.col("observedAt")), sources=F.col("sources"), status=F.col("status"), previous=F.col("previousStatus"))
    return out.withColumn("eventId", identity).select(*EVENT)


def build_events(observations: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """Events of one publication.

    Both ends of every observation of a published host and brand, and a transition
    where the published status differs from ``previous(id, latestStatus)`` or there
    was none.  A host that is gone makes no event.
    """
    published = current.select("id", "brand")
    seen = observations.join(published, ["id", "brand"]).withColumn("at", F.explode(F.array_distinct(F.array("firstSeen", "lastSeen"))))
    nothing = F.lit(None).cast("string")
    observed = _events(seen, "observation", F.col("at"), nothing, nothing)
    changed = current.join(previous.select("id", "latestStatus"), "id", "left").where(~F.col("status").eqNullSafe(F.col("latestStatus")))
    moved = _events(changed, "status-transition", F.col("lastSeen"), F.col("latestStatus"), F.when(F.col("latestStatus").isNull(), "first-publication").otherwise("source-status-change"))
    return observed.unionByName(moved).dropDuplicates(["eventId"])


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events that the log does not have; repeating a run adds nothing."""
    return events.dropDuplicates(["eventId"]).join(stored.select("eventId"), "eventId", "left_anti")


def _newest(rows: DataFrame) -> DataFrame:
    """Per signal its newest transitions and event ids.

    The newest of either kind are ranked first; Spark cuts each task's rows to as many
    before it shuffles them, so a signal with most of the events is no task of its own.
    """
    moved = F.col("eventType") == "status-transition"
    kept = rows.select("id", moved.alias("moved"), "observedAt", "eventId", *[F.when(moved, F.col(c)).alias(c) for c in ("previousStatus", "status", "sources", "reasonCodes")])
    place = F.row_number().over(Window.partitionBy("id", "moved").orderBy(F.desc("observedAt"), F.desc("eventId")))
    kept = kept.withColumn("_place", place).where(F.col("_place") <= RECENT)
    transition = F.struct("observedAt", "eventId", "previousStatus", "status", "sources", "reasonCodes")
    last = lambda c, n: F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)
    out = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("moved") & (F.col("_place") <= TRANSITIONS), transition))).alias("statusTransitions"), F.array_sort(F.collect_list(F.struct("observedAt", "eventId"))).alias("_ids"))
    return out.select("id", "statusTransitions", F.transform(last(F.col("_ids"), RECENT), lambda x: x["eventId"]).alias("recentEventIds"))


def _entries(rows: DataFrame) -> DataFrame:
    """Per signal its distinct sources and its first distinct reason codes, of which there is a fixed set."""
    codes = F.transform("reasonCodes", lambda x, i: F.struct(F.lit(True).alias("code"), i.alias("pos"), x.alias("entry")))
    sources = F.transform("sources", lambda x: F.struct(F.lit(False).alias("code"), F.lit(0).alias("pos"), x.alias("entry")))
    each = rows.select("id", "observedAt", "eventId", F.explode(F.concat(codes, sources)).alias("e")).select("id", "observedAt", "eventId", "e.*")
    once = each.groupBy("id", "code", "entry").agg(F.min(F.when(F.col("code"), F.struct("observedAt", "eventId", "pos"))).alias("at"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("code"), F.struct("at", "entry"))))
    return once.groupBy("id").agg(F.array_sort(F.collect_list(F.when(~F.col("code"), F.col("entry")))).alias("sources"), F.slice(F.transform(ordered, lambda x: x["entry"]), 1, 16).alias("reasonCodes"))


def fold(events: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Per signal: first and last time, counts, latest status, transitions, recent events.

    ``summary`` is an earlier fold to go on from.  Signals with two domains or
    brands go; the last ``TRANSITIONS`` transitions and ``RECENT`` event ids stay.
    """
    rows = events.dropDuplicates(["eventId"])
    if summary is not None:
        rows = rows.join(summary.select(F.explode("recentEventIds").alias("eventId")), "eventId", "left_anti")
    rows = rows.withColumnRenamed("signalId", "id")
    main = rows.groupBy("id").agg(
        F.min("domain").alias("domain"),
        F.max("domain").alias("_domain"),
        F.min("brand").alias("brand"),
        F.max("brand").alias("_brand"),
        F.min("observedAt").alias("firstSeen"),
        F.max("observedAt").alias("lastSeen"),
        F.count_if(F.col("eventType") == "observation").alias("observationCount"),
        F.max_by("status", F.struct("observedAt", "eventId")).alias("latestStatus"),
        F.max("observedAt").alias("statusObservedAt"),
    )
    new = main.join(_newest(rows), "id").join(_entries(rows), "id", "left")
    new = new.withColumns({c: F.coalesce(c, F.array().cast(new.schema[c].dataType)) for c in ("sources", "reasonCodes")})
    if summary is None:
        merged = new
    else:
        old = summary.select([F.col(c).alias(f"o_{c}") for c in summary.columns])
        both = new.join(old, F.col("id") == F.col("o_id"), "full")
        either = lambda c: F.coalesce(c, f"o_{c}")
        later = F.col("statusObservedAt") >= F.col("o_statusObservedAt")
        listed = lambda c: F.concat(F.coalesce(f"o_{c}", F.expr(f"slice({c}, 1, 0)")), F.coalesce(c, F.expr(f"slice(o_{c}, 1, 0)")))
        merged = both.select(
            either("id").alias("id"),
            F.least("domain", "o_domain").alias("domain"),
            F.greatest("_domain", "o_domain").alias("_domain"),
            F.least("brand", "o_brand").alias("brand"),
            F.greatest("_brand", "o_brand").alias("_brand"),
            F.least("firstSeen", "o_firstSeen").alias("firstSeen"),
            F.greatest("lastSeen", "o_lastSeen").alias("lastSeen"),
            (F.coalesce("observationCount", F.lit(0)) + F.coalesce("o_observationCount", F.lit(0))).alias("observationCount"),
            F.array_sort(F.array_distinct(listed("sources"))).alias("sources"),
            F.when(F.coalesce(later, F.col("o_id").isNull()), F.col("latestStatus")).otherwise(F.col("o_latestStatus")).alias("latestStatus"),
            F.greatest("statusObservedAt", "o_statusObservedAt").alias("statusObservedAt"),
            F.slice(F.array_distinct(listed("reasonCodes")), 1, 16).alias("reasonCodes"),
            F.array_sort(F.array_distinct(listed("statusTransitions"))).alias("statusTransitions"),
            listed("recentEventIds").alias("recentEventIds"),
        )
        last = lambda c, n: F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(F.col(c))
        merged = merged.withColumns({"statusTransitions": last("statusTransitions", TRANSITIONS), "recentEventIds": last("recentEventIds", RECENT)})
    merged = merged.where("domain = _domain and brand = _brand").select(*FOLDED)
    return merged.withColumn("observationCount", F.least(F.col("observationCount"), F.lit(MOST_COUNT)).cast("int"))


def compact(log: DataFrame, summary: DataFrame | None, watermark: str | None, today: str, now: Column, detail_days: int = 30, summary_days: int = 730, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(summary, watermark(compactedThrough))`` after folding the days that leave the detail window.

    ``log`` has a ``day``; only days before the window and after the watermark are
    folded, so late rows of folded days change nothing.  Signals last seen before
    ``summary_days`` expire.  ``most`` keeps the newest signals only, for a summary that
    has a bound; a published document has its own (``snapshots.as_document``).
    """
    cutoff = F.date_sub(F.lit(today).cast("date"), detail_days)
    due = F.col("day") < cutoff if watermark is None else (F.col("day") < cutoff) & (F.col("day") > F.lit(watermark).cast("date"))
    old = log.where(due)
    folded = fold(old, summary).where(F.col("lastSeen") >= now - F.make_interval(days=F.lit(summary_days)))
    mark = old.agg(F.coalesce(F.max("day"), F.lit(watermark).cast("date")).alias("compactedThrough"))
    return folded if most is None else folded.orderBy(F.desc("lastSeen"), F.desc("id")).limit(most), mark


def retained(log: DataFrame, today: str, detail_days: int = 30) -> DataFrame:
    """The days of the log that stay in detail."""
    return log.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), detail_days))


def public(summary: DataFrame, matches: DataFrame, in_scope: DataFrame, most: int = 5_000) -> DataFrame:
    """Rows of a fold that may be shown.

    ``in_scope`` has the signals (id, brand) that passed ``matching.scope``.  A host
    that matches no brand itself needs typed evidence of another kind.
    """
    typed = F.array(*[F.lit(x) for x in ("brand-title-match", "provider-verdict", "partner-public-export")])
    host = F.replace(F.col("domain"), F.lit("[.]"), F.lit("."))
    own = matches.where("brands = 1").select(F.col("domain").alias("_d"), F.col("brand").alias("_m"))
    rows = summary.join(in_scope.select("id", "brand"), ["id", "brand"], "left_semi").join(own, host == F.col("_d"), "left")
    rows = rows.where((F.col("_m").isNotNull() & (F.col("_m") == F.col("brand"))) | (F.col("_m").isNull() & F.arrays_overlap("reasonCodes", typed)))
    columns = ("id", "domain", "brand", "firstSeen", "lastSeen", "observationCount", "sources", "latestStatus", "reasonCodes", "statusTransitions")
    return rows.select(*columns).orderBy(F.desc("lastSeen"), F.desc("id")).limit(most)
