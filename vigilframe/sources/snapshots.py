"""Published documents: the snapshot, the history and its summary, the health of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.operators.history import RECENT, TRANSITIONS
from vigilframe.sources.archives import bounded, defanged_domain

TRANSITION = "struct<eventId: string, observedAt: string, previousStatus: string, status: string, sources: array<string>, reasonCodes: array<string>>"
SIGNAL = "id string, url string, domain string, firstSeen string, lastSeen string, sources array<string>, status string, brand string, country string, host string, screenshotUrl string, referenceUrl string, hashes array<string>, brandEvidence array<string>, reasonCodes array<string>, confidence int"
SUMMARY = f"id string, domain string, brand string, firstSeen string, lastSeen string, observationCount int, sources array<string>, latestStatus string, statusObservedAt string, reasonCodes array<string>, statusTransitions array<{TRANSITION}>, recentEventIds array<string>"


def _rows(spark: SparkSession, path: str, schema: str, most: int) -> DataFrame:
    """The ``signals`` of one JSON document, the first ``most``, with their place in it."""
    fields = ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in _split(schema))
    doc = spark.read.schema(f"signals array<struct<{fields}>>").json(path, multiLine=True)
    return doc.select(F.posexplode(F.slice("signals", 1, most)).alias("seq", "s")).select("seq", "s.*")


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def signal_valid(known: list[str]) -> Column:
    """The contract of a published row."""
    first, last = S.canonical_time(F.col("firstSeen")), S.canonical_time(F.col("lastSeen"))
    return F.coalesce(
        F.startswith("url", F.lit("hxxp")) & ~F.col("url").rlike("[?#]") & ~F.contains("url", F.lit("http://")) & ~F.contains("url", F.lit("https://")) & defanged_domain(F.col("domain")) & (F.col("id") == S.short_id(F.lower("domain")))
        & first.isNotNull() & last.isNotNull() & (first <= last) & F.size("sources").between(1, 10) & F.forall("sources", lambda s: s.isin(known)) & F.col("status").isin(list(S.PRIORITY))
        & (F.col("brand").isNull() | bounded(F.col("brand"), 120)) & F.col("confidence").between(0, 100) & (F.coalesce("reasonCodes", F.array().cast("array<string>")) == S.reasons(F.col("reasonCodes"))),
        F.lit(False),
    )


def read_snapshot(spark: SparkSession, path: str, known: list[str], most: int = 25_000) -> DataFrame:
    """Rows of an earlier snapshot that keep its contract, without hashes; the others are skipped."""
    rows = _rows(spark, path, SIGNAL, most).withColumn("sources", F.filter("sources", lambda s: s.isin(known)))
    kept = rows.where(signal_valid(known)).withColumn("hashes", F.array().cast("array<string>"))
    return kept.withColumns({c: S.canonical_time(F.col(c)) for c in ("firstSeen", "lastSeen")})


def recent_count(rows: DataFrame, since: Column) -> DataFrame:
    return rows.agg(F.count_if(F.col("lastSeen") >= since).alias("recent"))


def transition_valid(t: Column) -> Column:
    states = list(S.PRIORITY)
    return S.canonical_time(t["observedAt"]).isNotNull() & t["status"].isin(states) & (t["previousStatus"].isNull() | (t["previousStatus"].isin(states) & (t["previousStatus"] != t["status"]))) & (F.size(t["sources"]) > 0) & t["eventId"].rlike("^[0-9a-f]{32}$")


def summary_valid(public: bool = False) -> Column:
    """The contract of a folded row; public ones have neither recent ids nor the time of their status."""
    first, last = S.canonical_time(F.col("firstSeen")), S.canonical_time(F.col("lastSeen"))
    good = (
        defanged_domain(F.col("domain")) & (F.col("id") == S.short_id(F.col("domain"))) & bounded(F.col("brand"), 120) & first.isNotNull() & last.isNotNull() & (first <= last) & (F.col("observationCount") >= 0)
        & (F.size("sources") > 0) & (F.col("sources") == F.array_sort(F.array_distinct("sources"))) & F.col("latestStatus").isin(list(S.PRIORITY)) & (F.size("reasonCodes") > 0) & (F.col("reasonCodes") == S.reasons(F.col("reasonCodes")))
        & (F.size("statusTransitions") <= TRANSITIONS) & F.forall("statusTransitions", transition_valid)
    )
    if not public:
        good = good & (F.size("recentEventIds") <= RECENT) & (F.size(F.array_distinct("recentEventIds")) == F.size("recentEventIds")) & S.canonical_time(F.col("statusObservedAt")).isNotNull()
    return F.coalesce(good, F.lit(False))


def read_history(spark: SparkSession, path: str, public: bool = False, most: int = 25_000) -> DataFrame:
    """Rows of a history or summary document; a bad row or a repeated id fails the read."""
    rows = _rows(spark, path, SUMMARY, most)
    counts = rows.agg(F.count_if(~summary_valid(public)).alias("bad"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if counts["bad"] or counts["n"] != counts["ids"]:
        raise ValueError(f"{counts['bad']} invalid rows, {counts['n']} rows with {counts['ids']} ids")
    return rows.drop("seq", *(["statusObservedAt", "recentEventIds"] if public else []))


def previous_statuses(history: DataFrame) -> DataFrame:
    return history.select("id", "latestStatus")


def as_document(rows: DataFrame, generated: str, dataset: str = "signals", most: int = 25_000) -> DataFrame:
    """One JSON document of published rows, in their order; ``most`` bounds it by contract."""
    shown = rows.withColumns({c: S.shown_time(F.col(c)) for c, kind in rows.dtypes if kind.startswith("timestamp")}).orderBy(F.desc("lastSeen"), F.desc("firstSeen"), "id").limit(most)
    listed = F.array_sort(F.collect_list(F.struct(F.struct(F.col("lastSeen"), F.col("firstSeen"), "id").alias("k"), F.struct(*shown.columns).alias("v"))), lambda a, b: F.when((a["k"]["lastSeen"] > b["k"]["lastSeen"]) | ((a["k"]["lastSeen"] == b["k"]["lastSeen"]) & ((a["k"]["firstSeen"] > b["k"]["firstSeen"]) | ((a["k"]["firstSeen"] == b["k"]["firstSeen"]) & (a["k"]["id"] < b["k"]["id"])))), -1).otherwise(1))
    return shown.agg(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(dataset).alias("dataset"), F.lit(generated).alias("generatedAt"), F.transform(listed, lambda x: x["v"]).alias("signals"))).alias("value"))
