"""Archives of one JSON object per line, in folders by day, and documents.

Closed schemas are checked on the parsed variant, so unknown keys and numbers of the
wrong type are seen.  Two policies: bad rows are skipped, or the read fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.functions.hosts import normalize_domain

#: Keys of a candidate row, of a history event and of a report row.
CANDIDATE_KEYS = "schemaVersion id observedAt indicatorType domain registrableDomain source brand confidence reasons".split()
EVENT_KEYS = "schemaVersion eventId signalId eventType observedAt domain brand sources status previousStatus confidence reasonCodes".split()
REPORT_KEYS = "schemaVersion id url domain firstSeen lastSeen sources status brand country host screenshotUrl referenceUrl hashes hashType brandEvidence confidence".split()


def at_most(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, checked to be ``most`` at most before anything is read from them."""
    if (n := rows.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} rows ({n})")
    return rows


def read_lines(spark: SparkSession, root: str, name: str, longest: int = 16_384) -> DataFrame:
    """``(day, line, value)`` of every ``root/<day>/<name>``; lines that are blank, too long or no JSON have a null value."""
    lines = spark.read.text(f"{root}/*/{name}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    day = F.try_to_date(F.regexp_extract("path", r"/(\d{4}-\d\d-\d\d)/[^/]+$", 1))
    parsed = F.when((F.octet_length("value") <= longest) & (F.trim("value") != ""), F.try_parse_json("value"))
    return lines.select(day.alias("day"), F.col("value").alias("line"), parsed.alias("value")).where("day is not null")


def keys(value: Column) -> Column:
    return F.map_keys(F.from_json(F.to_json(value), "map<string, string>"))


def text(value: Column, name: str) -> Column:
    """A string field; null for other types."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def whole(value: Column, name: str) -> Column:
    """An integer field; null for other types, booleans and decimals included."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get(value, f"$.{name}", "bigint"))


def texts(value: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(value, f"$.{name}", "array<string>"))


def same_keys(value: Column, wanted: list[str]) -> Column:
    return F.array_sort(keys(value)) == F.array_sort(F.array(*[F.lit(k) for k in wanted]))


def defanged_domain(value: Column) -> Column:
    """A host in canonical defanged form."""
    bare = F.replace(value, F.lit("[.]"), F.lit("."))
    return (normalize_domain(bare) == bare) & (F.replace(bare, F.lit("."), F.lit("[.]")) == value)


def bounded(value: Column, most: int) -> Column:
    return (F.length(value).between(1, most)) & (F.trim(value) == value) & ~value.rlike(r"\p{Cntrl}")


def _read_once(lines: DataFrame, *fields: Column) -> DataFrame:
    """``day`` and the fields of each line with a value.

    A generator gives them, so they are read once, however often a check names them, and no
    check is moved to where the lines come from.
    """
    read = F.when(F.col("value").isNotNull(), F.array(F.struct(*fields)))
    return lines.select("day", F.explode(read).alias("_read")).select("day", "_read.*")


def candidates(lines: DataFrame, zone: str = "Europe/Vilnius") -> DataFrame:
    """Valid rows of the certificate archive; the others are skipped."""
    v = F.col("value")
    rows = _read_once(
        lines, same_keys(v, CANDIDATE_KEYS).alias("closed"), whole(v, "schemaVersion").alias("version"), text(v, "id").alias("id"), S.canonical_time(text(v, "observedAt")).alias("observedAt"),
        text(v, "indicatorType").alias("kind"), text(v, "domain").alias("shown"), text(v, "registrableDomain").alias("shown_registrable"), text(v, "source").alias("source"), text(v, "brand").alias("brand"),
        whole(v, "confidence").alias("confidence"), texts(v, "reasons").alias("reasons"),
    )
    bare = lambda c: F.replace(F.col(c), F.lit("[.]"), F.lit("."))
    domain, above = bare("shown"), bare("shown_registrable")
    good = (
        F.col("closed") & (F.col("version") == 1) & F.col("observedAt").isNotNull() & (F.col("kind") == "domain") & defanged_domain(F.col("shown")) & defanged_domain(F.col("shown_registrable"))
        & ((domain == above) | F.endswith(domain, F.concat(F.lit("."), above))) & (F.col("id") == S.short_id(domain)) & bounded(F.col("source"), 80) & bounded(F.col("brand"), 120)
        & F.col("confidence").between(0, 100) & F.size("reasons").between(1, 12) & F.forall("reasons", lambda r: bounded(r, 240)) & (S.local_day(F.col("observedAt"), zone) == F.col("day"))
    )
    return rows.where(F.coalesce(good, F.lit(False))).select("day", "id", "observedAt", domain.alias("domain"), above.alias("registrable"), "source", "brand", F.col("confidence").cast("int").alias("confidence"), "reasons")


def _event_columns(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    return lines.select(
        "day", "line", F.coalesce(same_keys(v, EVENT_KEYS), F.lit(False)).alias("closed"), whole(v, "schemaVersion").alias("version"), *[text(v, c).alias(c) for c in ("eventId", "signalId", "eventType", "domain", "brand", "status", "previousStatus")],
        S.canonical_time(text(v, "observedAt")).alias("observedAt"), texts(v, "sources").alias("sources"), whole(v, "confidence").cast("int").alias("confidence"), texts(v, "reasonCodes").alias("reasonCodes"),
    )


def event_valid() -> Column:
    """The contract of an event row, its identifiers included."""
    known = list(S.PRIORITY)
    identity = S.event_id(signal=F.col("signalId"), kind=F.col("eventType"), at=S.shown_time(F.col("observedAt")), sources=F.col("sources"), status=F.col("status"), previous=F.col("previousStatus"))
    kind = ((F.col("eventType") == "observation") & F.col("previousStatus").isNull()) | ((F.col("eventType") == "status-transition") & (F.col("previousStatus").isNull() | (F.col("previousStatus").isin(known) & (F.col("previousStatus") != F.col("status")))))
    return F.coalesce(
        F.col("closed") & (F.col("version") == 1) & F.col("observedAt").isNotNull() & kind & F.col("status").isin(known) & defanged_domain(F.col("domain")) & bounded(F.col("brand"), 120)
        & (F.col("signalId") == S.short_id(F.col("domain"))) & (F.size("sources") > 0) & (F.col("sources") == F.array_sort(F.array_distinct("sources"))) & F.col("confidence").between(0, 100)
        & (F.size("reasonCodes") > 0) & (F.col("reasonCodes") == S.reasons(F.col("reasonCodes"))) & (F.to_date("observedAt") == F.col("day")) & (F.col("eventId") == identity),
        F.lit(False),
    )


def events(lines: DataFrame, per_day: int = 10_000) -> DataFrame:
    """All rows of the event log; any bad row, repeated id or overfull day fails the read."""
    rows = _event_columns(lines).withColumn("valid", event_valid())
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("eventId").alias("ids"), F.count_if(~F.col("valid")).alias("bad"))
    wrong = days.where((F.col("bad") > 0) | (F.col("n") != F.col("ids")) | (F.col("n") > per_day)).orderBy("day").first()
    if wrong:
        raise ValueError(f"event log of {wrong['day']}: {wrong['bad']} invalid rows, {wrong['n']} rows, {wrong['ids']} ids")
    return rows.drop("line", "closed", "version", "valid")


def reports(lines: DataFrame, now: Column, reviewer: Column | None = None, display: Callable[[Column], Column] | None = None) -> DataFrame:
    """Valid rows of the report archive that the reviewer's predicate accepts; the others are skipped."""
    v = F.col("value")
    time = lambda c: S.canonical_time(text(v, c)).alias(c)
    rows = _read_once(
        lines, (F.size(F.array_except(keys(v), F.array(*[F.lit(k) for k in REPORT_KEYS]))) == 0).alias("closed"), whole(v, "schemaVersion").alias("version"), *[text(v, c).alias(c) for c in ("id", "url", "domain", "status", "brand", "country", "host", "screenshotUrl", "referenceUrl", "hashType")],
        time("firstSeen"), time("lastSeen"), *[texts(v, c).alias(c) for c in ("sources", "hashes", "brandEvidence")], whole(v, "confidence").cast("int").alias("confidence"),
    )
    evidence = F.col("brandEvidence")
    good = (
        F.col("closed") & (F.col("version") == 2) & (F.col("status") == "suspected") & defanged_domain(F.col("domain")) & (F.col("id") == S.short_id(F.col("domain"))) & F.startswith(F.col("url"), F.lit("hxxp"))
        & ~F.col("url").rlike("[?#]") & bounded(F.col("brand"), 120) & (F.col("hashes") == S.hashes(F.col("hashes"))) & F.size(evidence).between(1, 4) & (F.array_distinct(evidence) == evidence)
        & F.forall(evidence, lambda e: e.isin(list(S.EVIDENCE))) & F.arrays_overlap(evidence, F.array(F.lit("domain"), F.lit("title"), F.lit("verdict"))) & (F.col("firstSeen") <= F.col("lastSeen"))
        & (F.col("lastSeen") <= now + F.expr("interval 5 minutes")) & (F.col("firstSeen") >= F.date_sub("day", 91)) & F.col("confidence").between(0, 100)
    )
    kept = rows.where(F.coalesce(good, F.lit(False)))
    return (kept if reviewer is None else kept.where(reviewer)).drop("closed", "version")


def recent(rows: DataFrame, today: Column, days: int, most: int, order: list[Column]) -> DataFrame:
    """The last ``days`` days up to today, newest first, ``most`` rows in all; days outside are pruned before."""
    window = rows.where(F.col("day").between(F.date_sub(today, days - 1), today))
    return window.orderBy(F.desc("day"), *order).limit(most)


def append_new(rows: DataFrame, stored: DataFrame, order: Column, keys: tuple[str, ...] = ("day", "id")) -> DataFrame:
    """The first row per key in ``order`` that the archive does not have."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r"))
    return first.select(*keys, "_r.*").join(stored.select(*keys), list(keys), "left_anti").select(rows.columns)


def write_days(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Rows into Parquet folders by ``day``; ``overwrite`` replaces just the days that the rows have."""
    writer = rows.write.partitionBy("day")
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else writer.mode("append")).parquet(root)
