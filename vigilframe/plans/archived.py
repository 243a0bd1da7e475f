"""Raw signals from the library's own archives, checked again under the registry as it is now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.functions.hosts import normalize_domain
from vigilframe.functions.text import refang
from vigilframe.operators import matching, merge
from vigilframe.plans.shared import cut
from vigilframe.sources import archives


def _order(day: Column, key: Column) -> Column:
    """A row's place among a source's: newer days first, then by a checksum of its key."""
    return F.date_diff(F.lit("9999-12-31").cast("date"), day).cast("long") * (1 << 32) + F.crc32(key)


def candidate_signals(candidates: DataFrame, registry: matching.Registry, source: str) -> DataFrame:
    """Raw signals of ``archives.candidates``: hosts that still match one brand, with the brand, confidence and reasons of now."""
    rows = cut(candidates.select("day", "id", "observedAt", "domain"))
    found = matching.unique_matches(rows, registry, "domain").withColumnRenamed("domain", "_match")
    seen = S.shown_time(F.col("observedAt"))
    nothing = F.lit(None).cast("string")
    return rows.join(found, normalize_domain(F.col("domain")) == F.col("_match")).select(
        F.col("_match").alias("url"), seen.alias("first_seen"), seen.alias("last_seen"), F.lit(source).alias("source"), F.lit("suspected").alias("status"), "brand", nothing.alias("country"), nothing.alias("host"),
        F.array().cast("array<string>").alias("hashes"), F.col("confidence").cast("double").alias("confidence"), matching.match_reasons(F.col("reasons")).alias("reason_codes"), _order(F.col("day"), F.col("id")).alias("seq"),
    )


def reviewed_reports(reports: DataFrame, registry: matching.Registry) -> DataFrame:
    """Report rows that the registry of now still supports.

    The brand must be the registry's and the host neither suppressed nor reviewed as a
    collision.  A host that matches one brand itself must match this one; any other needs
    evidence from the title or a verdict.
    """
    spark = reports.sparkSession
    rows = cut(matching.declared_brand(reports.withColumn("_host", normalize_domain(refang(F.col("domain")))), registry, "brand").where("_host is not null and canonical_brand is not null"))
    kept = matching.drop_below(rows, "_host", registry.suppressed(spark))
    kept = matching.drop_collisions(kept, registry, "_host", "canonical_brand")
    own = matching.unique_matches(rows, registry, "_host").select(F.col("domain").alias("_d"), F.col("brand").alias("_own"))
    other = F.arrays_overlap("brandEvidence", F.array(F.lit("title"), F.lit("verdict")))
    held = kept.join(own, F.col("_host") == F.col("_d"), "left").where((F.col("_own").isNotNull() & (F.col("_own") == F.col("canonical_brand"))) | (F.col("_own").isNull() & other))
    return held.select(reports.columns)


def report_signals(reports: DataFrame, source: str) -> DataFrame:
    """Raw signals of ``archives.reports``: their evidence becomes reason codes."""
    return reports.select(
        refang(F.col("url")).alias("url"), S.shown_time(F.col("firstSeen")).alias("first_seen"), S.shown_time(F.col("lastSeen")).alias("last_seen"), F.lit(source).alias("source"), "status", "brand", "country", "host",
        F.col("screenshotUrl").alias("screenshot_url"), F.col("referenceUrl").alias("reference_url"), "hashes", F.col("confidence").cast("double").alias("confidence"),
        S.evidence_reasons(F.col("brandEvidence")).alias("reason_codes"), _order(F.col("day"), F.col("id")).alias("seq"),
    )


def recent_reports(reports: DataFrame, registry: matching.Registry, today: Column, days: int, most: int = 2_500) -> DataFrame:
    """The reports of the last days that the registry of now supports, ``most`` of the newest, merged per host."""
    window = archives.recent(reviewed_reports(reports, registry), today, days, most, [F.col("id")])
    rows = window.withColumn("seq", _order(F.col("day"), F.col("id")))
    lists = {"reasonCodes": F.array().cast("array<string>")} if "reasonCodes" not in rows.columns else {}
    return merge.merge(rows.withColumns(lists) if lists else rows, most)
