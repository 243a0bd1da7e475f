"""Feeds that were landed as files: text lists, a partner's JSON, a report service's replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions.urls import url_host
from vigilframe.operators.matching import Registry, unique_matches
from vigilframe.operators.seeds import may_match


def text_feed(spark: SparkSession, path: str) -> DataFrame:
    """``indicator`` per line; blank lines and those that begin with ``#`` or ``!`` are comments."""
    line = F.trim(F.regexp_replace("value", "\r$", ""))
    return spark.read.text(path).select(line.alias("indicator")).where("indicator <> '' and indicator not like '#%' and indicator not like '!%'")


def read_each(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, dict[str, int]]:
    """All readable feeds together and counts of feeds configured, completed and failed; one bad feed stops no other."""
    from pyspark.errors import AnalysisException

    rows, counts = None, {"configured": len(paths), "completed": 0, "failed": 0}
    for name, path in paths.items():
        try:
            feed = text_feed(spark, path).withColumn("feed", F.lit(name))
        except AnalysisException:
            counts["failed"] += 1
            continue
        counts["completed"] += 1
        rows = feed if rows is None else rows.unionByName(feed)
    return rows, counts


def seeds(indicators: DataFrame, registry: Registry, least: int = 80, most: int = 250) -> DataFrame:
    """The best matches of a feed's indicators, tested cheaply before they are scored."""
    from vigilframe.operators.seeds import merge_seeds

    hosts = indicators.select(url_host(F.col("indicator")).alias("host")).where("host is not null").distinct()
    found = unique_matches(hosts.where(may_match(registry, F.col("host"))), registry).where(F.col("confidence") >= least)
    return merge_seeds(found, most, unambiguous=False)


def _first(value: str, *names: str) -> Column:
    text = lambda n: F.nullif(F.trim(F.try_variant_get(F.col(value), f"$.{n}", "string")), F.lit(""))
    return F.coalesce(*[text(n) for n in names])


def _number(value: str, *names: str) -> Column:
    def one(n: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.col(value), f"$.{n}", "variant"))
        return F.when(kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(F.col(value), f"$.{n}", "double"))

    return F.coalesce(*[one(n) for n in names])


def partner_rows(spark: SparkSession, path: str, now: Column, source: str = "Partner", most: int = 25_000) -> DataFrame:
    """Raw signals of a partner's export, an array or an object with ``signals``; field names have aliases."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    kind = F.schema_of_variant("doc")
    listed = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.try_variant_get("doc", "$.signals", "array<variant>"))
    rows = whole.select(F.posexplode(F.slice(listed, 1, most)).alias("seq", "v"))
    hashes = F.when(F.try_variant_get("v", "$.hashType", "string") == "primary-html-sha256", F.try_variant_get("v", "$.hashes", "array<string>"))
    return rows.select(
        _first("v", "url", "indicator", "domain").alias("url"), F.lit(source).alias("source"), _first("v", "firstSeen", "first_seen").alias("first_seen"), F.coalesce(_first("v", "lastSeen", "last_seen"), now).alias("last_seen"),
        _first("v", "status").alias("status"), _first("v", "brand", "brandTargeted", "brand_targeted").alias("brand"), _first("v", "country").alias("country"), _first("v", "host", "hosting").alias("host"),
        _first("v", "screenshotUrl", "screenshot_url").alias("screenshot_url"), _first("v", "referenceUrl", "reference_url").alias("reference_url"), hashes.alias("hashes"),
        _number("v", "confidence", "confidenceScore", "confidence_score").alias("confidence"), F.array(F.lit("partner-public-export")).alias("reason_codes"), F.col("seq").cast("long").alias("seq"),
    ).where("url is not null")


def hand_off(signals: DataFrame, allowed: list[str], passive: list[str], budget: int = 20 * 1024 * 1024) -> DataFrame:
    """Signals of allowed sources only that a passive one saw, with the passive ones; the longest prefix within ``budget`` bytes of JSON."""
    from vigilframe.operators.views import within_budget

    lits = lambda names: F.array(*[F.lit(n) for n in names])
    rows = signals.where((F.size(F.array_except("sources", lits(allowed))) == 0) & F.arrays_overlap("sources", lits(passive)))
    rows = rows.withColumn("sources", F.array_sort(F.array_intersect("sources", lits(passive))))
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    return within_budget(rows, size, budget, [F.desc("lastSeen"), F.col("id")])


UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: What a scan's search reply and its detail both tell; where the detail has a key, its value counts.
TOLD_TWICE = {"country": "$.page.country", "asn": "$.page.asn", "asnname": "$.page.asnname", "ip": "$.page.ip", "time": "$.task.time"}


def _item(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(item: Column) -> Column:
    """A variant's text without blanks around it; null if it is no text or blank."""
    return F.when(F.schema_of_variant(item) == "STRING", F.nullif(F.trim(F.try_variant_get(item, "$", "string")), F.lit("")))


def _integer(item: Column) -> Column:
    return F.when(F.schema_of_variant(item) == "BIGINT", F.try_variant_get(item, "$", "bigint"))


def scans(replies: DataFrame) -> DataFrame:
    """Public scans of a search reply table ``(v variant, pos)``: uuid, addresses, title and what ``TOLD_TWICE`` names.

    Columns ``phase`` and ``query``, which say what search a reply answers, stay.
    """
    at = lambda path: _text(_item(F.col("v"), path))
    uuid = F.lower(F.coalesce(at("$._id"), at("$.task.uuid")))
    kept = [c for c in ("phase", "query") if c in replies.columns]
    rows = replies.where(at("$.task.visibility") == "public")
    rows = rows.select(uuid.alias("uuid"), "pos", *kept, at("$.page.url").alias("page_url"), at("$.task.url").alias("task_url"), at("$.page.title").alias("title"), *[at(path).alias(c) for c, path in TOLD_TWICE.items()])
    return rows.where(F.col("uuid").rlike(f"^{UUID}$"))


def _primary_digests(value: Column, page: Column) -> Column:
    """Digests of the main HTML document: its address is the page's, its reply a success of 512 bytes or more."""
    from vigilframe.functions.signals import hashes

    def usable(r: Column) -> Column:
        at = lambda path: _item(r, path)
        address = F.coalesce(_text(at("$.response.response.url")), _text(at("$.request.request.url")))
        kind = F.coalesce(_text(at("$.type")), _text(at("$.request.type")), _text(at("$.request.request.type")))
        code = F.coalesce(_integer(at("$.response.response.status")), _integer(at("$.response.status")), F.lit(0))
        sizes = [F.nullif(_integer(at(f"$.response.{n}")), F.lit(0)) for n in ("response.encodedDataLength", "response.dataLength", "size")]
        html = F.contains(F.lower(_text(at("$.response.response.mimeType"))), F.lit("html"))
        return F.coalesce((address == page) & code.between(200, 299) & html & (F.coalesce(F.lower(kind), F.lit("document")) == "document") & (F.coalesce(*sizes) >= 512), F.lit(False))

    found = F.filter(F.try_variant_get(value, "$.data.requests", "array<variant>"), usable)
    return F.slice(hashes(F.transform(found, lambda r: _text(_item(r, "$.response.hash")))), 1, 2)


def details(replies: DataFrame, service: str) -> DataFrame:
    """Public details of a detail table ``(uuid, v variant)``: page, verdict, primary documents.

    ``service`` is the key of the service's own verdict.  What ``TOLD_TWICE`` names comes
    as ``d_<name> struct<given, text>``; a given key counts even where it holds no text.
    """
    v = F.col("v")
    verdict = lambda path: _item(v, f"$.verdicts.{service}.{path}")
    whole = F.coalesce(_integer(verdict("score")), F.lit(0))
    texts = lambda path: F.transform(F.coalesce(F.try_variant_get(verdict(path), "$", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda x: x)
    phishing = F.exists(texts("categories"), lambda x: F.coalesce(F.lower(_text(x)) == "phishing", F.lit(False)))
    malicious = F.coalesce(F.when(F.schema_of_variant(verdict("malicious")) == "BOOLEAN", F.try_variant_get(verdict("malicious"), "$", "boolean")), F.lit(False))
    page = _text(_item(v, "$.page.url"))
    rows = replies.where(_text(_item(v, "$.task.visibility")) == "public")
    return rows.select(
        F.lower("uuid").alias("uuid"), page.alias("d_page_url"), _text(_item(v, "$.task.url")).alias("d_task_url"), _text(_item(v, "$.page.title")).alias("d_title"),
        (malicious | (whole > 0) | phishing).alias("malicious"), phishing.alias("phishing"), F.greatest(F.lit(-100), F.least(F.lit(100), whole)).cast("int").alias("score"),
        F.array_compact(F.transform(texts("brands"), lambda x: _text(_item(x, "$.name")))).alias("verdict_brands"), _primary_digests(v, page).alias("digests"),
        *[F.struct(_item(v, path).isNotNull().alias("given"), _text(_item(v, path)).alias("text")).alias(f"d_{c}") for c, path in TOLD_TWICE.items()],
    )
