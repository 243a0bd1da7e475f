"""The reviewers' published decisions: one document, read whole or not at all.

The document is checked inside the plan: its size, its keys, the number and identity of
its decisions, and each decision against the registry as it is now.  One broken rule
raises.  A document that does not exist is a policy without decisions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.functions.hosts import ancestors, normalize_domain
from vigilframe.functions.text import defang_host, refang
from vigilframe.functions.urls import safe_url
from vigilframe.operators import matching, review
from vigilframe.plans.shared import cut
from vigilframe.sources.archives import same_keys, text, texts, whole

MOST_BYTES, MOST_ROWS = 2 * 1024 * 1024, 2_500
DATASET = "review-decisions"
#: The keys of the document and of its decisions, and why a host may be suppressed.
DOCUMENT_KEYS = "schemaVersion dataset generatedAt suppressions candidates".split()
SUPPRESSION_KEYS = "id domain scope brand reasonCode".split()
CANDIDATE_KEYS = "id signalId url domain observedAt brand confidence reasonCodes".split()
REASONS = "legitimate-domain lexical-collision official-domain wrong-brand insufficient-evidence reviewed-exclusion".split()
SUPPRESSION = "id string, domain string, scope string, brand string, reasonCode string"
CANDIDATE = "id string, signalId string, url string, domain string, observedAt timestamp, brand string, confidence int, reasonCodes array<string>"


@dataclass(frozen=True)
class Policy:
    suppressions: DataFrame
    candidates: DataFrame

    def manual_signals(self, source: str) -> DataFrame:
        """The candidates that no suppression covers, as raw signals."""
        rows = review.drop_suppressed(self.candidates, self.rules())
        seen = S.shown_time(F.col("observedAt"))
        nothing = F.lit(None).cast("string")
        return rows.select(
            refang(F.col("url")).alias("url"), F.lit(source).alias("source"), seen.alias("first_seen"), seen.alias("last_seen"), F.lit("suspected").alias("status"), "brand", nothing.alias("country"), nothing.alias("host"),
            F.array().cast("array<string>").alias("hashes"), F.col("confidence").cast("double").alias("confidence"), F.col("reasonCodes").alias("reason_codes"), F.crc32("id").alias("seq"),
        )

    def rules(self) -> DataFrame:
        """The suppressions as ``review.drop_suppressed`` takes them, of plain hosts."""
        return self.suppressions.withColumn("domain", refang(F.col("domain")))


def decision_id(fields: dict[str, Column]) -> Column:
    """A decision's identity: a digest of its other fields as JSON, keys in order and nulls written."""
    return S.short_id(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 24)


def _evidenced(rows: DataFrame, registry: matching.Registry) -> DataFrame:
    """``rows`` of plain ``_host`` with ``_brands``, all that the host matches or is official for, and its one match."""
    spark = rows.sparkSession
    owners = spark.createDataFrame([(d, e.brand) for e in registry.entries for d in e.official_domains], "name string, brand string")
    above = rows.select("_host").where("_host is not null").distinct().withColumn("name", F.explode(ancestors(F.col("_host")))).join(owners, "name").select("_host", "brand")
    matches = cut(matching.score(rows.where("_host is not null"), registry, "_host"))
    all_ = above.unionByName(matches.select(F.col("domain").alias("_host"), "brand")).groupBy("_host").agg(F.collect_set("brand").alias("_brands"))
    one = matches.where("brands = 1").select(F.col("domain").alias("_host"), F.col("brand").alias("_match"), F.col("confidence").alias("_most"))
    return rows.join(all_, "_host", "left").join(one, "_host", "left").withColumn("_brands", F.coalesce("_brands", F.array().cast("array<string>")))


def checked_suppressions(rows: DataFrame, registry: matching.Registry) -> DataFrame:
    """``rows(v variant)`` as ``SUPPRESSION`` with ``valid``."""
    v = F.col("v")
    read = rows.select(same_keys(v, SUPPRESSION_KEYS).alias("_closed"), *[text(v, k).alias(k) for k in SUPPRESSION_KEYS], F.schema_of_variant(F.try_variant_get(v, "$.brand", "variant")).alias("_kind"))
    read = matching.declared_brand(cut(read.withColumn("_host", normalize_domain(refang(F.col("domain"))))), registry, "brand")
    held = _evidenced(read, registry)
    identity = decision_id({k: F.col(k) for k in SUPPRESSION_KEYS if k != "id"})
    brand = (F.col("_kind") == "VOID") | ((F.col("brand") == F.col("canonical_brand")) & ((F.size("_brands") == 0) | F.array_contains("_brands", F.col("brand"))))
    good = F.col("_closed") & (F.col("domain") == defang_host(F.col("_host"))) & F.col("scope").isin("exact", "subdomains") & brand & (F.size("_brands") <= 1) & F.col("reasonCode").isin(REASONS) & (F.col("id") == identity)
    return held.select(*SUPPRESSION_KEYS, F.coalesce(good, F.lit(False)).alias("valid"))


def checked_candidates(rows: DataFrame, registry: matching.Registry, now: Column) -> DataFrame:
    """``rows(v variant)`` as ``CANDIDATE`` with ``valid``."""
    v = F.col("v")
    names = ("id", "signalId", "url", "domain", "brand")
    read = rows.select(same_keys(v, CANDIDATE_KEYS).alias("_closed"), *[text(v, k).alias(k) for k in names], text(v, "observedAt").alias("_seen"), whole(v, "confidence").alias("confidence"), texts(v, "reasonCodes").alias("reasonCodes"))
    # Exploded, so that the address is taken apart once.
    read = cut(read.select("*", F.explode(F.array(safe_url(refang(F.col("url"))))).alias("_safe")).withColumn("_host", normalize_domain(refang(F.col("domain")))))
    held = _evidenced(read, registry).withColumn("observedAt", S.canonical_time(F.col("_seen")))
    identity = decision_id({k: F.col("_seen" if k == "observedAt" else k) for k in CANDIDATE_KEYS if k != "id"})
    good = (
        F.col("_closed") & (F.col("_safe.display_url") == F.col("url")) & (F.col("_safe.display_domain") == F.col("domain")) & (F.col("signalId") == S.short_id(F.lower("domain")))
        & (F.col("observedAt") <= now + F.expr("interval 5 minutes")) & (F.col("brand") == F.col("_match")) & F.col("confidence").between(0, F.col("_most"))
        & F.array_contains("reasonCodes", "manual-review") & (F.col("reasonCodes") == S.reasons(F.col("reasonCodes"))) & (F.col("id") == identity)
    )
    return held.select(*[F.col(k).cast("int") if k == "confidence" else F.col(k) for k in CANDIDATE_KEYS], F.coalesce(good, F.lit(False)).alias("valid"))


def exported(state: DataFrame, registry: matching.Registry, now: Column) -> Policy:
    """The decisions in force (``review.state``) as they are published: without notes, and each fit to be read again.

    Suppressions that the registry contradicts are an error.  Additions go unless the host
    itself matches their brand at their confidence or more, and no suppression covers them.
    """
    plain = state.withColumn("_host", normalize_domain(F.col("domain")))
    shown = defang_host(F.col("_host"))
    fields = {"domain": shown, "scope": F.coalesce("scope", F.lit("exact")), "brand": F.col("brand"), "reasonCode": F.coalesce("reason_code", F.lit("reviewed-exclusion"))}
    negative = cut(plain.where("family in ('suppression', 'allow')").select(decision_id(fields).alias("id"), *[v.alias(k) for k, v in fields.items()]).dropDuplicates(["id"]))
    read_again = negative.select(F.parse_json(F.to_json(F.struct(*SUPPRESSION_KEYS), {"ignoreNullFields": "false"})).alias("v"))
    checked = checked_suppressions(read_again, registry).agg(F.count_if(~F.col("valid")).alias("bad"), F.count("*").alias("n"))
    _asserted(checked, F.col("bad") == 0, "a suppression conflicts with the evidence for its host's brand")
    _asserted(checked, F.col("n") <= MOST_ROWS, "too many suppressions")
    added = cut(plain.where("family = 'addition'").select("_host", F.col("brand").alias("_brand"), "url", "confidence", F.col("recorded_at").alias("observedAt")))
    one = matching.unique_matches(added, registry, "_host").select(F.col("domain").alias("_d"), F.col("brand").alias("brand"), F.col("confidence").alias("_most"), "reasons")
    held = added.join(one, F.col("_host") == F.col("_d")).where("_brand = brand and confidence <= _most").select("*", F.explode(F.array(safe_url(F.col("url")))).alias("_safe")).where("_safe.key is not null")
    codes = S.reasons(F.concat(F.array(F.lit("manual-review")), matching.match_reasons(F.col("reasons"))))
    fields = {"signalId": S.short_id(F.lower("_safe.display_domain")), "url": F.col("_safe.display_url"), "domain": F.col("_safe.display_domain"), "observedAt": F.col("observedAt"), "brand": F.col("brand"), "confidence": F.col("confidence").cast("int"), "reasonCodes": codes}
    listed = held.select(*[v.alias(k) for k, v in fields.items()])
    identity = {k: S.shown_time(F.col(k)) if k == "observedAt" else F.col(k) for k in fields}
    candidates = cut(review.drop_suppressed(listed.select(decision_id(identity).alias("id"), *fields).dropDuplicates(["id"]), negative.withColumn("domain", refang(F.col("domain")))))
    _asserted(candidates.agg(F.count("*").alias("n")), F.col("n") <= MOST_ROWS, "too many additions")
    return Policy(negative, candidates)


def as_document(policy: Policy, generated: str, dataset: str = DATASET) -> DataFrame:
    """One row with the document's text, named ``dataset``; both lists in order, their lengths bounded by contract."""
    order = {"suppressions": ("domain", "scope", "id"), "candidates": ("domain", "id")}
    rows = {"suppressions": policy.suppressions, "candidates": policy.candidates.withColumn("observedAt", S.shown_time(F.col("observedAt")))}
    keys = {"suppressions": SUPPRESSION_KEYS, "candidates": CANDIDATE_KEYS}
    listed = [r.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order[k]).alias("o"), F.struct(*keys[k]).alias("v")))), lambda x: x["v"]).alias(k)) for k, r in rows.items()]
    body = F.struct(F.lit(1).alias("schemaVersion"), F.lit(dataset).alias("dataset"), F.lit(generated).alias("generatedAt"), "suppressions", "candidates")
    # One row with one row.
    return listed[0].join(listed[1]).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def _asserted(counts: DataFrame, good: Column, what: str) -> None:
    """Raises, from within the plan, unless the one row of ``counts`` is good."""
    counts.select(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit(what)))).first()


def read_decisions(spark: SparkSession, path: str, registry: matching.Registry, now: Column, dataset: str = DATASET) -> Policy:
    """The decisions of the document at ``path``; raises if it breaks any rule."""
    try:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_size").alias("size"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return Policy(spark.createDataFrame([], SUPPRESSION), spark.createDataFrame([], CANDIDATE))
    sized = files.agg(F.count("*").alias("n"), F.max("size").alias("size"))
    _asserted(sized, (F.col("n") == 1) & (F.col("size") <= MOST_BYTES), "the review document exceeds 2 MiB")
    doc = cut(files.select(F.try_parse_json("value").alias("v")))
    v = F.col("v")
    listed = lambda k: F.try_variant_get(v, f"$.{k}", "array<variant>")
    shape = same_keys(v, DOCUMENT_KEYS) & (whole(v, "schemaVersion") == 1) & (text(v, "dataset") == dataset) & S.canonical_time(text(v, "generatedAt")).isNotNull()
    for k in ("suppressions", "candidates"):
        shape = shape & listed(k).isNotNull() & (F.size(listed(k)) <= MOST_ROWS)
    _asserted(doc, shape, "the review document does not match its schema")
    found = []
    for k, checked in (("suppressions", lambda rows: checked_suppressions(rows, registry)), ("candidates", lambda rows: checked_candidates(rows, registry, now))):
        rows = cut(checked(doc.select(F.explode(listed(k)).alias("v"))))
        counts = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad"), F.count_distinct("id").alias("ids"))
        _asserted(counts, F.col("bad") == 0, f"the review document has invalid {k}")
        _asserted(counts, F.col("n") == F.col("ids"), f"the review document has repeated {k}")
        found.append(rows.drop("valid"))
    return Policy(*found)
