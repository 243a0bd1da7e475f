"""The reviewers' ledger: replay, suppressions and additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.hosts import ancestors, normalize_domain
from vigilframe.functions.signals import short_id

#: The ledger's actions, the family of each, and whether it sets or lifts.
ACTIONS = {
    "false-positive": ("suppression", True),
    "restore": ("suppression", False),
    "allowlist": ("allow", True),
    "unallowlist": ("allow", False),
    "add": ("addition", True),
    "remove": ("addition", False),
}


def state(ledger: DataFrame) -> DataFrame:
    """Decisions in force: the last action per domain and family, if it sets one."""
    family = F.coalesce(*[F.when(F.col("action") == a, f) for a, (f, _) in ACTIONS.items()])
    last = ledger.withColumn("family", family).where("family is not null").groupBy("domain", "family").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "domain"]), "sequence").alias("e"))
    return last.select("domain", "family", "e.*").where(F.col("action").isin([a for a, (_, sets) in ACTIONS.items() if sets]))


def decision_id(kind: Column, domain: Column, brand: Column) -> Column:
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    return short_id(F.concat(F.lit('{"brand":'), quoted(brand), F.lit(',"domain":'), quoted(domain), F.lit(',"type":'), quoted(kind), F.lit("}")), 24)


def public_export(decisions: DataFrame, most: int = 2_500) -> tuple[DataFrame, DataFrame]:
    """``(suppressions, candidates)`` without notes; more than ``most`` of either is an error."""
    from vigilframe.sources.archives import at_most

    negative = decisions.where("family in ('suppression', 'allow')").select(decision_id(F.col("family"), F.col("domain"), F.col("brand")).alias("id"), "domain", "scope", "brand", F.col("reason_code").alias("reasonCode")).dropDuplicates(["id"])
    added = decisions.where("family = 'addition'").select(decision_id(F.lit("candidate"), F.col("domain"), F.col("brand")).alias("id"), "domain", "url", "brand", "confidence").dropDuplicates(["id"])
    return at_most(negative, most).orderBy("domain", "scope", "id"), at_most(added, most).orderBy("domain", "id")


def drop_suppressed(rows: DataFrame, suppressions: DataFrame, host: str = "domain", brand: str = "brand") -> DataFrame:
    """Rows that no suppression covers: its exact host, or any below it in scope ``subdomains``; its brand or any.

    Hosts that are not valid are suppressed.
    """
    named = rows.withColumn("_host", normalize_domain(F.replace(F.col(host), F.lit("[.]"), F.lit(".")))).where("_host is not null")
    spread = named.select("_host", F.col(brand).alias("_brand")).distinct().withColumn("_name", F.explode(ancestors(F.col("_host"))))
    rule = suppressions.select(F.col("domain").alias("_name"), F.col("scope").alias("_scope"), F.col("brand").alias("_rule_brand"))
    covers = ((F.col("_scope") == "subdomains") | (F.col("_name") == F.col("_host"))) & (F.col("_rule_brand").isNull() | F.col("_rule_brand").eqNullSafe(F.col("_brand")))
    gone = spread.join(rule, "_name").where(covers).select(F.col("_host").alias("_g"), F.col("_brand").alias("_gb")).distinct()
    return named.join(gone, (F.col("_host") == F.col("_g")) & F.col(brand).eqNullSafe(F.col("_gb")), "left_anti").select(rows.columns)


def additions(candidates: DataFrame, seq: Column) -> DataFrame:
    """Reviewers' additions as raw signals."""
    nothing = F.lit(None).cast("string")
    time = F.col("recorded_at") if "recorded_at" in candidates.columns else nothing
    return candidates.select(
        F.col("url"), F.lit("Manual review").alias("source"), time.alias("first_seen"), time.alias("last_seen"), F.lit("suspected").alias("status"), "brand", nothing.alias("country"), nothing.alias("host"),
        F.array().cast("array<string>").alias("hashes"), F.col("confidence").cast("double").alias("confidence"), F.array(F.lit("manual-review")).alias("reason_codes"), seq.alias("seq"),
    )


def valid_suppressions(rows: DataFrame, matches: DataFrame, registry) -> DataFrame:
    """Suppressions of valid hosts whose brand is evidenced: matched by the host, or official there; one at most."""
    spark = rows.sparkSession
    owners = spark.createDataFrame([(d, e.brand) for e in registry.entries for d in e.official_domains], "name string, owner string")
    named = rows.withColumn("_host", normalize_domain(F.col("domain"))).where(F.col("_host") == F.col("domain"))
    above = named.select("_host").distinct().withColumn("name", F.explode(ancestors(F.col("_host")))).join(owners, "name").select("_host", F.col("owner").alias("_brand"))
    evidence = above.unionByName(matches.select(F.col("domain").alias("_host"), F.col("brand").alias("_brand"))).groupBy("_host").agg(F.collect_set("_brand").alias("_brands"))
    held = named.join(evidence, "_host", "left").withColumn("_brands", F.coalesce("_brands", F.array().cast("array<string>")))
    good = (F.size("_brands") <= 1) & (F.col("brand").isNull() | F.array_contains("_brands", F.col("brand"))) & F.col("scope").isin("exact", "subdomains")
    return held.where(good).select(rows.columns)


def valid_additions(rows: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """Additions whose brand is the host's own, at no more than the host's confidence and not of the future."""
    one = matches.where("brands = 1").select(F.col("domain").alias("_d"), F.col("brand").alias("_b"), F.col("confidence").alias("_c"))
    held = rows.withColumn("_host", normalize_domain(F.col("domain"))).join(one, F.col("_host") == F.col("_d"))
    good = (F.col("brand") == F.col("_b")) & F.col("confidence").between(0, F.col("_c")) & (F.coalesce(F.col("recorded_at").cast("timestamp") <= now + F.expr("interval 5 minutes"), F.lit(True)) if "recorded_at" in rows.columns else F.lit(True))
    return held.where(good).select(rows.columns)
