"""Seeds of a hunt: the best confidence per host and brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.hosts import CONTEXT_WORDS, deletions
from vigilframe.operators.matching import Registry


def merge_seeds(rows: DataFrame, most: int = 250, unambiguous: bool = True) -> DataFrame:
    """``(domain, brand, confidence)``: the maximum of each pair; hosts with two brands go if asked; the best ``most``."""
    out = rows.groupBy("domain", "brand").agg(F.max("confidence").alias("confidence"))
    if unambiguous:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("domain"))).where("_n = 1").drop("_n")
    return out.orderBy(F.desc("confidence"), "domain", "brand").limit(most)


def unique_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` where all rows of a key agree."""
    known = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_last"))
    return known.where(F.col(value) == F.col("_last")).drop("_last")


def may_match(registry: Registry, domain: Column) -> Column:
    """A cheap necessary test before scoring: punycode, an alias in the folded host, or a near token.

    It never drops a host that ``matching.score`` would match.
    """
    import re

    aliases = sorted({"".join(p) for e in registry.entries for a in e.aliases if (p := re.split(r"[\s._-]+", a.lower()))}, key=lambda a: (-len(a), a))
    folded = F.regexp_replace(domain, "[^a-z0-9.]", "")
    pattern = "|".join(re.escape(re.sub("[^a-z0-9]", "", a)) for a in aliases)
    near = sorted({re.sub("[^a-z0-9]", "", a.lower()) for e in registry.entries for a in e.fuzzy_aliases})
    test = domain.contains("xn--") | folded.rlike(pattern or "$^") | ~domain.rlike(r"^[\x00-\x7F]*$")
    if near:
        keys = sorted({k for a in near for k in [a, *(a[:i] + a[i + 1 :] for i in range(len(a)))]})
        test = test | F.exists(F.split(domain, r"[.-]"), lambda p: F.arrays_overlap(deletions(p), F.array(*[F.lit(k) for k in keys])))
    return test


def search_terms(registry: Registry, shortest: int = 5, longest: int = 40) -> list[str]:
    """Distinct brand terms for a remote search, sorted."""
    import re

    terms = {re.sub("[^a-z0-9]", "", a.lower()) for e in registry.entries for a in e.aliases}
    return sorted(t for t in terms if shortest <= len(t) <= longest and t not in CONTEXT_WORDS)
