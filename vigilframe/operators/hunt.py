"""Hunting reports in four phases over landed search and detail tables.

A phase ranks the scans that pass its cheap predicates and were not fetched by an
earlier phase, takes its budget of details, and only then applies evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.hosts import normalize_domain
from vigilframe.functions.urls import url_host
from vigilframe.plans.shared import ranged


def evidence(scans: DataFrame, matches: DataFrame, titles: DataFrame, verdicts: DataFrame, brand: str = "wanted") -> DataFrame:
    """``scans`` with what speaks for the wanted brand: ``by_domain, by_title, by_verdict, conflicting``.

    ``matches(domain, brand, brands)`` from ``matching.score``, ``titles(title,
    title_brand)``, ``verdicts(uuid, verdict_brand)``.
    """
    hosts = F.array_distinct(F.array_compact(F.array(*[url_host(F.col(c)) for c in ("page_url", "task_url", "d_page_url", "d_task_url")])))
    seen = scans.select("uuid", brand, F.explode(hosts).alias("_seen")).join(matches.select("domain", F.col("brand").alias("_host_brand")), normalize_domain(F.col("_seen")) == F.col("domain"))
    by_host = seen.groupBy("uuid", brand).agg(F.collect_set("_host_brand").alias("host_brands"))
    out = scans.join(by_host, ["uuid", brand], "left").join(titles, F.coalesce("d_title", "title") == F.col("_title"), "left").join(verdicts, "uuid", "left")
    all_brands = F.array_compact(F.array_union(F.coalesce("host_brands", F.array().cast("array<string>")), F.array("title_brand", "verdict_brand")))
    return out.withColumns(
        {
            "by_domain": F.coalesce(F.array_contains("host_brands", F.col(brand)), F.lit(False)),
            "by_title": F.coalesce(F.col("title_brand") == F.col(brand), F.lit(False)),
            "by_verdict": F.coalesce(F.col("verdict_brand") == F.col(brand), F.lit(False)),
            "conflicting": F.size(F.array_remove(all_brands, F.col(brand))) > 0,
        }
    )


def boosted(base: Column) -> Column:
    """A base confidence, raised by the service's verdict."""
    score = F.greatest(F.lit(0), F.col("score"))
    strong = F.greatest(base, F.least(F.lit(99), F.lit(95) + F.floor(score / 25)))
    return F.when(F.col("phishing"), strong).when(F.col("malicious"), F.greatest(base, F.least(F.lit(90), 80 + score))).otherwise(base).cast("int")


def phase(ranked: DataFrame, details: DataFrame, fetched: DataFrame | None, budget: int) -> DataFrame:
    """The first ``budget`` scans in the order of ``pos`` that have a public detail and were not fetched before."""
    rows = ranked if fetched is None else ranked.join(fetched.select("uuid"), "uuid", "left_anti")
    once = rows.groupBy("uuid").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "uuid"]), "pos").alias("_r")).select("uuid", "_r.*")
    return once.join(details, "uuid").orderBy("pos", "uuid").limit(budget)


def gate(rows: DataFrame, kind: str) -> DataFrame:
    """The evidence that a kind of phase asks for: ``seed``, ``domain``, ``title`` or ``pivot``."""
    some = F.col("by_domain") | F.col("by_title") | F.col("by_verdict")
    need = {"seed": some, "domain": F.col("by_domain"), "title": F.col("by_title") & (F.col("by_verdict") | F.col("phishing")), "pivot": some}[kind]
    return rows.where(~F.col("conflicting") & need)


def evidence_labels(pivot: bool = False) -> Column:
    label = lambda c, name: F.when(F.col(c), name)
    extra = [F.lit("primary-html-sha256")] if pivot else []
    return F.array_compact(F.array(label("by_domain", "domain"), label("by_title", "title"), label("by_verdict", "verdict"), *extra))


def pivots(signals: DataFrame, most: int = 3) -> DataFrame:
    """``(brand, digest, n)``: the first distinct digests of signals with title or verdict evidence, numbered in the order of ``pos``."""
    strong = signals.where(F.arrays_overlap("brandEvidence", F.array(F.lit("title"), F.lit("verdict"))))
    each = strong.select("brand", "pos", F.posexplode("hashes").alias("i", "digest"))
    return each.groupBy("brand", "digest").agg(F.min(F.struct("pos", "i")).alias("first")).orderBy("first", "brand", "digest").limit(most).withColumn("n", F.row_number().over(Window.orderBy("first", "brand", "digest"))).drop("first")


def pivot_candidates(wanted: DataFrame, documents: DataFrame, per_pivot: int = 10) -> DataFrame:
    """Scans that served a wanted digest, ``per_pivot`` of each: an equality join on the digest."""
    met = documents.select("uuid", "pos", F.explode("digests").alias("digest")).join(wanted, "digest")
    place = F.row_number().over(Window.partitionBy("brand", "digest").orderBy("pos", "uuid"))
    return met.withColumn("_n", place).where(F.col("_n") <= per_pivot).drop("_n")


def numbered_batches(rows: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """Rows numbered by the batch of ``size`` they fall in, in an order: ranks within ranges plus the ranges' counts."""
    held = ranged(rows, *order)
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return held.join(before, "_range").withColumn("batch", F.floor(rank / size)).drop("_range", "_before")


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def public_query(clause: str, days: int) -> str:
    """A remote search for public scans of the last days."""
    return f"task.visibility:public AND date:>now-{days}d AND ({clause})"


def domain_query(terms: list[str], official: list[str], days: int) -> str:
    """Scans of hosts that hold a term and are not official."""
    some = " OR ".join(f"page.domain:*{t}*" for t in terms)
    return public_query(f"({some}) AND NOT ({' OR '.join(f'page.domain:{d}' for d in official)})" if official else some, days)


def title_query(titles: list[str], days: int) -> str:
    return public_query(" OR ".join(f"page.title:{_quoted(t)}" for t in titles), days)


def host_query(hosts: list[str], days: int) -> str:
    """Scans of exact hosts, a batch of seeds at a time."""
    return public_query(" OR ".join(f"{field}:{_quoted(h)}" for h in hosts for field in ("page.domain", "task.domain")), days)
