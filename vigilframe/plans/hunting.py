"""The composed hunt: four phases over landed search replies and details.

A phase asks for the details of scans that pass its cheap conditions, in the order of
its replies, until its budget is spent; a scan that an earlier phase asked for is not
asked for again.  What the evidence of a detail says decides afterwards, so it spends
budget all the same.  The digests of strong findings are what the last phase looks for.

The first three phases depend on each other through the fetched ids only, so each is an
anti join with what was fetched; the evidence of all their scans is judged at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.hosts import normalize_domain
from vigilframe.functions.signals import shown_time
from vigilframe.functions.urls import url_host
from vigilframe.operators import hunt, matching, merge
from vigilframe.plans.shared import cut

#: The phases' numbers, which also order their signals.
SEED, DOMAIN, TITLE, PIVOT = range(4)
KINDS = ("seed", "domain", "title", "pivot")


@dataclass(frozen=True)
class Limits:
    """Replies a search gives, details a phase may ask for, and what else bounds a hunt."""

    least_confidence: int = 80
    seed_batch: int = 20
    seed_results: int = 50
    results: int = 100
    pivot_results: int = 10
    seed_details: int = 30
    domain_details: int = 30
    title_details: int = 10
    pivot_details: int = 30
    pivots: int = 3
    signals: int = 500
    title_confidence: int = 92
    pivot_confidence: int = 94


def _known(rows: DataFrame, urls: list[str]) -> DataFrame:
    """``rows`` exploded to ``url, place, host`` for the addresses that have a host; equal addresses count once."""
    listed = F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in urls])))
    spread = rows.select("*", F.posexplode(listed).alias("place", "url")).withColumn("host", url_host(F.col("url")))
    return spread.where("host is not null")


def _best(rows: DataFrame, pick: str, order: list[Column]) -> DataFrame:
    """One row per reply whose candidates name one brand: the greatest by ``order``."""
    held = [c for c in rows.columns if c not in ("phase", "query", "pos", "uuid")]
    found = rows.groupBy("phase", "query", "pos", "uuid").agg(F.max_by(F.struct(*held), F.struct(*order)).alias("r"), F.min("brand").alias("_low"), F.max("brand").alias("_high"))
    return found.where("_low = _high").select("phase", "query", "pos", "uuid", "r.*").drop(pick)


def seed_candidates(scans: DataFrame, seeds: DataFrame, registry: matching.Registry, limits: Limits) -> DataFrame:
    """Replies to the batches of exact hosts: those that hold a seed of their batch, of one brand."""
    numbered = hunt.numbered_batches(seeds.withColumn("_down", -F.col("confidence")), ["_down", "domain", "brand"], limits.seed_batch)
    asked = numbered.select(F.col("batch").cast("string").alias("query"), F.col("domain").alias("host"), "brand", F.col("confidence").alias("base"), "batch")
    found = _known(scans.where((F.col("phase") == "seed") & (F.col("pos") < limits.seed_results)), ["task_url", "page_url"]).join(asked, ["query", "host"])
    best = _best(found, "place", [F.col("base"), F.col("host")])
    kept = matching.drop_below(best, "host", registry.suppressed(scans.sparkSession))
    return kept.withColumn("at", F.col("batch") * (1 << 20) + F.col("pos")).drop("batch", "url")


def domain_candidates(scans: DataFrame, registry: matching.Registry, limits: Limits) -> DataFrame:
    """Replies whose own hosts match one brand well enough; the better match, else the first, is the finding."""
    rows = cut(_known(scans.where((F.col("phase") == "domain") & (F.col("pos") < limits.results)), ["task_url", "page_url"]))
    matches = matching.unique_matches(rows, registry).where(F.col("confidence") >= limits.least_confidence)
    found = rows.join(matches.select("domain", "brand", F.col("confidence").alias("base")), normalize_domain(F.col("host")) == F.col("domain"))
    best = _best(found, "place", [F.col("base"), -F.col("place")])
    # An address whose host is not in normal form is told by its host alone.
    return best.withColumn("matched_url", F.when(F.col("host") == F.col("domain"), F.col("url")).otherwise(F.col("domain"))).withColumn("at", F.col("pos").cast("long")).drop("url", "domain")


def title_candidates(scans: DataFrame, registry: matching.Registry, limits: Limits) -> DataFrame:
    """Replies whose title names one brand, on a host that is not the brand's own."""
    rows = scans.where((F.col("phase") == "title") & (F.col("pos") < limits.results)).withColumn("host", url_host(F.col("page_url"))).where("host is not null")
    named = matching.title_brand(rows, registry).where("title_brand is not null")
    kept = matching.drop_below(named, "host", registry.suppressed(scans.sparkSession))
    return kept.withColumn("brand", F.col("title_brand")).drop("title_brand").withColumns({"base": F.lit(limits.title_confidence), "at": F.col("pos").cast("long")})


def pivot_candidates(scans: DataFrame, wanted: DataFrame, registry: matching.Registry, limits: Limits) -> DataFrame:
    """Replies to the searches for wanted digests, in the order of the digests."""
    rows = scans.where((F.col("phase") == "pivot") & (F.col("pos") < limits.pivot_results)).join(wanted.select(F.col("digest").alias("query"), "brand", "n"), "query")
    rows = rows.withColumn("matched_url", F.coalesce("page_url", "task_url")).withColumn("host", url_host(F.col("matched_url"))).where("host is not null")
    kept = matching.drop_below(rows, "host", registry.suppressed(scans.sparkSession))
    return kept.withColumns({"base": F.lit(limits.pivot_confidence), "at": F.col("n") * (1 << 20) + F.col("pos")}).drop("n")


def _fetched(candidates: DataFrame, details: DataFrame, before: list[DataFrame], budget: int, number: int) -> DataFrame:
    """What a phase asks for, cut so that later phases read it and don't compute it again."""
    done = None
    for some in before:
        done = some.select("uuid") if done is None else done.unionByName(some.select("uuid"))
    ranked = candidates.drop("phase").withColumnRenamed("pos", "_reply").withColumnRenamed("at", "pos")
    return cut(hunt.phase(ranked, details, done, budget).withColumn("phase", F.lit(number)))


def _judged(rows: DataFrame, registry: matching.Registry) -> DataFrame:
    """Fetched scans with their evidence, whether they end on a suppressed host, and their digests."""
    spark = rows.sparkSession
    hosts = _known(rows, ["page_url", "task_url", "d_page_url", "d_task_url"]).select("host").distinct()
    named = rows.select("uuid", F.explode("verdict_brands").alias("title"))
    verdicts = matching.title_brand(named, registry).groupBy("uuid").agg(F.min("title_brand").alias("verdict_brand"), F.max("title_brand").alias("_last"))
    verdicts = verdicts.where("verdict_brand = _last").select("uuid", "verdict_brand")
    titles = matching.title_brand(rows.select(F.coalesce("d_title", "title").alias("title")).where("title is not null").distinct(), registry).withColumnRenamed("title", "_title")
    matches = cut(matching.unique_matches(hosts, registry))
    out = hunt.evidence(rows, matches, titles, verdicts, "brand")
    official = registry.suppressed(spark)
    out = out.withColumns({"_final": url_host(F.coalesce("d_page_url", "d_task_url")), "_page": url_host(F.col("d_page_url"))})
    out = matching.flag_below(matching.flag_below(out, "_final", official, "ends_official"), "_page", official, "_own")
    nothing = F.array().cast("array<string>")
    return out.withColumn("digests", F.when(F.col("_own") | F.col("_page").isNull(), nothing).otherwise(F.coalesce("digests", nothing)))


def _told(name: str) -> Column:
    return F.when(F.col(f"d_{name}.given"), F.col(f"d_{name}.text")).otherwise(F.col(name))


def _signals(judged: DataFrame, now: Column, source: str, root: str) -> DataFrame:
    """Raw signals of judged scans: what the detail tells replaces, key by key, what the reply told."""
    own = F.filter(F.array("d_task_url", "task_url", "d_page_url", "page_url"), lambda u: u.isNotNull() & (url_host(u) == F.col("host")))
    page = F.coalesce("d_page_url", "d_task_url", "page_url", "task_url", "host")
    address = F.when(F.col("phase") == SEED, F.get(own, F.lit(0))).when(F.col("phase") == TITLE, page).otherwise(F.col("matched_url"))
    seen = F.coalesce(_told("time"), shown_time(now))
    rows = judged.withColumns({"pivot": F.col("phase") == PIVOT, "url": address})
    labels = F.when(F.col("pivot"), hunt.evidence_labels(True)).otherwise(hunt.evidence_labels())
    return rows.where("url is not null").select(
        F.col("phase").cast("int").alias("phase"),
        "uuid",
        F.col("host").alias("matched_host"),
        "url",
        F.lit(source).alias("source"),
        seen.alias("first_seen"),
        seen.alias("last_seen"),
        F.lit("suspected").alias("status"),
        "brand",
        _told("country").alias("country"),
        F.nullif(F.concat_ws(" · ", _told("asn"), _told("asnname"), _told("ip")), F.lit("")).alias("host"),
        F.concat(F.lit(f"{root}/screenshots/"), "uuid", F.lit(".png")).alias("screenshot_url"),
        F.concat(F.lit(f"{root}/result/"), "uuid", F.lit("/")).alias("reference_url"),
        F.col("digests").alias("hashes"),
        hunt.boosted(F.col("base")).cast("double").alias("confidence"),
        F.array().cast("array<string>").alias("reason_codes"),
        labels.alias("brand_evidence"),
        (F.col("phase").cast("long") * (1 << 50) + F.col("pos")).alias("seq"),
    )


def _passed(judged: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    out = None
    for k in kinds:
        some = hunt.gate(judged.where(F.col("phase") == k), KINDS[k])
        out = some if out is None else out.unionByName(some)
    return out


def raw_signals(replies: DataFrame, details: DataFrame, seeds: DataFrame, registry: matching.Registry, now: Column, source: str, root: str, limits: Limits = Limits()) -> DataFrame:
    """Raw signals of all phases, in their order (``seq``), before they are normalised and merged.

    ``replies`` is what ``feeds.scans`` gave, with ``phase`` (seed, domain, title, pivot)
    and ``query``: the number of the batch of seeds, or the digest.  ``details`` is what
    ``feeds.details`` gave; ``seeds(domain, brand, confidence)`` what ``seeds.merge_seeds`` gave.
    """
    scans = replies.withColumn("query", F.coalesce("query", F.lit("")))
    details = details.dropDuplicates(["uuid"])
    first = _fetched(seed_candidates(scans, seeds, registry, limits), details, [], limits.seed_details, SEED)
    second = _fetched(domain_candidates(scans, registry, limits), details, [first], limits.domain_details, DOMAIN)
    third = _fetched(title_candidates(scans, registry, limits), details, [first, second], limits.title_details, TITLE)
    before = [first, second, third]
    fetched = first.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)
    judged = _judged(fetched, registry).where("not ends_official")
    found = cut(_signals(_passed(judged, (SEED, DOMAIN, TITLE)), now, source, root))
    strong = found.where(F.arrays_overlap("brand_evidence", F.array(F.lit("title"), F.lit("verdict")))).select("brand", F.col("seq").alias("pos"), "hashes", F.col("brand_evidence").alias("brandEvidence"))
    wanted = hunt.pivots(strong, limits.pivots)
    last = _fetched(pivot_candidates(scans, wanted, registry, limits), details, before, limits.pivot_details, PIVOT)
    pivoted = _judged(last, registry).where(F.array_contains("digests", F.col("query")))
    return found.unionByName(_signals(_passed(pivoted, (PIVOT,)), now, source, root))


def published(raw: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """Raw signals of a hunt in published form, one row per host."""
    return merge.merge(merge.prepare(raw, now, F.col("screenshot_url"), F.col("reference_url")), limits.signals)


def hunt_reports(replies: DataFrame, details: DataFrame, seeds: DataFrame, registry: matching.Registry, now: Column, source: str, root: str, limits: Limits = Limits()) -> DataFrame:
    """The hunt's findings in published form."""
    return published(raw_signals(replies, details, seeds, registry, now, source, root, limits), now, limits)
