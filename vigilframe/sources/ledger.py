"""The reviewers' ledger: a table that is only ever appended to.

Entries come in batches.  A batch is checked as a whole, numbered on from the ledger's
last entry, written to a folder of its own and renamed to the next number; a rename to a
number that exists fails, so two writers never give one sequence number twice, and no
entry is ever changed or removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.functions.hosts import normalize_domain
from vigilframe.functions.text import clean_text, refang
from vigilframe.functions.urls import safe_url
from vigilframe.operators import matching
from vigilframe.operators.review import ACTIONS
from vigilframe.operators.seeds import unique_value
from vigilframe.plans.shared import cut, ranged
from vigilframe.sources.publication import Conflict, _files

MOST_NOTE = 2_000
ENTRY = "sequence bigint, event_id string, recorded_at timestamp, action string, domain string, url string, brand string, scope string, reason_code string, confidence int, note string"


def indicators(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``domain`` and ``url`` of the indicator in a column; both null where it is no address."""
    safe = rows.select("*", F.explode(F.array(safe_url(F.col(column)))).alias("_safe"))
    return safe.withColumns({"domain": normalize_domain(refang(F.col("_safe.display_domain"))), "url": refang(F.col("_safe.display_url"))}).drop("_safe")


def entry_valid() -> Column:
    """The contract of an entry."""
    good = (
        F.col("action").isin(list(ACTIONS)) & (normalize_domain(F.col("domain")) == F.col("domain")) & F.col("recorded_at").isNotNull() & (F.col("scope").isNull() | F.col("scope").isin("exact", "subdomains"))
        & (F.col("confidence").isNull() | F.col("confidence").between(0, 100))
    )
    return F.coalesce(good, F.lit(False))


def _batches(spark: SparkSession, root: str) -> list[int]:
    path, fs = _files(spark, root)
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path(root)) if s.getPath().getName().isdigit()) if fs.exists(path(root)) else []


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """All entries; none of a ledger that does not exist.  An entry that breaks its contract raises when it is read."""
    if not (numbers := _batches(spark, root)):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).parquet(*[f"{root}/{n:012}" for n in numbers])
    return rows.where(F.when(entry_valid(), True).otherwise(F.raise_error(F.lit("the ledger holds an invalid entry"))))


def record(requests: DataFrame, root: str, order: str = "n") -> int:
    """Appends ``requests``, numbered in the order of a column; gives how many there were.

    Columns as in ``ENTRY`` but ``sequence`` and ``event_id``.  One invalid request stops all of them.
    """
    spark = requests.sparkSession
    columns = [c.split(" ")[0] for c in ENTRY.split(", ")][2:]
    rows = cut(requests.select(F.col(order).alias("_order"), *columns).withColumns({"domain": normalize_domain(refang(F.col("domain"))), "note": clean_text(F.col("note"), MOST_NOTE)}))
    if not rows.where(~entry_valid()).isEmpty():
        raise ValueError("a review action has an invalid domain, time, scope, confidence or kind")
    numbers = _batches(spark, root)
    last = spark.read.schema(ENTRY).parquet(f"{root}/{numbers[-1]:012}").agg(F.max("sequence")).first()[0] if numbers else 0
    held = ranged(rows, "_order")
    # As many rows as there are ranges.
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    sequence = F.row_number().over(Window.partitionBy("_range").orderBy("_order")) + F.col("_before") + F.lit(last or 0)
    told = held.join(before, "_range").withColumn("sequence", sequence.cast("long"))
    identity = F.sha2(F.to_json(F.struct("sequence", "recorded_at", "action", "domain", "url", "brand", "scope", "reason_code", "confidence", F.lit(uuid.uuid4().hex).alias("nonce")), {"ignoreNullFields": "false"}), 256)
    entries = told.select("sequence", identity.alias("event_id"), *columns)
    path, fs = _files(spark, root)
    draft, target = path(f"{root}/_draft-{uuid.uuid4().hex}"), path(f"{root}/{(numbers[-1] if numbers else 0) + 1:012}")
    entries.write.parquet(draft.toString())
    n = spark.read.schema(ENTRY).parquet(draft.toString()).count()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except Exception as e:
        fs.delete(draft, True)
        if "FileAlreadyExists" in str(e) or "not empty" in str(e):
            raise Conflict(f"{target} exists") from e
        raise
    return n


def resolved_brands(requests: DataFrame, registry: matching.Registry, snapshot: DataFrame | None = None) -> DataFrame:
    """``requests`` with the brand that counts: the requested one by the registry's name, else the host's.

    A host's brand is its one match, or, without any, the one that the published
    ``snapshot`` gives it.  A requested brand that the registry does not know, or that
    the host contradicts, raises when the row is read.
    """
    rows = cut(requests.withColumn("_host", normalize_domain(refang(F.col("domain")))))
    found = cut(matching.score(rows.where("_host is not null"), registry, "_host"))
    own = found.groupBy(F.col("domain").alias("_d")).agg(F.when(F.count("*") == 1, F.first("brand")).alias("_own"), F.count("*").alias("_brands"))
    named = matching.declared_brand(rows, registry, "brand").join(own, F.col("_host") == F.col("_d"), "left").withColumn("_brands", F.coalesce("_brands", F.lit(0)))
    if snapshot is None:
        named = named.withColumn("_shown", F.lit(None).cast("string"))
    else:
        shown = unique_value(snapshot.select(refang(F.col("domain")).alias("_s"), F.col("brand").alias("_shown")), "_s", "_shown")
        named = named.join(shown, F.col("_host") == F.col("_s"), "left").drop("_s")
    inferred = F.when(F.col("_brands") == 1, F.col("_own")).when(F.col("_brands") == 0, F.col("_shown"))
    conflict = F.col("canonical_brand").isNull() | (F.col("_inferred").isNotNull() & (F.col("canonical_brand") != F.col("_inferred")))
    wrong = F.raise_error(F.lit("a requested brand conflicts with the registry's evidence")).cast("string")
    brand = F.when(F.col("brand").isNull(), F.col("_inferred")).when(conflict, wrong).otherwise(F.col("canonical_brand"))
    return named.withColumn("_inferred", inferred).withColumn("brand", brand).select(requests.columns)
