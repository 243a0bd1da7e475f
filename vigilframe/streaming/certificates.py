"""The stream of certificate messages: flatten, match, deduplicate per day, count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vigilframe.functions import signals as S
from vigilframe.operators.matching import Registry, unique_matches
from vigilframe.plans.shared import cut, shared_folder
from vigilframe.sources.archives import append_new, write_days

MOST_NAMES = 500


def names_of(value: Column) -> Column:
    """Host names of a message: those of ``dns_entries``, or of a certificate's leaf; the first 500 entries, strings only."""
    get = lambda p: F.try_variant_get(value, p, "array<variant>")
    kind = F.try_variant_get(value, "$.message_type", "string")
    listed = F.when(kind == "dns_entries", get("$.data")).when(kind == "certificate_update", F.coalesce(get("$.data.leaf_cert.all_domains"), get("$.data.dns_entries")))
    strings = F.filter(F.slice(listed, 1, MOST_NAMES), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(strings, lambda x: F.try_variant_get(x, "$", "string"))


def flatten(messages: DataFrame) -> DataFrame:
    """``(host, time)`` for every name in ``messages(value, time)``; what is no JSON gives none."""
    parsed = messages.select(F.try_parse_json("value").alias("v"), "time").where("v is not null")
    return parsed.select(F.explode(names_of(F.col("v"))).alias("host"), "time")


def candidate_rows(hosts: DataFrame, registry: Registry, least: int = 80, zone: str = "Europe/Vilnius") -> DataFrame:
    """Archive rows of the hosts that match one brand with ``least`` confidence: the first of each local day."""
    first = hosts.withColumn("day", S.local_day(F.col("time"), zone)).groupBy("host", "day").agg(F.min("time").alias("observedAt"))
    found = unique_matches(first, registry).where(F.col("confidence") >= least)
    from vigilframe.functions.hosts import normalize_domain

    dated = first.select(normalize_domain(F.col("host")).alias("domain"), "day", "observedAt").groupBy("domain", "day").agg(F.min("observedAt").alias("observedAt"))
    return found.join(dated, "domain").select("day", S.short_id(F.col("domain")).alias("id"), "observedAt", "domain", "registrable", F.lit("Certificate log sample").alias("source"), "brand", "confidence", "reasons")


def stored_days(rows: DataFrame, root: str) -> DataFrame:
    """What the archive at ``root`` has of the days that ``rows`` have: the other days' folders are not read.

    The days of a batch are few; they are the only thing that comes to the driver.
    """
    days = [r["day"] for r in rows.select("day").distinct().collect()]
    try:
        stored = rows.sparkSession.read.parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return rows.limit(0)
    return stored.where(F.col("day").isin(days) if days else F.lit(False))


def collect(messages: DataFrame, registry: Registry, root: str, checkpoint: str, least: int = 80, trigger: dict | None = None, on_batch: Callable[[int, DataFrame], None] | None = None):
    """Start a query that appends new candidates to the archive at ``root``.

    A batch that is repeated after a failure adds nothing, because rows that the
    archive has are left out.
    """

    def append(batch: DataFrame, number: int) -> None:
        rows = cut(candidate_rows(flatten(batch), registry, least))
        write_days(append_new(rows, stored_days(rows, root), F.col("observedAt")), root)
        if on_batch:
            on_batch(number, batch)

    return messages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row per key among those within the watermark's delay."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, time: str = "ts", by: tuple[str, ...] = ("event_type",), late: str = "2 days") -> DataFrame:
    """Counts and sums per UTC day; a day is final when the watermark passes it."""
    window = F.window(time, "1 day")
    return events.withWatermark(time, late).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("day"), *by, "n", "total")


def drain(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and give its result as a table.

    Result and checkpoint are in the folder of ``spark.checkpoint.dir``.  A batch
    has its own folder, which a repeated batch writes anew; in complete mode the
    last batch is the result.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(at := f"{folder}/rows/{number}")
        written[:] = [at] if mode == "complete" else [*written, at]

    query = rows.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(*dict.fromkeys(written))


class Health(StreamingQueryListener):
    """Counts of a query's progress, for the health of a collection."""

    def __init__(self) -> None:
        self.rows, self.batches, self.late, self.failure = 0, 0, 0, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.late += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failure = event.exception


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of landed message lines with the time of their file."""
    return spark.readStream.format("text").load(path).select("value", F.col("_metadata.file_modification_time").alias("time"))
