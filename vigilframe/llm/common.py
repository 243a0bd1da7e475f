"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The folder is the one in ``spark.checkpoint.dir``; only a local session without
    that setting (a test) gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one if the whole session is local."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp("checkpoint")


#: Bytes of an Arrow batch on its way to Python, where the session names no figure.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as a batch of long texts by rows alone has no useful bound.

    A batch stands in the executor and in its worker, some of the time twice.  A figure
    that the session was given stays.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def give_back() -> None:
    """Returns the memory that a task has freed to the system: its worker lives on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, rows: Callable, schema: str, chars: int = 4_000_000) -> DataFrame:
    """``mapInArrow`` over slices of a few million characters.

    ``rows(slices)`` gets an iterator of lists of tuples (one per input row) and
    yields lists of output tuples; the slices bound a worker's memory whatever
    the lengths of the texts.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            held, size = [], 0
            columns = [c for c in batch.columns]
            for start in range(0, batch.num_rows, 256):
                part = list(zip(*(c.slice(start, 256).to_pylist() for c in columns), strict=True))
                for row in part:
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if size >= chars:
                        yield held
                        held, size = [], 0
            if held:
                yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in rows(slices(batches)):
            for start in range(0, len(made), 20_000):
                part = list(zip(*made[start : start + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, out, strict=True)], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def _forest(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with b < a: trees of depth one that join what each batch of ``edges(a, b)`` joins."""

    def rows(slices):
        for part in slices:
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = x = up[y]
                return x

            for a, b in part:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
            yield [(x, y) for x in list(up) if (y := root(x)) != x]

    return map_rows(edges.where("a <> b").select("a", "b"), rows, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``; the component is its smallest id.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until every end is a leaf with one centre or a centre with leaves only.
    Each round is checkpointed, so a lost executor repeats one round.
    """
    # The exchange also keeps this Python step and one before it from running side by side in a task.
    now = cut(_forest(edges.select("a", "b").distinct()))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, high = F.min("b"), F.max("b")
        ends = cut(both.groupBy("a").agg(F.least(low, "a").alias("m"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("up"), (high > F.col("a")).alias("larger")))
        if ends.where("up <> m or up is not null and larger").isEmpty():
            centres = ends.where("up is null").select(F.col("a").alias("id"), F.col("a").alias("component"))
            return ends.where("up is not null").select(F.col("a").alias("id"), F.col("m").alias("component")).unionByName(centres)
        large = now.join(ends.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.toDF("a", "b"))
        now = cut(small.where("a <> b").distinct())


def map_groups(df: DataFrame, keys: list[str], made: Callable, schema: str) -> DataFrame:
    """``made(key, rows)`` for each distinct value of the leading columns ``keys``.

    The groups must be bounded by construction: one at a time is held.  Rows come
    sorted by key, so a partition of many small groups streams through.
    """
    width = len(keys)

    def rows(slices):
        key, held = None, []
        for part in slices:
            out = []
            for row in part:
                if held and row[:width] != key:
                    out += made(key, held)
                    held = []
                key = row[:width]
                held.append(row[width:])
            if out:
                yield out
        if held and (out := list(made(key, held))):
            yield out

    return map_rows(df.repartition(*keys).sortWithinPartitions(*keys), rows, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Known:
    """Ids of chunks encoded before; what was not met again lately is forgotten.

    Chunks enter ``young``; at ``most`` entries it becomes ``old`` and the former
    ``old`` goes, so common chunks stay and memory is bounded.
    """

    def __init__(self, most: int = 900_000) -> None:
        self.most, self.young, self.old = most, {}, {}

    def recall(self, chunks: set[str]) -> set[str]:
        """Makes those of the chunks that are known young; gives the others."""
        back = {c: x for c in chunks if (x := self.old.get(c)) is not None}
        self.young.update(back)
        return chunks.difference(back) if back else chunks

    def age(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
