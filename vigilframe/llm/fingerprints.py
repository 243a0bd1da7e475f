"""Document fingerprints from prefix polynomial hashes.

For code points c_0, c_1, ... a text's prefix array holds, for every i, the sum
of c_j * B^j over j < i modulo the prime 2^31 - 1, for two fixed bases B.  Two
array reads give the hash of any span, whatever its place; equal spans have equal
hashes, so span equality is one comparison and the longest common extension of
two places a binary search.  A fingerprint is the whole text's hash and the
smallest mixed hashes of its spans of ``SPAN`` code points; the likeness of two
fingerprints estimates the Jaccard similarity of those span sets.

Null texts count as empty.  A text shorter than a span is one span.  Two empty
texts are alike (1.0); an empty and another text are not (0.0).  Rows with the
same id follow each other by text.  Null ids come first.  In a table of one row
that row is its own next document.  Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import map_rows, table

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 747_796_405)
SPAN = 16
KEPT = 64


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the bases and of their inverses, below ``size`` (a power of two)."""
    out = []
    for bases in (BASES, tuple(pow(b, -1, PRIME) for b in BASES)):
        rows = np.ones((2, 1), np.int64)
        while rows.shape[1] < size:
            step = np.array([[pow(b, rows.shape[1], PRIME)] for b in bases], np.int64)
            rows = np.concatenate([rows, _mod(rows * step)], axis=1)
        out.append(rows)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, int(n).bit_length()))


def prefixes(text: str) -> np.ndarray:
    """Array (2, n + 1): the hash of every prefix of ``text`` under both bases."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
    out = np.zeros((2, len(points) + 1), np.int64)
    if len(points):
        np.cumsum(_mod(points * powers(len(points))[0][:, : len(points)]), axis=1, out=out[:, 1:])
    return _mod(out)


def spliced(left: np.ndarray, m: int, right: np.ndarray, k: int) -> np.ndarray:
    """Prefix array of the first ``m`` code points of one text and the first ``k`` of another."""
    shift = powers(m)[0][:, m : m + 1]
    return np.concatenate([left[:, : m + 1], _mod(left[:, m : m + 1] + _mod(shift * right[:, 1 : k + 1]))], axis=1)


def span_hash(h: np.ndarray, start, length: int) -> np.ndarray:
    """Place-independent hash of the spans at ``start`` (an integer or an array), 62 bits."""
    start = np.atleast_1d(start)
    lanes = _mod(_mod(h[:, start + length] - h[:, start] + PRIME) * powers(h.shape[1])[1][:, start])
    return (lanes[0] << 31) | lanes[1]


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many code points agree from place ``i`` of one text and ``j`` of another on."""
    low, high = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while low < high:
        middle = (low + high + 1) // 2
        if span_hash(a, i, middle)[0] == span_hash(b, j, middle)[0]:
            low = middle
        else:
            high = middle - 1
    return low


def mixed(h: np.ndarray, first: int = 0) -> np.ndarray:
    """Mixed hashes of the spans of a text, from place ``first`` on."""
    n = h.shape[1] - 1
    if not n:
        return np.zeros(0, np.uint64)
    width = min(SPAN, n)
    last = n - width + 1
    lanes = _mod(_mod(h[:, first + width :] - h[:, first:last] + PRIME) * powers(h.shape[1])[1][:, first:last])
    x = ((lanes[0] << 31) | lanes[1]).astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(24)


def mixed_edit(x: np.ndarray, m: int, edit: np.ndarray) -> np.ndarray:
    """``mixed(edit)`` of a text's edit after its first ``m`` code points: spans before are the text's own."""
    own = m - SPAN + 1
    return mixed(edit) if own <= 0 else np.concatenate([x[:own], mixed(edit, own)])


def fingerprint(h: np.ndarray, x: np.ndarray | None = None) -> str:
    """``x``: the text's ``mixed`` hashes, if they are known."""
    n = h.shape[1] - 1
    x = mixed(h) if x is None else x
    least = np.unique(np.partition(x, 4 * KEPT)[: 4 * KEPT] if len(x) > 8 * KEPT else x)
    if len(least) < KEPT:
        least = np.unique(x)
    return f"{n:x}-{int(h[0, n]):08x}{int(h[1, n]):08x}-" + "".join([f"{v:010x}" for v in least[:KEPT].tolist()])


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints' span sets, 0 to 1."""
    if a == b:
        return 1.0
    left, right = ({x[i : i + 10] for i in range(0, len(x), 10)} for x in (a.rpartition("-")[2], b.rpartition("-")[2]))
    union = sorted(left | right)[:KEPT]
    return sum(x in left and x in right for x in union) / len(union) if left and right else 0.0


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def successors(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt out by ranges of id, each range ending with a guest: the next range's first row.

    ``(bucket, guest, doc_id, text)``, sorted by them in each partition.  The
    ranges' bounds are quantiles of the ids; only bounds and first ids, a few per
    range, reach the driver.
    """
    low = -(1 << 63)
    ids = docs.select(F.coalesce("doc_id", F.lit(low)).alias("k"))
    bounds = np.unique(np.array(ids.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), "right").astype(np.int32))

    first = {b: k for b, k in ids.groupBy(bucket_of("k").alias("b")).agg(F.min("k")).collect()}
    order = sorted(first)
    starts = np.array([first[b] for b in order], np.int64)
    before = np.array([order[i - 1] for i in range(len(order))], np.int32)

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        k = k.to_numpy(np.int64)
        own, at = np.searchsorted(bounds, k, "right"), np.searchsorted(starts, k).clip(max=max(len(starts) - 1, 0))
        return pd.Series([[int(b), int(before[i])] if starts[i] == x else [int(b)] for b, i, x in zip(own, at, k, strict=True)])

    dealt = docs.select(F.posexplode(places(F.coalesce("doc_id", F.lit(low)))).alias("guest", "bucket"), "doc_id", "text")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text").select("bucket", "guest", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning."""
    spark = docs.sparkSession
    buckets = buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows(slices):
        held = None
        for part in slices:
            out = []
            for bucket, guest, doc, text in part:
                now = (bucket, guest, doc, text, h := prefixes(text), fingerprint(h, x := mixed(h)), x)
                if held and held[0] == bucket and not held[1]:
                    _, _, before, old, g, mark, own = held
                    k = len(old) // 4
                    m, k = len(old) - k, min(k, len(text))
                    edit = spliced(g, m, h, k)
                    edited = fingerprint(edit, mixed_edit(own, m, edit))
                    sha = hashlib.sha256((old[:m] + text[:k]).encode()).hexdigest()
                    out.append((before, len(old), sha, mark, edited, likeness(mark, edited), likeness(mark, now[5]), common_extension(g, 0, edit, 0)))
                held = now
            if out:
                yield out

    return map_rows(successors(rows_in, buckets), rows, OUT).withColumnRenamed("doc_id", id_col)


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
