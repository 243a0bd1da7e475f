"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors of a label are collapsed to one class first.  A class's vector is
rotated by rounds of random signs and fast Hadamard transforms; the nearest signed
axes of ``functions`` rotations form its bucket in one of ``tables`` hash tables,
and further buckets are probed in which one rotation's axis is the second nearest.
Classes that share a bucket are compared by cosine in double precision, in blocks.
A pair counts in the first bucket that both have, so each link counts once without
any list of pairs; blocks give counts and spanning edges only, and the edges'
components are found by distributed star steps.

Exact counts of a group of n distinct near copies take n * n comparisons, spread
over blocks of ``block`` vectors a side; equal copies cost nothing.

Rows with a null label, or a vector that is null, empty, zero or holds null or
non-finite components link with nothing.  Vectors of different lengths never link.
Repeated rows are equal vectors; rows that share an id but not the vector are in
the components of their own vectors.  Rows with a null id count as vectors but have
a null component of their own when unlinked.  Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import connected_components, cut, map_groups, map_rows, table


@functools.lru_cache(maxsize=8)
def _signs(width: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (rotations, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (its length a power of two), orthonormal."""
    width, step = x.shape[-1], 1
    while step < width:
        pairs = x.reshape(*x.shape[:-1], width // (2 * step), 2, step)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, tables: int, functions: int, seed: int = 11) -> np.ndarray:
    """Buckets of unit vectors: array (n, tables, 1 + functions); the first is a vector's own, the others probes."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    out = np.zeros((n, tables, 1 + functions), np.int64)
    signs = _signs(width, tables * functions, seed)
    for t in range(tables):
        own, second = [], []
        for f in range(functions):
            y = padded
            for round_ in range(3):
                y = hadamard(y * signs[t * functions + f, round_])
            size = np.abs(y)
            top = np.argpartition(size, -2, axis=1)[:, -2:] if width > 2 else np.tile([0, 1], (n, 1))
            order = np.argsort(np.take_along_axis(size, top, 1), axis=1)
            best, next_ = (np.take_along_axis(top, order[:, [i]], 1)[:, 0] for i in (1, 0))
            code = lambda axis: 2 * axis + (np.take_along_axis(y, axis[:, None], 1)[:, 0] < 0)  # noqa: B023, E731
            own.append(code(best))
            second.append(code(next_))
        for probe in range(1 + functions):
            key = np.zeros(n, np.int64)
            for f in range(functions):
                key = key * (2 * width) + (second[f] if f == probe - 1 else own[f])
            out[:, t, probe] = key
    return out


def _components(adjacent: np.ndarray) -> np.ndarray:
    """Smallest reachable row number of each row of a symmetric boolean matrix."""
    at = np.arange(len(adjacent))
    while True:
        low = np.minimum(at, np.where(adjacent, at[None, :], len(at)).min(axis=1))
        low = low[low]
        if (low == at).all():
            return at
        at = low


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tables: int = 10,
    functions: int = 2,
    block: int = 512,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumns({"k1": F.xxhash64("v", "label"), "k2": F.xxhash64("label", F.lit(1), "v")})
    classes = rows.where("good").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))

    def hashed(slices):
        for part in slices:
            out = []
            by_size: dict[int, list] = {}
            for row in part:
                by_size.setdefault(len(row[2]), []).append(row)
            for some in by_size.values():
                for start in range(0, len(some), 512):
                    few = some[start : start + 512]
                    x = np.array([r[2] for r in few])
                    # Scaled first, so that the norm of very large or small components stays finite.
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for (cls, label, _), u, b in zip(few, x, buckets(x, tables, functions), strict=True):
                        out.append((cls, label, u.tobytes(), b.reshape(-1).tolist()))
            yield out

    units = cut(map_rows(classes.select("cls", "label", "v"), hashed, "cls long, label string, unit binary, keys array<long>", chars=1_000_000).join(classes.select("cls", "n"), "cls"))
    width = 1 + functions
    entries = units.select("cls", F.octet_length("unit").alias("bytes"), "label", F.posexplode("keys").alias("i", "key")).withColumn("t", F.expr(f"i div {width}"))
    entries = entries.groupBy("label", "bytes", "t", "key", "cls").agg(F.lit(1).alias("one")).drop("one")
    sizes = entries.groupBy("label", "bytes", "t", "key").agg(F.count("*").alias("size")).where("size > 1")
    live = entries.join(sizes, ["label", "bytes", "t", "key"])
    # A bucket of many classes is compared block by block: each class goes to every pair of blocks that has its own.
    count = F.ceil(F.col("size") / block)
    live = live.withColumns({"own": F.pmod(F.xxhash64("cls"), count), "other": F.explode(F.sequence(F.lit(0).cast("long"), count - 1))})
    live = live.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("size")
    placed = live.join(units.select("cls", "n", "unit", "keys"), "cls").select("label", "bytes", "t", "key", "b1", "b2", "own", "cls", "n", "unit", "keys")

    def linked(key, group):
        _, _, t, bucket, b1, b2 = key
        if len(group) < 2:
            return []
        own = np.array([g[0] for g in group])
        cls = np.array([g[1] for g in group])
        weight = np.array([g[2] for g in group], np.int64)
        x = np.frombuffer(b"".join(g[3] for g in group)).reshape(len(group), -1)
        adjacent = x @ x.T >= threshold
        if b1 != b2:
            adjacent &= own[:, None] != own[None, :]
        np.fill_diagonal(adjacent, False)
        i, j = np.nonzero(np.triu(adjacent))
        if not len(i):
            return []
        held = np.array([g[4] for g in group]).reshape(len(group), tables, width)
        first = np.ones(len(i), bool)
        for start in range(0, len(i), 100_000):
            a, b = held[i[start : start + 100_000]], held[j[start : start + 100_000]]
            met = (a[:, : t + 1, :, None] == b[:, : t + 1, None, :]) & ((np.arange(t + 1) < t)[None, :, None, None] | (a[:, : t + 1, :, None] < bucket))
            first[start : start + 100_000] = ~met.any(axis=(1, 2, 3))
        i, j = i[first], j[first]
        counts = np.bincount(i, weight[j], len(group)) + np.bincount(j, weight[i], len(group))
        mine = np.zeros_like(adjacent)
        mine[i, j] = mine[j, i] = True
        low = _components(mine)
        return [(int(cls[k]), int(counts[k]), int(cls[low[k]])) for k in np.flatnonzero(counts)]

    found = cut(map_groups(placed, ["label", "bytes", "t", "key", "b1", "b2"], linked, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    grouped = classes.join(parts.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_low"))
    known = grouped.join(lows, "component").join(links, "cls", "left").select("k1", "k2", "component_low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    of_row = F.when(F.col("good"), F.col("component_low")).otherwise(F.col("id"))
    out = rows.select("id", "good", F.when(F.col("good"), F.col("k1")).alias("k1"), F.when(F.col("good"), F.col("k2")).alias("k2")).join(known, ["k1", "k2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of_row.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op3_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT low.id AS vec_id, coalesce(n, 0) AS n_links, component_id, low.id = component_id AS kept FROM low LEFT JOIN counts USING (id)
"""
