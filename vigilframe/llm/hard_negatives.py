"""Hard negatives by a pivot table: bounds on inner products from stored distances.

Every vector x gets one more component, sqrt(M*M - |x|*|x|) with M the largest norm, and
an anchor q gets a zero there.  Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the nearest rows
are those of the largest inner product.  The distances of every row and anchor to a few
pivots are stored.  By the triangle inequality, |d(q', p) - d(x', p)| and
d(q', p) + d(x', p) bracket |q' - x'|, and so the score; only rows whose bracket reaches
into what is still wanted get an exact product.

Rows are dealt into parts and anchors into blocks.  A task meets one block of anchors
with one part of the rows, which streams through in slices, and keeps a few rows an
anchor; the tasks' few are then ranked.  Positives come first, from the parts of their
own label; their scores bound the second pass, which looks for the negatives between
them.  Both passes are exact.  Blocks have a bound of bytes, parts one of rows.

Pivots are picked among at most ``sample`` rows (those of the smallest hash of the id),
each the farthest from those before it; they change the speed, not the result.

Rows with a null id, a null label, a null or empty vector, or one with null or non-finite
components take no part.  Only vectors of equal lengths have a score.  Of the rows of
an id, the one whose label and vector come first counts.  Scores are summed in double precision:
whole numbers below 2^53 are exact.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, map_rows, table


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def further(x: np.ndarray, most: float) -> np.ndarray:
    """The component that brings each row to the norm ``most``."""
    return np.sqrt(np.maximum(most * most - _norms(x), 0.0))


def distances(x: np.ndarray, more: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, with their further component, to the pivots.

    The pivots' last component is their further one; rows of fewer components count as filled up with zeros.
    """
    width = x.shape[1]
    rest = _norms(pivots[:, width:-1])
    return np.sqrt(np.stack([_norms(x - p[:width]) + r + (more - p[-1]) ** 2 for p, r in zip(pivots, rest, strict=True)], axis=1))


def pick_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x``, each the farthest from those before it."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, np.sqrt(_norms(x - x[chosen[-1]])))
        chosen.append(int(far.argmax()))
    return x[chosen]


def brackets(q_norm: np.ndarray, q_far: np.ndarray, x_far: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the scores of anchors (rows) with rows (columns), from their distances to the pivots."""
    near, far = np.zeros((len(q_far), len(x_far))), np.full((len(q_far), len(x_far)), np.inf)
    for j in range(q_far.shape[1]):
        np.maximum(near, np.abs(q_far[:, j, None] - x_far[None, :, j]), out=near)
        np.minimum(far, q_far[:, j, None] + x_far[None, :, j], out=far)
    total = (q_norm + most * most)[:, None]
    if not np.isfinite(total).all():
        # Squares beyond double range bound nothing.
        return np.full(near.shape, -np.inf), np.full(near.shape, np.inf)
    slack = 1e-9 * total + 1e-9
    return (total - far * far) / 2 - slack, (total - near * near) / 2 + slack


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` by score, high first, and id."""
    if len(score) > 4 * n:
        some = np.flatnonzero(score >= np.partition(score, -n)[-n])
        return some[np.lexsort((ids[some], -score[some]))[:n]]
    return np.lexsort((ids, -score))[:n]


#: Anchors and rows that are compared at a time.
SOME, FEW = 512, 1024
#: Bytes at most of the rows that pivots are picked among, beside their number.
SAMPLE_BYTES = 32_000_000


def _exact(x: np.ndarray, survive: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Scores of the rows that survive; of all rows in one product where most do."""
    return (x @ anchor)[survive] if 2 * len(survive) > len(x) else x[survive] @ anchor


class _Anchors:
    """A block of anchors."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.x = np.array([np.frombuffer(r[1]) for r in rows])
        self.far = np.array([np.frombuffer(r[2]) for r in rows])
        self.norm = _norms(self.x)

    def bounds(self, far: np.ndarray, most: float):
        """``(first anchor, bounds below, bounds above)`` for some anchors at a time."""
        for start in range(0, len(self.ids), SOME):
            some = slice(start, start + SOME)
            yield start, *brackets(self.norm[some], self.far[some], far, most)


class _Positives(_Anchors):
    """The first rows of an anchor, itself left out."""

    def __init__(self, rows: list[tuple], count: int, _tolerance: tuple[int, int]) -> None:
        super().__init__(rows)
        self.count = count
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in rows]
        self.least = np.full(len(rows), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, most: float) -> None:
        for start, low, high in self.bounds(far, most):
            least = self.least[start : start + SOME]
            if len(ids) > self.count:
                # As many rows as are wanted reach this score for certain; one more of them may be the anchor itself.
                np.maximum(least, np.partition(low, -self.count - 1, axis=1)[:, -self.count - 1], out=least)
            reach = high >= least[:, None]
            for a in np.flatnonzero(reach.any(axis=1)).tolist():
                survive, a = np.flatnonzero(reach[a]), a + start
                survive = survive[ids[survive] != self.ids[a]]
                score, own = np.concatenate([self.best[a][0], _exact(x, survive, self.x[a])]), np.concatenate([self.best[a][1], ids[survive]])
                keep = _first(score, own, self.count)
                self.best[a] = score[keep], own[keep]
                if len(keep) == self.count:
                    self.least[a] = max(self.least[a], score[keep[-1]])

    def found(self) -> list[tuple]:
        return [(int(a), None, int(i), float(s)) for a, (score, ids) in zip(self.ids, self.best, strict=True) for s, i in zip(score, ids, strict=True)]


class _Negatives(_Anchors):
    """Per positive of an anchor, the first rows of other labels whose score is in its band."""

    def __init__(self, rows: list[tuple], count: int, tolerance: tuple[int, int]) -> None:
        super().__init__(rows)
        self.count, (self.low, self.high) = count, tolerance
        self.labels = np.array([r[3] for r in rows], object)
        self.wanted = [[(int(i), float(s)) for i, s in r[4]] for r in rows]
        self.best = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in w] for w in self.wanted]
        scores = [[s for _, s in w] for w in self.wanted]
        self.least, self.most = np.array([self.low * min(w) / self.high for w in scores]), np.array([max(w) for w in scores])

    def meet(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, most: float, labels: np.ndarray) -> None:
        slack = 1e-9 * np.abs(self.most) + 1e-9
        for start, low, high in self.bounds(far, most):
            some = slice(start, start + SOME)
            reach = (high >= (self.least - slack)[some, None]) & (low <= (self.most + slack)[some, None])
            for a in np.flatnonzero(reach.any(axis=1)).tolist():
                survive, a = np.flatnonzero(reach[a]), a + start
                survive = survive[labels[survive] != self.labels[a]]
                score = _exact(x, survive, self.x[a])
                for k, (_, positive) in enumerate(self.wanted[a]):
                    within = (self.low * positive <= self.high * score) & (score <= positive)
                    if within.any():
                        both, own = np.concatenate([self.best[a][k][0], score[within]]), np.concatenate([self.best[a][k][1], ids[survive[within]]])
                        keep = _first(both, own, self.count)
                        self.best[a][k] = both[keep], own[keep]

    def found(self) -> list[tuple]:
        out = []
        for a, wanted, best in zip(self.ids, self.wanted, self.best, strict=True):
            for (positive, _), (score, ids) in zip(wanted, best, strict=True):
                out += [(int(a), positive, int(i), float(s)) for s, i in zip(score, ids, strict=True)]
        return out


def _search(anchors: DataFrame, rows: DataFrame, keys: list[str], kind: type, count: int, most: float, tolerance: tuple[int, int]) -> DataFrame:
    """``(anchor_id, positive_id, other_id, score)`` of each block of anchors with each part of rows.

    Both frames have ``keys``; anchors come first in a group, then its rows stream through.
    """
    columns = [*keys, "role", "id", "x", "far", F.col("label").alias("own_label"), "wanted"]
    nothing = F.lit(None).cast("array<struct<id:long,score:double>>")
    if "wanted" not in anchors.columns:
        anchors = anchors.withColumn("wanted", nothing)
    both = anchors.withColumn("role", F.lit(0)).select(columns).unionByName(rows.withColumns({"role": F.lit(1), "wanted": nothing}).select(columns))
    width = len(keys)

    def met(slices):
        key, waiting, block = None, [], None
        for part in slices:
            out, at = [], 0
            while at < len(part):
                if part[at][:width] != key:
                    if block is not None:
                        out += block.found()
                    key, waiting, block = part[at][:width], [], None
                end = at
                while end < len(part) and part[end][:width] == key and part[end][width] == part[at][width]:
                    end += 1
                some, role, at = [r[width + 1 :] for r in part[at:end]], part[at][width], end
                if role == 0:
                    waiting += [(r[0], r[1], r[2], r[3], [(w["id"], w["score"]) for w in r[4] or []]) for r in some]
                    continue
                if not waiting and block is None:
                    continue
                if block is None:
                    block = kind(waiting, count, tolerance)
                for start in range(0, len(some), FEW):
                    few = some[start : start + FEW]
                    more = (np.array([r[3] for r in few], object),) if kind is _Negatives else ()
                    block.meet(np.array([r[0] for r in few], np.int64), np.array([np.frombuffer(r[1]) for r in few]), np.array([np.frombuffer(r[2]) for r in few]), most, *more)
            if out:
                yield out
        if block is not None:
            yield block.found()

    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "role")
    return map_rows(dealt, met, "anchor_id long, positive_id long, other_id long, score double", chars=8_000_000)


def _ranked(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= count)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    tolerance: tuple[int, int] = (80, 100),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    pivots: int = 8,
    sample: int = 1_000,
    block_bytes: int = 4_000_000,
    part_rows: int = 16_384,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` says of a row (by its id, label and vector columns) whether it is one.
    A negative's score is at least ``tolerance[0] / tolerance[1]`` of its positive's and
    at most as high.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.*")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    held = rows.agg(F.max(norm).alias("norm"), F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.sum(F.when(F.col("asks"), F.size("v"))).alias("asking")).first()
    columns = {"anchor_id": "long", "positive_id": "long", "rank": "int", "negative_id": "long", "positive_score": "long", "negative_score": "long"}
    if not held["n"]:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))
    most, width = float(held["norm"]), held["width"]
    some = min(sample, max(1, SAMPLE_BYTES // (8 * width)))
    picked = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(some).select("v").collect()]
    picked = np.array([x + [0.0] * (width - len(x)) for x in picked])
    points = pick_pivots(np.column_stack([picked, further(picked, most)]), pivots)

    def measured(slices):
        for part in slices:
            by_size: dict[int, list] = {}
            for row in part:
                by_size.setdefault(len(row[3]), []).append(row)
            for size, own in by_size.items():
                x = np.array([r[3] for r in own])
                # An anchor's further component is zero.
                far, asked = distances(x, further(x, most), points), distances(x, np.zeros(len(x)), points)
                yield [(r[0], r[1], r[2], size, a.tobytes(), b.tobytes(), c.tobytes() if r[2] else None) for r, a, b, c in zip(own, x, far, asked, strict=True)]

    stored = cut(map_rows(rows.select("id", "label", "asks", "v"), measured, "id long, label string, asks boolean, size int, x binary, far binary, asked binary", chars=100_000))
    blocks = max(1, -(-8 * (held["asking"] or 0) // block_bytes))
    parts = max(-(-held["n"] // part_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    block, part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    anchors = stored.where("asks").select("id", "label", "size", "x", F.col("asked").alias("far"), block.alias("block"))
    dealt = stored.select("id", "label", "size", "x", "far", part.alias("part"))
    asks = anchors.withColumn("part", every(parts))
    told = dealt.withColumn("block", every(blocks))
    found = _search(asks, told, ["size", "label", "block", "part"], _Positives, positives, most, tolerance)
    found = cut(_ranked(found, ["anchor_id"], positives))
    wanted = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("wanted")).withColumnRenamed("anchor_id", "id")
    asks = anchors.join(wanted, "id").withColumn("part", every(parts))
    far = _search(asks, told, ["size", "block", "part"], _Negatives, negatives, most, tolerance)
    ranked = _ranked(far, ["anchor_id", "positive_id"], negatives).withColumnRenamed("score", "negative_score").withColumnRenamed("other_id", "negative_id")
    scores = found.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(scores, ["anchor_id", "positive_id"]).select([F.col(c).cast(t).alias(c) for c, t in columns.items()])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # A double of 2^53 or more is whole already, and may be beyond what ``floor`` can give.
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    scaled = F.transform("embedding", lambda x: whole(x.cast("double") * 256))
    return mine(vectors.withColumns({"label": label, "embedding": scaled}), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""
