"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

A word is a point: its place among the words of its length in forward order, and its
place in the order of the reversed words.  A word that differs from w at position i
shares w's prefix before i and w's suffix after i, that is, it lies in the forward
interval of the prefix and in the reverse interval of the suffix.  A wavelet tree over
the reverse places, in forward order, reports the points of such a rectangle.

Words are split by length, and each length is split by halves: an edit at or behind the
middle leaves the first half as it is, one before it the second half.  So every word
goes once to the block of its first half and once to that of its second, and each edit
position is looked up in one block only.  A block holds the halves of one hash value;
a half with more words than a block has a block for each pair of shards, one of its points
and one of the words that ask.  Blocks are bounded by bytes, whatever the vocabulary.

Occurrences are counted by built-in functions with partial sums before the shuffle.

Texts that are null or empty have no words; a null id counts as an empty one; repeated
rows count again; words of one document that are deleted from are so by a checksum of id
and word, the same for each of their occurrences.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, map_groups, small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Latin-1 letters, with the two signs between them: one byte each, so that byte order is code-point order.
LETTERS = "[A-Za-zÀ-ÿ]+"


def with_slips(doc_id: Column, word: Column, one_in: int) -> Column:
    """``word``, or, for one in so many pairs of document and word, the word without one of its code points."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """``(word, n)``: the words of all texts, A-Z in lower case, of enough code points and occurrences."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars)
    word = F.col("run") if slips is None else with_slips(F.col("doc_id"), F.col("run"), slips)
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """Values ``0..n-1`` in a row, a bit of each a level; reports those in a rectangle of places and values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, value)`` for the values in ``low..high-1`` at the places ``left..right-1`` of each query, all queries level by level."""
        q = np.flatnonzero((left < right) & (low < high))
        left, right, base = left[q], right[q], np.zeros(len(q), np.int64)
        for level, zeros in zip(range(self.levels - 1, -1, -1), self.zeros, strict=True):
            l0, r0, ones, half = zeros[left], zeros[right], zeros[-1], 1 << level
            down = (l0 < r0) & (base + half > low[q]) & (base < high[q])
            up = (left - l0 < right - r0) & (base + 2 * half > low[q]) & (base + half < high[q])
            left, right = np.concatenate([l0[down], (ones + left - l0)[up]]), np.concatenate([r0[down], (ones + right - r0)[up]])
            base = np.concatenate([base[down], base[up] + half])
            q = np.concatenate([q[down], q[up]])
        return q, base


def _shared(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of a sorted matrix shares with the row before it (0 for the first)."""
    if len(matrix) < 2:
        return np.zeros(len(matrix), np.int64)
    same = matrix[1:] == matrix[:-1]
    run = np.where(same.all(axis=1), matrix.shape[1], same.argmin(axis=1))
    return np.concatenate([[0], np.minimum(run, np.minimum(lengths[1:], lengths[:-1]))])


class _Order:
    """Words in one direction's order: the interval of points that share a word's first bytes."""

    def __init__(self, matrix: np.ndarray, lengths: np.ndarray, point: np.ndarray) -> None:
        width = matrix.shape[1]
        order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
        self.shared = _shared(matrix[order], lengths[order])
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.before = np.concatenate([[0], np.cumsum(point[order])])
        self.points = order[point[order]]
        after = np.append(self.shared[1:], 0)
        self.most = np.empty(len(order), np.int64)
        self.most[order] = np.maximum(self.shared, after)

    def intervals(self, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length == 0:
            return np.zeros(len(words), np.int64), np.full(len(words), self.before[-1])
        starts = np.flatnonzero(self.shared < length)
        at = np.searchsorted(starts, self.place[words], "right") - 1
        ends = np.append(starts[1:], len(self.shared))
        return self.before[starts[at]], self.before[ends[at]]


def near_pairs(words: list[bytes], point: np.ndarray, asks: np.ndarray, length: int, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``(word that asks, point)`` one edit apart, the edit in the half that ``first_half`` leaves alone or not.

    Points have ``length`` bytes; words have as many (a replaced byte) or one less (an
    inserted byte, in front of equal bytes before it).  With ``first_half``, edits are at
    or behind ``length // 2``, else before it.
    """
    lengths = np.array([len(w) for w in words])
    matrix = np.frombuffer(b"".join(w.ljust(length, b"\0") for w in words), np.uint8).reshape(len(words), length)
    turned = np.frombuffer(b"".join(w[::-1].ljust(length, b"\0") for w in words), np.uint8).reshape(len(words), length)
    forward, reverse = _Order(matrix, lengths, point), _Order(turned, lengths, point)
    rank = np.empty(len(words), np.int64)
    rank[reverse.points] = np.arange(len(reverse.points))
    tree = WaveletTree(rank[forward.points])
    half = length // 2
    # A prefix longer than what a word shares with its neighbours meets no other word; likewise for suffixes.
    first = np.maximum(length - 1 - reverse.most, half if first_half else 0)
    last = np.where(asks, np.minimum(forward.most, length - 1 if first_half else half - 1), -1)
    asked, met = [], []
    for i in range(int(first.min()), int(last.max()) + 1):
        some = np.flatnonzero((first <= i) & (i <= last))
        if not len(some):
            continue
        q, value = tree.report(*forward.intervals(some, i), *reverse.intervals(some, length - 1 - i))
        q, p = some[q], reverse.points[value]
        keep = q != p
        if i:
            keep &= (lengths[q] == length) | (matrix[p, i] != matrix[p, i - 1])
        asked.append(q[keep])
        met.append(p[keep])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *asked]), np.concatenate([nothing, *met])


def _best(key: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per key: how many others, and the other of largest n, the smallest word among equals."""
    order = np.lexsort((rank[other], -n[other], key))
    key, other = key[order], other[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.diff(np.append(starts, len(key))), other[starts]


def _block(key: tuple, group: list[tuple]) -> list[tuple]:
    """Partial results of a block: ``(word, near, best_n, best)``."""
    length, first_half, *_ = key
    point, asks = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    if len(group) < 2 or not point.any():
        return []
    words, n = [g[2].encode("latin-1") for g in group], np.array([g[3] for g in group])
    q, p = near_pairs(words, point, asks, length, first_half)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    # A word of the points' length asks for itself; one that is shorter also counts for the points that it meets.
    lengths = np.array([len(w) for w in words])
    back = lengths[q] < length
    who, count, best = _best(np.concatenate([q, p[back]]), np.concatenate([p, q[back]]), n, rank)
    return [(group[w][2], int(c), int(n[b]), group[b][2]) for w, c, b in zip(who.tolist(), count.tolist(), best.tolist(), strict=True)]


def near_words(words: DataFrame, block_bytes: int = 256_000) -> DataFrame:
    """``(word, n_near, best, best_n)`` for the words of ``words(word, n)`` that have a near one."""
    size = F.char_length("word")
    half = lambda length: F.floor(length / 2).cast("int")
    ends = []
    for longer in (0, 1):
        length = size + longer
        front, back = F.left("word", half(length)), F.right("word", (length - half(length)))
        for first_half, kept in ((True, front), (False, back)):
            ends.append(F.struct(length.alias("length"), F.lit(first_half).alias("first_half"), F.lit(not longer).alias("point"), F.xxhash64(kept).alias("half")))
    placed = words.select("word", "n", F.explode(F.array(*ends)).alias("e")).select("e.*", "word", "n")
    points = placed.where("point").groupBy("length", "first_half", "half").agg(F.count("*").alias("m"))
    held = F.greatest(F.lit(1), F.lit(block_bytes) / F.greatest(F.col("length"), F.lit(32))).cast("long")
    points = points.withColumn("shards", F.ceil(F.col("m") / held))
    # Halves are dealt over as many blocks as a length's points fill.
    totals = points.groupBy("length", "first_half").agg(F.ceil(F.sum("m") / F.first(held)).alias("blocks"))
    met = placed.join(points.join(small(totals, 10_000), ["length", "first_half"]), ["length", "first_half", "half"])
    # A half of more points than a block holds has a block for each pair of shards, one of points and one of words that ask.
    own, every = F.pmod(F.xxhash64("word", F.lit(1)), F.col("shards")), F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)
    as_point = F.filter(F.transform(every, lambda a: F.struct(own.alias("p"), a.alias("a"))), lambda _: F.col("point"))
    as_asking = F.filter(F.transform(every, lambda p: F.struct(p.alias("p"), own.alias("a"))), lambda x: ~F.col("point") | (x["p"] != own))
    met = met.withColumns({"own": own, "pair": F.explode(F.concat(as_point, as_asking))})
    met = met.withColumns({"point": F.col("point") & (F.col("pair.p") == F.col("own")), "asks": F.col("pair.a") == F.col("own")})
    met = met.withColumn("blk", F.when(F.col("shards") > 1, F.xxhash64("half", "pair.p", "pair.a")).otherwise(F.pmod("half", "blocks")))
    met = met.select("length", "first_half", "blk", "point", "asks", "word", "n")
    parts = map_groups(met, ["length", "first_half", "blk"], _block, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best")))
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.best").alias("best"), (-F.col("_b.n")).alias("best_n"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = 97, least_chars: int = 5, least_count: int = 3, block_bytes: int = 256_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: every word with the commoner word it is a variant of.

    A form occurs twice as often as its word at least, so chains end after as many
    steps as a count has binary digits; each round of joins doubles the steps.
    """
    words = cut(vocabulary(docs, id_col, text_col, slips, least_chars, least_count))
    near = near_words(words, block_bytes)
    led = F.col("best_n") >= 2 * F.col("n")
    rows = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")))
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = cut(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return rows.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))
