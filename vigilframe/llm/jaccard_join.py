"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct shingles of ``words`` words (a shorter text is
one shingle); equal sets have equal 64-bit keys and form a class.  Sets fall in
size bands a square of the inverse threshold wide.  A band partitions the hashed
shingle domain twice: into first-level partitions, and each of these into
``CELLS`` cells.  If two sets differ in at most d shingles, at most d div 2 of the
first-level partitions hold two differences or more; in every other one, all cells
but one agree.  So a signature is made for each subset of ``CELLS - 1`` cells of a
first-level partition.  A set walks the partitions in one fixed order until d div 2
+ t of them have no empty subset, d being the most that a partner of its size can
differ; a link therefore shares t signatures at least that are not empty.  A set
that runs out of partitions goes on in another partitioning and in the end with its
single shingles, so the join is exact.  A set is signed for its own band and, if a
partner could be in the next one, for that.

Candidates are found in two steps.  First each class meets, in each of its
signature groups, the class of the smallest key and those of the ``NEXT`` next
smaller ones, which joins dense groups at linear cost.  Then only groups that still hold
several components are searched: small ones pair by pair; in large ones only the
classes with enough large groups to have all their shared signatures there, in
pairs of blocks.  Parity bitmaps bound the difference of a pair from below and
drop most; the rest is verified on the texts.  Within a component nothing is
compared again, since no link there can change it.

Null and empty texts and texts without words have the empty set (0 shingles) and
link with nothing.  Rows that share an id but not the set are in the components of
their own sets.  Rows with a null id link with nothing and have a null component.
Ties go to the smaller id.  Other columns are not read.  Keys are 64 bits, as the
hashes of shingles are: of n different sets, n * n / 2**65 pairs are expected to
be taken for equal.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import bound_batches, connected_components, cut, map_groups, map_rows, small, table

GOLD = np.uint64(0x9E3779B97F4A7C15)
LEVELS = 3
CELLS = 3
#: The cells of each enumerated subset: all but one.
SUBSETS = [[c for c in range(CELLS) if c != left_out] for left_out in range(CELLS)]
NEXT = 3
#: The lowest bits of a signature name its band; the last number is for signatures that are single shingles.
BAND_BITS, SINGLE = 7, 127


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``seed`` picks one of many."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.

    ASCII letters are lower-cased; words are separated by ASCII white space.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    n = min(words, len(hashed))
    out = np.full(len(hashed) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * GOLD + hashed[i : len(hashed) - n + 1 + i]
    out = np.sort(mix(out))  # faster than unique() on short arrays
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def key_of(h: np.ndarray) -> int:
    """64 bits that name a set, as a signed integer."""
    sums = np.array([mix(h, 1).sum(dtype=np.uint64), mix(h, 2).sum(dtype=np.uint64)])
    return int((sums[:1] * GOLD ^ sums[1:]).view(np.int64)[0])


@lru_cache(maxsize=64)
def bands(threshold: int, sizes: int = 1 << 28) -> tuple[int, ...]:
    """Upper bounds of the size bands, for a threshold in hundredths."""
    out = [1]
    while out[-1] < sizes:
        out.append(max(out[-1] + 1, out[-1] * 10_000 // threshold**2))
    return tuple(out)


def differences(n: int, m: int, threshold: int) -> int:
    """In how many shingles two linked sets of ``n`` and ``m`` can differ."""
    return (100 - threshold) * (n + m) // (100 + threshold)


@lru_cache(maxsize=4096)
def configuration(band: int, threshold: int) -> tuple[int, int]:
    """``(p, t)`` of a band: its first-level partitions, and how many of them links agree in at least."""
    top = bands(threshold)[band]
    needed = differences(top, top, threshold) // 2
    t = 1 + needed // 16
    spare = 1.0
    for _ in range(20):  # as many more as the largest sets leave with an empty subset, and two deviations
        p = needed + t + spare
        empty = min(1.0, CELLS * exp(-(CELLS - 1) * top / (CELLS * p)))
        spare = 1 + p * empty + 2 * sqrt(p * empty)
        if spare > needed + t:
            break
    return ceil(needed + t + spare), t


def signatures(h: np.ndarray, threshold: int = 80) -> np.ndarray:
    """PartEnum signatures of a set of sorted hashes; sets that can only link with equal ones have none."""
    out = []
    bounds, n = bands(threshold), len(h)
    most = 100 * n // threshold
    own, last = int(np.searchsorted(bounds, n)), int(np.searchsorted(bounds, most))
    for band in dict.fromkeys((own, last)):
        d = differences(n, min(most, bounds[band]), threshold)
        if not d:
            continue
        p, t = configuration(band, threshold)
        needed = d // 2 + t
        for level in range(LEVELS):
            x = h if not level else np.sort(mix(h, 10 + level))
            cell = (((x >> np.uint64(32)) * np.uint64(p * CELLS)) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sums, filled = np.zeros(p * CELLS, np.uint64), np.zeros(p * CELLS, bool)
            sums[cell[at]] = np.add.reduceat(mix(x, 3), at)
            filled[cell[at]] = True
            sums, filled = sums.reshape(p, CELLS), filled.reshape(p, CELLS)
            some = np.stack([filled[:, s].any(axis=1) for s in SUBSETS], axis=1)
            good = np.cumsum(some.all(axis=1))
            stop = int(np.searchsorted(good, needed)) + 1
            tag = np.uint64((band * LEVELS + level) << 40)
            place = tag + np.arange(min(stop, p) * CELLS, dtype=np.uint64).reshape(-1, CELLS)
            # Cells differ in weight, so that a subset's sum tells which cells it has.
            weighed = [sum(sums[:stop, c] * np.uint64(2 * c + 3) for c in s) for s in SUBSETS]
            made = mix(np.stack(weighed, axis=1) ^ (place * GOLD), 4)[some[:stop]]
            out.append((made << np.uint64(BAND_BITS)) | np.uint64(band))
            if stop <= p:
                break
        else:
            out.append((mix(h ^ np.uint64(band), 5) << np.uint64(BAND_BITS)) | np.uint64(SINGLE))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, 4 to 8 bits a shingle: bit i is set if an odd number of shingles falls on it."""
    bits = 64 << max(0, (4 * len(h) - 1).bit_length() - 6)
    odd = np.bincount((mix(h, 6) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap brought down to ``n`` words; parities of halves add up."""
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, threshold: int) -> bool:
    """A test that no link fails: sizes, and the differences that the bitmaps show."""
    if 100 * min(n_a, n_b) < threshold * max(n_a, n_b):
        return False
    words = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())
    return (100 + threshold) * apart <= (100 - threshold) * (n_a + n_b)


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


class Seen:
    """Keys met lately; two generations of ``most`` at most, so memory is bounded."""

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.young, self.old = most, set(), set()

    def add(self, key: int) -> bool:
        """Whether the key is new."""
        if key in self.young:
            return False
        if len(self.young) >= self.most:
            self.young, self.old = set(), self.young
        self.young.add(key)
        return key not in self.old


def _signed(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Rows ``(a, b, k, more)`` of every document, in one pass over the texts.

    ``(key, id, n, bitmap)`` for a set that is new to its task, with ``(signature,
    key, -1, null)`` for each signature; just ``(hash of id, id, -2 - n, key)`` for one met
    lately, so a hot set reaches a shuffle a few times per task.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int32()), ("more", pa.binary())])

    def made(sets: list[tuple], sigs: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        top = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*sets, strict=True), schema, strict=True)], schema=schema)
        if sigs:
            sizes = [len(x) for _, x in sigs]
            owner = np.repeat(np.array([key for key, _ in sigs], np.int64), sizes)
            rest = [np.concatenate([x for _, x in sigs]).view(np.int64), owner, np.full(len(owner), -1, np.int32)]
            top = pa.concat_tables([top, pa.Table.from_arrays([*map(pa.array, rest), pa.nulls(len(owner), pa.binary())], schema=schema)])
        return top.combine_chunks().to_batches()[0]

    def run(batches):
        seen = Seen()
        for batch in batches:
            sets, sigs, size = [], [], 0
            for i in range(batch.num_rows):
                doc, h = batch.column(0)[i].as_py(), shingles(batch.column(1)[i].as_py(), words)
                key = key_of(h)
                if len(h) and seen.add(key):
                    sets.append((key, doc, len(h), bitmap(h).tobytes()))
                    sigs.append((key, signatures(h, threshold)))
                    size += len(sigs[-1][1])
                else:
                    spread = int(mix(np.array([doc], np.int64).view(np.uint64)).view(np.int64)[0])
                    sets.append((spread, doc, -2 - len(h), key.to_bytes(8, "little", signed=True)))
                if size > 300_000:
                    yield made(sets, sigs)
                    sets, sigs, size = [], [], 0
            if sets:
                yield made(sets, sigs)

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "a long, b long, k int, more binary")


def _grouped(signed: DataFrame) -> DataFrame:
    """``(kind, x, y, z, w, n, bits)``: sets (0: key, id; with the bitmap once per key), signatures that several
    classes have (1: signature, key, ``met``: the smallest key and the ``NEXT`` next smaller ones with it) and copies (2: key, id)."""
    schema = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("met", pa.list_(pa.int64())), ("n", pa.int32()), ("bits", pa.binary())])

    def out(kind: int, x, y, met=None, n=None, bits=None) -> pa.RecordBatch:
        size = len(x)
        lists = pa.nulls(size, schema.field("met").type) if met is None else pa.ListArray.from_arrays(pa.array(np.arange(0, met.size + 1, met.shape[1], dtype=np.int32)), pa.array(met.reshape(-1)))
        rest = [pa.nulls(size, pa.int32()) if n is None else pa.array(n), pa.nulls(size, pa.binary()) if bits is None else bits]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(x), pa.array(y), lists, *rest], schema=schema)

    def run(batches):
        last_key = None
        # The last rows seen: signatures, keys and the smallest key of their group; whether the last one waits for another.
        sig, key, low, waits = *(np.zeros(0, np.int64) for _ in range(3)), False
        for batch in batches:
            a, b, k = (batch.column(i).to_numpy() for i in range(3))
            more = batch.column(3)
            if len(at := np.flatnonzero(k < -1)):
                keys = np.frombuffer(b"".join(more.take(pa.array(at)).to_pylist()), "<i8")
                yield out(2, keys, b[at], n=-2 - k[at])
            if len(at := np.flatnonzero(k >= 0)):
                names = a[at]
                fresh = np.concatenate([[names[0] != last_key], names[1:] != names[:-1]])
                maps = [m if f else None for m, f in zip(more.take(pa.array(at)).to_pylist(), fresh.tolist(), strict=True)]
                yield out(0, names, b[at], n=k[at], bits=pa.array(maps, pa.binary()))
                last_key = names[-1]
            if len(at := np.flatnonzero(k == -1)):
                sigs, keys = a[at], b[at]
                # Rows come sorted; those of one class under one signature are one.
                new = np.concatenate([[not len(sig) or sigs[0] != sig[-1] or keys[0] != key[-1]], (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1])])
                if not new.any():
                    continue
                held = len(sig)
                sigs, keys = np.concatenate([sig, sigs[new]]), np.concatenate([key, keys[new]])
                fresh = np.concatenate([[True], sigs[1:] != sigs[:-1]])
                smallest = keys[np.maximum.accumulate(np.where(fresh, np.arange(len(sigs)), 0))]
                if held:
                    smallest[sigs == sig[0]] = low[0]
                    smallest[sigs == sig[-1]] = low[-1]
                met = [smallest]
                for back in range(1, NEXT + 1):
                    before = np.concatenate([keys[:back], keys[:-back]])[: len(keys)]
                    same = np.concatenate([np.zeros(back, bool), sigs[back:] == sigs[:-back]])[: len(keys)]
                    met.append(np.where(same, before, smallest))
                # The first row of a group counts if another follows; the last one waits for the next batch.
                kept = ~fresh | np.concatenate([~fresh[1:], [False]])
                kept[:held] = False
                if held and waits:
                    kept[held - 1] = not fresh[held]
                if held and not fresh[held]:
                    kept[held] = True
                if kept.any():
                    yield out(1, sigs[kept], keys[kept], np.stack(met, axis=1)[kept])
                waits = bool(fresh[-1]) and keys[-1] == smallest[-1]
                sig, key, low = sigs[-NEXT:], keys[-NEXT:], smallest[-NEXT:]

    rows = signed.repartition("a").sortWithinPartitions("a", "b")
    return rows.mapInArrow(run, "kind int, x long, y long, met array<long>, n int, bits binary")


def _packed(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(key, z)``: one text of every set ``wanted(id, key)``, compressed for shuffles."""

    def rows(slices):
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices:
            # An id may have rows with other texts.
            yield [(key, pack((text or "").encode())) for key, text in part if key_of(shingles(text, words)) == key]

    texts = docs.join(small(wanted, 1_000_000), docs["doc_id"] == wanted["id"])
    return map_rows(texts.select("key", "text"), rows, "key long, z binary").dropDuplicates(["key"])


def _unpacked(z: bytes, words: int) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(z).decode(), words)


PAIR = "a long, b long, part_a long, part_b long, id_a long, id_b long"


def _verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """``(part_a, part_b)`` of those pairs of ``PAIR`` that link."""

    def rows(slices):
        at, held = None, None
        for part in slices:
            out = []
            for b, zb, za, part_a, part_b in part:
                if b != at:
                    at, held = b, _unpacked(zb, words)
                if similar(held, _unpacked(za, words), threshold):
                    out.append((part_a, part_b))
            if out:
                yield out

    ends = [pairs.select(F.col(f"id_{x}").alias("id"), F.col(x).alias("key")) for x in "ab"]
    packed = _packed(docs, ends[0].unionByName(ends[1]).dropDuplicates(["key"]), words)
    first, second = (packed.select(F.col("key").alias(x), F.col("z").alias(f"z{x}")) for x in "ab")
    return map_rows(pairs.join(first, "a").join(second, "b").select("b", "zb", "za", "part_a", "part_b"), rows, "part_a long, part_b long")


def _possible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs ``(a, b, part_a, part_b)`` that ``may_link``, as ``PAIR``."""

    def rows(slices):
        for part in slices:
            yield [(*row, ia, ib) for *row, ia, n, x, ib, o, y in part if may_link(n, np.frombuffer(x, np.uint64), o, np.frombuffer(y, np.uint64), threshold)]

    first, second = (classes.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "bits")]) for x in "ab")
    sized = pairs.join(first, "a").join(second, "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return map_rows(sized.select("a", "b", "part_a", "part_b", "id_a", "n_a", "bits_a", "id_b", "n_b", "bits_b"), rows, PAIR)


def _block_pairs(threshold: int):
    """Pairs of different components within a group of two blocks that may link."""

    def made(key, group):
        _, b1, b2 = key
        if len(group) < 2:
            return []
        own, keys, part, sizes = (np.array([g[i] for g in group], np.int64) for i in range(4))
        maps = [np.frombuffer(g[4], np.uint64) for g in group]
        words = min(map(len, maps))
        flat = np.array([folded(m, words) for m in maps])
        out = []
        for i in range(len(group) - 1):
            n, o = sizes[i], sizes[i + 1 :]
            apart = np.bitwise_count(flat[i + 1 :] ^ flat[i]).sum(axis=1, dtype=np.int64)
            near = ((100 + threshold) * apart <= (100 - threshold) * (n + o)) & (part[i + 1 :] != part[i]) & ((own[i + 1 :] != own[i]) | (b1 == b2))
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if may_link(int(n), maps[i], int(sizes[j]), maps[j], threshold):
                    x, y = (i, j) if keys[i] > keys[j] else (j, i)
                    out.append(tuple(int(v) for v in (keys[x], keys[y], part[x], part[y], group[x][5], group[y][5])))
        return out

    return made


def _needed(threshold: int):
    """How many signatures links of a band share at least, as an expression over ``sig``."""
    last = len(bands(threshold)) - 1
    least = [configuration(min(b, last), threshold)[1] if b != SINGLE else 1 for b in range(1 << BAND_BITS)]
    return F.element_at(F.array(*map(F.lit, least)), F.expr(f"cast(sig & {(1 << BAND_BITS) - 1} as int) + 1"))


def _linked(live: DataFrame, classes: DataFrame, docs: DataFrame, words: int, threshold: int, pairwise: int, block: int) -> DataFrame:
    """``(id, component)`` of the keys that link with another one."""
    needed = _needed(threshold).alias("needed")
    band = F.expr(f"sig & {(1 << BAND_BITS) - 1}")
    # A few rows for each signature of a class.
    met = live.select(F.col("key").alias("a"), F.explode(F.array_distinct("met")).alias("b"), band.alias("band"), needed)
    met = met.where("a <> b").groupBy("a", "b", "band").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n >= needed")
    met = cut(_possible(met.select("a", "b", F.col("a").alias("part_a"), F.col("b").alias("part_b")), classes, threshold))
    roots = cut(connected_components(_verified(met, docs, words, threshold).toDF("a", "b")))

    placed = live.select("sig", "key").join(roots.toDF("key", "root"), "key", "left").select("sig", "key", F.coalesce("root", "key").alias("part"))
    groups = placed.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p <> q").select("sig", "size")
    # ``hot``: how many large groups of the band a class is in.
    hot = F.sum((F.col("size") > pairwise).cast("int")).over(Window.partitionBy("key", band))
    contested = cut(placed.join(groups, "sig").select("sig", "key", "part", "size", hot.alias("hot"), needed))

    few = contested.where(F.col("size") <= pairwise).groupBy("sig", "needed").agg(F.sort_array(F.collect_list(F.struct("key", "part", "hot"))).alias("g"))
    # At most ``pairwise`` rows a group, so at most half as many pairs for each row.
    pairs = few.select("sig", "needed", F.explode(F.expr("flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> y.part <> x.part), y -> struct(y.key as a, x.key as b, y.part as part_a, x.part as part_b, least(x.hot, y.hot) as spare))))")).alias("p"))
    pairs = pairs.select("p.*", band.alias("band"), "needed").groupBy("a", "b", "part_a", "part_b", "band").agg(F.count("*").alias("n"), F.first("spare").alias("spare"), F.first("needed").alias("needed"))
    found = _possible(pairs.where("n + spare >= needed").select("a", "b", "part_a", "part_b"), classes, threshold)
    # Pairs that share large groups only: both have at least as many of these as links must share.
    large = contested.where((F.col("size") > pairwise) & (F.col("hot") >= F.col("needed")))
    if not large.isEmpty():
        count = F.ceil(F.col("size") / block)
        many = large.withColumns({"own": F.pmod(F.xxhash64("key"), count), "to": F.explode(F.sequence(F.lit(0).cast("long"), count - 1))})
        many = many.select("sig", F.least("own", "to").alias("b1"), F.greatest("own", "to").alias("b2"), "own", "key", "part").join(classes, "key")
        found = found.unionByName(map_groups(many.select("sig", "b1", "b2", "own", "key", "part", "n", "bits", "id"), ["sig", "b1", "b2"], _block_pairs(threshold), PAIR))
    # Further links between two components change nothing.
    links = _verified(cut(found.dropDuplicates(["a", "b"])), docs, words, threshold)
    joined = connected_components(links.toDF("a", "b"))
    return roots.toDF("id", "root").join(joined.toDF("root", "component"), "root", "left").select("id", F.coalesce("component", "root").alias("component")).unionByName(joined.join(roots.select("id"), "id", "left_anti"))


def components(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", pairwise: int = 16, block: int = 512, keyed: bool = False) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row; ``threshold`` in hundredths.

    ``keyed`` adds the set's ``key``, which tells rows that share an id apart.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    rows = cut(_grouped(_signed(named, words, threshold)))
    live = rows.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("key"), "met")
    sets = rows.where("kind <> 1").select(F.col("x").alias("key"), F.col("y").alias("id"), "n")
    classes = rows.where("kind = 0 and bits is not null").select(F.col("x").alias("key"), F.col("y").alias("id"), "n", "bits")
    parts = _linked(live, classes, named, words, threshold, pairwise, block)
    placed = sets.where("n > 0").join(parts.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lows = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    every = placed.join(lows, "root").select("id", "n", "component_id", "key").unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "key"))
    out = every.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "key")
    out = out.unionByName(_nameless(docs.where("doc_id is null"), id_col, words))
    return out if keyed else out.drop("key")


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, text_hash, key, n)`` of rows of ``(doc_id, text)``."""

    def rows(slices):
        for part in slices:
            yield [(doc, number, key_of(h), len(h)) for doc, number, h in ((d, x, shingles(t, words)) for d, x, t in part)]

    return map_rows(docs.select("doc_id", F.xxhash64("text"), "text"), rows, "doc_id long, text_hash long, key long, n long")


def _nameless(docs: DataFrame, id_col: str, words: int) -> DataFrame:
    """Rows without an id: their numbers of shingles, and no component."""
    return _keys(docs, words).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), "key")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with the smallest id of each component only; rows with a null id stay.

    Of rows that share an id, one stays for each component that the id stands for.
    """
    found = cut(components(docs, words, threshold, id_col, text_col, keyed=True).where(F.col(id_col).isNotNull()))
    ids = found.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("rows"), F.bool_or(F.col(id_col) == F.col("component_id")).alias("stays"))
    gone = cut(ids.where("not stays or rows > 1"))
    out = docs.join(small(gone.select("__id"), 1_000_000), docs[id_col] == F.col("__id"), "left_anti")
    repeated = gone.where("stays").select("__id")
    if repeated.isEmpty():
        return out
    some = docs.join(small(repeated, 1_000_000), docs[id_col] == F.col("__id"), "left_semi")
    keys = _keys(some.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), words)
    stands = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("doc_id"), "key", "n_shingles")
    chosen = keys.join(stands, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("text_hash").alias("__stands")).select(F.col("doc_id").alias("__id"), "__stands")
    hashed = some.withColumn("__hash", F.xxhash64(F.col(text_col).cast("string")))
    one = hashed.join(chosen, (hashed[id_col] == F.col("__id")) & (F.col("__hash") == F.col("__stands")), "left_semi")
    return out.unionByName(one.dropDuplicates([id_col, "__hash"]).drop("__hash"))


def op6_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM split
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT low.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM low LEFT JOIN sizes ON sizes.doc_id = low.id
"""
