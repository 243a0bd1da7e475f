"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Each worker packs its own documents, without hearing of others.  A document of n
tokens belongs to the reciprocal class k with capacity / (k + 1) < n <= capacity / k;
a sequence of class k takes k documents of that class, whole.  The gap that they
leave, less than capacity / (k + 1), is filled with later documents: with one that
fits whole, or, when the open gaps together hold as much as a sequence, with one
that is cut at their ends.  Longer documents give full sequences first; the rest is
treated as a document.

What a worker has left at its end (unfinished classes and sequences with a gap) is
laid end to end and cut at the capacity, and the last cut at the binary digits of
its length.  So all sequences are full or a power of two long: none has padding.

Null and empty texts are one end token.  Repeated rows are packed once each.  An
empty table gives an empty result.  Null ids are kept.  Other columns are not
read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import Known, map_rows, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer; one for words of small letters, which need no normalising; the word-end tokens; what `_apart` leaves alone."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    added = [re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, bare, ends, "(?i)" + "|".join(["[\u0300-\u036f]", *added])


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"[{_LETTERS}]+")
#: A letter and a mark that no contraction rule of the tokenizer touches.
_MARKED = rf"([{_LETTERS}])([!-&(-/:-@\[-`{{-~])"


def _apart(texts: pa.Array, path: str) -> pa.Array:
    """Texts with the same ids and fewer different chunks: A-Z lower-cased, a blank between a letter and a mark.

    Not where a mark may be composed with a letter before it, nor where the text has one
    of the tokenizer's added tokens, in any case: these are found before lower-casing.
    """
    out = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKED, r"\1 \2")
    odd = pc.match_substring_regex(texts, _tokenizer(path)[3])
    return pc.replace_substring(pc.if_else(odd, texts, out), "\n", " ")


def _encode_words(words: list[str], path: str) -> list[bytes]:
    """Ids of words of letters; many at once, told apart by their word-end tokens."""
    _, bare, ends, _ = _tokenizer(path)
    out = []
    for start in range(0, len(words), 500):
        part = words[start : start + 500]
        ids = np.array(bare.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(part):
            data, last = ids.tobytes(), 0
            for stop in (4 * stops).tolist():
                out.append(data[last:stop])
                last = stop
        else:
            out += _encode_each(part, path)
    return out


def _encode_each(chunks: list[str], path: str) -> list[bytes]:
    got = _tokenizer(path)[0].encode_batch_fast(chunks, add_special_tokens=False)
    return [np.array(x.ids, "<u4").tobytes() for x in got]


#: Chunks encoded before in this worker, by tokenizer file; kept across tasks.
_KNOWN: dict[str, Known] = {}


def encode_by_chunk(texts: list[str], path: str, known: Known) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its space-separated chunks.  Each different chunk of the texts is
    looked up once; those met lately aren't encoded again.
    """
    known.age()
    held = known.young
    split = pc.split_pattern(_apart(pa.array(texts, pa.large_string()), path), " ")
    coded = split.flatten().dictionary_encode()
    chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = list(map(held.get, chunks))
    holes = [i for i, x in enumerate(found) if x is None]
    new = known.recall({chunks[i] for i in holes})
    words = list(filter(_WORD.fullmatch, new))
    others = list(new.difference(words))
    held.update(zip(words, _encode_words(words, path), strict=True))
    held.update(zip(others, _encode_each(others, path), strict=True))
    for i in holes:
        found[i] = held[chunks[i]]
    ids = pa.array(found, pa.large_binary()).take(coded.indices)
    return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()


class Packer:
    """One worker's open sequences.  A piece is ``(document, start, ids as bytes, tokens of the document)``.

    At most ``k`` pieces of class k wait, so the waiting ones hold ``capacity`` tokens a
    class at most; the open gaps together hold less than two capacities.
    """

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.number, self.done = capacity, first, []
        self.waiting: dict[int, list[tuple]] = {}
        self.gaps: deque[list] = deque()
        self.missing = 0

    def put(self, pieces: list[tuple]) -> None:
        """A finished sequence."""
        at = 0
        for doc, start, ids, n in pieces:
            length = len(ids) // 4
            self.done.append((doc, start, length, zlib.crc32(ids), n, self.number, at))
            at += length
        self.number += 1

    def add(self, piece: tuple) -> None:
        doc, start, ids, n = piece
        whole = 4 * self.capacity
        while len(ids) >= whole:
            self.put([(doc, start, ids[:whole], n)])
            start, ids = start + self.capacity, ids[whole:]
        if not ids:
            return
        size = len(ids) // 4
        if self.gaps and (size <= self.gaps[0][1] or self.missing >= self.capacity):
            self.fill((doc, start, ids, n))
            return
        k = self.capacity // size
        group = self.waiting.setdefault(k, [])
        group.append((doc, start, ids, n))
        if len(group) == k:
            del self.waiting[k]
            gap = self.capacity - sum(len(x[2]) for x in group) // 4
            if gap:
                self.gaps.append([group, gap])
                self.missing += gap
            else:
                self.put(group)

    def fill(self, piece: tuple) -> None:
        doc, start, ids, n = piece
        while ids:
            # While the gaps hold a capacity, they hold any piece.
            group, gap = self.gaps[0]
            part, ids = ids[: 4 * gap], ids[4 * gap :]
            size = len(part) // 4
            group.append((doc, start, part, n))
            self.gaps[0][1] -= size
            self.missing -= size
            start += size
            if size == gap:
                self.gaps.popleft()
                self.put(group)

    def end(self) -> None:
        """Finishes what is open."""
        rest = [x for group, _ in self.gaps for x in group] + [x for k in sorted(self.waiting) for x in self.waiting[k]]
        self.gaps.clear()
        self.waiting.clear()
        total = sum(len(x[2]) for x in rest) // 4
        sizes = [self.capacity] * (total // self.capacity)
        left = total % self.capacity
        sizes += [1 << d for d in range(left.bit_length() - 1, -1, -1) if left >> d & 1]
        queue = deque(rest)
        for room in sizes:
            held = []
            while room:
                doc, start, ids, n = queue.popleft()
                part, ids = ids[: 4 * room], ids[4 * room :]
                held.append((doc, start, part, n))
                room -= len(part) // 4
                if ids:
                    queue.appendleft((doc, start + len(part) // 4, ids, n))
            self.put(held)

    def taken(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", remember: bool = True) -> DataFrame:
    """One row per piece: document, place in it, sequence and place there.

    ``remember``: a worker keeps the chunks that it knows for its later tasks and takes
    larger slices of texts, which is faster and holds a few hundred MB.

    ``capacity`` must be a power of two.  A sequence's number tells the worker's task
    and the sequence's place in it, so nothing is shuffled.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(4, "little")

    def rows(slices):
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        known = _KNOWN.setdefault(tokenizer_path, Known()) if remember else Known(50_000)
        for part in slices:
            for (doc, _), ids in zip(part, encode_by_chunk([t or "" for _, t in part], tokenizer_path, known), strict=True):
                packer.add((doc, 0, ids + end, len(ids) // 4 + 1))
            if packer.done:
                yield packer.taken()
        packer.end()
        if packer.done:
            yield packer.taken()

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, PIECES, chars=4_000_000 if remember else 1_000_000).withColumnRenamed("doc_id", id_col)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
