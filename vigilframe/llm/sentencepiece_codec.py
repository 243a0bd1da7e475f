"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read field by field and rebuilt: the normaliser, the
marker for blanks, unigram scores or the merges that BPE scores imply, and byte
fallback.  Tasks encode and decode their rows in batches on ``threads`` threads.

Parity with the sentencepiece library: where a model's words do not depend on each other,
each distinct word of a text is encoded by both libraries and compared, not the text as a
whole; other models compare whole texts.  Decoding is compared with the text itself, not
with the library's decoder.

Null texts count as empty and have no ids.  Repeated rows are encoded each.  Very
long texts are encoded whole, as one member of their batch.  Other columns are not
read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import Known, map_rows, table

MARK = "▁"
#: Numbers of the protobuf's fields and of its enumerations.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
UNKNOWN, BYTE = 2, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool


def parse(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == PIECE:
            held = dict(fields(value))
            pieces.append((held.get(1, b"").decode(), struct.unpack("<f", held[2])[0] if 2 in held else 0.0, held.get(3, 1)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best joined score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-pieces[i][1], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def _words_apart(model: Model) -> bool:
    """No piece goes on past a marker, so nothing joins across the end of a word."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == 1)


def build(data: bytes):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model file says."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse(data)
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model.pieces), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if _words_apart(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "removed", invert=True)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


@dataclass
class Codec:
    """Both libraries with one model, and the words encoded before in this worker.

    ``words``: the model's words are independent, so a text's ids are those of its
    words.  ``odd``: words for which the libraries disagree.
    """

    tokenizer: object
    processor: object
    words: bool
    known: Known
    odd: set[str]


@functools.lru_cache(maxsize=2)
def _loaded(path: str, threads: int) -> Codec:
    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true" if threads > 1 else "false"
    from sentencepiece import SentencePieceProcessor

    with open(path, "rb") as f:
        data = f.read()
    model, tokenizer = parse(data), build(data)
    plain = model.dummy_prefix and not model.squeeze and not model.charsmap and _words_apart(model) and tokenizer.token_to_id(MARK) is not None
    return Codec(tokenizer, SentencePieceProcessor(model_proto=data), plain, Known(700_000), set())


_WORD = re.compile(" *[^ ]+| +")


def _split(text: str) -> list[str]:
    """A text's words, each with the blanks before it less the one that the dummy prefix stands for.

    A marker in the text is a blank, as for both libraries.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        parts = _WORD.findall(text)
        return parts[:1] + [p[1:] for p in parts[1:]]
    return text.split(" ") if text else []


def encode(texts: list[str], codec: Codec, threads: int) -> tuple[list[bytes], list[bool]]:
    """Ids of whole texts (little-endian unsigned 32-bit), and whether the sentencepiece library gives the same.

    With independent words, words not met lately are encoded by both libraries, in
    batches on their threads; other models encode and compare whole texts.
    """

    def both(batch: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in codec.tokenizer.encode_batch_fast(batch, add_special_tokens=False)], codec.processor.encode(batch, num_threads=threads)

    if not codec.words:
        ours, theirs = both(texts)
        ours = [g if t else [] for g, t in zip(ours, texts, strict=True)]
        return [np.array(g, "<u4").tobytes() for g in ours], [a == b for a, b in zip(ours, theirs, strict=True)]
    codec.known.age()
    held = codec.known.young
    words = [_split(t) for t in texts]
    new = list(codec.known.recall({w for some in words for w in filterfalse(held.__contains__, some)}))
    for start in range(0, len(new), 20_000):
        part = new[start : start + 20_000]
        ours, theirs = both(part)
        codec.odd.update(w for w, a, b in zip(part, ours, theirs, strict=True) if a != b and w)
        held.update(zip(part, [np.array(a, "<u4").tobytes() for a in ours], strict=True))
    # A text's last blank is the marker alone; an empty text has no ids at all.
    held[""] = codec.tokenizer.token_to_id(MARK).to_bytes(4, "little")
    return [b"".join(map(held.__getitem__, some)) for some in words], [codec.odd.isdisjoint(some) if codec.odd else True for some in words]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, batch: int = 1024, ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_crc32, same_word_ids, round_trip, ids)`` for every row.

    ``model_path`` must be readable on every executor.  ``same_word_ids``:
    the sentencepiece library gives the same ids, for each word of the text where words
    are independent, else for the whole text.  ``round_trip``: the ids decode to
    the text.  ``ids_crc32`` covers the ids as little-endian unsigned 32-bit.
    """

    def rows(slices):
        codec = _loaded(model_path, threads)
        for part in slices:
            for start in range(0, len(part), batch):
                some = part[start : start + batch]
                texts = [text or "" for _, text in some]
                coded, same = encode(texts, codec, threads)
                got = [np.frombuffer(c, "<u4").tolist() for c in coded]
                back = codec.tokenizer.decode_batch(got, skip_special_tokens=False)
                yield [(doc, len(g), zlib.crc32(c), s, b == text, g if ids else None) for (doc, _), text, c, g, s, b in zip(some, texts, coded, got, same, back, strict=True)]

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = map_rows(chosen, rows, "doc_id long, n_tokens long, ids_crc32 long, same_word_ids boolean, round_trip boolean, ids array<int>")
    return out.withColumnRenamed("doc_id", id_col)


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False).drop("ids")
