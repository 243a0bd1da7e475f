"""Secret scans with multipart credential linking.

Whole texts are searched for strong spans (assigned secrets, access identifiers,
long hexadecimal runs) and for weak parts: account names, opaque mixed tokens and
endpoints.  A weak part alone says nothing; an interval join of the parts of a
document reports it only when complementary parts lie within ``scope`` code points
of it, from the end of one to the start of the other: an account needs a secret, an opaque token an identifier, an
endpoint both.  Strong spans always stay.

Null texts are empty and give no spans.  Repeated rows are searched each.  Spans
are in code points, end exclusive.  Other columns are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilframe.llm.common import cut, map_rows, small, table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
BASE = 3
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ACCOUNT = re.compile(r"(?i:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]{3,})", re.ASCII)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")
_ENDPOINT = re.compile(r"(?i:https?)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?i:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}", re.ASCII)
SPAN = "struct<start: long, kind: int, stop: long>"
#: What an assignment, an account and a host name must be followed by; a text without any is spared those searches.
_MARKS = re.compile(r"[:=]")


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """All strong spans and weak parts of a text as (start, kind number, stop)."""
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _MARKS.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        out += [(m.start(), 3, m.end()) for m in _ACCOUNT.finditer(text)]
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    # Tokens and strong spans both come by start: the furthest end of the spans that begin before a token's end tells.
    taken = sorted((a, b) for a, k, b in out if k < BASE)
    at = reached = 0
    for m in _OPAQUE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reached = max(reached, taken[at][1])
            at += 1
        if reached <= m.start() and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]):
            out.append((m.start(), 4, m.end()))
    return sorted(out)


#: Kinds that identify and kinds that are secrets, as bits by kind number.
IDENTIFIERS, SECRETS = 1 << 1 | 1 << 3, 1 << 0 | 1 << 2 | 1 << 4


def _complements(kind: str) -> Column:
    """The kinds that a part of this kind needs beside it, as bits: secrets, identifiers, or, for an endpoint, both."""
    k = F.col(kind)
    return F.when(k.isin(1, 3), SECRETS).when(k.isin(0, 2, 4), IDENTIFIERS).otherwise(SECRETS | IDENTIFIERS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """``(row, id, text_hash, base, spans, links)`` for every row; arrays of (start, kind, stop), sorted.

    ``links`` are those of ``spans`` that have complementary parts in scope, each with
    the kinds of these (``with``, bits by kind number).
    """

    def rows(slices):
        for part in slices:
            found = [(doc, number, spans_of(text or "")) for doc, number, text in part]
            yield [(doc, number, [s for s in spans if s[1] < BASE], spans) for doc, number, spans in found]

    text = F.col(text_col).cast("string")
    found = map_rows(docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text), rows, f"doc_id long, text_hash long, base array<{SPAN}>, parts array<{SPAN}>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    part = found.where("size(parts) > 1").select("row", F.explode("parts").alias("p")).select("row", "p.*")
    blocks = lambda low, high: F.explode(F.expr(f"sequence(greatest({low}, 0) div {scope}, ({high}) div {scope})")).alias("block")
    near = part.select("row", F.col("start").alias("at"), F.col("stop").alias("to"), F.expr("shiftleft(1, kind)").alias("bit"), blocks("start", "stop"))
    asks = part.select("*", _complements("kind").alias("needs"), blocks(f"start - {scope}", f"stop + {scope}"))
    # The inner interval join: parts of one row that are at most ``scope`` apart and of complementary kinds.
    met = asks.join(near, ["row", "block"]).where(f"at - stop <= {scope} and start - to <= {scope} and needs & bit <> 0")
    linked = met.groupBy("row", "start", "kind", "stop").agg(F.bit_or("bit").alias("with")).where(f"kind <> 5 or (`with` & {SECRETS} <> 0 and `with` & {IDENTIFIERS} <> 0)")
    link = "struct<start: long, kind: int, stop: long, with: int>"
    more = linked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "with"))).alias("links"))
    weak = F.expr(f"transform(filter(links, s -> s.kind >= {BASE}), s -> named_struct('start', s.start, 'kind', s.kind, 'stop', s.stop))")
    out = found.join(more, "row", "left").withColumn("links", F.coalesce("links", F.expr(f"cast(array() as array<{link}>)")))
    return out.select("row", F.col("doc_id").alias(id_col), "text_hash", "base", F.array_sort(F.concat("base", weak)).alias("spans"), "links")


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')")


def linked_kinds(links: str) -> Column:
    """``kind:start:stop=kind+kind`` of each link, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    others = f"array_join(transform(filter(sequence(0, {len(KINDS) - 1}), k -> getbit(s.with, k) = 1), k -> element_at(array({names}), k + 1)), '+')"
    return F.expr(f"array_join(transform({links}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop, '=', {others})), ',')")


def _replaced(text: str, linked: str | None) -> str:
    """A text with its strong spans and the given linked parts replaced."""
    spans = [s for s in spans_of(text) if s[1] < BASE]
    if linked:
        spans = sorted(spans + [tuple(map(int, s.split(":"))) for s in linked.split(",")])
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _redacted(text: pd.Series, linked: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else _replaced(t, x) for t, x in zip(text, linked, strict=True)], dtype=object)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``[kind]``; rows and columns stay.

    Of overlapping spans the first one names the replacement.  Strong spans are found
    again where the text is; only linked parts, in few documents, are joined to it.
    """
    parts = F.expr(f"array_join(transform(filter(spans, s -> s.kind >= {BASE}), s -> concat_ws(':', s.start, s.kind, s.stop)), ',')")
    hits = scan(docs, id_col, text_col, scope).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), parts.alias("__linked")).where("__linked <> ''").dropDuplicates(["__id", "__hash"])
    joined = docs.join(small(cut(hits), 500_000), docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left")
    return joined.withColumn(text_col, _redacted(F.col(text_col), F.col("__linked"))).select(docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        linked_kinds("links").alias("links"),
    )
