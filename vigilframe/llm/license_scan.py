"""License scans by an exact set-similarity join with license templates.

A text's words are cut into blocks of ``BLOCK`` words, each half overlapping the
next.  A block matches a template when it contains at least ``threshold`` of the
template's distinct words.  The join finds every such block: the words of all
templates are ordered by their frequency over all documents, rarest first; a
matching block must contain one of the first words of the template in this order
(prefix filter), have enough words (length filter), and have enough words left
behind the first one that both share (positional filter).  Survivors are verified:
enough of the template's words must stand within ``STRETCH`` times as many words as
the template has, so that common words scattered over a block are no match.

Null texts are empty.  A text shorter than a block is one block.  Repeated rows
are scanned each.  Other columns are not read.  The templates are few and fixed,
so their words and the join's index are small whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, map_rows, table

#: The phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of well-known license notices, by label.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
BLOCK = 64
#: How many times a template's length the words that match it may be spread over.
STRETCH = 2
_SPACED = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return text.encode().lower().translate(_SPACED).split()


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(0, n)] if n <= BLOCK else [(s, min(n, s + BLOCK)) for s in range(0, n - BLOCK // 2, BLOCK // 2)]


def word_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest over all documents first."""
    vocabulary = {w.encode() for t in templates for w in t.split()}

    def rows(slices):
        counts: Counter = Counter()
        for part in slices:
            for (text,) in part:
                counts.update(filter(vocabulary.__contains__, words_of(text or "")))
        yield [(w.decode(), n) for w, n in counts.items()]

    found = map_rows(docs, rows, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    times = dict.fromkeys((w.decode() for w in vocabulary), 0) | {r[0]: r[1] for r in found}
    return sorted(times, key=lambda w: (times[w], w))


def tightest(places: list[int], tokens: list[int], wanted: set[int], need: int) -> int | None:
    """The least number of consecutive words that hold ``need`` different wanted tokens; None if all of them hold fewer."""
    hits = [(p, t) for p, t in zip(places, tokens, strict=True) if t in wanted]
    held: Counter = Counter()
    best, left = None, 0
    for place, token in hits:
        held[token] += 1
        while len(held) >= need:
            first, old = hits[left]
            best = place - first + 1 if best is None else min(best, place - first + 1)
            held[old] -= 1
            if not held[old]:
                del held[old]
            left += 1
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: ``(id, n_words, places, matches)``.

    ``places`` are (word number, label) of the phrases, ``matches`` (block start,
    block stop, template number, label, containment) of the templates.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string"))
    rank = {w: i for i, w in enumerate(word_order(texts, templates))}
    known = {w.encode(): i for w, i in rank.items()}
    index = []
    for number, (template, label) in enumerate(templates.items()):
        tokens = sorted({rank[w] for w in template.split()})
        need = ceil(threshold * len(tokens) - 1e-9)
        longest = STRETCH * len(template.split())
        index += [(token, place, number, label, tokens, need, longest) for place, token in enumerate(tokens[: len(tokens) - need + 1])]
    first = {row[0] for row in index}
    sought = [(tuple(p.encode() for p in phrase.split()), label) for phrase, label in phrases.items()]
    starts = {phrase[0] for phrase, _ in sought}
    of_interest = starts | known.keys()

    def rows(slices):
        for part in slices:
            out = []
            for doc, text in part:
                words = words_of(text or "")
                seen = [(i, w) for i, w in enumerate(words) if w in of_interest]
                places = [(i, label) for i, w in seen if w in starts for phrase, label in sought if tuple(words[i : i + len(phrase)]) == phrase]
                marked = [(i, known[w]) for i, w in seen if w in known]
                blocks = []
                if any(k in first for _, k in marked):
                    at = 0
                    for start, stop in _blocks(len(words)):
                        while at < len(marked) and marked[at][0] < start:
                            at += 1
                        inside = [(i, k) for i, k in marked[at : at + BLOCK] if i < stop]
                        held = sorted({k for _, k in inside})
                        if not first.isdisjoint(held):
                            blocks.append((start, stop, held, [i - start for i, _ in inside], [k for _, k in inside]))
                out.append((doc, len(words), places, blocks))
            yield out

    place, match = "struct<word: long, label: string>", "struct<start: long, stop: long, template: int, label: string, containment: double>"
    found = map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, f"doc_id long, n_words long, places array<{place}>, blocks array<struct<start: long, stop: long, tokens: array<int>, at: array<int>, marks: array<int>>>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    prefixes = spark.createDataFrame(index, "token int, t_place int, template int, label string, t_tokens array<int>, need int, longest int")
    block = found.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    # Of a block's words only those that are a template's prefix words can meet the index, which has a row for each of these.
    asked = F.array_intersect("tokens", F.array(*[F.lit(t) for t in sorted(first)]).cast("array<int>"))
    probe = block.select("row", "start", "stop", "tokens", "at", "marks", F.explode(asked).alias("token")).withColumn("place", F.array_position("tokens", F.col("token")) - 1)
    shared = F.size(F.array_intersect("tokens", "t_tokens"))
    candidates = probe.join(F.broadcast(prefixes), "token").where("size(tokens) - place >= need and size(t_tokens) - t_place >= need")
    # Verified before repeats go, so that only blocks that match are shuffled.
    likely = candidates.where(shared >= F.col("need")).withColumn("containment", shared / F.size("t_tokens")).dropDuplicates(["row", "start", "template"])

    def close(slices):
        for part in slices:
            yield [row[:6] for row in part if (n := tightest(row[6], row[7], set(row[8]), row[9])) is not None and n <= row[10]]

    asked = likely.select("row", "start", "stop", "template", "label", "containment", "at", "marks", "t_tokens", "need", "longest")
    verified = map_rows(asked, close, "row long, start long, stop long, template int, label string, containment double")
    verified = verified.select("row", F.struct("start", "stop", "template", "label", "containment").alias("m"))
    matches = verified.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    return found.join(matches, "row", "left").select(F.col("doc_id").alias(id_col), "n_words", "places", F.coalesce("matches", F.expr(f"cast(array() as array<{match}>)")).alias("matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda *sets: F.array_join(F.array_sort(F.array_distinct(F.concat(*sets))), ",")
    base, own = F.col("places.label"), F.col("matches.label")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, own).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
    )
