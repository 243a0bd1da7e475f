"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vigilframe.llm import spelling

DOCS = "doc_id long, text string, word string, n int, half string, root string"


def docs(spark, rows):
    """Documents with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "w", 1, "h", "r") for i, t in rows], DOCS)


def plain(rows, slips=97):
    """The words' rows by comparing all pairs of words with each other."""
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    met = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: (b if n[b := min(v, key=lambda x: (-n[x], x))] >= 2 * n[w] else None) if (v := met[w]) else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(met[w]), n[form[w]] if form[w] else None))
    return out


EDGE = [(900, None), (901, ""), (902, "a b c"), (903, "\u00e9t\u00e9s\u00d7 \u00c9T\u00c9S\u00f7 stra\u00dfe"), (None, "nullid nullid nullid"), (904, "again again"), (904, "again again"), (905, "x" * 5_000 + " " + "x" * 4_999 + " " + "y" + "x" * 4_999), (905, "x" * 5_000 + " " + "x" * 4_999 + " " + "y" + "x" * 4_999), (905, "x" * 5_000 + " " + "x" * 4_999 + " " + "y" + "x" * 4_999), (906, "word " * 20_000)]


@pytest.mark.parametrize("block_bytes", [256_000, 300])
def test_variants_equal_all_pairs(spark, block_bytes):
    rng = random.Random(2)
    words = ["".join(rng.choice("ab\u00e9") for _ in range(rng.randint(4, 8))) for _ in range(250)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa"]
    weights = [rng.choice([1, 2, 5, 20]) for _ in words]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=60))) for i in range(60)] + EDGE
    got = [tuple(r) for r in spelling.group_variants(docs(spark, rows), slips=7, block_bytes=block_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 7)
    assert any(r[1] != r[2] for r in got if r[1])


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "one two")]):
        got = spelling.group_variants(docs(spark, rows))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 100])
def test_rectangles_equal_brute_force(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    left, low = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
    right, high = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
    q, v = spelling.WaveletTree(values).report(left, right, low, high)
    want = {(k, int(x)) for k in range(50) for x in values[left[k] : right[k]] if low[k] <= x < high[k]}
    assert len(q) == len(want) and set(zip(q.tolist(), v.tolist(), strict=True)) == want
