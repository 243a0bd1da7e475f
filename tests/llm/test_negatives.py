"""Hard negatives against all scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import hard_negatives

ROWS = "vec_id long, embedding array<double>, label int, id int, x string, score int, part int"


def plain(rows, every, count=5):
    usable = {}
    for i, v, label in rows:
        if None not in (i, v, label) and len(v) and all(c is not None and np.isfinite(c) for c in v):
            usable[i] = min(usable.get(i, (str(label), v)), (str(label), v))
    out = set()
    for a in (i for i in usable if i % every == 0):
        label, v = usable[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in usable.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:count]:
            wanted = [(s, j) for s, j, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p][:count]
            out |= {(a, i, k, j, int(-p), int(-s)) for k, (s, j) in enumerate(wanted, 1)}
    return out


def vectors(spark, rows):
    """Vectors with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, 1, "x", 2, 3) for i, v, label in rows], ROWS)


@pytest.mark.parametrize("block_bytes, part_rows", [(4_000_000, 16_384), (300, 40)])
def test_negatives_equal_all_scores(spark, block_bytes, part_rows):
    rng = np.random.default_rng(3)
    centres = rng.integers(-9, 10, (4, 6))
    # A third of the rows has one label; few distinct values make ties.
    rows = [(i, [int(c) for c in centres[i % 4] + rng.integers(-3, 4, 6)], 0 if i % 3 == 0 else int(rng.integers(1, 4))) for i in range(-200, 200)]
    rows += [(500, None, 1), (510, [], 1), (520, [1] * 6, None), (None, [9] * 6, 1), (530, [None] + [1] * 5, 1), (540, [float("nan")] + [1] * 5, 1), (550, [float("inf")] * 6, 0)]
    rows += [(560, [2, 3], 0), (561, [2, 3], 0), (562, [2, 3], 1), (570, [0] * 6, 0), (580, [5] * 6, 1), (580, [5] * 6, 1), (580, [4] * 6, 2), (590, [7] * 6, 77)]
    got = [tuple(r) for r in hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, block_bytes=block_bytes, part_rows=part_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 10)


def test_no_usable_rows(spark):
    for rows in ([], [(1, None, 1)], [(10, [1, 2], 1)]):
        got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.count() == 0


def test_brackets_hold_and_exclude():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(100, 8)) for c in 20 * rng.normal(size=(5, 8))])
    most = float(np.sqrt((x**2).sum(1).max()))
    pivots = hard_negatives.pick_pivots(np.column_stack([x, hard_negatives.further(x, most)]), 8)
    far, asked = hard_negatives.distances(x, hard_negatives.further(x, most), pivots), hard_negatives.distances(x[:20], np.zeros(20), pivots)
    low, high = hard_negatives.brackets((x[:20] ** 2).sum(1), asked, far, most)
    score = x[:20] @ x.T
    assert (low <= score).all() and (score <= high).all()
    # Vectors in clusters: most rows cannot be among an anchor's first five.
    assert (high >= np.sort(score, axis=1)[:, [-5]]).mean() < 0.7
