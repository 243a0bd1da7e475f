"""Near-duplicate embeddings against brute force."""

from __future__ import annotations

import numpy as np

from vigilframe.llm import embedding_dedup


def by_brute_force(rows, threshold=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = (label, x / np.linalg.norm(x))
    links, low = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                low[root(b)] = root(a)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (links[k], least[root(k)]) for k, (i, *_) in enumerate(rows)}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(40):
        base = rng.normal(size=64)
        for _ in range(int(rng.choice([1, 2, 6, 30]))):
            rows.append((base + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.25, 0.3]), int(g % 3)))
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [1.0] + [float("nan")] * 63, 1), (n + 3, rows[0][1], None), (n + 4, [], 1), (n + 5, [None] + [1.0] * 63, 1), (n + 6, [1.0, 2.0, 2.0], 1), (n + 7, [1.0, 2.0, 2.0], 1), (n + 8, [float("inf")] * 64, 0), (n + 9, [5.0], 0), (n + 10, [7.0], 0)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n int, cls string")
    for block in (512, 8):
        got = embedding_dedup.near_duplicates(table, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == by_brute_force(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_of_the_buckets():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a, b = (embedding_dedup.buckets(v, 10, 2) for v in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * z))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.999


def test_hadamard_is_orthonormal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
