"""Clusters against plain k-means in exact integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from meterbook.llm import shallot_clusters as op


def slow(rows, k=8, rounds=10, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(1024 * x) for x in v)))
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in drawn[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = tuple(sum(c) // len(g) for c in zip(*g, strict=True))
    found = [(i, *near(v)) for i, v in kept]
    total, by = sum(d for _, d, _ in found), {}
    for _, d, j in found:
        by[j] = by.get(j, 0) + d
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def run(spark, rows, **sizes):
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, id string")
    found = op.cluster(docs, **sizes)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(seed, n, coarse):
    rng = random.Random(seed)
    bases = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(11)]
    rows = [(i, [round(x + rng.gauss(0, 0.1), 1 if coarse else 9) for x in rng.choice(bases)]) for i in range(n)]
    return rows + rows[:30]


ODD = [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 63 + [None]), (904, [0.0] * 63 + [float("nan")]), (905, [float("inf")] + [0.0] * 63), (None, [0.5] * 64)]


@pytest.mark.parametrize("coarse", [False, True])
def test_clusters_match_plain_search(spark, coarse):
    rows = vectors(4, 300, coarse) + ODD
    assert run(spark, rows) == slow(rows)


def test_few_and_equal_vectors(spark):
    rows = [(i, [0.25] * 64) for i in range(40)] + [(50, [0.5] * 64)]
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows[-3:]) == slow(rows[-3:])
    assert run(spark, [(1, [0.1] * 64)]) == slow([(1, [0.1] * 64)])
    assert run(spark, ODD[:-1]) == []
    assert run(spark, []) == []


def test_components_beyond_longs_take_no_part(spark):
    rows = vectors(5, 40, False)
    got = run(spark, [*rows, (7000, [1e300] + [0.0] * 63)])
    assert [r for r in got if r[0] == 7000] == [(7000, None, None, None, None, None)]
    assert [r for r in got if r[0] != 7000] == slow(rows)
    edge = [(1, [131071.0, *[-131071.0] * 63]), (2, [-131071.0, *[131071.0] * 63]), (3, [0.0] * 64)]
    assert run(spark, edge, k=1) == slow(edge, 1)


def test_bounds_spare_most_distances():
    """The search measures less than all distances and finds what a full scan finds."""
    rng = np.random.default_rng(2)
    bases = rng.normal(0, 900, (20, 64))
    data = (bases[rng.integers(0, 20, 3000)] + rng.normal(0, 150, (3000, 64))).astype(np.int32)
    at = data[:20].astype(np.int64)
    state, now, counts = op.fresh(len(data)), op.Centroids(at, np.zeros(20)), []
    for _ in range(8):
        counts.append(op.search(data, state, now))
        full = np.stack([op.squared(data, c) for c in now.at])
        assert (state["near"] == full.argmin(axis=0)).all()
        own = np.sqrt(full[state["near"], np.arange(len(data))])
        assert (state["upper"] >= own).all()
        full[state["near"], np.arange(len(data))] = np.iinfo(np.int64).max
        assert (state["lower"] <= np.sqrt(full.min(axis=0))).all()
        after = np.array([data[state["near"] == c].sum(axis=0, dtype=np.int64) // max(1, (state["near"] == c).sum()) for c in range(20)])
        now = op.Centroids(after, np.sqrt([float(((a - b) ** 2).sum()) for a, b in zip(after, now.at, strict=True)]) * (1 + 1e-9))
    assert counts[-1] < len(data) * 20 / 4
