"""Clusters around moving centroids, against full comparison in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from docquarry.llm.centroid_clusters import assign, centroid_clusters, pivot_distances, spread_pivots, squared

SCHEMA = "vec_id long, embedding array<float>, Cluster string, near int"


def brute(rows, clusters=16, rounds=3, size=64):
    kept = [
        (i, [math.floor(64 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    for turn in range(rounds + 1):
        placed = []
        for i, q in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(q, x)), c) for c, x in enumerate(centroids))
            placed.append((i, q, c, d))
        if turn == rounds:
            break
        for c in range(len(centroids)):
            members = [q for _, q, x, _ in placed if x == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for *_, d in placed)
    return sorted(
        ((i, c, d, sum(e for *_, x, e in placed if x == c), total, digest[c]) for i, _, c, d in placed), key=str
    )


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroid_clusters(frame).collect()), key=str)


def vectors(n, seed=3, spread=0.1):
    pick = random.Random(seed)
    middles = [[pick.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [m + pick.gauss(0, spread) for m in pick.choice(middles)]) for i in range(n)]


def test_against_brute_force(spark):
    rows = [(i, np.float32(v).tolist()) for i, v in vectors(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # copies tie
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[11][1]), (None, rows[11][1])]
    bad = list(rows[0][1])
    rows += [(900, None), (901, []), (902, bad[:63]), (903, bad + [0.0]), (904, [None, *bad[1:]]), (905, [float("nan"), *bad[1:]]), (906, [float("-inf"), *bad[1:]]), (907, [-1e5, *bad[1:]])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    rows = [(i, np.float32(v).tolist()) for i, v in vectors(n)] + [(77, None)]
    assert run(spark, rows) == brute(rows)


def test_all_alike_leaves_centroids_empty(spark):
    rows = [(i, [0.25] * 64) for i in range(40)]
    found = run(spark, rows)
    assert found == brute(rows) and {r[1] for r in found} == {0}


def test_distances_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e12] * 64)])


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_lose_a_centroid(seed):
    make = np.random.default_rng(seed)
    centroids = make.integers(-1000, 1000, (16, 64)) * [1, 2, 50, 5000][seed]
    q = centroids[make.integers(0, 16, 3000)] + make.integers(-90, 90, (3000, 64))
    q[:50] = (centroids[0] + centroids[1]) // 2
    pivots = spread_pivots(q[::7], 16)
    cluster, distance, compared = assign(q, pivot_distances(q, pivots), centroids, pivot_distances(centroids, pivots))
    full = np.stack([squared(q, c) for c in centroids], 1)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert compared < len(q) * 16 * 0.6  # of all comparisons
