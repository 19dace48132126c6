"""Centroid clustering against brute force in plain Python integers, the curve against its defining property."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import centroids


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_on_the_grid(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = centroids.hilbert_keys(grid, bits)
    assert len(set(keys)) == len(grid)
    walk = grid[sorted(range(len(grid)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_no_nearest_centroid_is_left_out():
    rng = np.random.default_rng(3)
    for _ in range(300):
        c = rng.integers(-9, 10, (7, 4))
        x = rng.integers(-3, 4, (6, 4)) + rng.integers(-9, 10, 4)
        some = centroids.candidates(x.min(axis=0), x.max(axis=0), c)
        for exact in (True, False):
            at, d = centroids.nearest(x, c[some], exact)
            every = [min((int(((v - m) ** 2).sum()), j) for j, m in enumerate(c)) for v in x]
            assert [(int(b), int(some[a])) for a, b in zip(at, d, strict=True)] == every


def brute(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return [(i, j, d, sum(e for _, e, o in last if o == j), total, c[j]) for i, d, j in last]


@pytest.mark.parametrize("wide", [1.0, 60_000.0])
def test_clusters_against_brute_force(spark, wide):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * wide).tolist()) for i in range(150)]
    rows += [(200 + i, [0.25 * wide] * 4) for i in range(140)]  # one common vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0]), (303, [1.0, float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("id", F.lit(1)).repartition(5)
    shares = []
    got = centroids.cluster(table, k=6, dims=4, scale=64, report=shares.append)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, 6, 3, 4, 64), key=str)
    assert len(shares) == 4 and all(0 < s <= 1 for s in shares)


def test_boxes_leave_centroids_out_and_blocks_hold_every_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) / 50 + (i % 8) * np.array([1.0, -1.0, 0.5, 2.0])).tolist()) for i in range(3000)]
    shares = []
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8, dims=4, report=shares.append)
    assert got.count() == 3000 and shares[-1] < 0.5


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 5.0])], "vec_id int, embedding array<float>")
    assert sorted(map(tuple, centroids.cluster(two, dims=2, scale=1).select("vec_id", "distance", "inertia").collect())) == [(1, 0, 0), (2, 0, 0)]
    none = centroids.cluster(two.where("vec_id > 5"), dims=2)
    assert none.columns[-1] == "centroid" and none.count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id int, embedding array<double>"), dims=2).collect()
