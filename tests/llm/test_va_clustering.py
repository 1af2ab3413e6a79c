"""Clustering on approximations against the rounds done plainly in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import va_clustering

INF, NAN = math.inf, math.nan


def plain(rows):
    """The contract, vector by vector; rows without an id start a centroid last."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _i, v in order[:8]]

    def near(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    for _ in range(10):
        own = [near(v)[0] for _i, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_i, v), k in zip(kept, own) if k == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = {c: sum(d for _i, k, d in got if k == c) for c in range(len(centroids))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), shas[k]) for i, k, d in got), key=repr)


def results(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def frame(spark, rows):
    made = [(i, v, "c", 1, 2) for i, v in rows]
    return spark.createDataFrame(made, "vec_id bigint, embedding array<double>, cells string, row int, cluster int")


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    good = rng.normal(0, 0.2, (40, 64)).tolist()
    ties = [[float(k % 3)] * 64 for k in range(30)]
    rows = list(enumerate(good + ties)) + [
        (100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [0.0] * 63 + [None]), (105, [0.0] * 63 + [NAN]),
        (106, [0.0] * 63 + [-INF]), (None, good[0]), (7, good[7]), (7, good[8]), (8, [0.0] * 64), (9, [40_000.0] + [-1e-9] * 63)]
    got = results(va_clustering.judged(frame(spark, rows)))
    assert got == plain(rows) and len(got) == 75


@pytest.mark.parametrize("count", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, count):
    rows = [(i, [i / 7] * 64) for i in range(count)]
    assert results(va_clustering.judged(frame(spark, rows))) == plain(rows)


def test_beyond_the_range_takes_no_part(spark):
    rows = [(1, [0.5] * 64), (2, [1e30] + [0.0] * 63)]
    assert results(va_clustering.judged(frame(spark, rows))) == plain(rows[:1])


def test_intervals_enclose_and_settle():
    """Bounds hold for vectors of the sample and others; on well parted vectors nearly all are settled by them."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-800, 800, (8, 64))
    vectors = centres[rng.integers(0, 8, 3000)] + rng.integers(-60, 61, (3000, 64))
    vectors[0] = 5000
    grid = va_clustering.Grid(vectors[::10], vectors.min(axis=0), vectors.max(axis=0))
    cells = grid.cells(vectors)
    at = np.arange(64)
    assert (grid.left[at, cells] <= vectors).all() and (vectors <= grid.right[at, cells]).all()
    mean = centres.sum(axis=0) // 8
    far = ((vectors[:, None] - centres) ** 2).sum(axis=2) - ((vectors - mean) ** 2).sum(axis=1)[:, None]
    least, most = va_clustering.intervals(cells, grid.tables(centres))
    assert (least <= far).all() and (far <= most).all()
    assert ((least <= most.min(axis=1, keepdims=True)).sum(axis=1) == 1).mean() > 0.99


def test_full_vectors_are_not_shuffled(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    seen = []
    moved = va_clustering._moved

    def look(fetched, centroids):
        seen.append(fetched._jdf.queryExecution().executedPlan().toString())
        return moved(fetched, centroids)

    va_clustering._moved = look
    try:
        va_clustering.clustered(rows.filter(F.col("vec_id") < 100), rounds=2)
    finally:
        va_clustering._moved = moved
    for plan in seen:
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(exchanges) == 1, plan
