import math

import numpy as np
import pytest

from sampleloom.llm import knn as N

SCHEMA = "vec_id long, embedding array<float>, label int, part int, v string, rank int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", 2) for i, v in vectors], SCHEMA)


def brute(vectors, k):
    rows = [(i, np.asarray(np.asarray(v, np.float32), np.float64)) for i, v in vectors]
    out = {}
    for i, v in rows:
        d = sorted((math.sqrt(((v - w) ** 2).sum()), j) for j, w in rows if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
        assert r.rank == len(out[r.vec_id])
    return out


@pytest.mark.parametrize(("kind", "group"), [("random", 40), ("clusters", 25), ("line", 30), ("grid", 10_000)])
def test_equals_brute_force(spark, kind, group):
    rng = np.random.default_rng(4)
    if kind == "random":
        x = rng.normal(size=(200, 24))
    elif kind == "clusters":
        x = rng.normal(size=(8, 6))[rng.integers(0, 8, 220)] * 50 + rng.normal(size=(220, 6))
    elif kind == "line":
        x = np.arange(150)[:, None] * np.ones((1, 3))
    else:
        x = rng.integers(0, 3, (180, 3)).astype(float)  # many ties and equal vectors
    vectors = list(enumerate(x.tolist()))
    assert result(N.knn_join(table(spark, vectors), 5, 16, group)) == brute(vectors, 5)


def test_clusters_are_not_sent_everywhere(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 400)] * 500 + rng.normal(size=(400, 6))
    rows, dim = N.clean_vectors(table(spark, list(enumerate(x.tolist()))))
    pivots = x[:20]
    d = N._distances(x, pivots)
    cell, own = d.argmin(1), d.min(1)
    summary = {i: (int((cell == i).sum()), float(own[cell == i].max()), np.sort(own[cell == i])[:6].tolist()) for i in range(20) if (cell == i).any()}
    plan = N._Plan(pivots, summary, 5, 50)
    need = np.logical_or.reduceat((d <= plan.reach[None, :])[:, plan.order], plan.cuts, axis=1)
    assert dim == 6 and need.mean() < 0.6


def test_large_cells_are_shared_out(spark):
    rng = np.random.default_rng(5)
    vectors = list(enumerate(rng.normal(size=(120, 4)).tolist()))
    assert result(N.knn_join(table(spark, vectors), 3, 2, 10)) == brute(vectors, 3)


def test_awkward_rows(spark):
    good = [(i, [float(i % 4), 1.0]) for i in range(9)]
    bad = [(None, [1.0, 2.0]), (20, None), (21, []), (22, [1.0]), (23, [1.0, None]), (24, [float("nan"), 1.0]), (25, [float("inf"), 0.0]), (0, [0.0, 1.0])]
    assert result(N.knn_join(table(spark, good + bad), 4)) == brute(good, 4)
    assert N.knn_join(table(spark, [])).count() == 0
    assert N.knn_join(table(spark, [(1, [1.0])])).count() == 0
    assert result(N.knn_join(table(spark, [(1, [1.0]), (2, [2.0])]), 10)) == {1: [2], 2: [1]}
