"""The partitioned neighbour search against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import neighbours as nn
from turfline.operators.neighbours import Cuts

SCHEMA = "gameid int, playid int, a double, b double, label string"


def cloud(n, seed, hot=0.0, grid=None):
    """Random points; a share ``hot`` of them lies on one spot, ``grid`` makes ties."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if r.random() < hot:
            a, b = 3.0, 3.0
        else:
            a, b = (r.gauss(0, 5), r.gauss(0, 1)) if grid is None else (float(r.randrange(grid)), float(r.randrange(grid)))
        out.append((1, i, a, b, r.choice("xyz")))
    return out


def brute(train, query, k, same_fold=lambda t, q: False):
    got = {}
    for q in query:
        d = sorted((((q[2] - t[2]) ** 2 + (q[3] - t[3]) ** 2), t[4]) for t in train if not same_fold(t, q))
        if not d:
            got[q[1]] = None
            continue
        edge = d[min(k, len(d)) - 1][0]
        votes = Counter(lab for dist, lab in d if dist <= edge)
        got[q[1]] = min(votes, key=lambda lab: (-votes[lab], lab))
    return got


@pytest.mark.parametrize(
    "train_rows, leaf, hot, grid",
    [(300, 10_000, 0.0, None), (900, 40, 0.0, None), (900, 40, 0.4, None), (900, 40, 0.0, 12), (3, 40, 0.0, None)],
)
def test_votes_equal_brute_force(spark, train_rows, leaf, hot, grid):
    train, query = cloud(train_rows, 1, hot, grid), cloud(200, 2, hot, grid)
    got = nn.knn_classify(
        spark.createDataFrame(train, SCHEMA), spark.createDataFrame(query, SCHEMA), ("a", "b"), "label", 7,
        leaf_points=leaf, chunk_queries=17,
    )
    assert {r["playid"]: r["pred"] for r in got.collect()} == brute(train, query, 7)


def test_small_leaves_are_really_used(spark, monkeypatch):
    seen = []
    original = Cuts.through
    monkeypatch.setattr(Cuts, "through", staticmethod(lambda p, n: seen.append(n) or original(p, n)))
    train = spark.createDataFrame(cloud(900, 1), SCHEMA)
    nn.knn_votes(train, train, ("a", "b"), "label", [3], leaf_points=40).count()
    assert seen == [23]


@pytest.mark.parametrize("grid, hot", [(None, 0.0), (None, 0.4), (15, 0.0)])
def test_large_leaves_get_trees_of_their_own(spark, monkeypatch, grid, hot):
    """A tiny sample leaves few, large leaves in the upper tree; no task compares more points than a few leaves hold."""
    monkeypatch.setattr(nn, "MOST_SAMPLED", 25)
    sizes = spark.sparkContext.accumulator(0)
    search = nn._candidates

    def counted(a, b, *rest):
        if len(b) > 300:
            sizes.add(1)
        return search(a, b, *rest)

    monkeypatch.setattr(nn, "_candidates", counted)
    train, query = cloud(3000, 1, hot, grid), cloud(300, 2, hot, grid)
    t, q = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(query, SCHEMA)
    got = nn.knn_classify(t, q, ("a", "b"), "label", 7, leaf_points=60, chunk_queries=50)
    assert {r["playid"]: r["pred"] for r in got.collect()} == brute(train, query, 7)
    assert sizes.value == 0


def test_folds_below_large_leaves(spark, monkeypatch):
    from turfline.functions.sampling import kfold

    monkeypatch.setattr(nn, "MOST_SAMPLED", 10)
    points = cloud(1200, 5, hot=0.2)
    df = spark.createDataFrame(points, SCHEMA)
    fold = {r["playid"]: r["fold"] for r in kfold(df, ("gameid", "playid")).collect()}
    got = {r["k"]: r["correct"] for r in nn.knn_cv(df, ("a", "b"), "label", (9,), scale=False, leaf_points=40).collect()}
    pred = brute(points, points, 9, lambda t, q: fold[t[1]] == fold[q[1]])
    assert got[9] == sum(pred[r[1]] == r[4] for r in points)


def tied(n, share=0.6, seed=0):
    """Points of which a share lies at the greatest value of the widest axis."""
    r = np.random.default_rng(seed)
    x = r.uniform(0, 100, (n, 2)) * (1, 0.01)
    x[r.random(n) < share, 0] = 100
    return x


def test_cuts_always_divide():
    points = tied(4000)
    cuts = Cuts.through(points, 32)
    sizes = np.bincount(cuts.home(points), minlength=cuts.leaves)
    assert cuts.leaves >= 32 and sizes.min() > 0 and sizes.max() <= 4000 / 16
    same = Cuts.through(np.ones((50, 2)), 8)
    assert same.leaves == 1


def test_bounds_hold_and_few_leaves_are_reached():
    points = tied(4000)
    cuts = Cuts.through(points, 32)
    leaf = cuts.home(points)
    import pandas as pd

    box = pd.DataFrame([(i, -1, (leaf == i).sum(), points[leaf == i].min(0), points[leaf == i].max(0)) for i in range(cuts.leaves)],
                       columns=["leaf", "fold", "n", "low", "high"])
    extents = nn.Extents.of(cuts, box, 2)
    queries = tied(200, seed=1)
    bound = extents.bound(queries, None, 10)
    exact = np.sort(((queries[:, None] - points[None]) ** 2).sum(2), 1)[:, 9]
    assert np.isfinite(bound).all() and (bound >= exact).all()
    idx, _ = cuts.reach(queries, np.sqrt(exact))
    assert len(idx) / len(queries) < 8
    assert np.isinf(extents.bound(queries, None, 5000)).all()


@pytest.mark.parametrize("leaf", [30, 10_000])
def test_ties_at_the_edge_equal_brute_force(spark, leaf):
    x, q = np.round(tied(600), 1), np.round(tied(80, seed=3), 1)
    r = random.Random(9)
    train = [(1, i, float(a), float(b), r.choice("xyz")) for i, (a, b) in enumerate(x)]
    query = [(1, i, float(a), float(b), "x") for i, (a, b) in enumerate(q)]
    got = nn.knn_classify(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(query, SCHEMA), ("a", "b"), "label", 7, leaf_points=leaf)
    assert {r["playid"]: r["pred"] for r in got.collect()} == brute(train, query, 7)


def test_many_k_in_one_search(spark):
    train, query = cloud(400, 3), cloud(100, 4)
    t, q = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(query, SCHEMA)
    got = {r["k"]: (r["count"], r["correct"]) for r in nn.knn_tune(t, q, ("a", "b"), "label", (1, 5, 20), leaf_points=50).collect()}
    for k in (1, 5, 20):
        pred = brute(train, query, k)
        assert got[k] == (100, sum(pred[r[1]] == r[4] for r in query))


@pytest.mark.parametrize("leaf", [50, 10_000])
def test_cross_validation_leaves_out_the_own_fold(spark, leaf):
    from turfline.functions.sampling import kfold

    points = cloud(500, 5, hot=0.3)
    df = spark.createDataFrame(points, SCHEMA)
    fold = {r["playid"]: r["fold"] for r in kfold(df, ("gameid", "playid")).collect()}
    got = {r["k"]: r["correct"] for r in nn.knn_cv(df, ("a", "b"), "label", (3, 9), scale=False, leaf_points=leaf).collect()}
    for k in (3, 9):
        pred = brute(points, points, k, lambda t, q: fold[t[1]] == fold[q[1]])
        assert got[k] == sum(pred[r[1]] == r[4] for r in points)


def test_rows_with_a_missing_feature_get_no_vote(spark):
    train = spark.createDataFrame(cloud(50, 1), SCHEMA)
    query = spark.createDataFrame([(1, 1, 0.0, None, None), (1, 2, 0.0, 0.0, None)], SCHEMA)
    got = {r["playid"]: r["pred"] for r in nn.knn_classify(train, query, ("a", "b"), "label", 3).collect()}
    assert got[1] is None and got[2] is not None


def test_label_type_is_kept(spark):
    train = spark.createDataFrame(cloud(50, 1), SCHEMA).withColumn("label", F.when(F.col("label") == "x", 1).otherwise(0))
    got = nn.decision_grid(train, {"a": range(2), "b": range(2)}, "label", 3)
    assert got.schema["pred"].dataType.simpleString() == "int" and got.count() == 4


def test_cells_reached_cover_every_point():
    r = np.random.default_rng(0)
    points = r.normal(size=(2000, 3))
    cuts = Cuts.through(points[:500], 16)
    queries, radius = r.normal(size=(50, 3)), r.uniform(0, 1.5, 50)
    home_idx, home = cuts.reach(points, np.zeros(len(points)))
    leaf_of = np.empty(len(points), int)
    leaf_of[home_idx] = home
    assert sorted(home_idx) == list(range(len(points)))
    qi, leaf = cuts.reach(queries, radius)
    reached = set(zip(qi.tolist(), leaf.tolist()))
    for i, q in enumerate(queries):
        near = np.flatnonzero(((points - q) ** 2).sum(1) <= radius[i] ** 2)
        assert all((i, leaf_of[p]) in reached for p in near)
