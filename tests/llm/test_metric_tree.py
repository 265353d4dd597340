"""Search by M-trees against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.llm import metric_tree as mt

SCHEMA = "vec_id bigint, embedding array<double>, key int, v int, region int, score int"


def brute(vectors, names, queries, k):
    """Best ``(score, name)`` of each query row among all other rows, on Python's whole numbers."""
    out = {}
    for q in queries:
        found = []
        for i, v in enumerate(vectors):
            if i != q:
                score = sum(int(a) * int(b) for a, b in zip(vectors[q], v))
                found.append((-max(-(2**63), min(score, 2**63 - 1)), names[i] is None, names[i] or 0))
        out[q] = [(-s, None if none else n) for s, none, n in sorted(found)[:k]]
    return out


def clusters(rng, n, dims, spread=300):
    centers = rng.normal(0, 1000, (12, dims))
    return (centers[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dims))).astype(int)


@pytest.mark.parametrize("capacity", [4, 16, 128])
def test_one_tree(capacity):
    rng = np.random.default_rng(3)
    points = np.concatenate([clusters(rng, 700, 5), np.zeros((60, 5), int), np.full((90, 5), 7)])
    names = rng.integers(0, 400, len(points))
    pages = {i: mt.Page(leaf, ids, names[ids] if leaf else ids, points[objects], far, away) for i, (leaf, ids, objects, far, away) in enumerate(mt.load(points, capacity))}
    leaves = np.concatenate([p.ids for p in pages.values() if p.leaf])
    assert sorted(leaves) == list(range(len(points)))
    root = points[mt.distances(points, points.mean(0)).argmin()]
    run = mt.Search(pages, root)
    expected = brute(points, list(names), range(0, len(points), 9), 5)
    for q, best in expected.items():
        assert [(s, n) for s, n, _ in run.top(points[q], q, 5)] == best
        least = best[2][0]
        assert [(s, n) for s, n, _ in run.top(points[q], q, 5, float(least))] == [b for b in best if b[0] >= least]
    if capacity == 4:  # bounds save most products of clustered points
        assert run.computed < 0.75 * len(expected) * len(points)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(4)
    kept = mt.whole_rows(df)
    queries = kept.where(F.col("vec_id") % 10 == 0).select(F.col("key").alias("qkey"), "v", F.col("vec_id").alias("query_id"))
    found = mt.search(mt.build(kept, k, **options), queries, k, chunk=7)
    got = {}
    for r in sorted(found.join(queries.select("qkey", "query_id"), "qkey").collect(), key=lambda r: r["rank"]):
        got.setdefault((r["query_id"], r["qkey"]), []).append((r["score"], r["vec_id"]))
    return got


def expect(rows, k=5):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.clip(np.floor(256 * x), -(2.0**63), 2.0**63 - 1024)) if abs(x) > 1e15 else int(np.floor(256 * x)) for x in v] for _, v in rows]
    names = [i for i, _ in rows]
    queries = [j for j, n in enumerate(names) if n is not None and n % 10 == 0]
    return sorted([(names[q], best) for q, best in brute(whole, names, queries, k).items()], key=str)


def same(got, rows, k=5):
    assert sorted([(q, best) for (q, _), best in got.items()], key=str) == expect(rows, k)


@pytest.mark.parametrize("tree_rows", [40, 100_000])
def test_search_equals_all_products(spark, tree_rows):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v / 256]) for i, v in enumerate(clusters(rng, 500, 6))]
    rows += [(1000 + i, [0.5, -0.5, 1.0, 2.0, 0.0, 0.25]) for i in range(300)]  # copies hold a third of the table
    same(run(spark, rows, tree_rows=tree_rows), rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 2.0]), (10, [1.0, 2.0]), (20, [1.0, nan]), (30, None), (40, [None, 1.0]), (50, []), (60, [0.0, 0.0]), (None, [3.0, 1.0])]
    rows += [(70, [1.0, inf]), (80, [0.001, -0.001, 5.0]), (5, [1.5, 2.5]), (None, [3.0, 1.0]), (90, [1.0])]
    same(run(spark, rows), rows)
    few = [(10, [1.0, 2.0]), (11, [2.0, 2.0])]
    same(run(spark, few), few)
    assert run(spark, []) == {} and run(spark, [(10, [1.0])]) == {}


def test_products_beyond_doubles(spark):
    rows = [(i, [2.0**25 + i, 3.0, -(2.0**24) + 7 * i]) for i in range(40)]
    same(run(spark, rows, tree_rows=10), rows)
