"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cover_tree


def test_matches_brute_force_with_ties_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.2).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 760)]  # ties
    rows += [(900, None), (901, [float("nan")] * 12), (902, [None, *[1.0] * 11]), (903, [math.inf] * 12), (950, [1.0, 2.0]), (951, [2.0, 1.0]), (None, [1.0] * 12), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", cover_tree.quantise("embedding"))
    got = cover_tree.top_k(df, df.filter(F.col("vec_id") % 50 == 0), k=5).collect()
    own = {r["vec_id"]: r["v"] for r in df.filter("v is not null and vec_id is not null").collect()}
    want = {}
    for q in own:
        if q % 50 == 0:
            s = sorted((-int(np.dot(own[q], v)), k) for k, v in own.items() if k != q and len(v) == len(own[q]))
            want |= {(q, i + 1): (k, -x) for i, (x, k) in enumerate(s[:5])}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_tree_invariants():
    x = np.random.default_rng(2).integers(-300, 300, (900, 8))
    t = cover_tree.Tree(x)
    for (at, _, _), (lower, parent, radius) in zip(t.levels, t.levels[1:], strict=False):
        assert (lower[: len(at)] == at).all()  # nesting
        assert (parent[: len(at)] == np.arange(len(at))).all()
        assert len(radius) == len(lower)
    for j in range(len(t.levels[-1][0])):
        d = np.sqrt(((x[t.leaf(j)] - x[t.levels[-1][0][j]]) ** 2).sum(axis=1))
        assert (d <= t.levels[-1][2][j]).all()  # covering
    assert sorted(t.order.tolist()) == list(range(900))


def test_walk_prunes_clustered_data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3000
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    best = cover_tree.Best(20, 5)
    scored = cover_tree.walk(cover_tree.Tree(x[:20]), x[:20], np.arange(20), cover_tree.Tree(x), x, np.arange(4000), best)
    assert scored < 20 * 4000 / 2


def test_products_stay_exact_or_fail():
    big = np.array([[1 << 40, 3]], np.int64)
    assert cover_tree.products(big, np.array([[1 << 20, 1]], np.int64))[0, 0] == (1 << 60) + 3
    with pytest.raises(OverflowError):
        cover_tree.products(np.array([[1 << 62]]), np.array([[1 << 40]]))


def test_fewer_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1, 2]), (50, [3, 4])], "vec_id long, v array<bigint>")
    assert [tuple(r) for r in cover_tree.top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 50, 11)]
    assert cover_tree.top_k(df.limit(0), df.limit(0)).count() == 0
    assert cover_tree.top_k(df.limit(0), df).count() == 0
