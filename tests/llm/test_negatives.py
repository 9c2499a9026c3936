import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import negatives
from tabsieve.llm.negatives import hard_negatives


def plain(rows, anchor, positives=5, keep=3, window=(50, 95)):
    """Every anchor against every row."""
    used = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            used[i] = min(used.get(i, (label, whole)), (label, whole))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in used.items():
        if anchor(a):
            scored = sorted((-dot(v, w), i, other) for i, (other, w) in used.items() if i != a)
            for s, p, _ in [x for x in scored if x[2] == label][:positives]:
                good = [(i, -n) for n, i, other in scored if other != label and window[0] * -s <= 100 * -n <= window[1] * -s]
                out += [(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(good[:keep])]
    return sorted(out)


def mined(spark, rows, by=10, **settings):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, rank int")
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % by == 0, F.col("label"), **settings).collect())


def clustered(n, d, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (8, d))
    return [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.1, d)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("d", [1, 3, 16])
def test_equal_to_plain_search_over_many_trees(spark, monkeypatch, d):
    monkeypatch.setattr(negatives, "TREE_ROWS", 100)
    monkeypatch.setattr(negatives, "BLOCK", 20)
    rows = clustered(700, d, 3, d)
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_ties_and_a_hot_vector(spark):
    """Half of the rows share one vector, so ids settle almost everything."""
    rows = [(i, [0.5, -0.25] if i % 2 else [(i % 5) / 10, -(i % 3) / 5], i % 3) for i in range(400)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=2, negatives=40, window=(10, 100)) == plain(rows, lambda i: i % 10 == 0, 2, 40, (10, 100))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 1.5], 1), (10, [1.0], 1), (20, [], 2), (30, None, 1), (40, [1.0, None], 1),
            (50, [nan, 1.0], 1), (60, [inf, 1.0], 1), (None, [1.0, 2.0], 1), (70, [1.0, 2.0], None), (1, [0.9, 1.9], 1), (2, [0.7, 1.2], 2),
            (3, [0.8, 0.7], 3), (4, [-1.0, -1.0], 1), (5, [0.0, 0.0], 2), (80, [-3.0, 1.0], 5), (90, [100000.0, -90000.0], 2), (6, [90000.0, 1.0], 1),
            (7, [120000.0, 1.0], 2)]
    got = mined(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0) and got
    assert mined(spark, rows[:0]) == [] and mined(spark, rows, by=1000) == plain(rows, lambda i: i % 1000 == 0)
    assert mined(spark, rows[5:9]) == []


def test_boxes_are_left_out(spark):
    """On clustered vectors of few dimensions most pages are never opened."""
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(0, 60, (4000, 2)))
    order = np.concatenate(list(negatives._tile(vectors, np.arange(4000), [0, 1], -(-4000 // negatives.PAGE))))
    assert sorted(order) == list(range(4000))
    tree = negatives.Tree(*(x.tobytes() for x in (order.astype(np.int64), (order % 3).astype(np.int64), vectors[order].astype(np.int32))), 2)
    opened = []
    product = negatives._products
    negatives._products = lambda a, b, exact: opened.append(b.shape[0] * a.shape[0]) or product(a, b, exact)
    try:
        ids = np.arange(10)
        lowest = np.full((10, 1), -(1 << 62)), np.full((10, 1), 1 << 62)
        rows = negatives.search(tree, ids, ids % 3, vectors[:10], *lowest, True, 5)
    finally:
        negatives._products = product
    want = [sorted((-int(vectors[a] @ vectors[i]), i) for i in range(4000) if i != a and i % 3 == a % 3)[:5] for a in range(10)]
    assert [(int(s), int(-v), int(i)) for s, v, i in rows] == [(a, s, i) for a in range(10) for s, i in want[a]]
    assert sum(opened) < 0.5 * 10 * 4000
