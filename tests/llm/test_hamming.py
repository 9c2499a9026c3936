import numpy as np
from pyspark.sql import functions as F

from tabsieve.llm.hamming import top_k


def brute(rows, k):
    out = set()
    rows = [(i, v) for i, v in rows if i is not None and v is not None]
    size = max((len(v) for _, v in rows), default=0)
    code = lambda v: np.array([*(x is not None and x > 0 for x in v), *[False] * (size - len(v))])
    codes = [(i, code(v)) for i, v in rows]
    for q, a in codes:
        if q % 100 == 0:
            near = sorted({(int((a != b).sum()), i) for i, b in codes if i != q})
            out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])}
    return out


def as_rows(df):
    return {(r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in df.collect()}


def test_exact_with_hot_codes_and_spread_ones(spark):
    """A third of the rows share one code; others are random, so their search has to grow its radius."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 1, (900, 32))
    vectors[::3] = vectors[0]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert as_rows(top_k(df, F.col("vec_id") % 100 == 0, 10)) == brute(rows, 10)


def test_awkward_rows(spark):
    rows = [(0, [1.0, -1.0, 2.0]), (100, [1.0, -1.0]), (200, []), (300, None), (None, [1.0, 1.0, 1.0]), (1, [None, -1.0, 1.0]),
            (2, [0.0] * 20), (3, [float(k % 2) for k in range(20)])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, rank int")
    got = as_rows(top_k(df, F.col("vec_id") % 100 == 0, 10))
    assert got == brute(rows, 10) and {q for q, *_ in got} == {0, 100, 200}
    twice = df.unionByName(df)
    assert as_rows(top_k(twice, F.col("vec_id") % 100 == 0, 10)) == got
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).collect() == []
