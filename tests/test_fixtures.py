"""Micro fixtures of FIXTURES.md part C (expected values computed from pandas/numpy semantics)."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.missing import pct, to_number
from tabsieve.functions.text import normalize_category
from tabsieve.operators import binning, cleaning, distribution, encoding, freq, profile, splitting
from tabsieve.operators.splitting import split_sizes


def _bins(spark, values, n, dtype="double"):
    if dtype == "double":
        values = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r.b for r in binning.quantile_bins(df, "x", n, "b").orderBy("i").collect()]


def test_quantile_bins(spark):
    assert _bins(spark, [1, 2, 3, 4, 5, 6, 7, 8], 4) == ["0", "0", "1", "1", "2", "2", "3", "3"]
    assert _bins(spark, [1, 2, 3, 4, None], 2) == ["0", "0", "1", "1", "<NA>"]
    assert _bins(spark, [1, 1, 1, 1, 5, 6], 4) == ["0", "0", "0", "0", "1", "1"]
    assert _bins(spark, [3, 3, 3], 4) == ["<NA>"] * 3
    assert _bins(spark, [None, None], 4) == ["<NA>"] * 2
    assert _bins(spark, ["1", "x", "3", "4"], 2, "string") == ["0", "<NA>", "0", "1"]


def test_target_quantiles_and_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "y double")
    r = profile.explore_target(df, "y").collect()[0]
    assert (r.q1, r.median, r.q3) == (1.75, 2.5, 4.75)
    assert r.std == pytest.approx(4.08248290463863)
    one = profile.explore_target(spark.createDataFrame([(5.0,)], "y double"), "y").collect()[0]
    assert one.std is None


def test_to_number(spark):
    good = ["1", " 2 ", "1e3", "+5", ".5", "5."]
    bad = ["1d", "1f", "0x10", "1_000", "1,000", "", "True", "1L", "nan"]
    inf = ["inf", "-Infinity"]
    df = spark.createDataFrame([(s,) for s in good + bad + inf], "s string")
    got = [r[0] for r in df.select(to_number(F.col("s"))).collect()]
    assert got[:6] == [1, 2, 1000, 5, 0.5, 5]
    assert got[6:15] == [None] * 9
    assert got[15] == math.inf and got[16] == -math.inf


def test_percentage_rounding(spark):
    df = spark.createDataFrame([(1, 8), (2675, 100000), (12345, 100000), (1005, 100000)], "c long, n long")
    got = [r[0] for r in df.select(F.bround(F.col("c") / F.col("n") * 100, 2)).collect()]
    assert [r[0] for r in df.select(pct(F.col("c"), F.col("n"))).collect()] == got
    assert got[0] == 12.5


def test_split_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (2, 6, 10, 14)], "n long")
    assert [r[0] for r in df.select(split_sizes(F.col("n"), 0.75)).collect()] == [2, 4, 8, 10]


def test_split_counts_fixture(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    out = splitting.stratified_split(orders, "p", ["o_orderkey"], 0.80, 42, stratum_col="s")
    got = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert got[("1-URGENT", "train")] == 2382 and got[("1-URGENT", "validation")] == 596
    assert got[("Unknown", "train")] == 2397 and got[("Unknown", "validation")] == 599
    assert out.count() == 15000 and out.select("o_orderkey").distinct().count() == 15000
    again = splitting.stratified_split(orders.repartition(3), "p", ["o_orderkey"], 0.80, 42)
    a = {r.o_orderkey for r in splitting.train_part(out.drop("s")).collect()}
    b = {r.o_orderkey for r in splitting.train_part(again).collect()}
    assert a == b


def test_split_window_form_equals_bucket_form(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderstatus")
    out = splitting.stratified_split(orders, "o_orderstatus", ["o_orderkey"], 0.7, 7)
    from pyspark.sql import Window
    h = F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit("7")))
    w = Window.partitionBy("o_orderstatus").orderBy(h, "o_orderkey")
    n = F.count(F.lit(1)).over(Window.partitionBy("o_orderstatus"))
    ref = orders.select("o_orderkey", F.when(F.row_number().over(w) <= F.bround(n * 0.7, 0), "train")
                        .otherwise("validation").alias("split"))
    assert out.select("o_orderkey", "split").exceptAll(ref).count() == 0


def test_binary_encode(spark):
    df = spark.createDataFrame([("Sí",), ("No",), (None,), (" SI ",), ("x",), ("1",), ("Sí",)], "c string")
    got = [r.c for r in cleaning.encode_binary(df, "c").collect()]
    assert got == [1, 0, None, 1, None, None, None]


def test_one_hot_null_and_unseen(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    model = encoding.fit_one_hot(train, ["c"])
    test = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    got = [tuple(r) for r in model.transform(test).collect()]
    assert model.transform(test).columns == ["ca", "cb"]
    assert got == [(1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        encoding.fit_one_hot(train, ["c"], max_categories=1)


def test_normalise_category(spark):
    vals = ["Automática", "Ñandú", "d·s", "ø ß", "½ ﬁ", None, "  Gris_Oscuro - x "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(normalize_category(F.col("v"))).collect()]
    assert got == ["automatica", "nandu", "d·s", "ø ß", "1⁄2 fi", "missing", "gris oscuro x"]


def test_category_table_merges_missing(spark):
    df = spark.createDataFrame([("Missing",), (None,), ("a",)], "c string")
    got = [(r.category, r["count"], r["rank"]) for r in freq.category_table(df, ["c"]).orderBy("rank").collect()]
    assert got == [("Missing", 2, 1), ("a", 1, 2)]


def test_duplicates_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("nan"), None), (1.0, "x")], "a double, b string")
    r = profile.duplicate_rows(df).collect()[0]
    assert (r.total_rows, r.duplicate_rows) == (3, 1)


def test_category_summary_counts_null(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "c string")
    assert profile_summary(spark, df) == 2


def profile_summary(spark, df):
    return freq.category_summary(df, ["c"]).collect()[0].unique_categories


def test_histogram_bins(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    got = [r["count"] for r in distribution.histogram_by_group(df, "v", "g", 3).orderBy("bin").collect()]
    assert got == [1, 1, 2]
    same = spark.createDataFrame([("g", 5.0)] * 3, "g string, v double")
    rows = distribution.histogram_by_group(same, "v", "g", 2).orderBy("bin").collect()
    assert [(r.bin_start, r.bin_end) for r in rows] == [(4.5, 5.0), (5.0, 5.5)]


def test_histogram_matches_numpy(spark):
    import numpy as np
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_type", "value")
    got = {}
    for r in distribution.histogram_by_group(ev, "value", "event_type", 40).collect():
        got.setdefault(r.group, {})[r.bin] = r["count"]
    pdf = ev.toPandas()
    for g, sub in pdf.groupby("event_type"):
        counts, _ = np.histogram(sub["value"].to_numpy(), bins=40)
        assert [got[g][i] for i in range(40)] == counts.tolist()


def test_empty_and_all_null_profiles(spark):
    empty = spark.createDataFrame([], "a double, b string")
    num = profile.numeric_profile(empty, ["a"]).collect()
    assert num[0].non_missing == 0 and num[0].missing_pct is None
    assert profile.unique_summary(empty).collect()[0].unique_pct is None
    nulls = spark.createDataFrame([(None, None)] * 3, "a double, b string")
    cat = profile.categorical_profile(nulls, ["b"]).collect()[0]
    assert cat.most_frequent is None and cat.rare_categories == 0 and cat.missing == 3
    const = profile.constant_columns(nulls).collect()
    assert [(r.column, r.unique_value) for r in const] == [("a", None), ("b", None)]


def test_semantic_mapping_later_entry_wins(spark):
    df = spark.createDataFrame([("Rosa",), ("ROSA ",), (None,), ("Azul",)], "c string")
    cmap = {"rosa": ["rosa"], "otros": ["otro", "rosa"]}
    got = [r.c for r in cleaning.apply_semantic_mapping(df, "c", cmap).collect()]
    assert got == ["otros", "otros", "missing", "azul"]


def test_top_n_other_real_other_value(spark):
    rows = [("Other",)] * 2 + [("a",)] * 5 + [("b",)] * 4 + [("c",)]
    df = spark.createDataFrame(rows, "c string")
    got = sorted((r.category, r["count"], r.is_rollup) for r in freq.top_n_other(df, ["c"], top_n=2).collect())
    assert got == [("Other", 3, True), ("a", 5, False), ("b", 4, False)]
    with pytest.raises(ValueError):
        freq.top_n_other(spark.createDataFrame([(1,)], "x int"))


def test_split_without_key_uses_whole_row(spark):
    rows = [("a", 1)] * 6 + [("a", 2)] * 4 + [("b", 1)] * 5
    df = spark.createDataFrame(rows, "s string, v int")
    out = splitting.stratified_split(df, "s", None, 0.8, 3)
    got = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert got == {("a", "train"): 8, ("a", "validation"): 2, ("b", "train"): 4, ("b", "validation"): 1}


def test_categorical_profile_in_table_order(spark):
    df = spark.createDataFrame([("x", "y", True)], "z string, a string, m boolean")
    assert [r.feature for r in freq.categorical_profile(df).collect()] == ["z", "a", "m"]


def test_one_hot_separator_avoids_collision(spark):
    df = spark.createDataFrame([("bc", "c"), ("x", "y")], "a string, ab string")
    import pytest as _pytest
    with _pytest.raises(ValueError):
        encoding.fit_one_hot(df, ["a", "ab"]).transform(df.withColumn("abc", F.lit(1)))
    model = encoding.fit_one_hot(df, ["a", "ab"], separator="=")
    assert model.transform(df).columns == ["a=bc", "a=x", "ab=c", "ab=y"]


def test_boxplot_fliers_match_counts(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    counts = {r.group: r.fliers for r in distribution.boxplot_stats(ev, ["value"], "event_type", ["value"]).collect()}
    rows = distribution.boxplot_fliers(ev, "value", "event_type")
    got = {r.event_type: r["count"] for r in rows.groupBy("event_type").count().collect()}
    assert got == {k: v for k, v in counts.items() if v}
    assert rows.columns == ev.columns


def test_pct_equals_numpy_round_on_many_ratios(spark):
    import random

    import numpy as np
    rnd = random.Random(11)
    pairs = []
    for _ in range(20000):
        n = rnd.randint(1, 10**6)
        pairs.append((rnd.randint(0, n), n))
    df = spark.createDataFrame(pairs, "c long, n long")
    got = [r[0] for r in df.select(pct(F.col("c"), F.col("n"))).collect()]
    expected = [float(np.round((np.int64(c) / np.int64(n)) * 100, 2)) for c, n in pairs]
    assert got == expected


def test_to_number_overflow_is_null(spark):
    df = spark.createDataFrame([("1e999",), ("-2E400",), ("inf",), ("-Infinity",), ("1e308",)], "s string")
    got = [r[0] for r in df.select(to_number(F.col("s"))).collect()]
    assert got[:2] == [None, None] and got[2] == float("inf") and got[3] == float("-inf") and got[4] == 1e308


def test_normalisers_equal_python_for_every_code_point(spark):
    from plain_text import category_form, text_form
    from tabsieve.functions.text import normalize_category, normalize_text
    texts = []
    for code in range(128):
        ch = chr(code)
        texts += [ch, f"A{ch}b", f" {ch}{ch}x_Y-z{ch} "]
    every = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["x".join(every[k:k + 64]) for k in range(0, len(every), 64)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", normalize_category(F.col("t")).alias("c"), normalize_text(F.col("t")).alias("n")) \
             .orderBy("i").collect()
    for r in rows:
        t = texts[r.i]
        assert r.c == category_form(t), repr(t)
        assert r.n == text_form(t), repr(t)


def test_boxplot_whisker_clamped_to_quartile(spark):
    # q1 interpolates to 75 between 0 and 100; the lowest value inside the fence (100) lies above q1,
    # so the whisker is drawn at q1 and 0 is the only flier (Matplotlib's boxplot_stats rule)
    df = spark.createDataFrame([(0.0,), (100.0,), (101.0,), (101.0,)], "x double")
    r = distribution.boxplot_stats(df, ["x"]).collect()[0]
    assert (r.q1, r.q3, r.whisker_low, r.whisker_high, r.fliers) == (75.0, 101.0, 75.0, 101.0, 1)
    assert [x.x for x in distribution.boxplot_fliers(df, "x").collect()] == [0.0]
