
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import binning, cleaning, distribution, encoding, freq, fuzzy, profile, splitting

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "k long, g string, v double")


@pytest.fixture(scope="module")
def all_null(spark):
    return spark.createDataFrame([(i, None, None) for i in range(4)], "k long, g string, v double")


def test_empty_table_everywhere(spark, empty):
    assert profile.explore_target(empty, "v", "g").count() == 1  # the "All" row
    assert profile.duplicate_rows(empty).collect()[0].total_rows == 0
    assert profile.missing_summary(empty).count() == 0
    assert freq.category_table(empty, ["g"]).count() == 0
    assert splitting.stratified_split(empty, "g", ["k"]).count() == 0
    assert distribution.histogram_by_group(empty, "v", "g").count() == 0
    assert binning.quantile_bins(empty, "v", 4).count() == 0
    assert fuzzy.semantic_repetitions(empty, ["g"], 0.8).count() == 0
    assert fuzzy.suggest_category_mapping(empty, "g").count() == 0


def test_all_null_column(spark, all_null):
    r = profile.explore_target(all_null, "v").collect()[0]
    assert (r["count"], r.missing, r.missing_pct, r.median, r.std) == (0, 4, 100.0, None, None)
    assert [x.b for x in binning.quantile_bins(all_null, "v", 3, "b").collect()] == ["<NA>"] * 4
    out = splitting.stratified_split(all_null, "g", ["k"], 0.5)
    assert {x.split for x in out.collect()} == {"train", "validation"} and out.count() == 4
    assert freq.category_table(all_null, ["g"]).collect()[0].category == "Missing"
    with pytest.raises(ValueError):
        encoding.fit_one_hot(all_null, ["g"], max_categories=-1)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    row = profile.numeric_profile(df, ["v"]).collect()[0]
    assert (row.non_missing, row.missing, row.unique) == (1, 2, 1)
    assert [r.column for r in profile.missing_summary(df).collect()] == ["v"]


def test_single_row(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, v double")
    r = profile.explore_target(df, "v", "g").collect()
    assert {x.group: (x.q1, x.median, x.std) for x in r} == {"All": (3.0, 3.0, None), "a": (3.0, 3.0, None)}
    h = distribution.histogram_by_group(df, "v", "g", 4).collect()
    assert sum(x["count"] for x in h) == 1 and len(h) == 4


def test_constant_column_detected(spark):
    df = spark.createDataFrame([(1, "SUV", True), (2, "SUV", True)], "k int, body string, flag boolean")
    assert [(r.column, r.unique_value) for r in profile.constant_columns(df).collect()] == [
        ("body", "SUV"), ("flag", "True")]


def test_filters_reach_the_parquet_scan(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    out = cleaning.remove_invalid_values(part.select("p_partkey", "p_size", "p_retailprice"),
                                         "p_size", "p_retailprice", 45, 1800)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), IsNotNull(p_retailprice), LessThanOrEqual(p_size,45)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in plan


def test_profile_scan_is_pruned(spark):
    """The numeric profile's single scan reads only the profiled columns."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    long_df = orders.select("o_orderstatus", "o_totalprice")
    plan = profile.numeric_profile(orders, ["o_totalprice"])._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan and "o_orderdate" not in plan
    assert long_df.columns == ["o_orderstatus", "o_totalprice"]


def test_split_plan_has_no_global_sort(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority")
    out = splitting.stratified_split(orders, "o_orderpriority", ["o_orderkey"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()


def test_approximate_profiles_close_to_exact(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    exact = {r.group: r for r in profile.explore_target(orders, "o_totalprice", "o_orderstatus").collect()}
    approx = {r.group: r for r in profile.explore_target(orders, "o_totalprice", "o_orderstatus", exact=False).collect()}
    assert exact.keys() == approx.keys()
    for g, e in exact.items():
        a = approx[g]
        assert (a["count"], a.missing, a["min"], a["max"], a.zero_count) == (e["count"], e.missing, e["min"], e["max"], e.zero_count)
        assert abs(a.mean - e.mean) < 1e-6 * abs(e.mean) and abs(a.std - e.std) < 1e-6 * e.std
        spread = e["max"] - e["min"]
        for q in ("q1", "median", "q3"):
            assert abs(a[q] - e[q]) <= 0.002 * spread
    empty = spark.createDataFrame([], "v double, g string")
    row = profile.explore_target(empty, "v", "g", exact=False).collect()
    assert [(r.group, r["count"], r.missing) for r in row] == [("All", 0, 0)]
    num = profile.numeric_profile(orders, ["o_totalprice"], exact=False).collect()[0]
    assert num.non_missing == 15000 and abs(num.unique - 15000) < 15000 * 0.05


def test_profiles_without_columns_of_a_kind(spark):
    text_only = spark.createDataFrame([("a",)], "t string")
    num_only = spark.createDataFrame([(1.0,)], "x double")
    feats = profile.explore_features(text_only)
    assert feats["numeric"].count() == 0 and feats["categorical"].count() == 1
    assert "outlier_pct" in feats["numeric"].columns
    feats = profile.explore_features(num_only)
    assert feats["categorical"].count() == 0 and feats["numeric"].count() == 1
    assert "least_frequent_preview" in feats["categorical"].columns
