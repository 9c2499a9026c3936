"""The reference-style entry points run end to end on the driver's tables."""

from pyspark.sql import functions as F

from tabsieve import compat

SF = "/root/testdata/sf0.01"


def test_reference_workflow(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert compat.explore_target(orders, "o_totalprice", "o_orderstatus").count() == 4
    feats = compat.explore_features(orders)
    assert {r.feature for r in feats["numeric"].collect()} == {"o_orderkey", "o_custkey", "o_totalprice"}
    assert compat.duplicate_rows_summary(orders).collect()[0].duplicate_rows == 0
    (xt, yt), (xv, yv) = compat.train_val_split_stratified(orders, "o_totalprice", "o_orderpriority",
                                                           ["o_orderkey"], 0.8, 42)
    assert xt.count() + xv.count() == 15000 and "o_totalprice" not in xt.columns
    assert yt.columns == ["o_orderkey", "o_totalprice"]
    cleaned = compat.convert_peso_prices_to_usd(orders, "o_totalprice", "o_orderstatus", "P")
    assert "o_orderstatus" not in cleaned.columns
    assert compat.plot_categorical_counts(orders, top_n=2).count() > 0
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert compat.find_semantic_repetitions(part, ["p_name"], 0.8).count() == 11
    strata = compat.make_brand_price_strata(part, "p_brand", "p_retailprice", 4, 20)
    assert strata.where(F.col("stratum") == "Other").count() >= 0


def test_preview_and_safe_index(spark):
    from tabsieve.operators import freq
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    row = compat.format_value_counts(freq.frequency_table(df, ["c"]), 1).collect()[0]
    assert (row.feature, row.preview) == ("c", "a: 2")
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority")
    split = compat.train_val_split_stratified  # noqa: F841
    from tabsieve.operators import splitting
    s = splitting.stratified_split(orders, "o_orderpriority", ["o_orderkey"])
    assert compat.safe_index(s, "train").count() + compat.safe_index(s, "validation").count() == 15000
