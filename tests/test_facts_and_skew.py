"""
ordering primitives (a hot group must not land in one task)."""

from pyspark.sql import functions as F

from tabsieve.operators import profile, splitting
from tabsieve.operators.ordering import ordered_positions, sliced_values, value_counts_by_group

SF = "/root/testdata/sf0.01"


def test_outlier_and_duplicate_facts(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert profile.numeric_profile(events, ["value"]).collect()[0].outlier_count == 463
    assert profile.numeric_profile(docs, ["n_chars"]).collect()[0].outlier_count == 95
    assert profile.duplicate_rows(docs, ["text", "lang", "source"]).collect()[0].duplicate_rows == 2
    assert profile.duplicate_rows(docs, ["text"]).collect()[0].duplicate_rows == 73
    assert profile.duplicate_rows(events, ["user_id", "event_type", "value"]).collect()[0].duplicate_rows == 5


def test_hot_group_is_spread_over_slices(spark):
    # one group holds two thirds of the distinct values
    rows = [("hot", i) for i in range(4000)] + [(f"g{i % 50}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int")
    ranked = ordered_positions(df, ["g"], [F.col("k")], pos_col="pos", num_partitions=8)
    assert ranked.where("g = 'hot'").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, 4000, 4000)
    sliced = sliced_values(value_counts_by_group(df, ["g"], F.col("k")), ["g"], num_partitions=8)
    per_slice = sliced.where("g = 'hot'").groupBy("_slice").count().collect()
    assert len(per_slice) >= 4 and max(r["count"] for r in per_slice) < 4000 / 2


def test_hot_stratum_ranks_only_its_boundary_bucket(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(30000)]
    df = spark.createDataFrame(rows, "k long, s string")
    out = splitting.stratified_split(df, "s", ["k"], 0.8, 42)
    counts = {r.split: r["count"] for r in out.where("s = 'hot'").groupBy("split").count().collect()}
    assert counts == {"train": 16000, "validation": 4000}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan  # only the boundary-bucket branch carries the window


def test_bracketed_quantiles_equal_numpy(spark, monkeypatch):
    """Coarse brackets on groups larger than the sketch: values outside them are only counted, ties and a hot
    value included, and the quantiles stay exact."""
    import numpy as np

    from tabsieve.operators import ordering
    monkeypatch.setattr(ordering, "BRACKET_ACCURACY", 100)
    monkeypatch.setattr(ordering, "_MARGIN", 3.0 / 100)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1, 3000), "b": rng.integers(0, 7, 2500).astype(float), "c": np.repeat([5.0, 1.0], [900, 40]),
              "d": rng.exponential(1, 57), "e": np.array([2.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("f", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    names = [f"q{k}" for k in range(len(probs))]
    small = ordering.bracketed_counts(df, ["g"], "v", [0.25, 0.5, 0.75])
    assert small.where("g = 'a'").count() < 1000
    got = {r["g"]: [r[n] for n in names] for r in ordering.exact_quantiles(df, ["g"], "v", probs, names).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == [float(np.quantile(xs, q)) for q in probs], g


def test_raw_cells_are_not_shuffled_by_feature_or_group(spark, monkeypatch):
    """With a small broadcast threshold no exchange by key lies straight over raw cells, and beyond the counted limit keys are salted;
    the results are the same."""
    from tabsieve.operators import distribution, ordering
    df = spark.createDataFrame([(k, "hot" if k % 3 else f"g{k % 5}", float(k % 97), float(k)) for k in range(3000)], "k long, g string, x double, y double")
    makes = {"target": lambda: profile.explore_target(df, "x", "g"), "numeric": lambda: profile.numeric_profile(df, ["x", "y"]),
             "histogram": lambda: distribution.histogram_by_group(df, "x", "g", 10), "raw": lambda: distribution.raw_distributions(df, ["x", "y"]),
             "box": lambda: distribution.boxplot_stats(df, ["x", "y"], "g", ["x"])}
    rows = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    want = {name: rows(make()) for name, make in makes.items()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
    met = []
    plain = ordering.met_keys
    seen = lambda left, table, keys, ready=False: met.append((plain(left, table, keys, ready), left, keys)) or met[-1][0]
    try:
        for module in (profile, distribution, ordering):
            monkeypatch.setattr(module, "met_keys", seen)
        for limit in (50_000, 0):
            monkeypatch.setattr(ordering, "BROADCAST_ROWS", limit)
            met.clear()
            for name, make in makes.items():
                assert rows(make()) == want[name], (name, limit)
            assert len(met) >= 10
            for joined, _, keys in met:
                plan = joined._jdf.queryExecution().executedPlan().toString()
                for line in plan.splitlines():
                    assert "Exchange hashpartitioning" not in line or (limit == 0 and "_salt" in line), (keys, line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
