"""Second-wave operators on small inputs with nulls, against numpy, pandas or plain Python (tables: the oracle tests)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import bivariate, effects, features, lookup, moments, regression

RNG = np.random.default_rng(7)


def frame(spark, n=400, brands=6):
    """Listings with missing values in every column."""
    rows = []
    for k in range(n):
        brand = None if k % 29 == 0 else f"b{int(RNG.integers(brands))}"
        rows.append((k, brand, None if k % 31 == 0 else f"c{int(RNG.integers(3))}", None if k % 17 == 0 else float(RNG.normal(5, 2)),
                     float("nan") if k % 23 == 0 else float(RNG.normal(-1, 3)), None if k % 19 == 0 else float(RNG.normal(100, 10))))
    schema = "id long, brand string, colour string, x double, z double, price double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["id", "brand", "colour", "x", "z", "price"])


def test_correlation_is_pairwise_complete(spark):
    df, local = frame(spark)
    shifted = df.withColumn("big", F.col("x") + 1e9).withColumn("same", F.lit(3.0)).withColumn("none", F.lit(None).cast("double"))
    shifted = shifted.withColumn("inf", F.when(F.col("id") == 5, float("inf")).otherwise(F.col("price"))).repartition(7)
    local = local.assign(big=local.x + 1e9, same=3.0, none=np.nan, inf=local.price.where(local.id != 5))
    names = ["x", "z", "price", "big", "same", "none", "inf"]
    got = {(r["left"], r["right"]): r for r in moments.correlation_matrix(shifted, names).collect()}
    assert len(got) == 49
    want, cov = local[names].corr(), local[names].cov()
    for (a, b), r in got.items():
        assert r["n"] == int((local[a].notna() & local[b].notna()).sum())
        for value, other in ((r["correlation"], want.loc[a, b]), (r["covariance"], cov.loc[a, b])):
            if a == "same" or b == "same":
                other = np.nan if value is None else 0.0
            assert (value is None) == bool(np.isnan(other)) and (value is None or value == pytest.approx(other, rel=1e-6, abs=1e-6))
    assert {r["n"] for r in moments.correlation_matrix(df.limit(0), ["x", "z"]).collect()} == {0}
    assert moments.correlation_matrix(df.select("brand")).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_adjusted_effects_equal_dummies(spark, monkeypatch, few):
    """Brands and colours that depend on each other, a covariate, nulls as levels: least squares on dense dummies."""
    df, local = frame(spark, 500)
    if not few:
        monkeypatch.setattr(effects, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    got = {(r["factor"], r["level"]): r for r in effects.adjusted_effects(df, "price", ["brand", "colour"], ["x"], tolerance=1e-9).collect()}
    used = local[local.price.notna() & local.x.notna()].copy()
    used["brand"], used["colour"] = used.brand.fillna("?"), used.colour.fillna("?")
    blocks = [used[["x"]].to_numpy(), np.ones((len(used), 1)), pd.get_dummies(used.brand).to_numpy(float), pd.get_dummies(used.colour).to_numpy(float)]
    solved = np.linalg.lstsq(np.hstack(blocks), used.price.to_numpy(), rcond=None)[0][2:]
    at = 0
    for factor in ("brand", "colour"):
        levels = sorted(used[factor].unique())
        raw = dict(zip(levels, solved[at:at + len(levels)]))
        at += len(levels)
        middle = used[factor].map(raw).mean()
        for level, value in raw.items():
            r = got.pop((factor, None if level == "?" else level))
            assert r["effect"] == pytest.approx(value - middle, abs=1e-5) and r["n"] == (used[factor] == level).sum() and r["converged"]
    assert not got
    assert effects.adjusted_effects(df.limit(0), "price", ["brand"]).collect() == []
    few_rounds = effects.adjusted_effects(df, "price", ["brand", "colour"], ["x"], tolerance=0.0, sweeps=1).collect()
    assert not any(r["converged"] for r in few_rounds)


def design(local, train):
    """Dense twin of the sparse rows: standardised numbers with missing at the mean, one-hot of the train's categories."""
    columns = [np.ones(len(local))]
    for c in ("x", "z"):
        mean, sd = np.nanmean(local.loc[train, c]), np.nanstd(local.loc[train, c])
        columns.append(((local[c] - mean) / sd).fillna(0.0).to_numpy())
    columns += [(local.brand == b).to_numpy(float) for b in sorted(local.loc[train, "brand"].dropna().unique())]
    return np.stack(columns, 1)


def test_price_model_and_residuals(spark):
    df, local = frame(spark)
    train = (local.id % 4 != 0) & local.price.notna()
    model = regression.fit_linear(df.where("id % 4 <> 0"), "price", ["x", "z"], ["brand"])
    out = model.predict(df)
    dense = design(local, train)
    want = dense @ np.linalg.pinv(dense[train], rcond=1e-10) @ local.price[train].to_numpy()
    got = {r["id"]: r["predicted"] for r in out.collect()}
    assert all(got[k] == pytest.approx(want[k], rel=1e-8) for k in range(len(local)))
    summary = {r["group"]: r for r in regression.residual_summary(out.withColumn("part", F.col("id") % 4 != 0), "price", "predicted", "part").collect()}
    for part in (True, False):
        mine = local.price.notna() & ((local.id % 4 != 0) == part)
        res = (local.price - want)[mine]
        r = summary[part]
        assert r["rows"] == mine.sum() and r["rmse"] == pytest.approx(np.sqrt((res**2).mean())) and r["median"] == pytest.approx(res.median())
        assert r["r2"] == pytest.approx(1 - (res**2).sum() / ((local.price[mine] - local.price[mine].mean()) ** 2).sum())
    none = regression.fit_linear(df.limit(0), "price", ["x"], ["brand"]).predict(df)
    assert {r["predicted"] for r in none.collect()} == {0.0}


def test_wide_models_are_refused_before_the_collect(spark, monkeypatch):
    monkeypatch.setattr(regression, "MAX_POSITIONS", 5)
    with pytest.raises(ValueError, match="adjusted_effects"):
        regression.fit_linear(frame(spark)[0], "price", ["x"], ["brand"])


def test_no_row_is_predicted_by_a_model_that_saw_it(spark):
    df, local = frame(spark)
    out = {r["id"]: r for r in regression.undervaluation(df, "price", ["id"], ["x", "z"], ["brand"], 3).collect()}
    fold = np.array([out[k]["fold"] for k in range(len(local))])
    assert set(fold) == {0, 1, 2}
    usable = local.price.notna().to_numpy()
    dense = design(local, local.price.notna())
    for f in range(3):
        train = usable & (fold != f)
        want = dense @ np.linalg.pinv(dense[train], rcond=1e-10) @ local.price[train].to_numpy()
        for k in np.flatnonzero(fold == f):
            r = out[k]
            assert r["predicted"] == pytest.approx(want[k], rel=1e-7)
            if usable[k]:
                assert r["undervaluation_pct"] == pytest.approx((want[k] - local.price[k]) / want[k] * 100, abs=1e-5)
            else:
                assert r["undervaluation_pct"] is None


def test_projection_equals_eigenvectors(spark):
    df, local = frame(spark)
    out, loadings = regression.project(df, ["x", "z"], ["brand"])
    dense = design(local, local.id >= 0)[:, 1:]
    centred = dense - dense.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    for c in range(2):
        v = vectors[:, -1 - c]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert np.allclose(loadings[:, c], v, atol=1e-6)
        got = {r["id"]: r[f"pc{c + 1}"] for r in out.collect()}
        assert all(got[k] == pytest.approx(x, abs=1e-5) for k, x in enumerate(centred @ v))
    assert regression.project(df.limit(0), ["x"], ["brand"])[0].collect() == []


def test_small_groups_do_not_lead_the_spread(spark):
    rows = [("big", float(v), 0.0) for v in RNG.normal(0, 3, 300)] + [("two", 8.0, 0.0), ("two", -8.0, 0.0), ("one", 90.0, 0.0), (None, 1.0, 0.0), (None, 2.0, 0.0), ("gone", None, 0.0)]
    got = {r["group"]: r for r in regression.residual_spread(spark.createDataFrame(rows, "g string, a double, p double"), "a", "p", "g").collect()}
    assert got["two"]["spread"] > got["big"]["spread"] and got["one"]["spread"] is None and "gone" not in got
    local = pd.DataFrame(rows, columns=["g", "a", "p"]).dropna(subset=["a"]).fillna({"g": "?"})
    ss = local.groupby("g").a.apply(lambda v: ((v - v.mean()) ** 2).sum())
    n = local.groupby("g").size()
    pooled = ss.sum() / (n - 1).sum()
    for g, r in got.items():
        g = g or "?"
        assert r["shrunken"] == pytest.approx(math.sqrt((ss[g] + 20 * pooled) / (n[g] - 1 + 20))) and r["rows"] == n[g]
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4]


def test_imputer_never_sees_validation_rows(spark):
    df, local = frame(spark)
    train = df.where("id < 200")
    out = features.fit_imputer(train, ["x", "price"], [["brand", "colour"], ["brand"]], ["brand"], min_rows=4).transform(df)
    t = local[local.id < 200]
    for r in out.collect():
        row = local.iloc[r["id"]]
        assert r["brand"] == (row.brand or "Unknown")
        for c in ("x", "price"):
            if not np.isnan(row[c]):
                assert r[c] == row[c]
                continue
            want = None
            for keys in (["brand", "colour"], ["brand"], []):
                if all(row[k] is not None for k in keys):
                    mine = t
                    for k in keys:
                        mine = mine[mine[k] == row[k]]
                    if mine[c].notna().sum() >= 4 or not keys:
                        want = mine[c].median()
                        break
            assert r[c] == pytest.approx(want)
    blank = features.fit_imputer(train.limit(0), ["x"], [["brand"]]).transform(df)
    assert blank.where("x IS NULL").count() == df.where("x IS NULL").count()


def test_label_codes_are_stable(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), (None, "y"), ("b", "x")], "u string, v string")
    first = features.fit_labels(df, ["u", "v"])
    assert {(r["feature"], r["category"]): r["code"] for r in first.collect()} == {("u", "a"): 0, ("u", "b"): 1, ("v", "x"): 0, ("v", "y"): 1}
    more = spark.createDataFrame([("aa", "x"), ("c", "w"), (None, None)], "u string, v string")
    again = features.fit_labels(more, ["u", "v"], first)
    assert {(r["feature"], r["category"]): r["code"] for r in again.collect()} == {
        ("u", "a"): 0, ("u", "b"): 1, ("u", "aa"): 2, ("u", "c"): 3, ("v", "x"): 0, ("v", "y"): 1, ("v", "w"): 2}
    unseen = spark.createDataFrame([("zz", None), ("c", "y")], "u string, v string")
    assert [tuple(r)[2:] for r in features.label_codes(unseen, again, ["u", "v"]).orderBy("u").collect()] == [(3, 1), (-2, -1)]
    assert features.fit_labels(df.limit(0), ["u"]).collect() == []


def test_features(spark):
    texts = ["2.0 Turbo", "2,0 TSI", "V8", "", None, "turbo", "1.6.3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(features.engine_litres(F.col("t")).alias("l"))
    assert [r["l"] for r in df.collect()] == [2.0, 2.0, 8.0, None, None, None, 1.6]
    rows = spark.createDataFrame([("2020", 60.0, "b", "m"), ("2026", 5.0, "b", None), (None, 5.0, None, "m"), ("2030", 5.0, "b", "m")], "y string, km double, b string, m string")
    got = features.derived_features(rows, "y", "km", "b", "m", 2026).select("age", "km_per_year", "brand_model").collect()
    assert [tuple(r) for r in got] == [(6.0, 10.0, "b_m"), (0.0, None, None), (None, None, None), (-4.0, None, "b_m")]
    values = [float(v) for v in np.exp(RNG.normal(0, 1, 300))]
    skewed = spark.createDataFrame([(v, 0.0 if k == 0 else v, 1.0) for k, v in enumerate(values)] + [(None, None, None)], "a double, b double, c double")
    out = {r["feature"]: r for r in features.skew_check(skewed, ["a", "b", "c"]).collect()}
    assert out["a"]["skew"] == pytest.approx(pd.Series(values).skew()) and out["a"]["log_skew"] == pytest.approx(pd.Series(np.log(values)).skew())
    assert out["a"]["use_log"] and not out["b"]["use_log"] and out["c"]["skew"] is None and out["b"]["positive"] == 299


def test_bivariate_views(spark):
    df, local = frame(spark)
    got = {r["category"]: r for r in bivariate.value_by_category(df, "price", "brand", 40).collect()}
    groups = local.fillna({"brand": "?"}).dropna(subset=["price"]).groupby("brand").price
    want = groups.quantile(0.75)
    assert {k or "?" for k in got} == {b for b, g in groups if len(g) >= 40}
    for b, r in got.items():
        assert r["q3"] == pytest.approx(want[b or "?"]) and r["median"] == pytest.approx(groups.median()[b or "?"])
    ranked = bivariate.iqr_ranking(df, "price", "brand", 40).orderBy("rank").collect()
    assert [r["iqr"] for r in ranked] == sorted((r["iqr"] for r in got.values()), reverse=True)
    cells = {(r["row"], r["column"]): (r["rows"], r["median"]) for r in bivariate.median_grid(df, "price", "brand", "colour").collect()}
    for key, g in local.fillna({"brand": "?", "colour": "?"}).dropna(subset=["price"]).groupby(["brand", "colour"]).price:
        assert cells.pop(tuple(None if k == "?" else k for k in key)) == (len(g), pytest.approx(g.median()))
    assert not cells
    whole = local.dropna(subset=["x", "z", "price"])
    whole = whole.assign(a=pd.qcut(whole.x, 3, labels=False), b=pd.qcut(whole.z, 4, labels=False))
    grid = {(r["x_bin"], r["y_bin"]): (r["rows"], r["median"]) for r in bivariate.binned_grid(df, "price", "x", "z", 3, 4).collect()}
    assert grid == {k: (len(g), pytest.approx(g.median())) for k, g in whole.groupby(["a", "b"]).price}
    assert bivariate.binned_grid(df.limit(0), "price", "x", "z").collect() == []


def test_yearly_loss_over_gaps(spark):
    rows = [("steady", a, 100.0 * 0.9**a) for a in range(5)] + [("gap", 0, 100.0), ("gap", 3, 72.9), ("gap", 4, 36.45), ("one", 2, 5.0), ("zero", 1, 0.0), ("zero", 2, 4.0),
                                                               (None, 1, 10.0), (None, 2, 9.5), ("steady", None, 9.0), ("steady", 1, None)]
    df = spark.createDataFrame(rows, "g string, age int, v double")
    got = [tuple(r) for r in bivariate.yearly_loss(df, "v", "age", "g").orderBy("rank").collect()]
    assert [(r[1], r[2], r[3], round(r[4], 9)) for r in got] == [(None, 2, 1, 0.05), ("steady", 5, 4, 0.1), ("gap", 3, 4, 0.2)]
    broken = {r["group"]: (r["years"], round(r["yearly_loss"], 9)) for r in bivariate.yearly_loss(df, "v", "age", "g", span_gaps=False).collect()}
    assert broken == {None: (1, 0.05), "steady": (4, 0.1), "gap": (1, 0.5)}


def test_dense_one_hot_refuses_wide_columns(spark):
    from tabsieve.operators import encoding
    df = spark.range(30).selectExpr("CAST(id AS STRING) AS c")
    assert len(encoding.fit_one_hot(df, ["c"]).categories["c"]) == 30 and encoding.MAX_CATEGORIES == 10_000
    with pytest.raises(ValueError, match="one_hot_sparse"):
        encoding.fit_one_hot(df, ["c"], max_categories=29)
