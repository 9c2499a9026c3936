"""Column names with spaces, accents and a dot (the reference's listing uses such names)."""

from tabsieve import compat
from tabsieve.operators import cleaning, distribution, encoding, freq, fuzzy, profile, splitting


def _listing(spark):
    rows = [(i, f"Marca{i % 3}", ["Sí", "No", None][i % 3], 2000 + i % 5, float(1000 + 37 * i),
             ["$", "U$S"][i % 2], ["Nafta", "Diésel"][i % 2], 4 + i % 2) for i in range(30)]
    return spark.createDataFrame(rows, "`id` long, `Marca` string, `Con cámara de retroceso` string, `Año` int, "
                                       "`Precio` double, `Moneda` string, `Tipo de combustible` string, `Puertas.n` int")


def test_every_operator_family_accepts_awkward_names(spark):
    df = _listing(spark)
    assert profile.explore_target(df, "Precio", "Moneda").count() == 3
    feats = profile.explore_features(df)
    assert {r.feature for r in feats["numeric"].collect()} == {"id", "Año", "Precio", "Puertas.n"}
    assert feats["categorical"].count() == 4
    assert profile.missing_summary(df).collect()[0].column == "Con cámara de retroceso"
    assert profile.unique_summary(df).count() == 8 and profile.duplicate_rows(df).count() == 1
    assert profile.constant_columns(df).count() == 0
    assert freq.category_table(df, ["Tipo de combustible", "Con cámara de retroceso"]).count() == 5
    assert freq.top_n_other(df, top_n=2).count() > 0
    enc = cleaning.encode_binary(df, "Con cámara de retroceso")
    assert sorted({r["Con cámara de retroceso"] for r in enc.collect()}, key=str) == [0, 1, None]
    usd = cleaning.convert_currency(df, "Precio", "Moneda", "$")
    assert "Moneda" not in usd.columns
    assert cleaning.remove_invalid_values(df, "Año", "Puertas.n", 2003, 4).count() > 0
    mapped = cleaning.apply_semantic_mapping(df, "Tipo de combustible", {"diesel": ["diésel"]})
    assert {r["Tipo de combustible"] for r in mapped.collect()} == {"nafta", "diesel"}
    model = encoding.fit_one_hot(df, ["Tipo de combustible"])
    assert model.transform(df).columns[-2:] == ["Tipo de combustibleDiésel", "Tipo de combustibleNafta"]
    assert distribution.histogram_by_group(df, "Precio", "Moneda", 5).count() == 10
    assert distribution.raw_distributions(df, ["Año", "Puertas.n", "Precio"], 7,
                                          integer_columns=["Año", "Puertas.n"]).count() > 0
    assert distribution.boxplot_stats(df, ["Precio", "Año"], "Moneda", ["Precio"]).count() == 3
    assert distribution.missing_by_group(df, "Año", "Con cámara de retroceso").count() == 5
    strata = compat.make_brand_price_strata(df, "Marca", "Precio", 2, 3)
    assert strata.count() == 30
    split = splitting.stratified_split(df, "Marca", ["id"], 0.8, 42)
    assert split.where("split = 'train'").count() == 24
    assert fuzzy.semantic_repetitions(df, ["Marca", "Tipo de combustible"], 0.8).count() >= 1
    assert fuzzy.suggest_category_mapping(df, "Marca", 0.8).count() == 3
