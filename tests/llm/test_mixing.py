import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import mixing, queries


def raked(table, goals, rounds=5000):
    """Plain proportional fitting of a small table; cell weights relative to the largest."""
    cells = list(table)
    value = np.array([table[c] for c in cells], float)
    for _ in range(rounds):
        for m, goal in enumerate(goals):
            for key, share in goal.items():
                mine = np.array([c[m] == key for c in cells])
                value[mine] *= share / value[mine].sum()
    weight = value / np.array([table[c] for c in cells], float)
    return dict(zip(cells, weight / weight.max()))


def test_weights_equal_plain_fitting_and_margins_hold(spark, docs):
    out = queries.QUERIES["op2_raked_mixture"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == docs.count()
    table = {}
    for r in out:
        cell = (r["source"], r["lang"], r["topic"])
        table[cell] = table.get(cell, 0) + r["n_tokens"]
    goals = []
    for m, name in enumerate(("source", "lang", "topic")):
        tokens = {}
        for cell, n in table.items():
            tokens[cell[m]] = tokens.get(cell[m], 0) + n
        raw = {k: v ** queries.MIX_TARGETS[name] for k, v in tokens.items()}
        goals.append({k: v / sum(raw.values()) for k, v in raw.items()})
    want = raked({c: n for c, n in table.items() if n}, goals)
    for r in out:
        if r["n_tokens"]:
            assert r["weight"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], rel=1e-4)
    expected = sum(r["probability"] * r["n_tokens"] for r in out)
    for m, name in enumerate(("source", "lang", "topic")):
        for key, share in goals[m].items():
            mine = sum(r["probability"] * r["n_tokens"] for r in out if r[name] == key)
            assert mine / expected == pytest.approx(share, rel=1e-4)
    kept = sum(r["n_tokens"] for r in out if r["kept"])
    assert kept == pytest.approx(expected, rel=0.35) and max(r["probability"] for r in out) <= 1


def test_given_weights_budget_and_salted_lookup(spark, monkeypatch):
    rows = [(k, "ab"[k % 2], "xy"[k % 3 == 0], 10) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string, l string, n long")
    margins = {"s": F.col("s"), "l": F.col("l")}
    targets = {"s": {"a": 0.75, "b": 0.25}, "l": {"x": 0.5, "y": 0.5}}
    plain = mixing.sample(df, margins, F.col("n"), targets, ["id"], budget=6000, seed=1)
    mass = {r["s"]: r["t"] for r in plain.groupBy("s").agg(F.sum(F.col("probability") * 10).alias("t")).collect()}
    assert mass["a"] == pytest.approx(4500, rel=1e-4) and mass["b"] == pytest.approx(1500, rel=1e-4)
    monkeypatch.setattr("tabsieve.llm.common.BROADCAST_ROWS", 0)
    salted = mixing.sample(df, margins, F.col("n"), targets, ["id"], budget=6000, seed=1)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_awkward_rows(awkward, empty):
    margins = {"source": F.col("source"), "lang": F.col("lang")}
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    targets = {"source": 0.5, "lang": 0.5}
    out = mixing.sample(awkward, margins, words, targets, ["doc_id", "text"])
    rows = out.collect()
    assert len(rows) == awkward.count() and sorted(out.columns) == sorted({*awkward.columns, "probability"})
    for r in rows:
        blank = not (r["text"] or "").strip()
        assert (r["weight"] == 0 and not r["kept"]) if blank else 0 < r["probability"] <= 1
    twice = [r["kept"] for r in rows if r["doc_id"] == 2 and r["source"] == rows[0]["source"]]
    assert len(set(twice)) <= 1
    assert mixing.sample(empty, margins, words, targets, ["doc_id", "text"]).collect() == []


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_wide_later_margin_holds(spark, monkeypatch, broadcast):
    """2,100 languages beside few sources: every margin is met, with factors broadcast or salted."""
    monkeypatch.setattr("tabsieve.llm.common.BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    n = 2_100 if broadcast else 40
    df = spark.range(4 * n).select("id", (F.col("id") % 3).alias("s"), (F.col("id") % n).cast("string").alias("l"), (1 + F.col("id") % 7).alias("n"))
    report = {}
    out = mixing.sample(df, {"s": F.col("s"), "l": F.col("l")}, F.col("n"), {"s": 0.5, "l": 0.0}, ["id"], report=report)
    assert report["raked"] and max(report["residual"].values()) < 1e-4
    mass = [r["t"] for r in out.groupBy("l").agg(F.sum(F.col("probability") * F.col("n")).alias("t")).collect()]
    assert len(mass) == n and max(mass) / min(mass) == pytest.approx(1.0, rel=1e-4)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_contradicting_targets_warn(spark, caplog, monkeypatch, broadcast):
    """A source that only has one language, wanted in other shares."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "SWEEPS", 3)
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 5)], "id long, s string, l string, n long")
    report = {}
    out = mixing.sample(df, {"s": F.col("s"), "l": F.col("l")}, F.col("n"), {"s": {"a": 0.9, "b": 0.1}, "l": {"x": 0.5, "y": 0.5}}, ["id"], report=report)
    assert out.count() == 2 and not report["raked"] and "raking stopped" in caplog.text


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, "s", 5, 1, 2, 3, 4) for k in range(4)], "id long, s string, n long, `a.b` int, __w int, __tokens int, __cell int")
    out = mixing.sample(df, {"s": F.col("s")}, F.col("n"), {"s": 1.0}, ["id"], share=0.5)
    assert out.columns == [*df.columns, "weight", "probability", "kept"]
    assert {tuple(r)[3:7] for r in out.collect()} == {(1, 2, 3, 4)}


def test_a_tiny_cell_does_not_throttle_the_corpus(spark):
    """The query's margins on a skewed table, with one 60-word document of a source of its own."""
    rows = [(k, f"s{k % 20}" if k % 3 else "s0", "en" if k % 7 else "de", 400) for k in range(4000)] + [(9999, "new", "en", 60)]
    df = spark.createDataFrame(rows, "id long, source string, lang string, n long")
    docs = df.withColumn("__topic", F.lit("prose")).withColumn("__words", F.col("n"))
    total = sum(r[3] for r in rows)
    for share in (0.2, 0.3, 0.95):
        report = {}
        out = queries.mixed(docs, ["id"], share=share, report=report).collect()
        expected = sum(r["probability"] * r["n"] for r in out)
        assert expected == pytest.approx(share * total, rel=1e-6) and report["share"] == pytest.approx(share, rel=1e-6)
        assert next(r["probability"] for r in out if r["source"] == "new") == 1.0
        assert max(r["probability"] for r in out) == 1.0 and report["whole_cells"] >= 1
        top = min(r["weight"] / r["probability"] for r in out)  # min(1, c * w): the rest is in proportion to the weights
        assert all(r["probability"] == pytest.approx(min(1.0, r["weight"] / top), rel=1e-6) for r in out)
        tokens, want = {}, {}
        for r in out:
            tokens[r["source"]] = tokens.get(r["source"], 0) + r["n"]
            want[r["source"]] = want.get(r["source"], 0) + r["probability"] * r["n"]
        whole = sum(v ** queries.MIX_TARGETS["source"] for v in tokens.values())
        missed = max(abs(want[k] / expected / (v ** queries.MIX_TARGETS["source"] / whole) - 1) for k, v in tokens.items())
        assert report["residual"]["source"] == pytest.approx(missed, rel=1e-4)
    everything = queries.mixed(docs, ["id"], share=1.0).collect()
    assert all(r["kept"] and r["probability"] == 1.0 for r in everything)


def test_pipeline_mixture_keeps_its_share(spark, docs):
    import corpus_pipeline

    words = lambda d: queries.mix_columns(d).agg(F.sum("__words")).first()[0]
    extra = spark.createDataFrame([(10**9, "word " * 60, "en", "one-of-a-kind", 300)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    more = docs.unionByName(extra, allowMissingColumns=True)
    assert words(corpus_pipeline.mixture(spark, more, "")) / words(more) == pytest.approx(corpus_pipeline.MIX_SHARE, rel=0.15)
