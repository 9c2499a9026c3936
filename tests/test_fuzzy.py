"""J1/J2/J3 and I3 against the sequential algorithm and the golden values of FIXTURES.md."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plain_text import category_form, text_form
from tabsieve.functions.similarity import ratio, similarity
from tabsieve.operators import cleaning, fuzzy


def score(a, b):
    return SequenceMatcher(None, a, b).ratio()


def expected_groups(values_with_counts, threshold):
    """Definition by sets: going from frequent to rare, a value leads if no leader before it is similar to
    it; every other value belongs to the first leader that is."""
    order = [v for v, _ in sorted(values_with_counts, key=lambda kv: (-kv[1], kv[0]))]
    similar = {(a, b) for a, b in itertools.combinations(order, 2)
               if score(category_form(a), category_form(b)) >= threshold}
    leaders = []
    for v in order:
        leaders += [] if any((lead, v) in similar for lead in leaders) else [v]
    belongs = {v: v if v in leaders else next(lead for lead in leaders if (lead, v) in similar) for v in order}
    members = [[v for v in order if belongs[v] == lead] for lead in leaders]
    return sorted(" | ".join(m) for m in members if len(m) > 1)


def expected_suggestions(values_with_counts, threshold):
    """Definition by argmax: the most similar more frequent value at the threshold or above, ties to the most
    frequent; none keeps the value."""
    order = [v for v, _ in sorted(values_with_counts, key=lambda kv: (-kv[1], kv[0]))]
    out = {}
    for k, v in enumerate(order):
        scores = [score(text_form(v), text_form(c)) for c in order[:k]]
        best = max((s for s in scores if s >= threshold), default=None)
        out[v] = (v, 1.0, "keep") if best is None else (order[scores.index(best)], round(best, 3), "map")
    return out


def test_similarity_fixtures(spark):
    assert ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5
    assert ratio("", "") == 1.0
    assert ratio("renault", "rrenault") == pytest.approx(0.9333333333333333)
    df = spark.createDataFrame([("hyundai", "hiunday"), ("tide", "diet")], "a string, b string")
    got = [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.7142857142857143), 0.25]


def test_admissible_lengths():
    lo, hi = fuzzy.admissible_lengths(10, 0.8)
    for other in range(1, 40):
        bound = 2 * min(10, other) / (10 + other)
        assert (bound >= 0.8) == (lo <= other <= hi)


def test_golden_similar_groups(spark):
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    got = fuzzy.semantic_repetitions(part, ["p_name"], 0.80).collect()
    assert [(r.similar_values, r.total_count) for r in got][:3] == [
        ("red widget | large widget | new widget | old widget", 120),
        ("red plate | large plate", 82), ("cold gear | old gear", 65)]
    assert len(got) == 11
    counts = {r["p_name"]: r["count"] for r in part.groupBy("p_name").count().collect()}
    assert sorted(r.similar_values for r in got) == expected_groups(counts.items(), 0.80)


def test_golden_suggestions(spark):
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    got = {r.original_category: (r.suggested_category, r.similarity, r.action)
           for r in fuzzy.suggest_category_mapping(part, "p_name", 0.85).collect()}
    assert got["cold plate"] == ("old plate", 0.947, "map")
    assert got["old widget"] == ("cold widget", 0.952, "map")
    assert sum(1 for v in got.values() if v[2] == "map") == 8
    counts = {r["p_name"]: r["count"] for r in part.groupBy("p_name").count().collect()}
    assert got == expected_suggestions(counts.items(), 0.85)


WORDS = ["renault", "rrenault", "renaul", "jetour", "jetur", "hyundai", "hiunday", "ds", "d.s.", "d·s",
         "gris", "gris plata", "gris oscuro", "Gris_Oscuro", "negro", "negra", "blanco", "blanca", "", "-",
         "azul", "azul claro", "Automática", "automatica", "manual", "ab", "ba", "abc", "cab"]


@pytest.mark.parametrize("seed", [1, 2])
def test_parallel_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for w in rnd.sample(WORDS, 18):
        rows += [(w,)] * rnd.randint(1, 6)
    df = spark.createDataFrame(rows, "v string")
    counts = {}
    for (w,) in rows:
        counts[w] = counts.get(w, 0) + 1
    for t in (0.6, 0.75):
        got = sorted(r.similar_values for r in fuzzy.semantic_repetitions(df, ["v"], t).collect())
        assert got == expected_groups(counts.items(), t), (seed, t)
        sugg = {r.original_category: (r.suggested_category, r.similarity, r.action)
                for r in fuzzy.suggest_category_mapping(df, "v", t).collect()}
        stripped = {}
        for w, n in counts.items():
            stripped[w.strip()] = stripped.get(w.strip(), 0) + n
        assert sugg == expected_suggestions(stripped.items(), t), (seed, t)


def test_no_group_gives_empty_typed_frame(spark):
    df = spark.createDataFrame([("apple",), ("zebra",), ("kiwi",)], "v string")
    out = fuzzy.semantic_repetitions(df, ["v"], 0.9)
    assert out.count() == 0
    assert out.columns == ["feature", "similar_values", "normalized_values", "total_count", "n_values_grouped"]


def test_candidate_plan_has_no_cartesian(spark):
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    vocab = fuzzy.vocabulary(part, ["p_name"], lambda c: c)
    plan = fuzzy.candidate_pairs(vocab, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_rejects_non_positive_threshold(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    with pytest.raises(ValueError):
        fuzzy.semantic_repetitions(df, ["v"], 0.0)


def test_apply_mapping_manual_wins_and_null_stays(spark):
    df = spark.createDataFrame([(" Golf ",), ("golf",), (None,), ("polo",)], "m string")
    mapping = spark.createDataFrame([("Golf", "golf"), ("golf", "golf"), ("polo", "polo")],
                                    "original_category string, suggested_category string")
    got = [r.m for r in cleaning.apply_category_mapping(df, "m", mapping, {"polo": "POLO"}).collect()]
    assert sorted(got, key=str) == sorted(["golf", "golf", None, "POLO"], key=str)


def test_multi_feature_groups_equal_sequential(spark):
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    cols = ["p_name", "p_brand", "p_type"]
    got = fuzzy.semantic_repetitions(part, cols, 0.80).collect()
    for c in cols:
        counts = {r[c]: r["count"] for r in part.groupBy(c).count().collect()}
        mine = sorted(r.similar_values for r in got if r.feature == c)
        assert mine == expected_groups(counts.items(), 0.80), c
    assert [r.feature for r in got] == sorted(r.feature for r in got)  # ordered by feature, total desc


def _random_vocabulary(spark, count, seed=1):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(6, 20))) for _ in range(count)})
    for k in range(0, count // 4):  # a light edit of another word
        w = words[k]
        at = rnd.randrange(len(w))
        words.append(w[:at] + rnd.choice("xyz") + w[at + rnd.randint(0, 1):])
    rows = [("f", k + 1, w, len(w)) for k, w in enumerate(dict.fromkeys(words))]
    return spark.createDataFrame(rows, "feature string, rank long, norm string, len int"), [r[2] for r in rows]


@pytest.mark.parametrize("threshold, share", [(0.85, 0.05), (0.8, 0.15), (0.7, 0.05), (0.6, 0.4)])
def test_candidates_are_few_and_lose_no_edge(spark, threshold, share):
    vocab, words = _random_vocabulary(spark, 400)
    got = {(r.r1, r.r2) for r in fuzzy.candidate_pairs(vocab, threshold).collect()}
    want = {(i + 1, j + 1) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2)
            if max(score(a, b), score(b, a)) >= threshold}
    assert want <= got and len(want) > 50
    assert len(got) <= share * len(words) * (len(words) - 1) / 2


def test_few_pairs_reach_the_scorer_and_once(spark):
    vocab, words = _random_vocabulary(spark, 300)
    edges = fuzzy.scored_edges(vocab, 0.7, True)
    want = {(i + 1, j + 1) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if score(a, b) >= 0.7}
    assert {(r.r1, r.r2) for r in edges.collect()} == want
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_long_leader_chain_finishes(spark):
    chain = spark.createDataFrame([("f", k, k + 1) for k in range(1, 10)], "feature string, r1 long, r2 long")
    got = {r["rank"]: r.leader for r in fuzzy.greedy_leaders(chain).collect()}
    assert got == {k: k if k % 2 else k - 1 for k in range(1, 11)}
