import numpy as np
from pyspark.sql import functions as F

from tabsieve.llm import langid, queries


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op1_language_mixture"](spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    scored = found.join(lang, "doc_id").where("held_out and lang is not null")
    right, rows, low, high = scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"),
                                        F.min("score"), F.max("score")).first()
    assert rows > 150 and right >= 0.98 and 0 <= low and high <= 1


def test_em_finds_the_best_shares():
    """Against a fine grid over all shares of three languages."""
    rng = np.random.default_rng(1)
    table = rng.dirichlet(np.ones(30), 3)
    counts = rng.multinomial(400, np.array([0.55, 0.3, 0.15]) @ table).astype(float)
    shares, reached = langid.em_shares(counts, table)
    grid = [(a / 50, b / 50, 1 - a / 50 - b / 50) for a in range(51) for b in range(51 - a)]
    best = max(float(counts @ np.log(np.array(g) @ table + 1e-300)) for g in grid)
    assert reached >= best - 0.05 and abs(shares.sum() - 1) < 1e-9


def test_bound_never_hides_a_language():
    """The growing search with bounds selects what it selects without them."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        table = rng.dirichlet(np.full(60, 0.3), 4) + 1e-6
        table /= table.sum(axis=1, keepdims=True)
        counts = rng.multinomial(300, rng.dirichlet(np.full(4, 0.4)) @ table).astype(float)
        chosen, _ = langid.mixture(counts, table)
        penalty = langid.PENALTY * np.log(counts.sum() + 1)
        mine, best = [int(np.argmax(np.log(table) @ counts))], float((np.log(table) @ counts).max())
        while True:
            tried = [(langid.em_shares(counts, table[[*mine, k]])[1], k) for k in range(4) if k not in mine]
            if not tried or max(tried)[0] - best <= penalty + 0.05:
                break
            best, added = max(tried)
            mine.append(added)
        assert set(mine) == set(chosen)


def test_mixed_text_and_chunks(spark, docs, monkeypatch):
    model = langid.fit(docs, key=F.col("doc_id"))
    whole = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(6).collect())[:6000]
             for lang in ("en", "de")}
    mixed = whole["en"][:3000] + " " + whole["de"][:3000]
    row = langid.identify(spark.createDataFrame([(mixed,)], "text string"), model).first()["__lang"]
    named = dict(x.split(":") for x in row["languages"].split(","))
    assert {"en", "de"} <= set(named) and abs(float(named["en"]) - 0.5) < 0.2
    letters = np.unpackbits(np.frombuffer(langid.letter_bits(), np.uint8)).astype(bool)
    once = langid.ngram_counts(mixed, letters)
    monkeypatch.setattr(langid, "_CHUNK", 700)
    parts = langid.ngram_counts(mixed, letters)
    assert (once[0] == parts[0]).all() and (once[1] == parts[1]).all()


def test_awkward_rows(spark, awkward, empty, docs):
    model = langid.fit(docs, key=F.col("doc_id"))
    rows = langid.identify(awkward, model, into="kept").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["kept"]["lang_pred"] == "und") == (not letters) and 0 <= r["kept"]["score"] <= 1
    assert langid.identify(empty, model).collect() == []
    unlearned = langid.fit(empty)
    assert unlearned.languages == [] and langid.identify(awkward, unlearned).first()["__lang"]["lang_pred"] == "und"
