import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tabsieve.llm import bpe, pii
from llm.test_neardup import brute


def test_stages_follow_the_contract(spark, docs):
    """Each stage on its own input against brute force; decisions take effect and clean documents stay."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixture", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    first = docs.limit(0).unionByName(docs).cache()
    told = stage["language_id"](spark, first, "").cache()
    lettered = [r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(r["doc_id"] for r in told.collect()) == sorted(lettered) and told.columns == docs.columns

    some = told.where("length(text) < 1500").cache()
    apart = stage["near_duplicates"](spark, some, "").cache()
    component, _ = brute([(r["doc_id"], r["text"]) for r in some.collect()], 80)
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted({v for v in component.values()})

    clean = stage["personal_data"](spark, apart, "").cache()
    before = {r["doc_id"]: r["text"] for r in apart.collect()}
    assert clean.count() == len(before) and clean.columns == docs.columns
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not any("@" in r["text"][a:b] for a, k, b in pii.base_spans(r["text"]))
        if not any(c.isdigit() or c == "@" for c in before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]

    mixed = stage["mixture"](spark, clean, "").cache()
    assert 0 < mixed.count() <= clean.count() and mixed.columns == docs.columns
    assert not set(map(tuple, mixed.collect())) - set(map(tuple, clean.collect()))

    ranks = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in stage["tokens"](spark, mixed, "").collect():
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_awkward_rows_pass_every_stage(spark, awkward, empty):
    for table in (awkward, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), table.schema)
            assert docs.columns == table.columns
            if name == "near_duplicates" and table is awkward:
                ids = [r["doc_id"] for r in docs.collect()]
                # 2 to 4 and a nameless copy repeat 1, 9 repeats 8; 5 to 7 have no letter
                assert sorted(i for i in ids if i is not None) == [1, 8, 10, 11, 13] and ids.count(None) == 1  # wordless ones fell to language ID
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert len(out) == docs.count() and all(r["round_trip"] for r in out)


def test_columns_of_any_name_pass_every_stage(spark, docs):
    """Names that operators use inside, or that need quoting, come back with their values."""
    names = ["__id", "__lang", "__topic", "__words", "__w", "__tokens", "__id2", "weight", "kept", "component_id", "a.b", "a`b", "__pii", "__bpe"]
    some = docs.orderBy("doc_id").limit(120)
    more = some.select("*", *[F.concat(F.lit(f"{k}-"), F.col("doc_id")).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        more = spark.createDataFrame(stage(spark, more, "").collect(), more.schema)
        assert more.columns == [*some.columns, *names] and more.count() > 0, name
        for r in more.collect():
            assert list(r)[len(some.columns):] == [f"{k}-{r['doc_id']}" for k in range(len(names))], name
    assert corpus_pipeline.STAGES[-1][1](spark, more, "").count() == more.count()


def test_nameless_texts_without_words_stay(spark, docs):
    rows = [(None, "", "en", "s", 0), (None, None, "en", "s", 0), (None, "  ", "en", "s", 2), (None, "two words", "en", "s", 9), (None, "two words", "fr", "s", 9)]
    df = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert sorted("-" if r["text"] is None else r["text"] for r in corpus_pipeline.near_duplicate(spark, df, "").collect()) == sorted(["", "-", "  ", "two words"])


def test_many_languages(spark):
    """2,100 languages through the mixture, with the margins held."""
    from tabsieve.llm import mixing, queries
    rows = spark.range(8_400).select(F.col("id").alias("doc_id"), F.lit("some words in a text here").alias("text"), F.concat(F.lit("l"), F.col("id") % 2100).alias("lang"),
                                     F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(25).cast("long").alias("n_chars"))
    report = {}
    queries.mixed(queries.mix_columns(rows), ["doc_id", "text"], 0.3, report).count()
    assert report["raked"] and max(report["residual"].values()) < 1e-4 and report["raking_residual"] < mixing.TOLERANCE
    assert 0 < corpus_pipeline.mixture(spark, rows, "").count() < 8_400
