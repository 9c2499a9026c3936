"""The corpus pipeline: language ID, near-duplicates, personal data, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.  Columns beside those of
``documents``, whatever their names, pass every stage but the last unchanged.  An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import bpe, langid, pii, queries
from tabsieve.llm.common import materialise
from tabsieve.llm.neardup import near_duplicates

#: share of the tokens that the mixture keeps; the most wanted cells are then kept whole
MIX_SHARE = 0.3

_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with every column beside those of ``documents`` under a name no operator uses."""
    return docs.toDF(*[c if c in _OWN else f"aside{k}" for k, c in enumerate(docs.columns)])


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with their names, in order."""
    return found.select(*_set_aside(docs).columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language cannot be told (null or no letter); names the language of those
    that state none.  An empty table, or one in which no document states a language, keeps nothing."""
    plain = _set_aside(docs)
    found = langid.identify(plain, queries.language_model(plain))
    return _restored(found.where(F.col("__lang.lang_pred") != langid.UNDETERMINED)
                     .withColumn("lang", F.coalesce("lang", "__lang.lang_pred")), docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the smallest id.  Rows of one id are one document, of which one
    row stays; rows without id are named by their text and give way to any with an id, but stay if they have no word."""
    plain = _set_aside(docs)
    nameless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = plain.where(~nameless).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")
                                              .bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))))
    stay = near_duplicates(named, "__id", "text").where("kept").select("__id").distinct()
    one = named.join(stay, "__id", "left_semi").dropDuplicates(["__id"]).select(*plain.columns)
    return _restored(one.unionByName(plain.where(nameless)), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks; every document stays, ``n_chars`` follows the text (a null text stays null)."""
    plain = _set_aside(docs)
    clean = pii.redact(plain, pii.fit(plain))
    return _restored(clean.withColumn("n_chars", F.length("text").cast("long")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples ``MIX_SHARE`` of the tokens so that sources, languages and topics come as near to their target
    shares as that allows (cells short of tokens are kept whole).  A null source or language is a value of its own; a document
    without a word has no token and is not kept."""
    plain = _set_aside(docs)
    return _restored(queries.mixed(queries.mix_columns(plain), ["doc_id", "text"], MIX_SHARE).where("kept"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, round_trip``: ids of every text (null: empty), and whether decoding them gives the
    text again.  Other columns are not read; repeated rows are encoded each."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_and_decode(_set_aside(docs), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("__bpe.ids").cast("long").alias("n_tokens"), "__bpe.ids",
                        (F.col("__bpe.decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicate), ("personal_data", personal_data),
          ("mixture", mixture), ("tokens", tokens)]

#: an iterated likelihood, a trained model and merges: not expressible in SQL, tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
