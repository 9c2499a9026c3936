"""The operators applied to the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import bpe, hamming, langid, licenses, lm, mixing, negatives, phrases, pii, quality, urls, warc
from tabsieve.llm.common import materialise
from tabsieve.llm.neardup import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: all pairs that share a shingle, counted; components by a recursive walk over the links
_NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


@query("op8_minhash_neardup", _NEARDUP_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", percent=85)


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).select("doc_id", "__bpe.*")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(id_col: str = "doc_id"):
    """True for the quarter of ids that models never learn from; false for a missing id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()), key=F.col("doc_id"))


@query("op1_language_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "__lang.lang_pred", "__lang.score",
                        "__lang.languages", "__lang.n_letters")


@query("op4_semi_markov_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    kind = F.array(*map(F.lit, pii.KINDS))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(
            ":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def of_kind(k: int):
        return F.filter("__pii.base", lambda x: x["kind"] == k)

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("__pii.base").cast("binary"), 256).alias("base_sha256"),
                        joined("__pii.found").alias("spans"))


#: powers of the token shares that the margins are raked to: hot sources and languages give way
MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: share of the input's tokens that the query samples: about the most for which the margins still hold on the small tables
MIX_SHARE = 0.2
_WORDS = r"[^\x20\x09-\x0D]+"


def mix_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__topic`` (by marker words: the given documents have no topic column) and ``__words``."""
    text = F.col("text")
    topic = (F.when(text.rlike("[Ll]icen[sc]e|[Rr]ights reserved"), "legal")
             .when((text.contains("@") & text.rlike("[^ ]@[^ ]")) | (text.contains("+") & text.rlike(r"\+[0-9]")), "contact")
             .when(text.contains(" | "), "table").otherwise("prose"))
    return docs.withColumn("__topic", topic).withColumn("__words", F.regexp_count("text", F.lit(_WORDS)).cast("long"))


def mixed(docs: DataFrame, key: list[str], share: float = MIX_SHARE, report: dict | None = None) -> DataFrame:
    """``docs`` (with the columns of ``mix_columns``) and their weights, probabilities and decisions, for ``share``
    of the tokens."""
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("__topic")}
    return mixing.sample(docs, margins, F.col("__words"), MIX_TARGETS, key, share=share, report=report)


@query("op2_raked_mixture")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mix_columns(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    read = materialise(docs.drop("text"), "mixture-documents")  # texts are read once
    return mixed(read, ["doc_id", "__words"]).select(
        "doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__words").alias("n_tokens"),
        "weight", "probability", "kept")


#: base32 of SHA-1, five bits a digit
_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p),
g AS (SELECT page_id, n, top, [('0x' || h[1 + 10 * k:10 + 10 * k])::BIGINT for k in range(0, 4)] AS parts FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> (35 - 5 * i)) & 31)::INT, 1)
    for i in range(0, 8)], '') for x in parts], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS intact
FROM g
"""


@query("op9_warc_round_trip", _WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read_records(index, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        "refers_to", "intact")


@query("op7_quality_regression")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).select("doc_id", "__quality.*")


@query("op3_license_templates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = [F.col(f"__license.{c}") for c in ("n_words", "n_base", "first_word", "last_word")]
    return found.select("doc_id", *fields, F.array_join("__license.base_labels", ",").alias("base_labels"),
                        F.array_join("__license.labels", ",").alias("labels"), "__license.score")


#: fixed values: the rules of the URL query
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_URL_SQL = r"""
WITH RECURSIVE u AS (
  SELECT DISTINCT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS q FROM u),
rules(rhost, rpath, own) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')),
o AS (SELECT url, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(own, length(rhost || rpath)) AS own
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
c AS (SELECT url, regexp_replace(host, '^(www|m|amp)\.', '') || regexp_replace(path, '/+$', '')
    || regexp_replace(regexp_replace(regexp_replace(q, '([?&])((utm_[a-z]+|ref|fbclid|gclid)=[^&#]*&?)+', '\1', 'g'),
         '[?&]$', ''), '[?&]$', '') AS form, host FROM h),
g AS (SELECT form, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM c JOIN o USING (url)
  WHERE c.host <> '' AND own IS NOT NULL GROUP BY form)
SELECT page_id, o.host, o.path, o.rule,
  coalesce(o.own, CASE WHEN g.blocked AND NOT g.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN o ON p.url IS NOT DISTINCT FROM o.url JOIN c ON p.url IS NOT DISTINCT FROM c.url
LEFT JOIN g ON g.form = c.form AND c.host <> ''
"""


@query("op5_redirect_url_filter", _URL_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules, "page_id", "url", "html")


_TOPK_SQL = """
WITH c AS (SELECT vec_id, [x > 0 for x in embedding] AS code FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
        list_sum([CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END for p in list_zip(q.code, r.code)])::INTEGER AS distance
      FROM c q JOIN c r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM n WHERE rank <= 10
"""


@query("op6_multi_index_hashing", _TOPK_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


@query("op11_bloom_language_model")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    model = lm.fit(docs.where(learn))
    return lm.score(docs, model, learn).select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                                               F.lit(model.settings.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: every phrase counted by itself
_PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, k, unnest([ws[i:i + k - 1] for i in range(1, len(ws) - k + 2)]) AS g FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
gone AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS g FROM c WHERE k = 3) b
    ON s.lang = b.lang AND s.g = b.g WHERE 100 * b.f >= 50 * s.f),
cut AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS j FROM c ANTI JOIN gone USING (lang, g)),
s AS (SELECT cut.lang, cut.g, a, j, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:j] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[j + 1:cut.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
d AS (SELECT *, array_to_string(g, ' ') AS phrase FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM d JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op13_debruijn_collocations", _PHRASES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: every anchor against every row
_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT a.vec_id AS anchor, a.label AS own, r.vec_id AS id, r.label, list_inner_product(a.v, r.v)::BIGINT AS s
      FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM d WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY d.s DESC, d.id)::INTEGER AS rank,
       d.id AS negative_id, p.s AS positive_score, d.s AS negative_score
FROM p JOIN d ON d.anchor = p.anchor AND d.label <> d.own AND 50 * p.s <= 100 * d.s AND 100 * d.s <= 95 * p.s QUALIFY rank <= 3
"""


@query("op12_rtree_hard_negatives", _NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, key % 50 == 0, label)
