"""Queries over the driver's tables (one per operator of the inventory) and their DuckDB oracles.

The tables hold no NULLs, so NULL paths are injected identically in the query and in the oracle
(``nullif`` / ``CASE``).  Floating results are rounded half-even to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabsieve.operators import binning, cleaning, distribution, encoding, freq, fuzzy, profile, splitting
from tabsieve.plans.catalog import register, rounded, table  # noqa: F401


# --------------------------------------------------------------------------------------------- freq
@register("category_table", """
WITH v AS (
  SELECT 'p_brand' AS feature, coalesce(nullif(p_brand, 'Brand#13'), 'Missing') AS category FROM part
  UNION ALL
  SELECT 'p_type', coalesce(CASE WHEN p_type = 'PROMO' THEN NULL
                                 WHEN p_type = 'SMALL' THEN 'Missing' ELSE p_type END, 'Missing') FROM part),
f AS (SELECT feature, category, count(*) AS cnt FROM v GROUP BY 1, 2)
SELECT feature,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) AS BIGINT) AS rank,
       category, CAST(cnt AS BIGINT) AS count,
       round_even(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY feature) * 100, 2) AS percentage
FROM f
""")
def q_category_table(spark: SparkSession, sf: str):
    part = table(spark, sf, "part").select(
        F.nullif("p_brand", F.lit("Brand#13")).alias("p_brand"),
        F.when(F.col("p_type") == "PROMO", None).when(F.col("p_type") == "SMALL", "Missing")
         .otherwise(F.col("p_type")).alias("p_type"))
    return freq.category_table(part, ["p_brand", "p_type"])


@register("category_summary", """
WITH b AS (SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)
SELECT 'o_orderstatus' AS feature, CAST(count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_categories FROM b
UNION ALL
SELECT 'o_orderpriority', CAST(count(DISTINCT o_orderpriority) + max(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM b
""")
def q_category_summary(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return freq.category_summary(o, ["o_orderstatus", "o_orderpriority"])


@register("rare_categories", """
WITH v AS (SELECT 'p_name' AS feature, p_name AS category FROM part
           UNION ALL SELECT 'p_brand', p_brand FROM part),
f AS (SELECT feature, category, count(*) AS cnt FROM v GROUP BY 1, 2),
t AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) AS BIGINT) AS rank,
             category, CAST(cnt AS BIGINT) AS count,
             round_even(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY feature) * 100, 2) AS percentage FROM f)
SELECT * FROM t WHERE count <= 25
""")
def q_rare_categories(spark, sf):
    part = table(spark, sf, "part")
    return freq.rare_categories(freq.category_table(part, ["p_name", "p_brand"]), max_count=25)


@register("value_counts", """
SELECT event_type AS category, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1
""")
def q_value_counts(spark, sf):
    return freq.value_counts(table(spark, sf, "events"), "event_type")


@register("currency_counts", """
SELECT CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS category,
       CAST(count(*) AS BIGINT) AS count
FROM orders GROUP BY 1
""")
def q_currency_counts(spark, sf):
    o = table(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"))
    return freq.value_counts(o, "o_orderstatus", dropna=False)


@register("top_n_other", """
WITH v AS (SELECT 'p_brand' AS feature, coalesce(nullif(p_brand, 'Brand#4'), 'Missing') AS category FROM part
           UNION ALL SELECT 'p_type', p_type FROM part),
f AS (SELECT feature, category, count(*) AS cnt FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) AS rn,
             count(*) OVER (PARTITION BY feature) AS k FROM f)
SELECT feature, category, CAST(cnt AS BIGINT) AS count, false AS is_rollup FROM r WHERE rn <= 10
UNION ALL
SELECT feature, 'Other', CAST(sum(cnt) AS BIGINT), true FROM r WHERE rn > 10 GROUP BY feature
""")
def q_top_n_other(spark, sf):
    part = table(spark, sf, "part").select(F.nullif("p_brand", F.lit("Brand#4")).alias("p_brand"), "p_type")
    return freq.top_n_other(part, ["p_brand", "p_type"], top_n=10)


@register("explore_categorical", """
WITH base AS (SELECT nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment, c_name,
                     CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS c_positive FROM customer),
long AS (SELECT 'c_mktsegment' AS feature, 'string' AS dtype, c_mktsegment AS v FROM base
         UNION ALL SELECT 'c_name', 'string', c_name FROM base
         UNION ALL SELECT 'c_positive', 'boolean', c_positive FROM base),
f AS (SELECT feature, dtype, v, count(*) AS cnt FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, v) AS rn_top,
                row_number() OVER (PARTITION BY feature ORDER BY cnt ASC, v DESC) AS rn_low
      FROM f WHERE v IS NOT NULL),
tot AS (SELECT feature, dtype, sum(cnt) AS n, coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS miss,
               count(v) AS uniq, count(*) FILTER (WHERE v IS NOT NULL AND cnt <= 1) AS rare
        FROM f GROUP BY ALL),
agg AS (SELECT feature,
               string_agg(v || ': ' || cnt, ' | ' ORDER BY rn_top) FILTER (WHERE rn_top <= 5) AS categories_preview,
               max(v) FILTER (WHERE rn_top = 1) AS most_frequent,
               max(cnt) FILTER (WHERE rn_top = 1) AS most_frequent_count,
               string_agg(v || ': ' || cnt, ' | ' ORDER BY cnt, v) FILTER (WHERE rn_low <= 5) AS least_frequent_preview
        FROM r GROUP BY feature)
SELECT tot.feature, dtype, categories_preview, most_frequent,
       CAST(most_frequent_count AS BIGINT) AS most_frequent_count,
       round_even(most_frequent_count::DOUBLE / n * 100, 2) AS most_frequent_pct,
       least_frequent_preview, CAST(rare AS BIGINT) AS rare_categories,
       CAST(miss AS BIGINT) AS missing, round_even(miss::DOUBLE / n * 100, 2) AS missing_pct,
       CAST(n - miss AS BIGINT) AS non_missing, CAST(uniq AS BIGINT) AS "unique",
       round_even(uniq::DOUBLE / n * 100, 2) AS unique_pct
FROM tot LEFT JOIN agg USING (feature)
""")
def q_explore_categorical(spark, sf):
    c = table(spark, sf, "customer").select(
        F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("c_mktsegment"), "c_name",
        (F.col("c_acctbal") > 0).alias("c_positive"))
    return profile.categorical_profile(c, ["c_mktsegment", "c_name", "c_positive"])


# ------------------------------------------------------------------------------------------ profile
_STATS6 = ["min", "q1", "median", "mean", "q3", "max", "std"]


@register("explore_target", """
WITH base AS (
  SELECT CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS grp,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 0.0
              ELSE o_totalprice END AS v
  FROM orders),
g AS (
  SELECT CASE WHEN grouping(grp) = 1 THEN 'All' ELSE grp END AS "group", grouping(grp) = 1 AS is_total,
         count(v) AS count, CAST(count(*) - count(v) AS BIGINT) AS missing,
         round_even((count(*) - count(v))::DOUBLE / count(*) * 100, 2) AS missing_pct,
         min(v) AS mn, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, avg(v) AS mean,
         quantile_cont(v, 0.75) AS q3, max(v) AS mx, stddev_samp(v) AS std,
         CAST(count(*) FILTER (WHERE v = 0) AS BIGINT) AS zero_count
  FROM base GROUP BY GROUPING SETS ((), (grp)))
SELECT "group", is_total, count, missing, missing_pct, round_even(mn, 6) AS min, round_even(q1, 6) AS q1,
       round_even(median, 6) AS median, round_even(mean, 6) AS mean, round_even(q3, 6) AS q3,
       round_even(mx, 6) AS max, round_even(std, 6) AS std, zero_count
FROM g
""")
def q_explore_target(spark, sf):
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    o = o.select(F.nullif(status, F.lit("O")).alias("o_orderstatus"),
                 F.when(F.col("o_orderpriority") == "5-LOW", None)
                  .when((F.col("o_orderpriority") == "1-URGENT") & (status == "P"), 0.0)
                  .otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return rounded(profile.explore_target(o, "o_totalprice", "o_orderstatus"), _STATS6)


def _numeric_profile_sql(cte: str, cols: list[tuple[str, str]]) -> str:
    union = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{t}' AS dtype, CAST({c} AS DOUBLE) AS v FROM base" for c, t in cols)
    return f"""
WITH base AS ({cte}),
long AS ({union}),
s AS (SELECT feature, dtype, count(v) AS nn, count(*) - count(v) AS miss, count(*) AS n,
             min(v) AS mn, max(v) AS mx, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
             stddev_samp(v) AS std, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
             count(*) FILTER (WHERE v = 0) AS zc, count(DISTINCT v) AS uq
      FROM long GROUP BY 1, 2),
o AS (SELECT l.feature, count(*) FILTER (WHERE l.v < s.q1 - 1.5 * (s.q3 - s.q1)
                                         OR l.v > s.q3 + 1.5 * (s.q3 - s.q1)) AS oc
      FROM long l JOIN s USING (feature) GROUP BY 1)
SELECT feature, dtype, CAST(nn AS BIGINT) AS non_missing, CAST(miss AS BIGINT) AS missing,
       round_even(miss::DOUBLE / n * 100, 2) AS missing_pct,
       round_even(mn, 6) AS min, round_even(mx, 6) AS max, round_even(mean, 6) AS mean,
       round_even(median, 6) AS median, round_even(std, 6) AS std, round_even(q1, 6) AS q1,
       round_even(q3, 6) AS q3, CAST(zc AS BIGINT) AS zero_count, CAST(oc AS BIGINT) AS outlier_count,
       round_even(oc::DOUBLE / n * 100, 2) AS outlier_pct, CAST(uq AS BIGINT) AS "unique",
       round_even(uq::DOUBLE / n * 100, 2) AS unique_pct
FROM s JOIN o USING (feature)
"""


_NUM_COLS = ["min", "max", "mean", "median", "std", "q1", "q3"]


@register("explore_numeric", _numeric_profile_sql(
    "SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events",
    [("user_id", "bigint"), ("value", "double")]))
def q_explore_numeric(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("value"))
    return rounded(profile.numeric_profile(e, ["user_id", "value"]), _NUM_COLS)


@register("explore_numeric_documents", _numeric_profile_sql(
    "SELECT n_chars, doc_id FROM documents", [("n_chars", "bigint"), ("doc_id", "bigint")]))
def q_explore_numeric_documents(spark, sf):
    d = table(spark, sf, "documents")
    return rounded(profile.numeric_profile(d, ["n_chars", "doc_id"]), _NUM_COLS)


@register("duplicate_rows_documents", """
SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source)
""")
def q_duplicate_rows_documents(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("text", "lang", "source"))


@register("duplicate_rows_events", """
SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type, value)
""")
def q_duplicate_rows_events(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "events"), ["user_id", "event_type", "value"])


_LINEITEM_NULLED_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE l_discount END AS l_discount,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS l_tax,
       l_returnflag, l_linestatus, l_shipdate,
       'x' AS l_const, CAST(NULL AS VARCHAR) AS l_empty,
       CASE WHEN l_linenumber = 7 THEN 1 END AS l_seven
FROM lineitem"""

_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_const",
                  "l_empty", "l_seven"]


def _lineitem_nulled(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), None)
         .otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate", F.lit("x").alias("l_const"),
        F.lit(None).cast("string").alias("l_empty"),
        F.when(F.col("l_linenumber") == 7, F.lit(1)).alias("l_seven"))


def _per_column_sql(expr: str) -> str:
    return "\n  UNION ALL ".join(expr.format(c=c, i=i) for i, c in enumerate(_LINEITEM_COLS))


_MISSING_PARTS = _per_column_sql("""SELECT '{c}' AS "column", count(*) - count({c}) AS mc, count(*) AS n FROM b""")
_UNIQUE_PARTS = _per_column_sql("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS u, count(*) AS n FROM b""")
_CONST_PARTS = _per_column_sql("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS u, CAST(min({c}) AS VARCHAR) AS v FROM b""")


@register("missing_summary", f"""
WITH b AS ({_LINEITEM_NULLED_SQL}),
m AS ({_MISSING_PARTS})
SELECT "column", CAST(mc AS BIGINT) AS missing_count, round_even(mc::DOUBLE / n * 100, 2) AS missing_percentage
FROM m WHERE mc > 0
""")
def q_missing_summary(spark, sf):
    return profile.missing_summary(_lineitem_nulled(spark, sf))


@register("unique_summary", f"""
WITH b AS ({_LINEITEM_NULLED_SQL}),
u AS ({_UNIQUE_PARTS})
SELECT "column", CAST(u AS BIGINT) AS unique_values, round_even(u::DOUBLE / n * 100, 2) AS unique_pct FROM u
""")
def q_unique_summary(spark, sf):
    return profile.unique_summary(_lineitem_nulled(spark, sf))


@register("constant_columns", f"""
WITH b AS ({_LINEITEM_NULLED_SQL}),
u AS ({_CONST_PARTS})
SELECT "column", v AS unique_value FROM u WHERE u <= 1
""")
def q_constant_columns(spark, sf):
    return profile.constant_columns(_lineitem_nulled(spark, sf))


@register("range_check", """
SELECT 'p_size' AS "column", 45.0::DOUBLE AS "limit", max(p_size)::DOUBLE AS max_value,
       CAST(count(*) FILTER (WHERE p_size > 45) AS BIGINT) AS above_limit FROM part
UNION ALL
SELECT 'p_retailprice', 2000.0::DOUBLE, max(p_retailprice), CAST(count(*) FILTER (WHERE p_retailprice > 2000) AS BIGINT) FROM part
""")
def q_range_check(spark, sf):
    return profile.range_check(table(spark, sf, "part"), {"p_size": 45, "p_retailprice": 2000})


# ----------------------------------------------------------------------------------------- cleaning
@register("unit_conversion", """
SELECT o_orderkey,
       round_even(CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 904.125::DOUBLE ELSE o_totalprice END, 6) AS o_totalprice,
       o_orderpriority
FROM orders
""")
def q_unit_conversion(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    out = cleaning.convert_currency(o, "o_totalprice", "o_orderstatus", symbol="P")
    return rounded(out, ["o_totalprice"])


_LABEL_TEXT_SQL = """CASE WHEN quality = 1 AND toxic = 1 THEN ' SI ' WHEN quality = 1 THEN 'Sí'
                          WHEN toxic = 1 THEN NULL ELSE 'No' END"""


@register("binary_encode", f"""
SELECT doc_id, CAST(CASE WHEN lower(trim(t)) IN ('sí', 'si') THEN 1 WHEN lower(trim(t)) = 'no' THEN 0 END AS INTEGER) AS has_quality
FROM (SELECT doc_id, {_LABEL_TEXT_SQL} AS t FROM labels)
""")
def q_binary_encode(spark, sf):
    lab = table(spark, sf, "labels")
    q, t = F.col("quality"), F.col("toxic")
    text = (F.when((q == 1) & (t == 1), F.lit(" SI ")).when(q == 1, F.lit("Sí"))
             .when(t == 1, F.lit(None).cast("string")).otherwise(F.lit("No")))
    return cleaning.encode_binary(lab.select("doc_id", text.alias("has_quality")), "has_quality")


@register("range_filter", """
SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 45 AND p_retailprice <= 1800
""")
def q_range_filter(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return cleaning.remove_invalid_values(p, "p_size", "p_retailprice", max_year=45, max_doors=1800)


@register("drop_missing", """
SELECT doc_id, quality FROM (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN NULL ELSE toxic END AS toxic FROM labels)
WHERE toxic IS NOT NULL
""")
def q_drop_missing(spark, sf):
    lab = table(spark, sf, "labels").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, None).otherwise(F.col("toxic")).alias("toxic"))
    return cleaning.drop_columns(cleaning.drop_missing(lab, ["toxic"]), ["toxic", "not_a_column"])


# Fixed test dictionary (the shape of the reference's brand/colour maps; "large" listed twice so the
# later entry must win).
_TYPE_MAP = {
    "Big": ["large", "STANDARD"],
    "small": ["Smáll", "small-x"],
    "misc": ["promo", "economy", "large"],
}

_MANGLED_TYPE_SQL = """CASE WHEN p_size <= 10 THEN concat('  ', lower(p_type), '-x')
                            WHEN p_size <= 20 THEN replace(p_type, 'A', 'Á')
                            WHEN p_size <= 25 THEN NULL
                            WHEN p_size <= 30 THEN replace(p_type, 'E', '_e ')
                            ELSE p_type END"""


@register("semantic_mapping", f"""
WITH b AS (SELECT p_partkey, {_MANGLED_TYPE_SQL} AS t FROM part),
n AS (SELECT p_partkey,
             CASE WHEN t IS NULL THEN 'missing'
                  ELSE trim(regexp_replace(replace(replace(strip_accents(lower(trim(t))), '_', ' '), '-', ' '), '\\s+', ' ', 'g'))
             END AS v FROM b)
SELECT p_partkey, CASE v WHEN 'standard' THEN 'big' WHEN 'small' THEN 'small' WHEN 'small x' THEN 'small'
                         WHEN 'promo' THEN 'misc' WHEN 'economy' THEN 'misc' WHEN 'large' THEN 'misc'
                         ELSE v END AS p_type
FROM n
""")
def q_semantic_mapping(spark, sf):
    p = table(spark, sf, "part")
    size, ptype = F.col("p_size"), F.col("p_type")
    mangled = (F.when(size <= 10, F.concat(F.lit("  "), F.lower(ptype), F.lit("-x")))
                .when(size <= 20, F.replace(ptype, F.lit("A"), F.lit("Á")))
                .when(size <= 25, F.lit(None).cast("string"))
                .when(size <= 30, F.replace(ptype, F.lit("E"), F.lit("_e ")))
                .otherwise(ptype))
    return cleaning.apply_semantic_mapping(p.select("p_partkey", mangled.alias("p_type")), "p_type", _TYPE_MAP)


@register("one_hot", """
SELECT c_custkey,
       CAST(coalesce(seg = 'AUTOMOBILE', false) AS INTEGER) AS c_mktsegmentAUTOMOBILE,
       CAST(coalesce(seg = 'BUILDING', false) AS INTEGER) AS c_mktsegmentBUILDING,
       CAST(coalesce(seg = 'FURNITURE', false) AS INTEGER) AS c_mktsegmentFURNITURE,
       CAST(coalesce(seg = 'HOUSEHOLD', false) AS INTEGER) AS c_mktsegmentHOUSEHOLD
FROM (SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS seg FROM customer)
""")
def q_one_hot(spark, sf):
    c = table(spark, sf, "customer")
    model = encoding.fit_one_hot(c.where(F.col("c_mktsegment") != "MACHINERY"), ["c_mktsegment"])
    scoring = c.select("c_custkey", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("c_mktsegment"))
    return model.transform(scoring)


# ---------------------------------------------------------------------------------- binning / split
_EDGES_SQL = """(SELECT list_sort(list_distinct(quantile_cont(p_retailprice, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM part)"""


@register("quantile_bins", f"""
SELECT p_partkey,
       CASE WHEN p_retailprice = e[1] THEN '0'
            ELSE CAST(len(list_filter(e, lambda q: q < p_retailprice)) - 1 AS VARCHAR) END AS price_bin
FROM part, {_EDGES_SQL} AS edges
""")
def q_quantile_bins(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return binning.quantile_bins(p, "p_retailprice", 4).select("p_partkey", "price_bin")


@register("strata", f"""
WITH b AS (
  SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#7'), 'Unknown') || '_price_bin_' ||
         CASE WHEN p_retailprice = e[1] THEN '0'
              ELSE CAST(len(list_filter(e, lambda q: q < p_retailprice)) - 1 AS VARCHAR) END AS s
  FROM part, {_EDGES_SQL} AS edges)
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY s) < 20 THEN 'Other' ELSE s END AS stratum FROM b
""")
def q_strata(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"),
                                        "p_retailprice")
    return binning.brand_price_strata(p, "p_brand", "p_retailprice", 4, 20).select("p_partkey", "stratum")


@register("stratified_split", """
WITH b AS (SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS s,
                  md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, o_orderkey) AS rn,
             count(*) OVER (PARTITION BY s) AS n FROM b)
SELECT o_orderkey, s AS stratum,
       CASE WHEN rn <= round_even(n::DOUBLE * 0.8, 0) THEN 'train' ELSE 'validation' END AS split
FROM r
""")
def q_stratified_split(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    out = splitting.stratified_split(o, "o_orderpriority", ["o_orderkey"], 0.80, 42, stratum_col="stratum")
    return out.select("o_orderkey", "stratum", "split")


# ------------------------------------------------------------------------------------ distributions
def _numpy_bin_sql(v: str) -> str:
    """SQL twin of distribution.numpy_bin over columns f (first edge), l (last edge), nb (bins)."""
    i1 = f"LEAST(CAST(floor(({v} - f) / (l - f) * nb) AS INTEGER), nb - 1)"
    e = lambda i: f"(CASE WHEN {i} >= nb THEN l ELSE f + ({i}) * ((l - f) / nb) END)"
    i2 = f"(CASE WHEN {v} < {e(i1)} THEN {i1} - 1 ELSE {i1} END)"
    return f"(CASE WHEN {v} >= {e(i2 + ' + 1')} AND {i2} <> nb - 1 THEN {i2} + 1 ELSE {i2} END)"


@register("histogram", f"""
WITH v AS (SELECT event_type AS grp, value AS v FROM events),
p AS (SELECT grp, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS f,
             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS l, 40 AS nb FROM v GROUP BY grp),
c AS (SELECT grp, {_numpy_bin_sql('v')} AS bin, count(*) AS cnt FROM v JOIN p USING (grp) GROUP BY ALL),
g AS (SELECT grp, f, l, nb, CAST(unnest(range(0, nb)) AS INTEGER) AS bin FROM p),
m AS (SELECT grp, quantile_cont(v, 0.5) AS median FROM v GROUP BY grp)
SELECT grp AS "group", bin, round_even(f + bin * ((l - f) / nb), 6) AS bin_start,
       round_even(CASE WHEN bin = nb - 1 THEN l ELSE f + (bin + 1) * ((l - f) / nb) END, 6) AS bin_end,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count, round_even(median, 6) AS median
FROM g LEFT JOIN c USING (grp, bin) JOIN m USING (grp)
""")
def q_histogram(spark, sf):
    e = table(spark, sf, "events")
    return rounded(distribution.histogram_by_group(e, "value", "event_type", 40),
                   ["bin_start", "bin_end", "median"])


@register("raw_distribution", f"""
WITH v AS (SELECT 'p_size' AS feature, CAST(p_size AS DOUBLE) AS v FROM part
           UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
lim AS (SELECT feature, quantile_cont(v, 0.01) AS plo, quantile_cont(v, 0.99) AS phi,
               quantile_cont(v, 0.5) AS median FROM v GROUP BY feature),
t AS (SELECT feature, v.v FROM v JOIN lim USING (feature) WHERE v.v BETWEEN plo AND phi),
p AS (SELECT feature, feature = 'p_size' AS is_int,
             CASE WHEN feature = 'p_size' THEN floor(min(v)) - 0.5
                  WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS f,
             CASE WHEN feature = 'p_size' THEN floor(min(v)) - 0.5 + (ceil(max(v)) - floor(min(v)) + 1)
                  WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS l,
             CAST(CASE WHEN feature = 'p_size' THEN ceil(max(v)) - floor(min(v)) + 1 ELSE 35 END AS INTEGER) AS nb
      FROM t GROUP BY feature),
c AS (SELECT feature, CASE WHEN is_int THEN LEAST(CAST(floor(v - f) AS INTEGER), nb - 1)
                           ELSE {_numpy_bin_sql('v')} END AS bin, count(*) AS cnt
      FROM t JOIN p USING (feature) GROUP BY ALL),
g AS (SELECT feature, f, l, nb, CAST(unnest(range(0, nb)) AS INTEGER) AS bin FROM p)
SELECT feature, bin, round_even(f + bin * ((l - f) / nb), 6) AS bin_start,
       round_even(CASE WHEN bin = nb - 1 THEN l ELSE f + (bin + 1) * ((l - f) / nb) END, 6) AS bin_end,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count, round_even(median, 6) AS median
FROM g LEFT JOIN c USING (feature, bin) JOIN lim USING (feature)
""")
def q_raw_distribution(spark, sf):
    p = table(spark, sf, "part")
    out = distribution.raw_distributions(p, ["p_size", "p_retailprice", "absent"], bins=35,
                                         integer_columns=["p_size"])
    return rounded(out, ["bin_start", "bin_end", "median"])


@register("percentile_trim", """
SELECT p_partkey, p_retailprice FROM part
WHERE p_retailprice BETWEEN (SELECT quantile_cont(p_retailprice, 0.01) FROM part)
                        AND (SELECT quantile_cont(p_retailprice, 0.99) FROM part)
""")
def q_percentile_trim(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return distribution.percentile_trim(p, "p_retailprice")


@register("boxplot_stats", """
WITH v AS (SELECT 'value' AS feature, event_type AS grp, value AS v FROM events
           UNION ALL SELECT 'user_id', NULL, CAST(user_id AS DOUBLE) FROM events),
q AS (SELECT feature, grp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ALL),
w AS (SELECT feature, q.grp, q1, median, q3, count(*) AS n,
             min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS wl,
             max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS wh
      FROM v JOIN q USING (feature) WHERE v.grp IS NOT DISTINCT FROM q.grp
      GROUP BY feature, q.grp, q1, median, q3),
b AS (SELECT feature, grp, n, q1, median, q3,
             CASE WHEN wl IS NULL OR wl > q1 THEN q1 ELSE wl END AS whisker_low,
             CASE WHEN wh IS NULL OR wh < q3 THEN q3 ELSE wh END AS whisker_high FROM w)
SELECT b.feature, b.grp AS "group", CAST(b.n AS BIGINT) AS n, round_even(q1, 6) AS q1,
       round_even(median, 6) AS median, round_even(q3, 6) AS q3,
       round_even(whisker_low, 6) AS whisker_low, round_even(whisker_high, 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE v.v < whisker_low OR v.v > whisker_high) AS BIGINT) AS fliers
FROM v JOIN b ON v.feature = b.feature AND v.grp IS NOT DISTINCT FROM b.grp
GROUP BY ALL
""")
def q_boxplot_stats(spark, sf):
    e = table(spark, sf, "events")
    out = distribution.boxplot_stats(e, ["value", "user_id"], group_col="event_type", grouped_columns=["value"])
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@register("missing_by_year", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS missing,
       round_even(avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct
FROM orders GROUP BY 1
""")
def q_missing_by_year(spark, sf):
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("o_year"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"))
    return rounded(distribution.missing_by_group(o, "o_year", "prio"), ["missing_pct"])


# ------------------------------------------------------------------------------------------- fuzzy
# Iterative / difflib-based: no SQL oracle (rows-only check by the driver); tests/test_fuzzy.py checks
# them against the sequential reference algorithm on fixtures and the golden values of FIXTURES.md.
def _ratio_sql(features: dict[str, str], norm: str, threshold: float, first: str) -> str:
    """CTEs up to ``e(feature, r1, r2, score)``: matching blocks by recursion on the longest common run, earliest
    first, of each pair of values.  ``first`` is the side (``x`` the more frequent, ``y``) that is matched against the
    other."""
    second = "y" if first == "x" else "x"
    union = " UNION ALL ".join(f"SELECT '{f}' AS feature, {e} AS category FROM part" for f, e in features.items())
    return f"""
WITH RECURSIVE f AS (SELECT feature, category, count(*) AS cnt FROM ({union}) WHERE category IS NOT NULL GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) AS rank, {norm} AS norm FROM f),
p AS (SELECT x.feature, x.rank AS r1, y.rank AS r2, {first}.norm AS a, {second}.norm AS b FROM v x JOIN v y
      ON x.feature = y.feature AND x.rank < y.rank),
cells AS (SELECT p.*, unnest(range(1, length(a) + 1)) AS i FROM p),
runs AS (SELECT feature, r1, r2, i, j, list_max([n for n in range(1, least(length(a) - i, length(b) - j) + 2)
                                                if substr(a, i, n) = substr(b, j, n)]) AS k
         FROM (SELECT *, unnest(range(1, length(b) + 1)) AS j FROM cells) WHERE substr(a, i, 1) = substr(b, j, 1)),
seg AS (
  SELECT feature, r1, r2, 1::BIGINT AS alo, length(a) + 1 AS ahi, 1::BIGINT AS blo, length(b) + 1 AS bhi FROM p
  UNION ALL
  SELECT feature, r1, r2, part.alo, part.ahi, part.blo, part.bhi FROM (
    SELECT feature, r1, r2, unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j}},
                                    {{'alo': m.i + m.k, 'ahi': ahi, 'blo': m.j + m.k, 'bhi': bhi}}]) AS part
    FROM (SELECT s.*, r.m FROM seg s JOIN LATERAL (
            SELECT arg_max({{'i': i, 'j': j, 'k': least(k, s.ahi - i, s.bhi - j)}}, [least(k, s.ahi - i, s.bhi - j), -i, -j]) AS m
            FROM runs q WHERE q.feature = s.feature AND q.r1 = s.r1 AND q.r2 = s.r2
              AND q.i >= s.alo AND q.i < s.ahi AND q.j >= s.blo AND q.j < s.bhi) r ON r.m IS NOT NULL))
  WHERE part.alo < part.ahi AND part.blo < part.bhi),
matched AS (SELECT feature, r1, r2, sum(best) AS m FROM (
    SELECT s.feature, s.r1, s.r2, max(least(k, s.ahi - i, s.bhi - j)) AS best
    FROM seg s JOIN runs q ON q.feature = s.feature AND q.r1 = s.r1 AND q.r2 = s.r2
      AND q.i >= s.alo AND q.i < s.ahi AND q.j >= s.blo AND q.j < s.bhi
    GROUP BY s.feature, s.r1, s.r2, s.alo, s.ahi, s.blo, s.bhi) GROUP BY ALL),
e AS (SELECT feature, r1, r2, 2.0::DOUBLE * m / (length(a) + length(b)) AS score FROM p JOIN matched USING (feature, r1, r2)
      WHERE 2.0::DOUBLE * m / (length(a) + length(b)) >= {threshold})"""


def _groups_sql(features: list[str], threshold: float) -> str:
    norm = "trim(regexp_replace(replace(replace(strip_accents(lower(category)), '_', ' '), '-', ' '), '\\s+', ' ', 'g'))"
    return _ratio_sql({f: f for f in features}, norm, threshold, "x") + """,
before AS (SELECT feature, r2, list(r1) AS known FROM e GROUP BY ALL),
walk AS (SELECT feature, max(rank) AS n, 0::BIGINT AS step, []::BIGINT[] AS leaders FROM v GROUP BY feature
  UNION ALL
  SELECT w.feature, n, step + 1, CASE WHEN list_has_any(leaders, coalesce(known, []::BIGINT[])) THEN leaders
                               ELSE list_append(leaders, step + 1) END
  FROM walk w LEFT JOIN before b ON b.feature = w.feature AND b.r2 = w.step + 1 WHERE step < n),
led AS (SELECT feature, unnest(leaders) AS leader FROM walk WHERE step = n),
member AS (SELECT feature, leader AS rank, leader FROM led UNION ALL
  SELECT e.feature, e.r2, min(e.r1) FROM e JOIN led l ON l.feature = e.feature AND l.leader = e.r1
  WHERE NOT EXISTS (SELECT 1 FROM led x WHERE x.feature = e.feature AND x.leader = e.r2) GROUP BY ALL)
SELECT feature, string_agg(category, ' | ' ORDER BY rank) AS similar_values,
       array_to_string(list_sort(list_distinct(list(norm))), ' | ') AS normalized_values,
       sum(cnt)::BIGINT AS total_count, count(*) AS n_values_grouped
FROM member JOIN v USING (feature, rank) GROUP BY feature, leader HAVING count(*) > 1"""


_SUGGEST_SQL = _ratio_sql(
    {"p_name": "trim(p_name)"},
    "trim(regexp_replace(strip_accents(lower(category)), '[^a-z0-9]+', ' ', 'g'))", 0.85, "y") + """,
best AS (SELECT r2, arg_max({'r1': r1, 'score': score}, [score, -r1]) AS b FROM e GROUP BY r2),
s AS (SELECT v.category AS original_category, v.cnt AS original_count, coalesce(c.category, v.category) AS suggested_category,
             coalesce(c.cnt, v.cnt) AS suggested_count, coalesce(round_even(b.score, 3), 1.0::DOUBLE) AS similarity,
             CASE WHEN b IS NULL THEN 'keep' ELSE 'map' END AS action
      FROM v LEFT JOIN best ON best.r2 = v.rank LEFT JOIN v c ON c.rank = b.r1)"""


@register("semantic_repetitions", _groups_sql(["p_name"], 0.80))
def q_semantic_repetitions(spark, sf):
    return fuzzy.semantic_repetitions(table(spark, sf, "part"), ["p_name"], similarity_threshold=0.80)


@register("suggest_mapping", _SUGGEST_SQL + "\nSELECT * FROM s")
def q_suggest_mapping(spark, sf):
    return fuzzy.suggest_category_mapping(table(spark, sf, "part"), "p_name", threshold=0.85)


@register("apply_mapping", _SUGGEST_SQL + """
SELECT p_partkey, CASE WHEN trim(p_name) = 'red plate' THEN 'plate' ELSE coalesce(suggested_category, p_name) END AS p_name
FROM part LEFT JOIN s ON s.original_category = trim(p_name)""")
def q_apply_mapping(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    mapping = fuzzy.suggest_category_mapping(part, "p_name", threshold=0.85)
    return cleaning.apply_category_mapping(part, "p_name", mapping, manual_mapping={"red plate": "plate"})


@register("normalize_text", r"""
WITH b AS (SELECT p_partkey, CASE WHEN p_size <= 5 THEN NULL
                                  WHEN p_size <= 20 THEN upper(replace(p_name, 'o', 'ö'))
                                  WHEN p_size <= 30 THEN concat(' ', replace(p_name, ' ', '--'), '! ')
                                  ELSE p_name END AS t FROM part)
SELECT p_partkey,
       CASE WHEN t IS NULL THEN 'missing'
            ELSE trim(regexp_replace(regexp_replace(strip_accents(lower(t)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))
       END AS p_name
FROM b
""")
def q_normalize_text(spark, sf):
    from tabsieve.functions.text import normalize_text as norm2
    p = table(spark, sf, "part")
    size, name = F.col("p_size"), F.col("p_name")
    t = (F.when(size <= 5, F.lit(None).cast("string"))
          .when(size <= 20, F.upper(F.replace(name, F.lit("o"), F.lit("ö"))))
          .when(size <= 30, F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("--")), F.lit("! ")))
          .otherwise(name))
    return p.select("p_partkey", norm2(t).alias("p_name"))


# ------------------------------------------------------------------------------- more inventory rows
@register("missing_top_n", f"""
WITH b AS ({_LINEITEM_NULLED_SQL}),
m AS ({_MISSING_PARTS}),
o AS (SELECT "column", CAST(mc AS BIGINT) AS missing_count, round_even(mc::DOUBLE / n * 100, 2) AS missing_percentage,
             row_number() OVER () AS ordinal FROM m)
SELECT "column", missing_count, missing_percentage FROM o WHERE missing_count > 0
ORDER BY missing_percentage DESC, ordinal LIMIT 2
""")
def q_missing_top_n(spark, sf):
    """The bar data of the missing-value chart (top 2 columns)."""
    return profile.missing_summary(_lineitem_nulled(spark, sf), top_n=2)


@register("unique_top_n", f"""
WITH b AS ({_LINEITEM_NULLED_SQL}),
u AS ({_UNIQUE_PARTS}),
o AS (SELECT "column", CAST(u AS BIGINT) AS unique_values, round_even(u::DOUBLE / n * 100, 2) AS unique_pct,
             row_number() OVER () AS ordinal FROM u)
SELECT "column", unique_values, unique_pct FROM o ORDER BY unique_values DESC, ordinal LIMIT 5
""")
def q_unique_top_n(spark, sf):
    """The bar data of the unique-value chart (top 5 columns)."""
    return profile.unique_summary(_lineitem_nulled(spark, sf), top_n=5)


@register("duplicate_rows_text", """
SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM documents GROUP BY text)
""")
def q_duplicate_rows_text(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents"), ["text"])


@register("explore_categorical_events", """
WITH f AS (SELECT event_type AS v, count(*) AS cnt FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, v) AS rn_top,
                row_number() OVER (ORDER BY cnt ASC, v DESC) AS rn_low FROM f),
n AS (SELECT sum(cnt) AS n, count(*) AS uniq, count(*) FILTER (WHERE cnt <= 1) AS rare FROM f)
SELECT 'event_type' AS feature, 'string' AS dtype,
       (SELECT string_agg(v || ': ' || cnt, ' | ' ORDER BY rn_top) FROM r WHERE rn_top <= 2) AS categories_preview,
       (SELECT v FROM r WHERE rn_top = 1) AS most_frequent,
       (SELECT CAST(cnt AS BIGINT) FROM r WHERE rn_top = 1) AS most_frequent_count,
       (SELECT round_even(cnt::DOUBLE / n.n * 100, 2) FROM r WHERE rn_top = 1) AS most_frequent_pct,
       (SELECT string_agg(v || ': ' || cnt, ' | ' ORDER BY cnt, v) FROM r WHERE rn_low <= 2) AS least_frequent_preview,
       CAST(rare AS BIGINT) AS rare_categories, CAST(0 AS BIGINT) AS missing, 0.0::DOUBLE AS missing_pct,
       CAST(n AS BIGINT) AS non_missing, CAST(uniq AS BIGINT) AS "unique",
       round_even(uniq::DOUBLE / n * 100, 2) AS unique_pct
FROM n
""")
def q_explore_categorical_events(spark, sf):
    return profile.categorical_profile(table(spark, sf, "events"), ["event_type"], top_n=2)


@register("suggest_mapping_mapped", _SUGGEST_SQL + "\nSELECT * FROM s WHERE action = 'map'")
def q_suggest_mapping_mapped(spark, sf):
    """C4: only the suggestions whose action is ``map`` (scores as difflib's)."""
    return fuzzy.mapped_only(fuzzy.suggest_category_mapping(table(spark, sf, "part"), "p_name", 0.85))


@register("train_part", """
WITH b AS (SELECT o_orderkey, o_totalprice, coalesce(o_orderpriority, 'Unknown') AS s,
                  md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '7')) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, o_orderkey) AS rn,
             count(*) OVER (PARTITION BY s) AS n FROM b)
SELECT o_orderkey, o_totalprice FROM r WHERE rn <= round_even(n::DOUBLE * 0.75, 0)
""")
def q_train_part(spark, sf):
    """B8 + K2: the train view of a split on all orders (seed 7, 75 %)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    split = splitting.stratified_split(o, "o_orderpriority", ["o_orderkey"], 0.75, 7)
    return splitting.train_part(split).select("o_orderkey", "o_totalprice")


_PRICE_TEXT_SQL = """CASE WHEN o_orderpriority = '1-URGENT' THEN concat(CAST(o_totalprice AS VARCHAR), 'd')
                          WHEN o_orderpriority = '2-HIGH' THEN concat(' ', CAST(o_totalprice AS VARCHAR), ' ')
                          WHEN o_orderpriority = '3-MEDIUM' THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',')
                          WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'nan'
                          WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN '-Infinity'
                          ELSE CAST(o_totalprice AS VARCHAR) END"""


@register("to_number", rf"""
SELECT o_orderkey,
       CASE WHEN regexp_full_match(trim(t), '(?i)[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)')
            THEN try_cast(trim(t) AS DOUBLE) END AS price
FROM (SELECT o_orderkey, {_PRICE_TEXT_SQL} AS t FROM orders)
""")
def q_to_number(spark, sf):
    """I4: ``pandas.to_numeric(errors="coerce")`` on text prices with junk suffixes, padding, decimal
    commas, ``nan`` and infinities."""
    from tabsieve.functions.missing import to_number
    o = table(spark, sf, "orders")
    txt = o["o_totalprice"].cast("string")
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    t = (F.when(prio == "1-URGENT", F.concat(txt, F.lit("d")))
          .when(prio == "2-HIGH", F.concat(F.lit(" "), txt, F.lit(" ")))
          .when(prio == "3-MEDIUM", F.replace(txt, F.lit("."), F.lit(",")))
          .when((prio == "4-NOT SPECIFIED") & (status == "F"), F.lit("nan"))
          .when((prio == "4-NOT SPECIFIED") & (status == "O"), F.lit("-Infinity"))
          .otherwise(txt))
    return o.select("o_orderkey", to_number(t).alias("price"))


@register("semantic_repetitions_multi", _groups_sql(["p_name", "p_brand", "p_type"], 0.80))
def q_semantic_repetitions_multi(spark, sf):
    """J1 over several features at once (each feature grouped independently), threshold 0.80."""
    return fuzzy.semantic_repetitions(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], 0.80)


def _categorical_profile_sql(cte: str, cols: list[tuple[str, str, str]], top_n: int = 5) -> str:
    """SQL twin of freq.categorical_profile; ``cols`` = (feature, Spark dtype, text expression)."""
    union = "\n  UNION ALL ".join(f"SELECT '{c}' AS feature, '{t}' AS dtype, {e} AS v FROM base" for c, t, e in cols)
    return f"""
WITH base AS ({cte}),
long AS ({union}),
f AS (SELECT feature, dtype, v, count(*) AS cnt FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, v) AS rn_top,
                row_number() OVER (PARTITION BY feature ORDER BY cnt ASC, v DESC) AS rn_low
      FROM f WHERE v IS NOT NULL),
tot AS (SELECT feature, dtype, sum(cnt) AS n, coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS miss,
               count(v) AS uniq, count(*) FILTER (WHERE v IS NOT NULL AND cnt <= 1) AS rare
        FROM f GROUP BY ALL),
agg AS (SELECT feature,
               string_agg(v || ': ' || cnt, ' | ' ORDER BY rn_top) FILTER (WHERE rn_top <= {top_n}) AS categories_preview,
               max(v) FILTER (WHERE rn_top = 1) AS most_frequent,
               max(cnt) FILTER (WHERE rn_top = 1) AS most_frequent_count,
               string_agg(v || ': ' || cnt, ' | ' ORDER BY cnt, v) FILTER (WHERE rn_low <= {top_n}) AS least_frequent_preview
        FROM r GROUP BY feature)
SELECT tot.feature, dtype, categories_preview, most_frequent,
       CAST(most_frequent_count AS BIGINT) AS most_frequent_count,
       round_even(most_frequent_count::DOUBLE / n * 100, 2) AS most_frequent_pct,
       least_frequent_preview, CAST(rare AS BIGINT) AS rare_categories,
       CAST(miss AS BIGINT) AS missing, round_even(miss::DOUBLE / n * 100, 2) AS missing_pct,
       CAST(n - miss AS BIGINT) AS non_missing, CAST(uniq AS BIGINT) AS "unique",
       round_even(uniq::DOUBLE / n * 100, 2) AS unique_pct
FROM tot LEFT JOIN agg USING (feature)
"""


_ORDERS_NULLED_SQL = """SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, 'O') AS o_orderstatus,
                               o_orderpriority, o_orderdate FROM orders"""


def _orders_nulled(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"),
        "o_orderpriority", "o_orderdate")


@register("explore_features_numeric", _numeric_profile_sql(
    _ORDERS_NULLED_SQL, [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double")]))
def q_explore_features_numeric(spark, sf):
    """D2 via explore_features: every numeric column of a mixed table."""
    return rounded(profile.explore_features(_orders_nulled(spark, sf))["numeric"], _NUM_COLS)


@register("explore_features_categorical", _categorical_profile_sql(_ORDERS_NULLED_SQL, [
    ("o_orderstatus", "string", "o_orderstatus"), ("o_orderpriority", "string", "o_orderpriority"),
    ("o_orderdate", "timestamp_ntz", "CAST(o_orderdate AS VARCHAR)")]))
def q_explore_features_categorical(spark, sf):
    """D3 via explore_features: text columns and the timestamp (profiled as text, like the reference's
    object columns)."""
    return profile.explore_features(_orders_nulled(spark, sf))["categorical"]


@register("csv_roundtrip", """
SELECT c_custkey, concat(c_name, CASE WHEN c_nationkey < 5 THEN chr(10) || 'said "hi"' ELSE '' END) AS c_name,
       CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_balance_text
FROM customer
""")
def q_csv_roundtrip(spark, sf):
    """A1-A3: a CSV copy of ``customer`` (index column, ``NA`` tokens, quoted fields with quotes and
    newlines) written to the shared checkpoint folder and read back with pandas semantics."""
    from tabsieve.session import scratch_folder
    from tabsieve.sources.csv import read_csv
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    out = c.select(
        F.monotonically_increasing_id().alias("Unnamed: 0"), "c_custkey",
        F.concat("c_name", F.when(F.col("c_nationkey") < 5, F.lit('\nsaid "hi"')).otherwise(F.lit(""))).alias("c_name"),
        "c_nationkey", "c_acctbal",
        F.when(seg == "HOUSEHOLD", F.lit("NA")).otherwise(seg).alias("c_mktsegment"),
        F.when(seg == "BUILDING", F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("c_balance_text"))
    path = scratch_folder(spark, "csv")
    out.write.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)
    return read_csv(spark, path)


@register("audit_report_roundtrip", """
WITH v AS (SELECT 'p_brand' AS feature, p_brand AS category FROM part
           UNION ALL SELECT 'p_type', p_type FROM part),
f AS (SELECT feature, category, count(*) AS cnt FROM v GROUP BY 1, 2)
SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) AS BIGINT) AS rank,
       category, CAST(cnt AS BIGINT) AS count,
       round_even(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY feature) * 100, 2) AS percentage,
       '<tr><td>' || row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) || '</td><td>'
         || replace(replace(replace(replace(category, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
         || '</td><td>' || cnt || '</td><td>'
         || CAST(round_even(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY feature) * 100, 2) AS VARCHAR)
         || '</td></tr>' AS html
FROM f
""")
def q_audit_report_roundtrip(spark, sf):
    """A4: the category audit written to the shared checkpoint folder (Parquet tables and HTML rows,
    partitioned by feature) and read back, each table row next to its HTML row."""
    from tabsieve.session import scratch_folder
    from tabsieve.sources.reports import save_category_audit
    part = table(spark, sf, "part").select("p_brand", "p_type")
    path = save_category_audit(freq.category_summary(part, ["p_brand", "p_type"]),
                               freq.category_table(part, ["p_brand", "p_type"]),
                               scratch_folder(spark, "report"))
    tables = spark.read.parquet(f"{path}/tables")
    html = (spark.read.text(f"{path}/html")
                 .select("feature", F.col("value").alias("html"),
                         F.regexp_extract("value", "^<tr><td>([0-9]+)</td>", 1).cast("long").alias("rank")))
    return tables.join(html, ["feature", "rank"]).select("feature", "rank", "category", "count", "percentage", "html")


@register("boxplot_fliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY event_type),
w AS (SELECT event_type, q1, q3, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS wl,
             max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS wh
      FROM events JOIN q USING (event_type) GROUP BY ALL),
b AS (SELECT event_type, CASE WHEN wl IS NULL OR wl > q1 THEN q1 ELSE wl END AS lo,
             CASE WHEN wh IS NULL OR wh < q3 THEN q3 ELSE wh END AS hi FROM w)
SELECT e.event_id, e.event_type, e.value FROM events e JOIN b USING (event_type)
WHERE e.value < lo OR e.value > hi
""")
def q_boxplot_fliers(spark, sf):
    """The outlying rows themselves (per event type), as a filtered DataFrame."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return distribution.boxplot_fliers(ev, "value", "event_type")


@register("explore_documents", _categorical_profile_sql(
    "SELECT text, lang, source FROM documents",
    [("text", "string", "text"), ("lang", "string", "lang"), ("source", "string", "source")]))
def q_explore_documents(spark, sf):
    """D3/D4 over whole texts: the most/least frequent documents are previewed in full."""
    d = table(spark, sf, "documents").select("text", "lang", "source")
    return profile.explore_features(d)["categorical"]


@register("audit_report_document", """
WITH v AS (SELECT 'p_brand' AS feature, p_brand AS category FROM part
           UNION ALL SELECT 'p_type', p_type FROM part),
f AS (SELECT feature, category, count(*) AS cnt FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, category) AS rank,
             round_even(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY feature) * 100, 2) AS pct FROM f),
u AS (SELECT feature, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY n DESC, feature) AS pos FROM u),
l AS (
  SELECT 0 AS a, 0 AS b, 0::BIGINT AS c, '<!DOCTYPE html><html><head><meta charset=''utf-8''></head><body><h1>Categories</h1>' AS line
  UNION ALL SELECT 0, 0, 1, '<table><tr><th>feature</th><th>unique_categories</th></tr>'
  UNION ALL SELECT 1, pos, 0, '<tr><td>' || feature || '</td><td>' || n || '</td></tr>' FROM s
  UNION ALL SELECT 2, 0, 0, '</table>'
  UNION ALL SELECT 3, pos, -1, '<h2>' || feature || '</h2><table><tr><th>rank</th><th>category</th><th>count</th><th>percentage</th></tr>' FROM s
  UNION ALL SELECT 3, pos, rank, '<tr><td>' || rank || '</td><td>' || category || '</td><td>' || cnt || '</td><td>' || pct || '</td></tr>'
    FROM r JOIN s USING (feature)
  UNION ALL SELECT 3, pos, 4611686018427387904, '</table>' FROM s
  UNION ALL SELECT 4, 0, 0, '</body></html>')
SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS line_number, line FROM l
""")
def q_audit_report_document(spark, sf):
    """A4: the readable report, written and read back with the place of each line."""
    from tabsieve.session import scratch_folder
    from tabsieve.sources.reports import read_report, save_category_audit
    part = table(spark, sf, "part").select("p_brand", "p_type")
    path = save_category_audit(freq.category_summary(part, ["p_brand", "p_type"]),
                               freq.category_table(part, ["p_brand", "p_type"]), scratch_folder(spark, "report"))
    return read_report(spark, path)


@register("csv_with_index", """
SELECT c_custkey AS "Unnamed: 0", c_custkey, c_name, c_acctbal FROM customer
""")
def q_csv_with_index(spark, sf):
    """A2: a CSV copy of ``customer`` read raw, its index column kept."""
    from tabsieve.session import scratch_folder
    from tabsieve.sources.csv import read_csv
    path = scratch_folder(spark, "csv")
    (table(spark, sf, "customer").select(F.col("c_custkey").alias("Unnamed: 0"), "c_custkey", "c_name", "c_acctbal")
     .write.option("header", True).csv(path))
    return read_csv(spark, path, drop_index_columns=False)


@register("preview_customers", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def q_preview_customers(spark, sf):
    """A5: the first rows in a stated order (the limit is the feature)."""
    from tabsieve.sources.csv import preview
    return preview(table(spark, sf, "customer"), 5, ["c_custkey"])


@register("table_shape", """
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n_rows, 6::BIGINT AS n_columns UNION ALL
SELECT 'customer', (SELECT count(*) FROM customer), 5 UNION ALL
SELECT 'documents', (SELECT count(*) FROM documents), 5
""")
def q_table_shape(spark, sf):
    """A5: rows and columns of three tables."""
    from tabsieve.sources.csv import shape
    found = [(name, *shape(table(spark, sf, name))) for name in ("orders", "customer", "documents")]
    return spark.createDataFrame(found, "table_name string, n_rows long, n_columns long")


@register("default_categorical_columns", """
SELECT feature, count(*) AS unique_categories FROM (
  SELECT DISTINCT 'o_orderstatus' AS feature, o_orderstatus AS v FROM orders
  UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY feature
""")
def q_default_categorical_columns(spark, sf):
    """B1: the string columns that the schema names, summarised without a column list."""
    return freq.category_summary(table(spark, sf, "orders"))


@register("split_target", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
""")
def q_split_target(spark, sf):
    """The features without the target."""
    return cleaning.split_target(table(spark, sf, "orders").drop("o_orderdate"), "o_totalprice")[0]


@register("split_target_only", "SELECT o_totalprice FROM orders")
def q_split_target_only(spark, sf):
    """The target alone."""
    return cleaning.split_target(table(spark, sf, "orders"), "o_totalprice")[1]


@register("shuffled_orders", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey::VARCHAR, '42|shuffle'))) AS place FROM orders
""")
def q_shuffled_orders(spark, sf):
    """The place of every row in the seeded order."""
    return splitting.shuffled_places(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 42)


@register("text_similarity", _ratio_sql({"p_name": "p_name"}, "lower(trim(category))", 0.0, "x") + """
SELECT x.category AS first, y.category AS second, score AS similarity FROM e
JOIN v x ON x.rank = e.r1 JOIN v y ON y.rank = e.r2 WHERE split_part(x.category, ' ', 1) = split_part(y.category, ' ', 1)
""")
def q_text_similarity(spark, sf):
    """The ratio of every two part names with the same first word, the more frequent one first."""
    from tabsieve.functions.similarity import similarity
    from tabsieve.functions.text import normalize_category
    names = (fuzzy.vocabulary(table(spark, sf, "part"), ["p_name"], normalize_category)
             .select("rank", "category", "norm", F.substring_index("category", " ", 1).alias("word")))
    x, y = (names.select("word", *[F.col(c).alias(f"{c}_{s}") for c in ("rank", "category", "norm")]) for s in "xy")
    return (x.join(y, "word").where("rank_x < rank_y")
            .select(F.col("category_x").alias("first"), F.col("category_y").alias("second"),
                    similarity(F.col("norm_x"), F.col("norm_y")).alias("similarity")))


@register("one_hot_sparse", """
WITH w AS (SELECT DISTINCT 0 AS k, o_orderpriority AS c FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'
           UNION SELECT DISTINCT 1, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'),
p AS (SELECT *, row_number() OVER (ORDER BY k, c) - 1 AS position FROM w)
SELECT o_orderkey, array_to_string(list_sort(list_filter([a.position, b.position], lambda x: x IS NOT NULL)), ',') AS positions
FROM orders LEFT JOIN p a ON a.k = 0 AND a.c = o_orderpriority LEFT JOIN p b ON b.k = 1 AND b.c = o_orderstatus
""")
def q_one_hot_sparse(spark, sf):
    """B6 / B7 without a vocabulary limit: positions learned on a part that lacks some categories."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    learned = encoding.fit_vocabulary(o.where("o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT'"),
                                      ["o_orderpriority", "o_orderstatus"])
    coded = encoding.one_hot_sparse(o, learned, ["o_orderpriority", "o_orderstatus"])
    return coded.select("o_orderkey", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@register("missing_number_groups", """
WITH b AS (SELECT event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (user_id % 5)::DOUBLE END AS g, value FROM events)
SELECT coalesce(CAST(g AS VARCHAR), 'none') AS grp, count(*) AS n FROM b WHERE g IS NULL OR g >= 1 GROUP BY 1
""")
def q_missing_number_groups(spark, sf):
    """NaN policy: NaN group keys are missing ones, and a lower bound drops NaN like a comparison in pandas."""
    e = table(spark, sf, "events")
    nan = e.withColumn("g", F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("user_id") % 5).cast("double")))
    bounded = cleaning.range_filter(nan, {"g": (1, None)}).unionByName(nan.where(F.isnan("g")))
    text = bounded.select(F.coalesce(freq.as_text(bounded, "g"), F.lit("none")).alias("grp"))
    return text.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
