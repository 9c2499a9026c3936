"""Queries of the second wave: bivariate views, features and the price model (N2 to N16), with their DuckDB oracles.

The driver's tables stand in for listings: parts have a brand, type, size and price, orders a date and a total.  NULLs are
injected alike on both sides.  Floating results are rounded half-even; least-squares oracles are closed forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import bivariate, effects, features, moments, regression, splitting
from tabsieve.plans.catalog import register, rounded, table


def _rounded(df, digits: int, *columns: str):
    return df.select(*[F.bround(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ------------------------------------------------------------------------------------- correlation
_PAIRED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_CORRELATION_SQL = """
WITH r AS (SELECT nullif(l_quantity, 7) AS l_quantity, l_extendedprice,
                  CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN NULL ELSE l_discount END AS l_discount, l_tax FROM lineitem)
""" + "\nUNION ALL ".join(f"""
SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS n, round_even(covar_samp({a}, {b}), 2) AS covariance,
       round_even(corr({a}, {b}), 6) AS correlation FROM r WHERE {a} IS NOT NULL AND {b} IS NOT NULL""" for a in _PAIRED for b in _PAIRED)


@register("correlation_matrix", _CORRELATION_SQL)
def q_correlation_matrix(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.nullif("l_quantity", F.lit(7)).alias("l_quantity"), "l_extendedprice",
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2), None).otherwise(F.col("l_discount")).alias("l_discount"), "l_tax")
    return _rounded(rounded(moments.correlation_matrix(rows, _PAIRED), ["correlation"]), 2, "covariance")


# --------------------------------------------------------------------------------- adjusted effects
@register("adjusted_effects", """
WITH r AS (SELECT nullif(l_returnflag, 'R') AS f, CAST(l_suppkey AS VARCHAR) AS s, l_quantity AS x,
                  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS y FROM lineitem),
u AS (SELECT *, CASE WHEN f = 'A' THEN 1.0 ELSE 0.0 END AS a, CASE WHEN f = 'N' THEN 1.0 ELSE 0.0 END AS b FROM r WHERE y IS NOT NULL),
g AS (SELECT s, avg(x) AS mx, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) AS n FROM u GROUP BY s),
d AS (SELECT x - mx AS x, y - my AS y, a - ma AS a, b - mb AS b FROM u JOIN g USING (s)),
m AS (SELECT sum(x * x) AS xx, sum(x * a) AS xa, sum(x * b) AS xb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb,
             sum(x * y) AS xy, sum(a * y) AS ay, sum(b * y) AS yb FROM d),
k AS (SELECT xx * (aa * bb - ab * ab) - xa * (xa * bb - ab * xb) + xb * (xa * ab - aa * xb) AS det,
             xy * (aa * bb - ab * ab) - xa * (ay * bb - ab * yb) + xb * (ay * ab - aa * yb) AS dx,
             xx * (ay * bb - ab * yb) - xy * (xa * bb - ab * xb) + xb * (xa * yb - ay * xb) AS da,
             xx * (aa * yb - ay * ab) - xa * (xa * yb - ay * xb) + xy * (xa * ab - aa * xb) AS db FROM m),
e AS (SELECT 'l_returnflag' AS factor, f AS level, count(*) AS n, any_value(CASE WHEN f = 'A' THEN da / det WHEN f = 'N' THEN db / det ELSE 0 END) AS raw
      FROM u, k GROUP BY f
      UNION ALL SELECT 'l_suppkey', s, n, my - dx / det * mx - da / det * ma - db / det * mb FROM g, k)
SELECT factor, level, n, round_even(raw - sum(raw * n) OVER (PARTITION BY factor) / sum(n) OVER (PARTITION BY factor), 3) AS effect,
       true AS converged FROM e
""")
def q_adjusted_effects(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"), "l_suppkey", "l_quantity",
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_extendedprice")).alias("price"))
    return _rounded(effects.adjusted_effects(rows, "price", ["l_returnflag", "l_suppkey"], ["l_quantity"], tolerance=1e-12), 3, "effect")


# ---------------------------------------------------------------------- price model, residuals
_SPLIT_SQL = """
WITH b AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
                  md5(concat_ws('|', CAST(p_partkey AS VARCHAR), '42')) AS h FROM part),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey)
                     <= round_even(count(*) OVER (PARTITION BY p_brand)::DOUBLE * 0.8, 0) THEN 'train' ELSE 'validation' END AS split FROM b),
g AS (SELECT p_brand, avg(x) AS mx, avg(y) AS my FROM s WHERE split = 'train' GROUP BY p_brand),
k AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS beta FROM s JOIN g USING (p_brand) WHERE split = 'train'),
f AS (SELECT p_partkey, p_brand, split, y, my + beta * (x - mx) AS predicted FROM s JOIN g USING (p_brand), k)
"""


def _priced(spark, sf):
    """Parts with a prediction by the model of the train part."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    split = splitting.stratified_split(parts, "p_brand", ["p_partkey"], 0.80, 42).checkpoint()
    model = regression.fit_linear(split.where("split = 'train'"), "p_retailprice", ["p_size"], ["p_brand"])
    return model.predict(split)


@register("price_model", _SPLIT_SQL + """
SELECT p_partkey, split, round_even(predicted, 3) AS predicted, round_even(y - predicted, 3) AS residual FROM f
""")
def q_price_model(spark, sf):
    out = _priced(spark, sf).select("p_partkey", "split", "predicted", (F.col("p_retailprice") - F.col("predicted")).alias("residual"))
    return _rounded(out, 3, "predicted", "residual")


@register("price_residuals", _SPLIT_SQL + """
SELECT split AS "group", count(*) AS rows, round_even(avg(y - predicted), 4) AS bias, round_even(avg(abs(y - predicted)), 4) AS mae,
       round_even(sqrt(avg((y - predicted) ** 2)), 4) AS rmse, round_even(1 - sum((y - predicted) ** 2) / (var_pop(y) * count(*)), 4) AS r2,
       round_even(quantile_cont(y - predicted, 0.25), 4) AS q1, round_even(quantile_cont(y - predicted, 0.5), 4) AS median,
       round_even(quantile_cont(y - predicted, 0.75), 4) AS q3 FROM f GROUP BY split
""")
def q_price_residuals(spark, sf):
    out = regression.residual_summary(_priced(spark, sf), "p_retailprice", "predicted", "split")
    return _rounded(out, 4, "bias", "mae", "rmse", "r2", "q1", "median", "q3")


@register("residual_spread", _SPLIT_SQL + """,
v AS (SELECT p_brand, y - predicted AS r FROM f WHERE split = 'validation' OR p_partkey % 40 = 0),
p AS (SELECT p_brand, count(*) AS n, stddev_samp(r) AS sd, var_pop(r) * count(*) AS ss FROM v GROUP BY p_brand),
w AS (SELECT sum(ss) / sum(n - 1) AS pooled FROM p),
t AS (SELECT p_brand, n, sd, sqrt((ss + 20 * pooled) / (n - 1 + 20)) AS shrunken FROM p, w)
SELECT p_brand AS "group", n AS rows, round_even(sd, 4) AS spread, round_even(shrunken, 4) AS shrunken,
       row_number() OVER (ORDER BY shrunken DESC, p_brand) AS rank FROM t
""")
def q_residual_spread(spark, sf):
    seen = _priced(spark, sf).where("split = 'validation' OR p_partkey % 40 = 0")
    return _rounded(regression.residual_spread(seen, "p_retailprice", "predicted", "p_brand"), 4, "spread", "shrunken")


# -------------------------------------------------------------------------------- undervaluation
@register("undervaluation", """
WITH s AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
                  (('0x' || md5(CAST(p_partkey AS VARCHAR))[1:7])::BIGINT % 5)::INTEGER AS fold FROM part),
t AS (SELECT unnest(range(0, 5))::INTEGER AS fold),
g AS (SELECT t.fold, p_brand, avg(x) AS mx, avg(y) AS my FROM s JOIN t ON s.fold <> t.fold GROUP BY t.fold, p_brand),
k AS (SELECT g.fold, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS beta FROM s JOIN g ON s.p_brand = g.p_brand AND s.fold <> g.fold GROUP BY g.fold),
f AS (SELECT p_partkey, fold, y, my + beta * (x - mx) AS predicted FROM s JOIN g USING (fold, p_brand) JOIN k USING (fold)),
r AS (SELECT p_partkey, fold, round_even(predicted, 3) AS predicted, round_even((predicted - y) / predicted * 100, 4) AS undervaluation_pct FROM f)
SELECT *, row_number() OVER (ORDER BY undervaluation_pct DESC, p_partkey) AS rank FROM r
""")
def q_undervaluation(spark, sf):
    from tabsieve.operators.ordering import ordered_positions
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    out = regression.undervaluation(parts, "p_retailprice", ["p_partkey"], ["p_size"], ["p_brand"], 5)
    out = _rounded(_rounded(out.select("p_partkey", "fold", "predicted", "undervaluation_pct"), 4, "undervaluation_pct"), 3, "predicted")
    ranked = ordered_positions(out, [], [F.desc("undervaluation_pct"), "p_partkey"], pos_col="rank")
    return ranked.withColumn("rank", F.col("rank").cast("long"))


# ------------------------------------------------------------------------------------ projection
@register("projection", """
WITH RECURSIVE r AS (SELECT *, l_quantity + 100 * l_discount AS mixed FROM lineitem),
z AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS q,
    (mixed - avg(mixed) OVER ()) / stddev_pop(mixed) OVER () AS e, (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS d FROM r),
c AS (SELECT avg(q * e) AS qe, avg(q * d) AS qd, avg(e * d) AS ed FROM z),
one AS (SELECT 0 AS i, 0.6::DOUBLE AS a, 0.6::DOUBLE AS b, 0.5::DOUBLE AS c, 1.0::DOUBLE AS l UNION ALL
  SELECT i + 1, x / l, y / l, w / l, l FROM (SELECT i, x, y, w, sqrt(x * x + y * y + w * w) AS l FROM (
    SELECT i, a + qe * b + qd * c AS x, qe * a + b + ed * c AS y, qd * a + ed * b + c AS w FROM one, c AS cc(qe, qd, ed) WHERE i < 300))),
v AS (SELECT * FROM one WHERE i = 300),
two AS (SELECT 0 AS i, 0.1::DOUBLE AS a, 0.2::DOUBLE AS b, 0.9::DOUBLE AS c UNION ALL
  SELECT i + 1, x / l, y / l, w / l FROM (SELECT i, x, y, w, sqrt(x * x + y * y + w * w) AS l FROM (
    SELECT two.i, two.a + qe * two.b + qd * two.c - v.l * v.a * p AS x, qe * two.a + two.b + ed * two.c - v.l * v.b * p AS y,
           qd * two.a + ed * two.b + two.c - v.l * v.c * p AS w
    FROM (SELECT two.*, two.a * v.a + two.b * v.b + two.c * v.c AS p FROM two, v) AS two, v, c AS cc(qe, qd, ed) WHERE two.i < 300))),
u AS (SELECT * FROM two WHERE i = 300),
n1 AS (SELECT a * sign(a) AS a, b * sign(a) AS b, c * sign(a) AS c FROM v),
n2 AS (SELECT a * sign(c) AS a, b * sign(c) AS b, c * sign(c) AS c FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, round_even(q * n1.a + e * n1.b + d * n1.c, 4) AS pc1, round_even(q * n2.a + e * n2.b + d * n2.c, 4) AS pc2
FROM z, n1, n2
""")
def q_projection(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("mixed", F.col("l_quantity") + 100 * F.col("l_discount"))
    out, _ = regression.project(rows, ["l_quantity", "mixed", "l_tax"])
    return _rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "pc1", "pc2"), 4, "pc1", "pc2")


# --------------------------------------------------------------------------- by category, grids
@register("value_by_category", """
WITH r AS (SELECT nullif(o_orderpriority, '5-LOW') AS category, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS x FROM orders)
SELECT category, count(x) AS rows, round_even(median(x), 6) AS median, round_even(quantile_cont(x, 0.25), 6) AS q1,
       round_even(quantile_cont(x, 0.75), 6) AS q3, round_even(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr,
       round_even(avg(x), 4) AS mean, round_even(stddev_samp(x), 4) AS std, round_even(stddev_samp(x) / avg(x), 6) AS cv
FROM r GROUP BY category HAVING count(x) >= 30
""")
def q_value_by_category(spark, sf):
    rows = table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
                                             F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")).alias("price"))
    out = bivariate.value_by_category(rows, "price", "priority", 30)
    return _rounded(rounded(out, ["median", "q1", "q3", "iqr", "cv"]), 4, "mean", "std")


@register("iqr_ranking", """
WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS category, count(*) AS rows, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 20)
SELECT row_number() OVER (ORDER BY q3 - q1 DESC, category) AS rank, category, rows, round_even(q1, 6) AS q1, round_even(q3, 6) AS q3,
       round_even(q3 - q1, 6) AS iqr FROM r
""")
def q_iqr_ranking(spark, sf):
    return rounded(bivariate.iqr_ranking(table(spark, sf, "lineitem"), "l_extendedprice", "l_suppkey", 20), ["q1", "q3", "iqr"])


@register("median_grid", """
SELECT nullif(p_brand, 'Brand#7') AS "row", CAST(p_size AS VARCHAR) AS "column", count(*) AS rows, round_even(median(p_retailprice), 6) AS median
FROM part GROUP BY ALL HAVING count(*) >= 2
""")
def q_median_grid(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#7")))
    return rounded(bivariate.median_grid(parts, "p_retailprice", "p_brand", "p_size", 2), ["median"])


def _code_sql(x: str, e: str) -> str:
    return f"CASE WHEN {x} = {e}[1] THEN 0 ELSE len(list_filter({e}, lambda t: t < {x}))::INTEGER - 1 END"


@register("binned_grid", f"""
WITH r AS (SELECT nullif(l_quantity, 7) AS x, l_discount AS y, l_extendedprice AS v FROM lineitem), s AS (SELECT * FROM r WHERE x IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS ex,
             list_sort(list_distinct(quantile_cont(y, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS ey FROM s),
c AS (SELECT {_code_sql("x", "ex")} AS x_bin, {_code_sql("y", "ey")} AS y_bin, ex, ey, v FROM s, e)
SELECT x_bin, y_bin, ex[x_bin + 1] AS x_low, ex[x_bin + 2] AS x_high, ey[y_bin + 1] AS y_low, ey[y_bin + 2] AS y_high, count(*) AS rows,
       round_even(median(v), 6) AS median FROM c GROUP BY ALL
""")
def q_binned_grid(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(7)))
    return rounded(bivariate.binned_grid(rows, "l_extendedprice", "l_quantity", "l_discount", 4, 4), ["median"])


# ------------------------------------------------------------------------------------- yearly loss
_LOSS_SQL = """
WITH r AS (SELECT nullif(o_orderpriority, '5-LOW') AS g, o_totalprice AS x,
             CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996 THEN NULL ELSE 2010 - year(o_orderdate) END AS age FROM orders),
m AS (SELECT g, age, median(x) AS med FROM r WHERE age IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT *, lag(med) OVER w AS before, age - lag(age) OVER w AS y FROM m WINDOW w AS (PARTITION BY g ORDER BY age)),
p AS (SELECT g, sum(y)::BIGINT AS years, sum((1 - pow(med / before, 1.0 / y)) * y) / sum(y) AS loss FROM s WHERE before > 0 AND med > 0 %s GROUP BY g),
a AS (SELECT g, count(*) AS ages FROM m GROUP BY g)
SELECT row_number() OVER (ORDER BY loss, p.g) AS rank, p.g AS "group", ages, years, round_even(loss, 6) AS yearly_loss
FROM p JOIN a ON p.g IS NOT DISTINCT FROM a.g
"""


def _aged(spark, sf):
    year = F.year("o_orderdate")
    return table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_totalprice",
        F.when((F.col("o_orderpriority") == "1-URGENT") & (year == 1996), None).otherwise(2010 - year).alias("age"))


@register("yearly_loss", _LOSS_SQL % "")
def q_yearly_loss(spark, sf):
    return rounded(bivariate.yearly_loss(_aged(spark, sf), "o_totalprice", "age", "priority", 3), ["yearly_loss"])


@register("yearly_loss_unbroken", _LOSS_SQL % "AND y = 1")
def q_yearly_loss_unbroken(spark, sf):
    return rounded(bivariate.yearly_loss(_aged(spark, sf), "o_totalprice", "age", "priority", 3, span_gaps=False), ["yearly_loss"])


# ------------------------------------------------------------------------------- features
@register("engine_litres", """
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size // 10) || ',' || (p_size % 10) || ' TSI' WHEN 1 THEN 'V' || p_size || ' Turbo'
             WHEN 2 THEN p_type ELSE NULL END AS engine FROM part)
SELECT p_partkey, engine, try_cast(replace(regexp_extract(engine, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS litres FROM t
""")
def q_engine_litres(spark, sf):
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    engine = (F.when(k == 0, F.concat((size / 10).cast("int"), F.lit(","), size % 10, F.lit(" TSI")))
              .when(k == 1, F.concat(F.lit("V"), size, F.lit(" Turbo"))).when(k == 2, F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", engine.alias("engine")).withColumn("litres", features.engine_litres(F.col("engine")))


@register("derived_features", """
WITH t AS (SELECT p_partkey, 1999 + p_size % 28 AS year, p_retailprice * 100 AS km, nullif(p_brand, 'Brand#7') AS brand, p_type FROM part)
SELECT p_partkey, (2026 - year)::DOUBLE AS age, CASE WHEN year < 2026 THEN round_even(km / (2026 - year), 6) END AS km_per_year,
       brand || '_' || p_type AS brand_model FROM t
""")
def q_derived_features(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (1999 + F.col("p_size") % 28).alias("year"), (F.col("p_retailprice") * 100).alias("km"),
                                           F.nullif("p_brand", F.lit("Brand#7")).alias("brand"), "p_type")
    out = features.derived_features(rows, "year", "km", "brand", "p_type", 2026)
    return rounded(out.select("p_partkey", "age", "km_per_year", "brand_model"), ["km_per_year"])


@register("skew_check", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(x) AS rows, count(y) AS positive, round_even(skewness(x), 6) AS skew, round_even(skewness(y), 6) AS log_skew,
       count(x) = count(y) AND abs(skewness(x)) > 0.4 AND abs(skewness(y)) < abs(skewness(x)) AS use_log
FROM (SELECT {c} AS x, CASE WHEN {c} > 0 THEN ln({c}) END AS y FROM lineitem)""" for c in ("l_extendedprice", "l_quantity", "l_tax")))
def q_skew_check(spark, sf):
    out = features.skew_check(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"], 0.4)
    return rounded(out, ["skew", "log_skew"])


@register("imputed_by_train", """
WITH r AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS p_brand, p_type, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
                  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size::DOUBLE END AS p_size FROM part),
t AS (SELECT * FROM r WHERE p_partkey % 5 <> 0),
a AS (SELECT p_brand, p_type, CASE WHEN count(price) >= 12 THEN median(price) END AS price, CASE WHEN count(p_size) >= 12 THEN median(p_size) END AS p_size
      FROM t WHERE p_brand IS NOT NULL GROUP BY ALL),
b AS (SELECT p_brand, CASE WHEN count(price) >= 12 THEN median(price) END AS price, CASE WHEN count(p_size) >= 12 THEN median(p_size) END AS p_size
      FROM t WHERE p_brand IS NOT NULL GROUP BY ALL),
w AS (SELECT median(price) AS price, median(p_size) AS p_size FROM t)
SELECT p_partkey, coalesce(r.p_brand, 'Unknown') AS p_brand, r.p_type, round_even(coalesce(r.price, a.price, b.price, w.price), 6) AS price,
       round_even(coalesce(r.p_size, a.p_size, b.p_size, w.p_size), 6) AS p_size
FROM r LEFT JOIN a ON r.p_brand = a.p_brand AND r.p_type = a.p_type LEFT JOIN b ON r.p_brand = b.p_brand, w
""")
def q_imputed_by_train(spark, sf):
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"), "p_type", F.when(key % 7 == 0, None).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(key % 11 == 0, None).otherwise(F.col("p_size").cast("double")).alias("p_size"))
    model = features.fit_imputer(rows.where(key % 5 != 0), ["price", "p_size"], [["p_brand", "p_type"], ["p_brand"]], ["p_brand"], min_rows=12)
    return rounded(model.transform(rows), ["price", "p_size"])


@register("label_codes", """
WITH r AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS b, p_name FROM part),
v AS (SELECT p_partkey, 'p_brand' AS f, b AS c FROM r UNION ALL SELECT p_partkey, 'p_name', p_name FROM r),
a AS (SELECT f, c, row_number() OVER (PARTITION BY f ORDER BY c) - 1 AS code FROM (SELECT DISTINCT f, c FROM v WHERE c IS NOT NULL AND p_partkey % 97 = 0)),
n AS (SELECT f, c, row_number() OVER (PARTITION BY f ORDER BY c) AS i FROM (SELECT DISTINCT f, c FROM v WHERE c IS NOT NULL AND p_partkey % 13 = 0)
      ANTI JOIN a USING (f, c)),
k AS (SELECT f, c, code FROM a UNION ALL SELECT n.f, c, coalesce(top, -1) + i FROM n LEFT JOIN (SELECT f, max(code) AS top FROM a GROUP BY f) m USING (f))
SELECT p_partkey, CASE WHEN b IS NULL THEN -1 ELSE coalesce(x.code, -2) END AS p_brand_code, coalesce(y.code, -2) AS p_name_code
FROM r LEFT JOIN k x ON x.f = 'p_brand' AND x.c = b LEFT JOIN k y ON y.f = 'p_name' AND y.c = p_name
""")
def q_label_codes(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"), "p_name")
    columns = ["p_brand", "p_name"]
    first = features.fit_labels(rows.where("p_partkey % 97 = 0"), columns)
    again = features.fit_labels(rows.where("p_partkey % 13 = 0"), columns, first)
    return features.label_codes(rows, again, columns).select("p_partkey", "p_brand_code", "p_name_code")
