"""Column profiling.

Numeric statistics share one core, :func:`numeric_stats`: one pass aggregates counts, means and a sketch that brackets the
quartiles, one picks the exact quartiles out of the few values inside the brackets, and one sums squared deviations and
IQR outliers.  Raw cells meet the per-key bounds by a counted broadcast (or salts), so no pass moves them by key;
only ``unique`` shuffles distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.labels import ALL_GROUP
from tabsieve.functions.missing import canonicalize_missing, is_categorical, is_numeric, pct, to_number
from tabsieve.operators.freq import INDEX_PREFIX, as_text, categorical_profile, frequency_table
from tabsieve.operators.ordering import bracket_aggregate, exact_quantiles, join_keys, met_keys
from tabsieve.session import checkpoint_dir


def _features_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, dtype, ordinal)`` from the schema (metadata only)."""
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("dtype", T.StringType()),
                           T.StructField("ordinal", T.IntegerType())])
    rows = [(c, df.schema[c].dataType.simpleString(), i) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, schema)


def approx_numeric_stats(long_df: DataFrame, keys: Sequence[str], value_col: str = "v",
                         whisker: float = 1.5, accuracy: int = 10000,
                         always_keys: DataFrame | None = None) -> DataFrame:
    """``numeric_stats`` with bounded-memory sketches instead of exact order statistics: one
    aggregation over the cells (``percentile_approx`` sketches and HyperLogLog++ merge map-side, so
    no group is ever held whole) and a second pass for the IQR outlier count.  Quantiles are within
    ``1 / accuracy`` of the exact rank; ``unique`` is an estimate."""
    keys = list(keys)
    v = F.col(value_col)
    cells = long_df.select(*keys, v.alias(value_col), F.lit(False).alias("_pad"))
    if always_keys is not None:  # NULL padding rows: every aggregate ignores them, the counts skip them
        cells = cells.unionByName(always_keys.select(*keys, F.lit(None).cast("double").alias(value_col),
                                                     F.lit(True).alias("_pad")))
    real = ~F.col("_pad")
    base = cells.groupBy(*keys).agg(
        F.count_if(real).alias("_rows"), F.count(v).alias("non_missing"),
        F.count_if(v.isNull() & real).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("_sd"),
        F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_q"),
        F.approx_count_distinct(v).alias("unique"), F.count_if(v == 0).alias("zero_count"))
    base = base.select("*", F.get("_q", 0).alias("q1"), F.get("_q", 1).alias("median"),
                       F.get("_q", 2).alias("q3")).drop("_q")
    bounds = base.select(*keys, (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("_lo"),
                         (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("_hi"))
    outl = met_keys(long_df.select(*keys, v.alias("_x")), bounds, keys).groupBy(*keys).agg(
        F.count_if((F.col("_x") < F.col("_lo")) | (F.col("_x") > F.col("_hi"))).alias("outlier_count"))
    return (join_keys(base, outl, keys, "left")
            .withColumn("std", F.when(F.col("non_missing") > 1, F.col("_sd"))).drop("_sd"))


def numeric_stats(long_df: DataFrame, keys: Sequence[str], value_col: str = "v",
                  whisker: float = 1.5, always_keys: DataFrame | None = None,
                  exact: bool = True, unique: bool = True) -> DataFrame:
    """Per key: ``_rows, non_missing, missing, min, max, mean, median, std, q1, q3, zero_count,
    unique, outlier_count`` (IQR rule: ``v < q1 - 1.5 iqr`` or ``v > q3 + 1.5 iqr``; NULL is not an
    outlier).  ``long_df`` holds one row per cell: ``keys..., value_col`` (NULL = missing).  Three pruned passes,
    each aggregated before its shuffle; only ``unique`` (left out on request) shuffles distinct values.
    ``exact=False`` switches to :func:`approx_numeric_stats`."""
    keys = list(keys)
    if not exact:
        return approx_numeric_stats(long_df, keys, value_col, whisker, always_keys=always_keys)
    v = F.col(value_col)
    cells = long_df.select(*keys, v, F.lit(False).alias("_pad"))
    if always_keys is not None:  # NULL padding rows: the keys exist even without data
        cells = cells.unionByName(always_keys.select(*keys, F.lit(None).cast("double").alias(value_col),
                                                     F.lit(True).alias("_pad")))
    probs = [0.25, 0.5, 0.75]
    checkpoint_dir(long_df.sparkSession)
    base = cells.groupBy(*keys).agg(
        F.count_if(~F.col("_pad")).alias("_rows"), F.count(v).alias("non_missing"),
        F.count_if(v.isNull() & ~F.col("_pad")).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.count_if(v == 0).alias("zero_count"),
        F.count(v).alias("_n"), bracket_aggregate(v, probs).alias("_limits")).checkpoint()
    quart = exact_quantiles(long_df, keys, value_col, probs, ["q1", "median", "q3"], ["median"],
                            base.where("_n > 0").select(*keys, "_n", "_limits"))
    base = join_keys(base.drop("_n", "_limits"), quart, keys, "left")
    if unique:
        distinct = (long_df.where(v.isNotNull()).select(*keys, v).distinct()
                    .groupBy(*keys).agg(F.count(F.lit(1)).alias("unique")))
        base = join_keys(base, distinct, keys, "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    bounds = base.select(*keys, "mean",
                         (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("_lo"),
                         (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("_hi"))
    second = met_keys(long_df.where(v.isNotNull()).select(*keys, v.alias("_x")), bounds, keys).groupBy(*keys).agg(
        F.sum((F.col("_x") - F.col("mean")) * (F.col("_x") - F.col("mean"))).alias("_ss"),
        F.count_if((F.col("_x") < F.col("_lo")) | (F.col("_x") > F.col("_hi"))).alias("outlier_count"))
    out = join_keys(base, second, keys, "left")
    return out.withColumn(
        "std", F.when(F.col("non_missing") > 1,
                      F.sqrt(F.col("_ss") / (F.col("non_missing") - 1).cast("double")))).drop("_ss")


def explore_target(df: DataFrame, target: str, group_col: str | None = None, exact: bool = True) -> DataFrame:
    """Summary of a numeric target overall (``is_total``, group ``All``) and per group value.

    ``group, is_total, count, missing, missing_pct, min, q1, median, mean, q3, max, std, zero_count``;
    the target is coerced like ``pandas.to_numeric``; a NULL group is a group of its own.  Both
    grouping levels come from one aggregation (each row feeds its group and the total)."""
    x = to_number(F.col(f"`{target}`"), df.schema[target].dataType)
    if group_col is None:
        long_df = df.select(F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("grp"), x.alias("v"))
    else:
        g = as_text(df, group_col)
        levels = F.array(F.struct(F.lit(True).alias("t"), F.lit(None).cast("string").alias("g")),
                         F.struct(F.lit(False).alias("t"), g.alias("g")))
        long_df = (df.select(F.explode(levels).alias("_l"), x.alias("v"))
                     .select(F.col("_l.t").alias("is_total"), F.col("_l.g").alias("grp"), "v"))
    # an empty table still has its "All" row (count 0), as in the reference: a zero-weight NULL
    # cell for that key guarantees the row without changing any count
    always = df.sparkSession.createDataFrame([(True, None)], "is_total boolean, grp string")
    st = numeric_stats(long_df, ["is_total", "grp"], always_keys=always, exact=exact, unique=False)
    return (st.select(F.when(F.col("is_total"), F.lit(ALL_GROUP)).otherwise(F.col("grp")).alias("group"),
                      "is_total",
                      F.col("non_missing").cast("long").alias("count"),
                      F.col("missing").cast("long").alias("missing"),
                      pct(F.col("missing"), F.col("_rows")).alias("missing_pct"),
                      "min", "q1", "median", "mean", "q3", "max", "std",
                      F.col("zero_count").cast("long").alias("zero_count"))
              .orderBy(F.desc("is_total"), F.asc_nulls_last("group")))


NUMERIC_PROFILE_SCHEMA = (
    "feature string, dtype string, non_missing bigint, missing bigint, missing_pct double, min double, "
    "max double, mean double, median double, std double, q1 double, q3 double, zero_count bigint, "
    "outlier_count bigint, outlier_pct double, unique bigint, unique_pct double")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """D2 (+C7): one row per numeric feature, columns in the reference order.

    ``feature, dtype, non_missing, missing, missing_pct, min, max, mean, median, std, q1, q3,
    zero_count, outlier_count, outlier_pct, unique, unique_pct``; percentages over all rows."""
    columns = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if is_numeric(f.dataType) and not f.name.startswith(INDEX_PREFIX)]
    if not columns:
        return df.sparkSession.createDataFrame([], NUMERIC_PROFILE_SCHEMA)
    df = canonicalize_missing(df.select(*[F.col(f"`{c}`") for c in columns]))
    long_df = (df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
                 .unpivot([], [F.col(f"`{c}`") for c in columns], "feature", "v"))
    st = numeric_stats(long_df, ["feature"], exact=exact)
    feats = _features_frame(df, columns)
    rows = F.col("_rows")
    out = feats.join(st, "feature", "left")
    return (out.select(
        "feature", "dtype",
        F.coalesce(F.col("non_missing"), F.lit(0)).cast("long").alias("non_missing"),
        F.coalesce(F.col("missing"), F.lit(0)).cast("long").alias("missing"),
        pct(F.col("missing"), rows).alias("missing_pct"),
        "min", "max", "mean", "median", "std", "q1", "q3",
        F.coalesce(F.col("zero_count"), F.lit(0)).cast("long").alias("zero_count"),
        F.coalesce(F.col("outlier_count"), F.lit(0)).cast("long").alias("outlier_count"),
        pct(F.col("outlier_count"), rows).alias("outlier_pct"),
        F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"),
        pct(F.col("unique"), rows).alias("unique_pct"), "ordinal")
        .orderBy("ordinal").drop("ordinal"))


def explore_features(df: DataFrame, top_n_categories: int = 5, rare_threshold: int = 1,
                     exact: bool = True) -> dict[str, DataFrame]:
    """``{"numeric": D2, "categorical": D3}``; ``Unnamed:`` index columns are skipped.  Booleans are
    categorical; nested columns are in neither table."""
    cols = [f for f in df.schema.fields if not f.name.startswith(INDEX_PREFIX)]
    numeric = [f.name for f in cols if is_numeric(f.dataType)]
    other = [f.name for f in cols if not is_numeric(f.dataType)
             and (is_categorical(f.dataType)
                  or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)))]
    return {"numeric": numeric_profile(df, numeric, exact=exact),
            "categorical": categorical_profile(df, other, top_n_categories, rare_threshold)}


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``total_rows, duplicate_rows`` (rows after the first of each group of equal rows; NULL and
    NaN equal themselves).  One grouped count, partial-aggregated map-side; strings over 64
    characters are grouped by length and SHA-256, so no long text is shuffled."""
    cols = list(columns) if columns is not None else df.columns
    rows = canonicalize_missing(df.select(*[F.col(f"`{c}`") for c in cols]))
    keys = [F.when(F.length(f"`{c}`") <= 64, F.col(f"`{c}`")).otherwise(F.sha2(F.col(f"`{c}`").cast("binary"), 256)).alias(c)
            if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`") for c in cols]
    longs = [F.length(f"`{c}`").alias(f"_length{k}") for k, c in enumerate(cols)
             if isinstance(df.schema[c].dataType, T.StringType)]
    groups = rows.groupBy(*keys, *longs).agg(F.count(F.lit(1)).alias("_cnt"))
    return groups.agg(F.coalesce(F.sum("_cnt"), F.lit(0)).cast("long").alias("total_rows"),
                      F.coalesce(F.sum(F.col("_cnt") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def _null_counts_long(df: DataFrame) -> DataFrame:
    """``(column, ordinal, missing_count, _rows)`` from ONE one-row aggregate (no shuffle of data)."""
    df = canonicalize_missing(df)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                               F.col(f"_m{i}").alias("missing_count")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(items).alias("_x"), "_rows").select("_x.*", "_rows")


def missing_summary(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """D6 (+C8, D18): ``column, missing_count, missing_percentage`` for columns with missing values,
    highest percentage first (``top_n`` keeps the first rows, the bar-chart data)."""
    out = (_null_counts_long(df).where(F.col("missing_count") > 0)
           .select("column", F.col("missing_count").cast("long").alias("missing_count"),
                   pct(F.col("missing_count"), F.col("_rows")).alias("missing_percentage"), "ordinal")
           .orderBy(F.desc("missing_percentage"), "ordinal").drop("ordinal"))
    return out.limit(top_n) if top_n is not None else out


def unique_summary(df: DataFrame, top_n: int | None = None, exact: bool = True) -> DataFrame:
    """D7 (+D19): ``column, unique_values, unique_pct`` (NULL not counted; pct over all rows),
    most distinct first.  Exact: one unpivot + one grouped distinct; ``exact=False`` uses HyperLogLog++
    sketches in a single one-row aggregate (no shuffle of values)."""
    cols = df.columns
    if exact:
        per = _distinct_per_column(df, cols)
        feats = _features_frame(df, cols)
        out = feats.join(per, "feature", "left").select(
            F.col("feature").alias("column"),
            F.coalesce(F.col("_u"), F.lit(0)).cast("long").alias("unique_values"),
            pct(F.col("_u"), F.col("_rows")).alias("unique_pct"), "ordinal")
    else:
        sdf = canonicalize_missing(df)
        one = sdf.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_u{i}") for i, c in enumerate(cols)])
        items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                                   F.col(f"_u{i}").alias("_u")) for i, c in enumerate(cols)])
        out = one.select(F.explode(items).alias("_x"), "_rows").select(
            "_x.column", F.col("_x._u").cast("long").alias("unique_values"),
            pct(F.col("_x._u"), F.col("_rows")).alias("unique_pct"), "_x.ordinal")
    out = out.orderBy(F.desc("unique_values"), "ordinal").drop("ordinal")
    return out.limit(top_n) if top_n is not None else out


def _text_of(c, dtype: T.DataType):
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType,
                          T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "long"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def _as_family(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if _family(dtype) == "string":
        return as_text(df, name)
    return c.cast(_family(dtype))


def _distinct_per_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, _u, _rows``: exact distinct non-null values and row count per column.  Columns are
    unpivoted per type family (integers/dates/timestamps as long, floats as double, the rest as
    text) so grouping stays on native types and each branch reads only its own columns."""
    df = canonicalize_missing(df)
    parts = None
    for fam in ("long", "double", "string"):
        members = [c for c in cols if _family(df.schema[c].dataType) == fam]
        if not members:
            continue
        typed = df.select(*[_as_family(df, c).alias(c) for c in members])
        counts = (typed.unpivot([], [F.col(f"`{c}`") for c in members], "feature", "v")
                       .groupBy("feature", "v")
                       .agg(F.count(F.lit(1)).alias("_c"))
                       .groupBy("feature").agg(F.count("v").alias("_u"), F.sum("_c").alias("_rows")))
        parts = counts if parts is None else parts.unionByName(counts)
    return parts


def constant_columns(df: DataFrame) -> DataFrame:
    """``column, unique_value`` for columns with at most one distinct non-null value (value NULL
    when the column is all NULL), in table order.  ``min <=> max`` per column, no distinct.  Strings take part
    as 64-bit hashes, which keeps the one-row aggregate a hash aggregate; only columns whose hash is
    constant are read again, as strings."""
    df = canonicalize_missing(df)
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if strings:
        hashed = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")) for c in strings]
        seen = df.agg(*[x for k, h in enumerate(hashed) for x in (F.min(h).alias(f"l{k}"), F.max(h).alias(f"h{k}"))]).first()
        varied = {c for k, c in enumerate(strings) if seen[f"l{k}"] != seen[f"h{k}"]}
        fields = [f for f in fields if f.name not in varied]
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, unique_value string")
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}")]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
        (F.col(f"_lo{i}").isNull() | (F.col(f"_lo{i}") == F.col(f"_hi{i}"))).alias("_const"),
        _text_of(F.col(f"_lo{i}"), f.dataType).alias("unique_value"))
        for i, f in enumerate(fields)])
    return (one.select(F.explode(items).alias("_x")).select("_x.*").where("_const")
               .orderBy("ordinal").select("column", "unique_value"))


def range_check(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Per column the maximum and the number of values above ``limit`` (one-row aggregate)."""
    aggs = []
    for i, (c, lim) in enumerate(limits.items()):
        x = to_number(F.col(f"`{c}`"), df.schema[c].dataType)
        aggs += [F.max(x).alias(f"_max{i}"), F.count_if(x > F.lit(float(lim))).alias(f"_n{i}")]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(lim)).alias("limit"),
                               F.col(f"_max{i}").alias("max_value"),
                               F.col(f"_n{i}").cast("long").alias("above_limit"))
                      for i, (c, lim) in enumerate(limits.items())])
    return one.select(F.explode(items).alias("_x")).select("_x.*")
