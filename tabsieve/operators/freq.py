"""Category frequency operators, all derived from one long table ``F(feature, category, count)``.

``F`` is built by a single unpivot of the selected columns (cast to text) and one grouped count:
partial aggregation collapses every hot value map-side, so the shuffle carries one row per
(task, feature, category), never the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.labels import LIST_SEPARATOR, MISSING_CATEGORY, OTHER_CATEGORY, PREVIEW_PAIR
from tabsieve.functions.missing import canonicalize_missing, is_categorical, pct
from tabsieve.operators.ordering import ordered_positions
from tabsieve.session import checkpoint_dir

INDEX_PREFIX = "Unnamed:"


def categorical_columns(df: DataFrame, ignored_columns: Sequence[str] | None = None,
                        skip_index_columns: bool = False) -> list[str]:
    """B1: string/boolean columns in table order, minus ``ignored_columns`` (schema only, no job)."""
    ignored = set(ignored_columns or [])
    return [f.name for f in df.schema.fields
            if is_categorical(f.dataType) and f.name not in ignored
            and not (skip_index_columns and f.name.startswith(INDEX_PREFIX))]


def as_text(df: DataFrame, name: str) -> Column:
    """Value as the text pandas would print (``astype(str)``): booleans as ``True``/``False``; NaN, like NULL,
    is missing and stays NULL."""
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0)).when(~F.isnan(c), c).cast("string")  # -0.0 and 0.0 are equal
    return c.cast("string")


def long_values(df: DataFrame, columns: Sequence[str], value_name: str = "category") -> DataFrame:
    """``(feature, value)`` for every cell of ``columns`` (nulls kept), values as text."""
    df = canonicalize_missing(df.select(*[F.col(f"`{c}`") for c in columns]))
    text = df.select(*[as_text(df, c).alias(c) for c in columns])
    return text.unpivot([], [F.col(f"`{c}`") for c in columns], "feature", value_name)


def frequency_table(df: DataFrame, columns: Sequence[str] | None = None,
                    null_label: str | None = None, dropna: bool = False) -> DataFrame:
    """``F(feature, category, count)``.  ``null_label`` replaces NULL (and merges with a real value
    of that text); ``dropna`` drops NULL; otherwise NULL is its own category."""
    columns = list(columns) if columns is not None else categorical_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, category string, count bigint")
    values = long_values(df, columns)
    cat = F.col("category")
    if null_label is not None:
        values = values.withColumn("category", F.coalesce(cat, F.lit(null_label)))
    elif dropna:
        values = values.where(cat.isNotNull())
    return values.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("count"))


def category_table(df: DataFrame, categorical_columns_: Sequence[str] | None = None) -> DataFrame:
    """D8 (+F1, F2, I5): ``feature, rank, category, count, percentage``.

    NULL becomes ``Missing``; rank 1..k by count desc, category asc; percentage of the feature total.
    The full rank uses :func:`ordered_positions`, so a feature with a huge vocabulary is ranked by many
    tasks; the per-feature totals are a one-row-per-feature table."""
    freq = frequency_table(df, categorical_columns_, null_label=MISSING_CATEGORY)
    ranked = ordered_positions(freq, ["feature"], [F.desc("count"), F.asc("category")], pos_col="rank")
    totals = ranked.groupBy("feature").agg(F.sum("count").alias("_total"))  # from the checkpoint
    return (ranked.join(totals, "feature")
                  .select("feature", F.col("rank").cast("long").alias("rank"), "category",
                          F.col("count").cast("long").alias("count"),
                          pct(F.col("count"), F.col("_total")).alias("percentage")))


def rare_categories(category_tbl: DataFrame, max_count: int = 5) -> DataFrame:
    """Rows of the category table with ``count <= max_count``, by feature, count, category."""
    return (category_tbl.where(F.col("count") <= max_count)
                        .orderBy("feature", "count", "category"))


def category_summary(df: DataFrame, categorical_columns_: Sequence[str] | None = None) -> DataFrame:
    """Distinct values per feature, NULL counted as one value; most categories first."""
    freq = frequency_table(df, categorical_columns_)
    return (freq.groupBy("feature").agg(F.count(F.lit(1)).alias("unique_categories"))
                .orderBy(F.desc("unique_categories"), F.asc("feature")))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """``category, count`` of one column, most frequent first (NULL kept unless dropna)."""
    freq = frequency_table(df, [column], dropna=dropna)
    return freq.select("category", "count").orderBy(F.desc("count"), F.asc_nulls_last("category"))


def top_n_other(df: DataFrame, categorical_columns_: Sequence[str] | None = None,
                ignored_columns: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """Per feature the ``top_n`` categories (NULL as ``Missing``) plus one ``Other`` row holding
    the rest when there are more than ``top_n``; ``is_rollup`` tells it from a real ``Other`` value.

    Only the top ``n`` per feature pass the window (Spark plans a partial WindowGroupLimit before the
    shuffle), and the rest is ``total - sum(top)`` from the per-feature totals: no full sort."""
    cols = list(categorical_columns_) if categorical_columns_ is not None else categorical_columns(
        df, ignored_columns, skip_index_columns=True)
    ignored = set(ignored_columns or [])
    cols = [c for c in cols if c not in ignored and not c.startswith(INDEX_PREFIX)]
    if not cols:
        raise ValueError("No categorical columns found.")
    freq = frequency_table(df, cols, null_label=MISSING_CATEGORY)
    w = Window.partitionBy("feature").orderBy(F.desc("count"), F.asc("category"))
    top = freq.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n)
    stats = freq.groupBy("feature").agg(F.sum("count").alias("_total"),
                                        F.count(F.lit(1)).alias("_k"))
    top_sum = top.groupBy("feature").agg(F.sum("count").alias("_top"))
    other = (stats.join(top_sum, "feature", "left").where(F.col("_k") > top_n)  # top_n = 0: all is the rest
                  .select("feature", F.lit(OTHER_CATEGORY).alias("category"),
                          (F.col("_total") - F.coalesce("_top", F.lit(0))).alias("count"),
                          F.lit(True).alias("is_rollup")))
    return (top.select("feature", "category", "count", F.lit(False).alias("is_rollup"))
               .unionByName(other)
               .select("feature", "category", F.col("count").cast("long").alias("count"), "is_rollup")
               .orderBy("feature", "count", "is_rollup", "category"))  # ascending, as the bars are drawn


def _preview(items: Column) -> Column:
    """``"cat: n | cat: n"`` from an array of ``struct(k, category, count)`` sorted by ``k``."""
    return F.array_join(F.transform(F.array_sort(items),
                                    lambda x: F.concat(x["category"], F.lit(PREVIEW_PAIR),
                                                       x["count"].cast("string"))), LIST_SEPARATOR)


CATEGORICAL_PROFILE_SCHEMA = (
    "feature string, dtype string, categories_preview string, most_frequent string, "
    "most_frequent_count bigint, most_frequent_pct double, least_frequent_preview string, "
    "rare_categories bigint, missing bigint, missing_pct double, non_missing bigint, unique bigint, "
    "unique_pct double")


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 5,
                        rare_threshold: int = 1) -> DataFrame:
    """D3 (+D4, D11): one row per categorical feature.

    ``feature, dtype, categories_preview, most_frequent, most_frequent_count, most_frequent_pct,
    least_frequent_preview, rare_categories, missing, missing_pct, non_missing, unique, unique_pct``.
    Percentages are over all rows.  Ties: count desc, category asc; the least-frequent preview holds
    the last ``top_n`` of that order shown by count asc, category asc."""
    columns = list(columns) if columns is not None else [
        c for c in categorical_columns(df) if not c.startswith(INDEX_PREFIX)]
    if not columns:
        return df.sparkSession.createDataFrame([], CATEGORICAL_PROFILE_SCHEMA)
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    checkpoint_dir(df.sparkSession)
    freq = frequency_table(df, columns).checkpoint()  # one scan: filters below are not pushed into a second
    nonnull = freq.where(F.col("category").isNotNull())
    stats = freq.groupBy("feature").agg(
        F.sum("count").alias("_rows"),
        F.sum(F.when(F.col("category").isNull(), F.col("count")).otherwise(0)).alias("missing"),
        F.count("category").alias("unique"),
        F.count_if(F.col("category").isNotNull() & (F.col("count") <= rare_threshold)).alias("rare_categories"))
    top_w = Window.partitionBy("feature").orderBy(F.desc("count"), F.asc("category"))
    low_w = Window.partitionBy("feature").orderBy(F.asc("count"), F.desc("category"))
    top = (nonnull.withColumn("_rn", F.row_number().over(top_w)).where(F.col("_rn") <= top_n)
                  .groupBy("feature").agg(
                      F.collect_list(F.struct(F.col("_rn").alias("k"), "category", "count")).alias("_top")))
    low = (nonnull.withColumn("_rn", F.row_number().over(low_w)).where(F.col("_rn") <= top_n)
                  .groupBy("feature").agg(F.collect_list(F.struct(
                      F.struct(F.col("count"), F.col("category")).alias("k"), "category", "count")).alias("_low")))
    dtype_map = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(dtypes[c]))])
    order_map = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    rows = F.col("_rows")
    first = F.filter(F.col("_top"), lambda x: x["k"] == 1)
    return (stats.join(top, "feature", "left").join(low, "feature", "left")
                 .select(
                     "feature",
                     F.try_element_at(dtype_map, F.col("feature")).alias("dtype"),
                     _preview(F.col("_top")).alias("categories_preview"),
                     F.get(first, 0)["category"].alias("most_frequent"),
                     F.get(first, 0)["count"].cast("long").alias("most_frequent_count"),
                     pct(F.get(first, 0)["count"], rows).alias("most_frequent_pct"),
                     _preview(F.col("_low")).alias("least_frequent_preview"),
                     F.col("rare_categories").cast("long").alias("rare_categories"),
                     F.col("missing").cast("long").alias("missing"),
                     pct(F.col("missing"), rows).alias("missing_pct"),
                     (rows - F.col("missing")).cast("long").alias("non_missing"),
                     F.col("unique").cast("long").alias("unique"),
                     pct(F.col("unique"), rows).alias("unique_pct"),
                     F.try_element_at(order_map, F.col("feature")).alias("_ordinal"))
                 .orderBy("_ordinal").drop("_ordinal"))  # table order
