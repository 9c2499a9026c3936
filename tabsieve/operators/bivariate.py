"""Views of a value by one or two other columns: by category (N7, N11), on grids (N9), and along age.

All order statistics are exact and come from :func:`~tabsieve.operators.ordering.exact_quantiles`: no group's values are gathered,
and any number of groups or cells is in long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.missing import to_number
from tabsieve.operators.binning import bin_code, quantile_edges
from tabsieve.operators.freq import as_text
from tabsieve.operators.ordering import exact_quantiles, join_keys, ordered_positions


def _number(df: DataFrame, column: str):
    x = to_number(F.col(f"`{column}`"), df.schema[column].dataType).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def value_by_category(df: DataFrame, value: str, category: str, min_rows: int = 1) -> DataFrame:
    """``category, rows, median, q1, q3, iqr, mean, std, cv`` of ``value`` for the categories with at least ``min_rows`` values.
    A null category is one of its own; missing values do not count; ``cv`` is ``std / mean``, null where that is 0."""
    rows = df.select(as_text(df, category).alias("category"), _number(df, value).alias("x")).where("x IS NOT NULL")
    base = rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    quartiles = exact_quantiles(rows, ["category"], "x", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["median"])
    return (join_keys(base.where(F.col("rows") >= min_rows), quartiles, ["category"])
            .select("category", "rows", "median", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "mean",
                    F.when(F.col("rows") > 1, F.col("std")).alias("std"),
                    F.when(F.col("rows") > 1, F.try_divide("std", "mean")).alias("cv")))


def iqr_ranking(df: DataFrame, value: str, category: str, min_rows: int = 1) -> DataFrame:
    """``rank, category, rows, q1, q3, iqr``: the categories of :func:`value_by_category`, widest first, ties by category."""
    found = value_by_category(df, value, category, min_rows).select("category", "rows", "q1", "q3", "iqr")
    return ordered_positions(found, [], [F.desc("iqr"), F.asc_nulls_last("category")], pos_col="rank").withColumn("rank", F.col("rank").cast("long"))


def median_grid(df: DataFrame, value: str, row: str, column: str, min_rows: int = 1) -> DataFrame:
    """``row, column, rows, median`` of ``value`` for every met pair of the two columns (as text; null is a value of its own)."""
    cells = df.select(as_text(df, row).alias("row"), as_text(df, column).alias("column"), _number(df, value).alias("x")).where("x IS NOT NULL")
    counts = cells.groupBy("row", "column").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_rows)
    medians = exact_quantiles(cells, ["row", "column"], "x", [0.5], ["median"], ["median"])
    return join_keys(counts, medians, ["row", "column"])


def binned_grid(df: DataFrame, value: str, x: str, y: str, x_bins: int = 10, y_bins: int = 10) -> DataFrame:
    """``x_bin, y_bin, x_low, x_high, y_low, y_high, rows, median``: ``value`` over the quantile bins of two numeric columns
    (right-closed, repeated edges dropped).  Rows missing one of the three are left out; cells without rows too."""
    rows = df.select(_number(df, x).alias("a"), _number(df, y).alias("b"), _number(df, value).alias("v")).dropna()
    edges = {c: quantile_edges(rows, c, n) for c, n in (("a", x_bins), ("b", y_bins))}
    coded = rows.select(bin_code(F.col("a"), edges["a"]).alias("x_bin"), bin_code(F.col("b"), edges["b"]).alias("y_bin"), "v")
    coded = coded.where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
    medians = exact_quantiles(coded, ["x_bin", "y_bin"], "v", [0.5], ["median"], ["median"])
    cells = join_keys(coded.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("rows")), medians, ["x_bin", "y_bin"])

    def edge(axis: str, code: str, add: int):
        known = F.array(*[F.lit(float(e)) for e in edges[axis]]) if edges[axis] else F.array().cast("array<double>")
        return F.get(known, F.col(code) + add)
    return cells.select("x_bin", "y_bin", edge("a", "x_bin", 0).alias("x_low"), edge("a", "x_bin", 1).alias("x_high"), edge("b", "y_bin", 0).alias("y_low"),
                        edge("b", "y_bin", 1).alias("y_high"), "rows", "median")


def median_by_age(df: DataFrame, value: str, age: str, group: str, min_rows: int = 1) -> DataFrame:
    """``group, age, rows, median`` of ``value`` for whole ages of at least ``min_rows`` values; rows missing one of the two are left out."""
    rows = df.select(as_text(df, group).alias("group"), F.floor(_number(df, age)).cast("long").alias("age"), _number(df, value).alias("x")).dropna(subset=["age", "x"])
    counts = rows.groupBy("group", "age").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_rows)
    return join_keys(counts, exact_quantiles(rows, ["group", "age"], "x", [0.5], ["median"], ["median"]), ["group", "age"])


def yearly_loss(df: DataFrame, value: str, age: str, group: str, min_rows: int = 1, span_gaps: bool = True) -> DataFrame:
    """``rank, group, ages, years, yearly_loss``: the groups by what they lose a year, least first, ties by group.

    A group's median values are chained along its ages.  From one age to the next the value keeps ``later / earlier``, of which a
    year's loss is ``1 - ratio``.  A missing age is spanned by a step of several years with the loss ``1 - ratio ** (1 / years)``
    each, or, without ``span_gaps``, breaks the chain.  ``yearly_loss`` is the mean over the ``years`` covered.  Steps from or to a
    median of 0 or below are left out; groups without a step have no rank and are not returned."""
    medians = median_by_age(df, value, age, group, min_rows).checkpoint()  # one row per group and age
    along = Window.partitionBy("group").orderBy("age")
    steps = (medians.withColumn("_from", F.lag("median").over(along)).withColumn("_years", F.col("age") - F.lag("age").over(along))
             .where((F.col("_from") > 0) & (F.col("median") > 0)))
    if not span_gaps:
        steps = steps.where("_years = 1")
    lost = 1.0 - F.pow(F.col("median") / F.col("_from"), 1.0 / F.col("_years"))
    per = (steps.groupBy("group").agg(F.sum("_years").cast("long").alias("years"),
                                      (F.sum(lost * F.col("_years")) / F.sum("_years")).alias("yearly_loss")))
    out = join_keys(per, medians.groupBy("group").agg(F.count(F.lit(1)).alias("ages")), ["group"])
    ranked = ordered_positions(out, [], ["yearly_loss", F.asc_nulls_last("group")], pos_col="rank")
    return ranked.select(F.col("rank").cast("long").alias("rank"), "group", "ages", "years", "yearly_loss")
