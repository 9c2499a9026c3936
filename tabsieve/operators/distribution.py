"""Aggregates behind the reference's charts.

Every figure is a pruned pass over the source that is aggregated before its shuffle: ranges and quantile
brackets first, then counts of a computed bin index or of the values inside the brackets.  The per-group
ranges/quantiles are one row per group joined back (AQE broadcasts them when measured small).  Empty bins are emitted from ``sequence(0, bins - 1)`` of the
per-group table, so the result has exactly ``bins`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.missing import canonicalize_missing, to_number
from tabsieve.operators.freq import as_text
from tabsieve.operators.lookup import lookup
from tabsieve.operators.ordering import exact_quantiles, join_keys, met_keys
from tabsieve.session import checkpoint_dir


def numpy_bin(x: Column, lo: Column, hi: Column, bins: Column | int) -> Column:
    """Index of ``x`` among ``bins`` equal-width bins over ``[lo, hi]`` exactly as ``numpy.histogram``
    computes it (edges ``lo + i * step``, last bin closed, then numpy's +-1 edge corrections).
    ``lo == hi`` uses the range ``[lo - 0.5, hi + 0.5]`` as numpy does."""
    nb = bins if isinstance(bins, Column) else F.lit(int(bins))
    first = F.when(lo == hi, lo - 0.5).otherwise(lo)
    last = F.when(lo == hi, hi + 0.5).otherwise(hi)
    step = (last - first) / nb.cast("double")
    idx0 = F.floor((x - first) / (last - first) * nb.cast("double")).cast("int")
    idx1 = F.when(idx0 >= nb, nb - 1).otherwise(idx0)
    edge = lambda i: F.when(i >= nb, last).otherwise(first + i.cast("double") * step)
    idx2 = F.when(x < edge(idx1), idx1 - 1).otherwise(idx1)
    return F.when((x >= edge(idx2 + 1)) & (idx2 != nb - 1), idx2 + 1).otherwise(idx2)


def _cells(values: DataFrame, keys: list[str]) -> DataFrame:
    """``values(keys..., v)`` as ``(keys..., _v, _cnt)`` with NULL left out; read again by each pass."""
    return values.where(F.col("v").isNotNull()).select(*keys, F.col("v").alias("_v"), F.lit(1).cast("long").alias("_cnt"))


def _histogram(local: DataFrame, keys: list[str], bins: int, integer_mode: Column | None = None) -> DataFrame:
    """Weighted ``(keys..., _v, _cnt)`` -> ``keys..., bin, bin_start, bin_end, count`` (empty bins kept)."""
    v, cnt = F.col("_v"), F.col("_cnt")
    rng = local.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    rng = rng.withColumn("_int", integer_mode if integer_mode is not None else F.lit(False))
    lo_i = F.floor("_lo").cast("double") - 0.5
    rng = (rng.withColumn("_nb", F.when(F.col("_int"), (F.ceil("_hi") - F.floor("_lo") + 1).cast("int"))
                                   .otherwise(F.lit(int(bins))))
              .withColumn("_first", F.when(F.col("_int"), lo_i)
                                     .when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")))
              .withColumn("_last", F.when(F.col("_int"), lo_i + F.col("_nb").cast("double"))
                                    .when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))))
    checkpoint_dir(local.sparkSession)
    rng = rng.checkpoint()
    int_bin = F.least(F.floor(v - F.col("_first")).cast("int"), F.col("_nb") - 1)
    counted = (met_keys(local, rng, keys, ready=True)
               .withColumn("bin", F.when(F.col("_int"), int_bin)
                                   .otherwise(numpy_bin(v, F.col("_lo"), F.col("_hi"), F.col("_nb"))))
               .groupBy(*keys, "bin").agg(F.sum(cnt).alias("count")))
    step = (F.col("_last") - F.col("_first")) / F.col("_nb").cast("double")
    grid = rng.select(*keys, "_first", "_last", "_nb",
                      F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("bin"))
    grid = grid.select(*keys, "bin",
                       (F.col("_first") + F.col("bin").cast("double") * step).alias("bin_start"),
                       F.when(F.col("bin") == F.col("_nb") - 1, F.col("_last"))
                        .otherwise(F.col("_first") + (F.col("bin") + 1).cast("double") * step).alias("bin_end"))
    return (join_keys(grid, counted, [*keys, "bin"], "left")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long")))


def histogram_by_group(df: DataFrame, value_col: str, group_col: str, bins: int = 40) -> DataFrame:
    """Per group (rows with NULL value or NULL group dropped) ``bins`` equal-width bins over that
    group's own min..max, plus the group median: ``group, bin, bin_start, bin_end, count, median``."""
    x = to_number(F.col(f"`{value_col}`"), df.schema[value_col].dataType)
    values = (df.select(as_text(df, group_col).alias("group"), x.alias("v"))
                .where(F.col("group").isNotNull() & F.col("v").isNotNull()))
    local = _cells(values, ["group"])
    hist = _histogram(local, ["group"], bins)
    med = exact_quantiles(local, ["group"], "_v", [0.5], ["median"], ["median"])
    return join_keys(hist, med, ["group"]).select("group", "bin", "bin_start", "bin_end", "count", "median")


def _long_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = canonicalize_missing(df)
    typed = df.select(*[to_number(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in columns])
    return (typed.unpivot([], [F.col(f"`{c}`") for c in columns], "feature", "v")
                 .where(F.col("v").isNotNull()))


def percentile_trim(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Rows whose value lies in ``[p_lower, p_upper]`` (inclusive; NULL dropped).  The two limits
    are a one-row statistic; the rows themselves are filtered where they are."""
    x = to_number(F.col(f"`{column}`"), df.schema[column].dataType)
    lim = exact_quantiles(df.select(x.alias("v")), [], "v", [lower, upper], ["_plo", "_phi"]).collect()
    if not lim or lim[0]["_plo"] is None:
        return df.where(F.lit(False))
    return df.where(x.between(F.lit(lim[0]["_plo"]), F.lit(lim[0]["_phi"])))


def raw_distributions(df: DataFrame, columns: Sequence[str], bins: int = 35,
                      use_percentile_range: bool = True,
                      integer_columns: Sequence[str] = ()) -> DataFrame:
    """Per numeric column (absent names skipped) a histogram of the values trimmed to
    ``[p1, p99]`` (when ``use_percentile_range``), unit-wide integer-centred bins for
    ``integer_columns``, and the median of the *untrimmed* values.
    ``feature, bin, bin_start, bin_end, count, median``.  One scan of the source."""
    cols = [c for c in columns if c in df.columns]
    values = _long_numeric(df.select(*[F.col(f"`{c}`") for c in cols]), cols)
    local = _cells(values, ["feature"])
    q = exact_quantiles(local, ["feature"], "_v", [0.01, 0.5, 0.99], ["_plo", "median", "_phi"], ["median"])
    trimmed = local
    if use_percentile_range:
        q = q.checkpoint()
        trimmed = (met_keys(local, q.select("feature", "_plo", "_phi"), ["feature"], ready=True)
                   .where(F.col("_v").between(F.col("_plo"), F.col("_phi"))).drop("_plo", "_phi"))
    int_flag = F.col("feature").isin(list(integer_columns)) if integer_columns else F.lit(False)
    hist = _histogram(trimmed, ["feature"], bins, integer_mode=int_flag)
    return (join_keys(hist, q.select("feature", "median"), ["feature"])
            .select("feature", "bin", "bin_start", "bin_end", "count", "median"))


def _box_whiskers(local: DataFrame, keys: list[str], whis: float) -> DataFrame:
    """Per key ``n, q1, median, q3, whisker_low, whisker_high`` with Matplotlib's rule: the whiskers
    are the most extreme values within ``whis * IQR`` of the quartiles, clamped to the quartile when
    that value lies on the wrong side of it (quartiles are interpolated)."""
    quart = exact_quantiles(local, keys, "_v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - whis * iqr, F.col("q3") + whis * iqr
    v, cnt = F.col("_v"), F.col("_cnt")
    raw = met_keys(local, quart, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.sum(cnt).alias("n"), F.min(F.when(v >= lo, v)).alias("_wl"), F.max(F.when(v <= hi, v)).alias("_wh"))
    return raw.select(*keys, "n", "q1", "median", "q3",
                      F.when(F.col("_wl").isNull() | (F.col("_wl") > F.col("q1")), F.col("q1"))
                       .otherwise(F.col("_wl")).alias("whisker_low"),
                      F.when(F.col("_wh").isNull() | (F.col("_wh") < F.col("q3")), F.col("q3"))
                       .otherwise(F.col("_wh")).alias("whisker_high"))


def boxplot_stats(df: DataFrame, columns: Sequence[str], group_col: str | None = None,
                  grouped_columns: Sequence[str] = (), whis: float = 1.5) -> DataFrame:
    """Box-plot statistics per numeric column; columns in ``grouped_columns`` are split by
    ``group_col`` (rows with a NULL group dropped).  Quartiles as ``numpy.percentile``, whiskers and
    fliers (values beyond the whiskers) as Matplotlib computes them.
    ``feature, group, n, q1, median, q3, whisker_low, whisker_high, fliers``.  One scan."""
    cols = [c for c in columns if c in df.columns]
    grouped = [c for c in cols if group_col is not None and c in grouped_columns and group_col in df.columns]
    df = canonicalize_missing(df)
    g = as_text(df, group_col) if grouped else F.lit(None).cast("string")
    items = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (g if c in grouped else F.lit(None).cast("string")).alias("group"),
                               F.lit(c in grouped).alias("_grouped"),
                               to_number(F.col(f"`{c}`"), df.schema[c].dataType).alias("v")) for c in cols])
    values = (df.select(F.explode(items).alias("_x")).select("_x.*")
                .where(F.col("v").isNotNull() & (~F.col("_grouped") | F.col("group").isNotNull()))
                .drop("_grouped"))
    keys = ["feature", "group"]
    local = _cells(values, keys)
    box = _box_whiskers(local, keys, whis).checkpoint()
    v, cnt = F.col("_v"), F.col("_cnt")
    fliers = met_keys(local, box.select(*keys, "whisker_low", "whisker_high"), keys, ready=True).groupBy(*keys).agg(
        F.sum(F.when((v < F.col("whisker_low")) | (v > F.col("whisker_high")), cnt).otherwise(0)).alias("fliers"))
    return join_keys(box, fliers, keys).select(
        "feature", "group", F.col("n").cast("long").alias("n"), "q1", "median", "q3",
        "whisker_low", "whisker_high", F.col("fliers").cast("long").alias("fliers"))


def boxplot_fliers(df: DataFrame, column: str, group_col: str | None = None, whis: float = 1.5) -> DataFrame:
    """The rows whose ``column`` lies beyond the box-plot whiskers (per ``group_col`` when
    given; NULL values and groups dropped) -- a filtered DataFrame, never collected.  The whiskers
    are one row per group and reach the rows by a size-checked lookup."""
    x = to_number(F.col(f"`{column}`"), df.schema[column].dataType)
    g = as_text(df, group_col) if group_col else F.lit("")
    keyed = df.withColumn("_g", g).withColumn("_x", x).where(F.col("_x").isNotNull() & F.col("_g").isNotNull())
    local = _cells(keyed.select(F.col("_g").alias("group"), F.col("_x").alias("v")), ["group"])
    box = _box_whiskers(local, ["group"], whis).select(F.col("group").alias("_g"), "whisker_low", "whisker_high")
    box = box.withColumnRenamed("_g", "_of")
    return (lookup(keyed, F.col("_g"), box, "_of", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                 .where((F.col("_x") < F.col("whisker_low")) | (F.col("_x") > F.col("whisker_high")))
                 .drop("_g", "_x", "whisker_low", "whisker_high"))


def missing_by_group(df: DataFrame, year_col: str, target_col: str) -> DataFrame:
    """Per integer year (text coerced, NULL/non-numeric dropped, truncated toward zero)
    ``total, missing, missing_pct`` of ``target_col`` (percent, not rounded), ascending."""
    y = to_number(F.col(f"`{year_col}`"), df.schema[year_col].dataType)
    miss = F.col(f"`{target_col}`").isNull()
    if df.schema[target_col].dataType.typeName() in ("double", "float"):
        miss = miss | F.isnan(F.col(f"`{target_col}`"))
    return (df.select(y.alias("_y"), miss.alias("_m")).where(F.col("_y").isNotNull())
              .groupBy(F.col("_y").try_cast("long").alias(year_col))
              .agg(F.count(F.lit(1)).alias("total"),
                   F.count_if("_m").alias("missing"),
                   (F.avg(F.col("_m").cast("double")) * 100.0).alias("missing_pct"))
              .orderBy(F.col(f"`{year_col}`")))
