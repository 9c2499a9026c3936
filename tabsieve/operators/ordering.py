"""Positions in a total order within groups, and exact quantiles built on them.

A window ``partitionBy(group).orderBy(...)`` sorts a whole group inside one task, so a group holding a
third of all rows would run on one core.  Here the table is range-partitioned on ``(group, order)``
instead -- a hot group is spread over many contiguous slices -- and materialised once with a reliable
``checkpoint()`` (range bounds come from sampling and must not be recomputed differently).  Positions
are then local numbers plus per-slice offsets from a ``(slice, group)`` table of one row per slice
and group; quantiles only run a window over the few slices that hold the needed order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.operators.lookup import BROADCAST_ROWS, SALTS
from tabsieve.session import checkpoint_dir


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              null_safe: bool = True) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``); the right-hand key copies are dropped.
    Right keys are renamed first so a self-derived right side cannot alias the left columns."""
    keys = list(keys)
    renamed = right.select(*[F.col(c).alias(f"_rk_{c}") if c in keys else F.col(c) for c in right.columns])
    if not keys:
        raise ValueError("join_keys needs at least one key")
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_rk_{k}")) if null_safe else F.col(k) == F.col(f"_rk_{k}")
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_rk_{k}" for k in keys])


def met_keys(left: DataFrame, table: DataFrame, keys: Sequence[str], ready: bool = False) -> DataFrame:
    """Inner :func:`join_keys` of raw rows to a derived ``table`` with one row per key, which is written and counted first
    (``ready``: it has been written).  Up to ``BROADCAST_ROWS`` rows it is broadcast, so a hot key's rows stay where they are; beyond
    that every row of the table is repeated per salt and the raw rows are dealt over the salts in turn."""
    checkpoint_dir(left.sparkSession)
    table = table if ready else table.checkpoint()
    if table.count() <= BROADCAST_ROWS:
        return join_keys(left, F.broadcast(table), keys)
    dealt = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_keys(dealt, salted, [*keys, "_salt"]).drop("_salt")


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def ordered_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                      pos_col: str = "_pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 1-based row number within each group in the order ``order_cols``.
    ``group_cols + order_cols`` must be a total order (unique per row) so the result is deterministic.

    One range shuffle: inside each sorted slice ``monotonically_increasing_id()`` numbers the rows, so
    the local position is ``id - first id of (slice, group)``; offsets of earlier slices come from a
    ``(slice, group)`` table with one row per slice and group."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = list(group_cols)
    if not group:  # one implicit group; keeps every join an equi-join
        return (ordered_positions(df.withColumn("_all", F.lit(0)), ["_all"], order_cols, pos_col,
                                  num_partitions).drop("_all"))
    keys = _cols(group) + _cols(order_cols)
    local = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("_mid", F.monotonically_increasing_id())
               .withColumn("_slice", F.shiftright("_mid", 33))
               .checkpoint(eager=True))
    sizes = local.groupBy("_slice", *group).agg(F.min("_mid").alias("_first"),
                                                F.count(F.lit(1)).alias("_slice_total"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", *group, "_first",
                           F.coalesce(F.sum("_slice_total").over(before), F.lit(0)).alias("_offset"))
    return (join_keys(local, offsets, ["_slice", *group])
            .withColumn(pos_col, F.col("_offset") + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_slice", "_mid", "_first", "_offset"))


def sliced_values(counts: DataFrame, group_cols: Sequence[str], value_col: str = "_v",
                  num_partitions: int | None = None) -> DataFrame:
    """The distinct ``(group, value, weight)`` table range-partitioned on ``(group, value)`` (NULL
    values last) with its slice number, materialised once with a reliable ``checkpoint()``: the
    range bounds come from sampling and every later use must see the same slices."""
    spark = counts.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + [F.asc_nulls_last(value_col)]
    return (counts.repartitionByRange(n, *keys).withColumn("_slice", F.spark_partition_id())
                  .checkpoint(eager=True))


def value_counts_by_group(df: DataFrame, group_cols: Sequence[str], value: Column) -> DataFrame:
    """``(group..., _v, _cnt)`` for non-null values: partial aggregation collapses hot values map-side."""
    return (df.select(*group_cols, value.alias("_v")).where(F.col("_v").isNotNull())
              .groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_cnt")))


def weighted_quantiles(counts: DataFrame, group_cols: Sequence[str], probs: Sequence[float],
                       aliases: Sequence[str], value_col: str = "_v",
                       weight_col: str = "_cnt", mean_of_middle: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas ``quantile`` default) from a distinct
    ``(group, value, weight)`` table.  One row per group with one column per probability."""
    group = list(group_cols)
    if not group:
        return (weighted_quantiles(counts.withColumn("_all", F.lit(0)), ["_all"], probs, aliases,
                                   value_col, weight_col, mean_of_middle).drop("_all"))
    local = sliced_values(counts, group, value_col)
    return quantiles_from_slices(local, group, probs, aliases, value_col, weight_col,
                                 mean_of_middle=mean_of_middle)


def quantiles_from_slices(local: DataFrame, group_cols: Sequence[str], probs: Sequence[float],
                          aliases: Sequence[str], value_col: str = "_v",
                          weight_col: str = "_cnt", sizes: DataFrame | None = None,
                          mean_of_middle: Sequence[str] = ()) -> DataFrame:
    """Quantiles from :func:`sliced_values`.  Per-slice weight totals (one row per slice and group)
    locate the few slices holding the needed order statistics; only the rows of those slices are
    put through a running-sum window, and at most two rows per probability survive.

    Arithmetic follows pandas bit for bit: ``Series.quantile(q)`` hands ``q * 100`` to numpy, which
    divides by 100 again and uses the index ``(n - 1) * q`` with its two-sided linear interpolation;
    aliases in ``mean_of_middle`` follow ``Series.median()`` instead (mean of the two middle values)."""
    group = list(group_cols)
    w = F.col(weight_col)
    nonnull = local.where(F.col(value_col).isNotNull())
    if sizes is None:  # callers that aggregate per slice anyway pass ``(_slice, group..., _sw)``
        sizes = nonnull.groupBy("_slice", *group).agg(F.sum(w).alias("_sw"))
    prior = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offs = sizes.select("_slice", *group, "_sw",
                        F.coalesce(F.sum("_sw").over(prior), F.lit(0)).alias("_before"),
                        F.sum("_sw").over(whole).alias("_n"))
    n1 = (F.col("_n") - 1).cast("double")
    pandas_q = [(float(p) * 100.0) / 100.0 for p in probs]  # the q numpy sees after pandas' "* 100"
    targets = F.array(*[
        F.struct(F.lit(i).alias("i"),
                 F.floor(n1 * F.lit(q)).alias("lo"),
                 F.ceil(n1 * F.lit(q)).alias("hi"),
                 (n1 * F.lit(q) - F.floor(n1 * F.lit(q))).alias("t"))
        for i, q in enumerate(pandas_q)])
    in_slice = lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_sw"))
    needed = (offs.where(F.exists(targets, lambda x: in_slice(x["lo"]) | in_slice(x["hi"])))
                  .select("_slice", *group, "_before", targets.alias("_targets")))
    run = (Window.partitionBy("_slice", *group).orderBy(value_col)
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (join_keys(nonnull, needed, ["_slice", *group])
            .withColumn("_end", F.col("_before") + F.sum(w).over(run)))
    start = F.col("_end") - w  # 0-based positions [start, _end) hold this value
    covers = lambda k: (k >= start) & (k < F.col("_end"))
    covering = rows.select(*group, F.col(value_col).alias("_v"), start.alias("_s"),
                           F.explode(F.filter("_targets", lambda x: covers(x["lo"]) | covers(x["hi"])))
                            .alias("_t"))
    # hi is lo or lo + 1, so at most two rows cover a target: the earlier holds lo, the later hi.
    aggs = []
    for i in range(len(probs)):
        mine = F.col("_t.i") == i
        aggs += [F.max(F.when(mine, F.col("_t.t"))).alias(f"_t{i}"),
                 F.min(F.when(mine, F.struct("_s", "_v"))).alias(f"_a{i}"),
                 F.max(F.when(mine, F.struct("_s", "_v"))).alias(f"_b{i}")]
    picked = covering.groupBy(*group).agg(*aggs)
    out = []
    for i, alias in enumerate(aliases):
        a, b, t = F.col(f"_a{i}._v"), F.col(f"_b{i}._v"), F.col(f"_t{i}")
        # numpy's two-sided linear interpolation (monotone in t); median(): mean of the middle two
        value = F.when(a == b, a)
        if alias in mean_of_middle:
            value = value.when(t == 0.5, (a + b) / 2.0)
        out.append(value.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t))
                        .otherwise(a + (b - a) * t).alias(alias))
    return picked.select(*group, *out)


#: sketch size of the brackets; a group of at most so many values keeps them all
BRACKET_ACCURACY = 10_000
_MARGIN = 3.0 / BRACKET_ACCURACY


def bracket_aggregate(value: Column, probs: Sequence[float]) -> Column:
    """One mergeable sketch that encloses the order statistics of ``probs``: its rank error is at most one part in
    ``BRACKET_ACCURACY``, and the limits lie three such parts to either side."""
    limits = [min(1.0, max(0.0, float(q) + side * _MARGIN)) for q in probs for side in (-1, 1)]
    return F.percentile_approx(value, limits, BRACKET_ACCURACY)


def bracketed_counts(values: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                     brackets: DataFrame | None = None) -> DataFrame:
    """``(group..., _v, _cnt)`` that has the same quantiles at ``probs`` as the non-null ``value``, from two passes and a
    shuffle of few rows: a value outside every bracket cannot be one of the wanted order statistics and is
    counted under a stand-in (the bracket limit before it).  ``brackets`` has ``group..., _n, _limits``
    where the caller has aggregated them already."""
    probs, group = sorted(probs), list(group_cols)
    checkpoint_dir(values.sparkSession)
    values = values.where(F.col(value).isNotNull())
    if not group:
        return bracketed_counts(values.withColumn("_all", F.lit(0)), ["_all"], value, probs,
                                None if brackets is None else brackets.withColumn("_all", F.lit(0))).drop("_all")
    if brackets is None:
        brackets = values.groupBy(*group).agg(F.count(value).alias("_n"), bracket_aggregate(F.col(value), probs).alias("_limits"))
    brackets = brackets.select(*group, "_n", "_limits").checkpoint()
    x, below = F.col(value), F.lit(float("-inf"))
    small = F.col("_n") <= BRACKET_ACCURACY
    stand_in = F.when(small, x)
    for i, q in enumerate(probs):
        low = F.lit(float("-inf")) if q - _MARGIN <= 0 else F.get("_limits", 2 * i)
        high = F.lit(float("inf")) if q + _MARGIN >= 1 else F.get("_limits", 2 * i + 1)
        stand_in = stand_in.when((x >= low) & (x <= high), x).when(x < low, below)
        below = high
    return (met_keys(values.select(*group, x), brackets, group, ready=True)
            .select(*group, stand_in.otherwise(below).alias("_v"))
            .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_cnt")))


def exact_quantiles(values: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                    aliases: Sequence[str], mean_of_middle: Sequence[str] = (),
                    brackets: DataFrame | None = None) -> DataFrame:
    """Exact quantiles of raw values (:func:`weighted_quantiles` of :func:`bracketed_counts`)."""
    return weighted_quantiles(bracketed_counts(values, group_cols, value, probs, brackets), group_cols, probs, aliases,
                              mean_of_middle=mean_of_middle)


def linspace_probs(n_bins: int) -> list[float]:
    """``numpy.linspace(0, 1, n_bins + 1)`` (same floating values, e.g. 0.6000000000000001)."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]
