"""Seeded, exact stratified train/validation split.

Order inside a stratum is ``md5(key | seed)`` (then the key): deterministic across partitionings and
reproducible in any SQL engine.  Per stratum the first ``round_half_even(n * train_size)`` rows go to
train.  No window sorts a whole stratum: rows are counted per (stratum, 20-bit hash bucket) -- a tiny
table -- which locates the single boundary bucket holding the cut; every other row is decided by a
comparison, and only the boundary bucket (about 2^-20 of its stratum) is ranked.  The boundaries reach the
rows by a size-checked lookup, so rows are not shuffled by stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.missing import half_even_count
from tabsieve.operators.binning import UNKNOWN_LABEL
from tabsieve.operators.freq import as_text
from tabsieve.operators.lookup import lookup
from tabsieve.operators.ordering import ordered_positions

TRAIN, VALIDATION = "train", "validation"
_BUCKET_HEX = 5  # 2^20 buckets per stratum


def split_sizes(n: Column, train_size: float = 0.80) -> Column:
    """K1: number of train rows of a stratum of ``n`` rows (``int(round(n * train_size))``)."""
    return half_even_count(n, train_size)


def _order_hash(df: DataFrame, key_cols: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(as_text(df, k), F.lit("\\N")) for k in key_cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def stratified_split(df: DataFrame, stratify_by: str | Column, key_cols: Sequence[str] | None = None,
                     train_size: float = 0.80, seed: int = 42, split_col: str = "split",
                     stratum_col: str | None = None) -> DataFrame:
    """K2: add ``split_col`` (``train``/``validation``); NULL stratum -> ``Unknown``.

    ``key_cols`` identify a row (default: all columns -- equal rows are interchangeable)."""
    keys = list(key_cols) if key_cols is not None else list(df.columns)
    stratum = (F.coalesce(as_text(df, stratify_by), F.lit(UNKNOWN_LABEL)) if isinstance(stratify_by, str)
               else F.coalesce(stratify_by.cast("string"), F.lit(UNKNOWN_LABEL)))
    d = (df.withColumn("_stratum", stratum)
           .withColumn("_h", _order_hash(df, keys, seed))
           .withColumn("_b", F.conv(F.substring("_h", 1, _BUCKET_HEX), 16, 10).cast("int")))
    per_bucket = d.groupBy("_stratum", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_stratum").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_stratum")
    cum = (per_bucket.withColumn("_end", F.sum("_c").over(upto))
                     .withColumn("_k", split_sizes(F.sum("_c").over(whole), train_size)))
    # boundary bucket: the one whose [end - c, end) range contains the k-th row (k >= 1)
    boundary = (cum.where((F.col("_k") > F.col("_end") - F.col("_c")) & (F.col("_k") <= F.col("_end")))
                   .select("_stratum", F.col("_b").alias("_bstar"),
                           (F.col("_k") - (F.col("_end") - F.col("_c"))).alias("_krem")))
    marked = lookup(d, F.col("_stratum"), boundary.withColumnRenamed("_stratum", "_of"), "_of", F.col("_h"))
    bstar = F.coalesce(F.col("_bstar"), F.lit(-1))  # k == 0: every row to validation
    decided = (marked.where(F.col("_b") != bstar)
                     .withColumn(split_col, F.when(F.col("_b") < bstar, F.lit(TRAIN)).otherwise(F.lit(VALIDATION))))
    edge_w = Window.partitionBy("_stratum").orderBy("_h", *[F.col(f"`{k}`") for k in keys])
    edge = (marked.where(F.col("_b") == bstar)
                  .withColumn(split_col, F.when(F.row_number().over(edge_w) <= F.col("_krem"), F.lit(TRAIN))
                                          .otherwise(F.lit(VALIDATION))))
    out = decided.unionByName(edge)
    if stratum_col:
        out = out.withColumnRenamed("_stratum", stratum_col)
    return out.drop("_stratum", "_h", "_b", "_bstar", "_krem")


def train_part(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """The train rows (a filtered view; no row positions in Spark)."""
    return split_df.where(F.col(split_col) == TRAIN).drop(split_col)


def validation_part(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    return split_df.where(F.col(split_col) == VALIDATION).drop(split_col)


def shuffled(df: DataFrame, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """A seeded reproducible order (row order is not part of a Spark result otherwise)."""
    return df.orderBy(F.md5(F.concat_ws("|", *[as_text(df, k) for k in key_cols], F.lit(f"{seed}|shuffle"))))


def shuffled_places(df: DataFrame, key_cols: Sequence[str], seed: int = 42, place_col: str = "place") -> DataFrame:
    """G9 with the order as data: the row's place in the order of :func:`shuffled`, numbered by many tasks."""
    keyed = df.withColumn("_shuffle", F.md5(F.concat_ws("|", *[as_text(df, k) for k in key_cols], F.lit(f"{seed}|shuffle"))))
    return ordered_positions(keyed, [], ["_shuffle"], pos_col=place_col).drop("_shuffle")
