"""Co-moments of all pairs of numeric columns in one pass.

Every task folds its rows into one state per pair: the rows in which both columns are present, both means over those
rows, and their centred second moments.  States are small tables that Spark merges: first the common means, then
every state's moments shifted to them, so large means cost no digits and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.functions.missing import is_numeric, to_number
from tabsieve.session import checkpoint_dir

_STATE = "i int, j int, n long, mean_i double, mean_j double, ss_i double, ss_j double, ss_ij double"


class CoMoments:
    """States of all ordered pairs: ``mean[i, j]`` and ``ss[i, j]`` belong to column ``i`` where ``j`` is present too."""

    def __init__(self, columns: int) -> None:
        shape = (columns, columns)
        self.n, self.mean, self.ss, self.cross = (np.zeros(shape) for _ in range(4))

    def add(self, rows: np.ndarray) -> None:
        """Fold in ``rows``, in which NaN and infinite values are missing."""
        there = np.isfinite(rows)
        counts = there.sum(0)
        shift = np.where(counts > 0, np.where(there, rows, 0.0).sum(0) / np.maximum(counts, 1), 0.0)
        z, m = np.where(there, np.where(there, rows, 0.0) - shift, 0.0), there.astype(float)
        n, total = m.T @ m, z.T @ m
        some = np.maximum(n, 1.0)
        other = CoMoments(0)
        other.n, other.mean = n, np.where(n > 0, total / some + shift[:, None], 0.0)
        other.ss, other.cross = (z * z).T @ m - total * total / some, z.T @ z - total * total.T / some
        self.merge(other)

    def merge(self, other: CoMoments) -> None:
        n = np.maximum(self.n + other.n, 1.0)
        apart, weight = other.mean - self.mean, self.n * other.n / n
        self.ss += other.ss + apart * apart * weight
        self.cross += other.cross + apart * apart.T * weight
        self.mean += apart * other.n / n
        self.n += other.n


def _fold(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = CoMoments(columns)
        for batch in batches:
            values = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(columns)]
            state.add(np.stack(values, 1))  # a null comes as NaN
        i, j = (x.astype(np.int32) for x in np.triu_indices(columns))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (i, j, state.n[i, j].astype(np.int64), state.mean[i, j], state.mean[j, i], state.ss[i, j], state.ss[j, i],
                                   state.cross[i, j])], ["i", "j", "n", "mean_i", "mean_j", "ss_i", "ss_j", "ss_ij"])
    return run


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair ``i <= j`` of ``columns``: rows with both present, their means and centred second moments."""
    checkpoint_dir(df.sparkSession)
    numbers = df.select(*[to_number(F.col(f"`{c}`"), df.schema[c].dataType).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    states = numbers.mapInArrow(_fold(len(columns)), _STATE).where("n > 0").checkpoint()
    means = states.groupBy("i", "j").agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean_i")) / F.sum("n")).alias("all_i"),
                                         (F.sum(F.col("n") * F.col("mean_j")) / F.sum("n")).alias("all_j"))
    di, dj, n = F.col("mean_i") - F.col("all_i"), F.col("mean_j") - F.col("all_j"), F.col("n")
    return (states.join(means, ["i", "j"]).groupBy("i", "j")
            .agg(F.first("all_n").alias("n"), F.first("all_i").alias("mean_i"), F.first("all_j").alias("mean_j"),
                 F.sum(F.col("ss_i") + n * di * di).alias("ss_i"), F.sum(F.col("ss_j") + n * dj * dj).alias("ss_j"),
                 F.sum(F.col("ss_ij") + n * di * dj).alias("ss_ij")))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``left, right, n, covariance, correlation`` for every ordered pair of numeric columns (all of them by default).

    Pairwise complete: a row counts for a pair if both values are present (null, NaN and infinite are not).  ``covariance``
    needs two rows, ``correlation`` also two different values on both sides; else they are null.  A pair that never
    meets has ``n`` 0."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    spark = df.sparkSession
    every = spark.createDataFrame([(a, b, min(i, j), max(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)],
                                  "left string, right string, i int, j int")
    if not cols:
        return every.select("left", "right", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("covariance"),
                            F.lit(None).cast("double").alias("correlation"))
    spread = F.sqrt(F.col("ss_i")) * F.sqrt(F.col("ss_j"))
    near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ss_ij") / spread))
    return (every.join(F.broadcast(co_moments(df, cols)), ["i", "j"], "left")  # a row per pair of columns
            .select("left", "right", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    F.when(F.col("n") > 1, F.col("ss_ij") / (F.col("n") - 1)).alias("covariance"),
                    F.when((F.col("n") > 1) & (spread > 0), near).alias("correlation")))


ship_by_value(__name__)
