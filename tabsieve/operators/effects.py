"""Adjusted effects of categories (N15): least squares with any number of levels, by iterated group demeaning.

The rows are aggregated once to cells (one per combination of levels) with counts, sums and cross products; that table is all
that is read again.  Each sweep sets one factor's effects after another to its levels' mean residuals, then
refits the covariates' slopes, which falls to the least-squares solution without a dummy column.  Levels meet
cells by a counted lookup, so neither the number of levels nor a hot level matters.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.missing import to_number
from tabsieve.operators.freq import as_text
from tabsieve.operators.lookup import BROADCAST_ROWS, lookup
from tabsieve.session import checkpoint_dir

_LOG = logging.getLogger(__name__)


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def adjusted_effects(df: DataFrame, target: str, factors: Sequence[str], covariates: Sequence[str] = (), tolerance: float = 1e-10,
                     sweeps: int = 1000) -> DataFrame:
    """``factor, level, n, effect, converged``: how much a level moves ``target`` with the other factors and ``covariates``
    held fixed.

    A factor's effects have mean 0 over the rows.  A null level is a level of its own.  Rows whose target or a covariate is
    missing (null, NaN, infinite) take no part; without rows the result is empty.  Sweeps end when no effect moves by
    more than ``tolerance`` standard deviations of the target; ``converged`` is false if ``sweeps`` did not suffice (factors that
    nearly determine each other).  Where two factors fall into groups of levels that never meet, only differences inside a group
    are determined."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    levels = [f"f{k}" for k in range(len(factors))]
    xs = [f"x{k}" for k in range(len(covariates))]
    number = lambda c: _finite(to_number(F.col(f"`{c}`"), df.schema[c].dataType).cast("double"))
    used = df.select(*[as_text(df, c).alias(f) for f, c in zip(levels, factors)], number(target).alias("y"),
                     *[number(c).alias(x) for x, c in zip(xs, covariates)]).dropna(subset=["y", *xs])
    schema = "factor string, level string, n long, effect double, converged boolean"
    # centred by the overall means, so sums of products keep their digits
    first = used.agg(F.count(F.lit(1)), F.stddev_pop("y"), F.avg("y"), *[F.avg(x) for x in xs]).first()
    if not first[0]:
        return spark.createDataFrame([], schema)
    used = used.withColumns({c: F.col(c) - F.lit(first[2 + k]) for k, c in enumerate(["y", *xs])})
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), *[F.sum(x).alias(f"s{x}") for x in xs],
            *[F.sum(F.col(x) * F.col("y")).alias(f"y{x}") for x in xs],
            *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(xs) for b in xs[i:]]]
    cells = used.groupBy(*levels).agg(*sums).withColumns({f"a_{f}": F.lit(0.0) for f in levels}).checkpoint()
    few = cells.count() <= BROADCAST_ROWS  # then its levels are no more
    square = np.zeros((len(xs), len(xs)))
    if xs:
        row = cells.agg(*[F.sum(f"{a}{b}").alias(f"{a}{b}") for i, a in enumerate(xs) for b in xs[i:]]).first()
        for i, a in enumerate(xs):
            for j, b in enumerate(xs[i:], i):
                square[i, j] = square[j, i] = row[f"{a}{b}"]
    slopes = np.zeros(len(xs))
    enough, done = tolerance * (first[1] or 1.0), False
    for _ in range(sweeps):
        now = cells.withColumn("_moved", F.lit(0.0))
        for f in levels:
            rest = F.col("sy")
            for x, slope in zip(xs, slopes):
                rest = rest - F.lit(float(slope)) * F.col(f"s{x}")
            for g in levels:
                if g != f:
                    rest = rest - F.col("n") * F.col(f"a_{g}")
            found = now.groupBy(F.col(f).alias("_level")).agg((F.sum(rest) / F.sum("n")).alias("_a"))
            now = (now.join(F.broadcast(found), F.col(f).eqNullSafe(F.col("_level")), "left").drop("_level") if few
                   else lookup(now, F.col(f), found, "_level", F.struct(*levels)))
            now = now.withColumn("_moved", F.greatest("_moved", F.abs(F.col("_a") - F.col(f"a_{f}")))).drop(f"a_{f}").withColumnRenamed("_a", f"a_{f}")
        cells = now.checkpoint()
        fitted = sum((F.col(f"a_{f}") for f in levels), F.lit(0.0))
        row = cells.agg(F.max("_moved"), *[F.sum(F.col(f"y{x}") - fitted * F.col(f"s{x}")) for x in xs]).first()
        cells = cells.drop("_moved")
        if xs:
            better = np.linalg.lstsq(square, np.array(row[1:], float), rcond=None)[0]
            scale = np.sqrt(np.diag(square) / first[0])
            moved = float(np.abs((better - slopes) * scale).max())
            slopes = better
        else:
            moved = 0.0
        if max(row[0], moved) <= enough:
            done = True
            break
    _LOG.info("adjusted effects: converged %s, slopes %s", done, slopes)
    out = None
    for f, c in zip(levels, factors):
        per = cells.groupBy(F.col(f).alias("level")).agg(F.sum("n").alias("n"), F.first(f"a_{f}").alias("a"))
        middle = cells.agg(F.sum(F.col("n") * F.col(f"a_{f}")) / F.sum("n")).first()[0]
        mine = per.select(F.lit(c).alias("factor"), "level", "n", (F.col("a") - F.lit(middle)).alias("effect"), F.lit(done).alias("converged"))
        out = mine if out is None else out.unionByName(mine)
    return out
