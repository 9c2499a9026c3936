"""Linear price model over sparse one-hot rows: N13 (model and residuals), N14 (cross-fitted undervaluation), N12
(projection), N16 (residual spread).

A row is a short list of (position, value): the intercept, the standardised numeric columns, the position of each of its
categories.  The Gram matrix is a grouped sum over the pairs of a row's entries, combined before the shuffle; only its
nonzero cells exist.  It is collected for the solve, so a model may have ``MAX_POSITIONS`` positions and more are refused
before that; for wider categories see :mod:`~tabsieve.operators.effects`.  Coefficients return to the rows by
counted lookups of their categories.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.missing import to_number
from tabsieve.operators.encoding import fit_vocabulary
from tabsieve.operators.freq import as_text
from tabsieve.operators.lookup import lookup
from tabsieve.operators.ordering import exact_quantiles, join_keys, ordered_positions
from tabsieve.session import checkpoint_dir

MAX_POSITIONS = 4000
_RANK = 1e-10


def _number(df: DataFrame, column: str) -> Column:
    x = to_number(F.col(f"`{column}`"), df.schema[column].dataType).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


@dataclass
class Design:
    """What turns a row into entries: means and deviations of the numeric columns and the categories' positions."""

    numeric: list[str]
    categorical: list[str]
    means: list[float]
    scales: list[float]
    vocabulary: DataFrame
    positions: int

    @property
    def first(self) -> int:
        return 1 + len(self.numeric)

    def standardised(self, df: DataFrame) -> list[Column]:
        """A missing number counts as the mean."""
        return [F.coalesce((_number(df, c) - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(self.numeric, self.means, self.scales)]

    def looked_up(self, df: DataFrame, table: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
        """``df`` with one column per categorical column: ``value`` of its category in ``table`` (null if missing or unseen)."""
        names, every = [], F.struct(*[F.col(f"`{c}`") for c in df.columns])
        for k, c in enumerate(self.categorical):
            own = table.where(F.col("feature") == c).select(F.col("category").alias(f"_is{k}"), F.col(value).alias(f"_of{k}"))
            df = lookup(df, as_text(df, c), own, f"_is{k}", every)
            names.append(f"_of{k}")
        return df, names

    def entries(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_entries``: ``(p, v)`` of the intercept, the numbers and the known categories."""
        numbers = [F.struct(F.lit(1 + k).alias("p"), x.alias("v")) for k, x in enumerate(self.standardised(df))]
        found, names = self.looked_up(df, self.vocabulary, "position")
        known = [F.when(F.col(n).isNotNull(), F.struct((F.col(n) + self.first).cast("int").alias("p"), F.lit(1.0).alias("v"))) for n in names]
        one = F.struct(F.lit(0).alias("p"), F.lit(1.0).alias("v"))
        return found.withColumn("_entries", F.array_compact(F.array(one, *numbers, *known))).drop(*names)


def design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Design:
    """The design of the rows of ``df`` (a train part); categories are null-free texts."""
    checkpoint_dir(df.sparkSession)
    means, scales = [], []
    if numeric:
        row = df.agg(*[x for c in numeric for x in (F.avg(_number(df, c)), F.stddev_pop(_number(df, c)))]).first()
        means = [row[2 * k] or 0.0 for k in range(len(numeric))]
        scales = [row[2 * k + 1] or 1.0 for k in range(len(numeric))]
    if categorical:
        vocabulary = fit_vocabulary(df, categorical).checkpoint()
    else:
        vocabulary = df.sparkSession.createDataFrame([], "feature string, category string, position long")
    return Design(list(numeric), list(categorical), means, scales, vocabulary, 1 + len(numeric) + vocabulary.count())


def gram(entries: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``group..., i, j, v``: sums of products of the entries of ``_entries`` (upper triangle), combined before the shuffle."""
    pairs = F.flatten(F.transform("_entries", lambda a: F.transform(
        F.filter("_entries", lambda b: b["p"] >= a["p"]),
        lambda b: F.struct(a["p"].alias("i"), b["p"].alias("j"), (a["v"] * b["v"]).alias("v")))))
    return (entries.select(*groups, F.explode(pairs).alias("_x")).groupBy(*groups, F.col("_x.i").alias("i"), F.col("_x.j").alias("j"))
            .agg(F.sum("_x.v").alias("v")))


def _matrices(table: DataFrame, size: int, groups: int) -> np.ndarray:
    """Dense symmetric matrices by group number (``g``), at most ``MAX_POSITIONS`` wide."""
    if size > MAX_POSITIONS:
        raise ValueError(f"{size} positions, more than {MAX_POSITIONS}: use adjusted_effects for wide categories")
    out = np.zeros((groups, size, size))
    cells = table.toArrow()
    g, i, j, v = (cells[c].to_numpy() for c in ("g", "i", "j", "v"))
    out[g, i, j] = v
    out[g, j, i] = v
    return out


def _solve(square: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares of lowest norm (full one-hot columns beside an intercept are dependent)."""
    values, vectors = np.linalg.eigh(square)
    good = values > _RANK * max(values[-1], 0.0)
    return vectors[:, good] @ ((vectors[:, good].T @ right) / values[good])


@dataclass
class LinearModel:
    """Coefficients per fold (one fold without cross-fitting)."""

    design: Design
    coefficients: np.ndarray

    def predict(self, df: DataFrame, into: str = "predicted", fold: Column | None = None) -> DataFrame:
        """``df`` with ``into``; with ``fold`` every row gets the prediction of the model of that number."""
        d = self.design
        number = F.lit(0) if fold is None else fold
        at = lambda k: F.get(F.array(*[F.lit(float(c)) for c in self.coefficients[:, k]]), number)
        table = d.vocabulary
        if d.categorical:
            rows = [(k, [float(x) for x in self.coefficients[:, d.first + k]]) for k in range(d.positions - d.first)]
            table = table.join(F.broadcast(df.sparkSession.createDataFrame(rows, "position long, c array<double>")), "position")  # bounded by the solve
        value = at(0)
        for k, x in enumerate(d.standardised(df)):
            value = value + at(1 + k) * x
        found, names = d.looked_up(df.withColumn("_base", value).withColumn("_fold", number), table, "c")
        value = F.col("_base")
        for n in names:
            value = value + F.coalesce(F.get(F.col(n), F.col("_fold")), F.lit(0.0))
        return found.withColumn(into, value).drop("_base", "_fold", *names)


def fit_linear(df: DataFrame, target: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), fold: Column | None = None,
               folds: int = 1) -> LinearModel:
    """Least squares of ``target``, fitted on the rows of ``df`` with a target (null, NaN and infinite are none).

    With ``fold`` (0 to ``folds - 1``), model ``k`` is fitted on the rows of all other folds: the Gram matrices are summed once
    per fold and the own one is taken away.  A missing number counts as the mean, a missing or unseen category adds nothing; no
    usable rows predict 0."""
    y = _number(df, target)
    used = df.withColumn("_y", y).withColumn("_g", F.lit(0) if fold is None else fold.cast("int")).where("_y IS NOT NULL")
    d = design(used, numeric, categorical)
    rows = d.entries(used)
    last = F.struct(F.lit(d.positions).alias("p"), F.col("_y").alias("v"))
    rows = rows.withColumn("_entries", F.concat("_entries", F.array(last)))
    parts = _matrices(gram(rows.withColumnRenamed("_g", "g"), ["g"]), d.positions + 1, folds)
    if fold is not None:
        parts = parts.sum(0) - parts
    return LinearModel(d, np.stack([_solve(m[:-1, :-1], m[:-1, -1]) if m.any() else np.zeros(d.positions) for m in parts]))


def fold_of(df: DataFrame, key_cols: Sequence[str], folds: int) -> Column:
    """A row's fold by the MD5 of its key, the same in any SQL engine."""
    key = F.concat_ws("|", *[F.coalesce(as_text(df, k), F.lit("\\N")) for k in key_cols])
    return (F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("int") % folds).cast("int")


def undervaluation(df: DataFrame, target: str, key_cols: Sequence[str], numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                   folds: int = 5) -> DataFrame:
    """``df`` with ``fold``, ``predicted``, ``undervaluation_pct`` (``(predicted - target) / predicted * 100``) by models
    that have not seen the row.  Rows without a target keep a prediction and have no percentage, nor have those predicted at 0."""
    keyed = df.withColumn("fold", fold_of(df, key_cols, folds))
    model = fit_linear(keyed, target, numeric, categorical, F.col("fold"), folds)
    out = model.predict(keyed, "predicted", F.col("fold"))
    return out.withColumn("undervaluation_pct", F.try_divide(F.col("predicted") - _number(out, target), "predicted") * 100.0)


def residual_summary(df: DataFrame, actual: str, predicted: str, group_col: str) -> DataFrame:
    """Per group ``rows, bias, mae, rmse, r2`` and the quartiles of ``actual - predicted`` (rows with both present)."""
    rows = (df.select(F.col(f"`{group_col}`").alias("group"), _number(df, actual).alias("a"), _number(df, predicted).alias("p"))
            .dropna(subset=["a", "p"]).withColumn("r", F.col("a") - F.col("p")))
    base = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.avg("r").alias("bias"), F.avg(F.abs("r")).alias("mae"),
                                     F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.sum(F.col("r") * F.col("r")).alias("_e"),
                                     (F.var_pop("a") * F.count(F.lit(1))).alias("_t"))
    quartiles = exact_quantiles(rows, ["group"], "r", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["median"])
    return (join_keys(base, quartiles, ["group"], "left")
            .select("group", "rows", "bias", "mae", "rmse", F.when(F.col("_t") > 0, 1.0 - F.col("_e") / F.col("_t")).alias("r2"), "q1", "median", "q3"))


def residual_spread(df: DataFrame, actual: str, predicted: str, group_col: str, prior_rows: float = 20.0) -> DataFrame:
    """``group, rows, spread, shrunken, rank``: the residuals' standard deviation by group, most spread first.

    ``shrunken`` pulls a group's variance to the pooled within-group one as if ``prior_rows`` further rows had it, so groups of two
    rows do not lead; groups of one row have only the pooled one and no ``spread``.  A null group is a group."""
    rows = (df.select(F.col(f"`{group_col}`").alias("group"), (_number(df, actual) - _number(df, predicted)).alias("r")).dropna(subset=["r"]))
    per = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.stddev_samp("r").alias("spread"),
                                    (F.var_pop("r") * F.count(F.lit(1))).alias("_ss")).checkpoint()
    within, freedom = per.agg(F.sum("_ss"), F.sum(F.col("rows") - 1)).first()
    pooled = within / freedom if freedom else 0.0
    shrunken = F.sqrt((F.col("_ss") + F.lit(prior_rows * pooled)) / (F.col("rows") - 1 + F.lit(prior_rows)))
    out = per.select("group", "rows", F.when(F.col("rows") > 1, F.col("spread")).alias("spread"), shrunken.alias("shrunken"))
    ranked = ordered_positions(out, [], [F.desc("shrunken"), F.asc_nulls_last("group")], pos_col="rank")
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def project(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), components: int = 2, rounds: int = 10_000,
            tolerance: float = 1e-13) -> tuple[DataFrame, np.ndarray]:
    """``df`` with ``pc1, pc2, ...``, the rows' scores on the leading principal components, and their loadings.

    Numeric columns are standardised, categories are 0/1 columns; a missing number counts as the mean.  Covariances come from one
    Gram matrix of sparse rows, components from subspace iteration with a fixed start.  Each component's sign makes its
    loading of largest size positive (the first such)."""
    checkpoint_dir(df.sparkSession)
    d = design(df, numeric, categorical)
    whole = _matrices(gram(d.entries(df)).withColumn("g", F.lit(0)), d.positions, 1)[0]
    n = max(whole[0, 0], 1.0)
    mean = whole[0] / n
    cov = (whole / n - np.outer(mean, mean))[1:, 1:]
    k = min(components, len(cov))
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(len(cov), min(len(cov), k + 4))))[0] if len(cov) else np.zeros((0, 0))
    for _ in range(rounds if len(cov) else 0):
        after = np.linalg.qr(cov @ basis)[0]
        apart = np.abs(after[:, :k] - basis[:, :k] @ (basis[:, :k].T @ after[:, :k])).max()
        basis = after
        if apart < tolerance:
            break
    values, turn = np.linalg.eigh(basis.T @ cov @ basis)
    loadings = (basis @ turn[:, np.argsort(-values)])[:, :k]
    for c in range(k):
        size = np.abs(loadings[:, c])
        loadings[:, c] *= np.sign(loadings[np.flatnonzero(size >= size.max() * (1 - 1e-9))[0], c]) or 1.0
    coefficients = np.vstack([-(mean[1:] @ loadings)[None, :], loadings])
    out = df
    for c in range(k):
        out = LinearModel(d, coefficients[:, c][None, :]).predict(out, f"pc{c + 1}")
    return out, loadings
