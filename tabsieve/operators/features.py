"""Columns for a model: derived features (N2, N3), log target and skew (N4), imputation fitted on the train part (N5) and
label codes that stay the same when refitted (N6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.missing import to_number
from tabsieve.operators.binning import UNKNOWN_LABEL
from tabsieve.operators.freq import as_text, long_values
from tabsieve.operators.lookup import lookup
from tabsieve.operators.ordering import exact_quantiles, ordered_positions
from tabsieve.session import checkpoint_dir

MISSING_CODE, UNSEEN_CODE = -1, -2


def _number(df: DataFrame, column: str) -> Column:
    return to_number(F.col(f"`{column}`"), df.schema[column].dataType)


def engine_litres(text: Column) -> Column:
    """The first number of an engine text as litres (``2.0 Turbo`` or ``2,0 TSI`` -> 2.0); null without one."""
    return F.replace(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def derived_features(df: DataFrame, year_col: str, km_col: str, brand_col: str, model_col: str, reference_year: int) -> DataFrame:
    """``df`` with ``age``, ``km_per_year`` (null at age 0 or below, or without a value) and ``brand_model`` (null if either is)."""
    age = F.lit(float(reference_year)) - _number(df, year_col)
    both = F.concat(as_text(df, brand_col), F.lit("_"), as_text(df, model_col))
    return (df.withColumn("age", age).withColumn("km_per_year", F.when(F.col("age") > 0, _number(df, km_col) / F.col("age")))
            .withColumn("brand_model", both))


def log_positive(df: DataFrame, column: str) -> Column:
    """Natural logarithm where the value is above 0, else null."""
    x = _number(df, column)
    return F.when(x > 0, F.ln(x))


def skew_check(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """``feature, rows, positive, skew, log_skew, use_log``: sample skewness (as ``Series.skew``) before and after the logarithm.
    ``use_log`` advises it: all values positive, skew beyond ``limit`` and nearer 0 afterwards.  Null for under three values or none that differ."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _number(df, c).alias("x")) for c in columns]))
    rows = df.select(cells.alias("c")).select("c.*").withColumn("y", F.when(F.col("x") > 0, F.ln("x")))

    def sample(column: str) -> Column:
        n = F.count(column).cast("double")
        return F.when((n > 2) & (F.var_pop(column) > 0), F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))
    out = rows.groupBy("feature").agg(F.count("x").alias("rows"), F.count("y").alias("positive"), sample("x").alias("skew"), sample("y").alias("log_skew"))
    advised = (F.col("positive") == F.col("rows")) & (F.abs("skew") > limit) & (F.abs("log_skew") < F.abs("skew"))
    return out.withColumn("use_log", F.coalesce(advised, F.lit(False)))


@dataclass
class Imputer:
    """Medians by level of a hierarchy, most special first; the last level is the whole train part."""

    columns: list[str]
    levels: list[list[str]]
    medians: DataFrame  # level int, key array<string>, feature string, median double
    categorical: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with missing values of ``columns`` filled from the first level that knows a median, and of ``categorical`` by
        ``Unknown``.  What no level knows stays null.  The rows of ``df`` have no influence."""
        out, every = df, F.struct(*[F.col(f"`{c}`") for c in df.columns])
        for k, level in enumerate(self.levels):
            known = self.medians.where(F.col("level") == k).groupBy("key").agg(*[
                F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m{k}_{i}") for i, c in enumerate(self.columns)])
            out = lookup(out, _key(df, level), known.withColumnRenamed("key", f"_key{k}"), f"_key{k}", every)
        filled = {c: F.coalesce(_number(df, c), *[F.col(f"_m{k}_{i}") for k in range(len(self.levels))]) for i, c in enumerate(self.columns)}
        filled |= {c: F.coalesce(as_text(df, c), F.lit(UNKNOWN_LABEL)) for c in self.categorical}
        return out.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def _key(df: DataFrame, level: Sequence[str]) -> Column:
    """A level's key; null if a part is missing, so such rows fall through to the next level."""
    parts = [as_text(df, c) for c in level]
    whole = F.array(*parts) if parts else F.array().cast("array<string>")
    complete = F.lit(True)
    for p in parts:
        complete = complete & p.isNotNull()
    return F.when(complete, whole)


def fit_imputer(train: DataFrame, columns: Sequence[str], hierarchy: Sequence[Sequence[str]] = (), categorical: Sequence[str] = (),
                min_rows: int = 1) -> Imputer:
    """Exact medians of ``columns`` in the train part, by each level of ``hierarchy`` (say ``[["brand", "model"], ["brand"]]``) and
    over all.  A level's median needs ``min_rows`` values; missing values and rows with a missing key part give none."""
    checkpoint_dir(train.sparkSession)
    levels = [list(level) for level in hierarchy] + [[]]
    keyed = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _key(train, level).alias("key")) for k, level in enumerate(levels)]))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _number(train, c).alias("x")) for c in columns]))
    rows = train.select(cells.alias("c"), *[F.col(f"`{c}`") for c in dict.fromkeys(x for level in levels for x in level)])
    rows = rows.where("c.x IS NOT NULL").select(keyed.alias("k"), "c").select("k.level", "k.key", "c.feature", "c.x").where("key IS NOT NULL")
    enough = rows.groupBy("level", "key", "feature").agg(F.count(F.lit(1)).alias("n"))
    medians = exact_quantiles(rows, ["level", "key", "feature"], "x", [0.5], ["median"], ["median"])
    medians = medians.join(enough.where((F.col("n") >= min_rows) | (F.size("key") == 0)).drop("n"), ["level", "key", "feature"])
    return Imputer(list(columns), levels, medians.checkpoint(), list(categorical))


def fit_labels(df: DataFrame, columns: Sequence[str], previous: DataFrame | None = None) -> DataFrame:
    """``feature, category, code`` of the non-null categories, codes from 0 in the order of the categories.

    With ``previous`` (an earlier result) every known category keeps its code, also those no longer met, and new ones
    follow behind each column's highest code, again in order.  Ranked by many tasks."""
    found = long_values(df, columns).where(F.col("category").isNotNull()).distinct()
    if previous is None:
        return ordered_positions(found, ["feature"], ["category"]).select("feature", "category", (F.col("_pos") - 1).cast("long").alias("code"))
    checkpoint_dir(df.sparkSession)
    previous = previous.select("feature", "category", "code").checkpoint()
    fresh = found.join(previous.select("feature", "category"), ["feature", "category"], "left_anti")
    top = previous.groupBy("feature").agg((F.max("code") + 1).alias("_next"))
    ranked = ordered_positions(fresh, ["feature"], ["category"]).join(F.broadcast(top), "feature", "left")  # one row per column
    return previous.unionByName(ranked.select("feature", "category", (F.coalesce("_next", F.lit(0)) + F.col("_pos") - 1).cast("long").alias("code")))


def label_codes(df: DataFrame, labels: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """``df`` with a code column per column: ``MISSING_CODE`` for null, ``UNSEEN_CODE`` for a category that ``labels`` has not."""
    out, every = df, F.struct(*[F.col(f"`{c}`") for c in df.columns])
    codes = {}
    for k, c in enumerate(columns):
        own = labels.where(F.col("feature") == c).select(F.col("category").alias(f"_is{k}"), F.col("code").alias(f"_code{k}"))
        out = lookup(out, as_text(df, c), own, f"_is{k}", every)
        codes[f"{c}{suffix}"] = F.when(as_text(df, c).isNull(), F.lit(MISSING_CODE)).otherwise(F.coalesce(F.col(f"_code{k}"), F.lit(UNSEEN_CODE))).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in codes], *[x.alias(n) for n, x in codes.items()])
