"""One-hot encoding (B6 fit, B7 transform).

Dense: one column per category, so the categories have to be known to the driver, whatever their number.
Sparse, for wide vocabularies: the vocabulary is a table of positions, and a row gets the positions of
its categories; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.missing import canonicalize_missing
from tabsieve.operators.freq import as_text, long_values
from tabsieve.operators.lookup import lookup
from tabsieve.operators.ordering import ordered_positions


@dataclass
class OneHotModel:
    columns: list[str]
    categories: dict[str, list] = field(default_factory=dict)
    separator: str = ""  # the reference joins name and category with nothing; a separator avoids collisions

    def output_names(self) -> dict[str, list[str]]:
        return {c: [f"{c}{self.separator}{cat}" for cat in self.categories[c]] for c in self.columns}

    def transform(self, df: DataFrame) -> DataFrame:
        """``col == category`` as 0/1 per learned category (NULL and unseen -> all zeros); the
        source columns are dropped and the new ones appended in fit order."""
        names = self.output_names()
        new = [n for c in self.columns for n in names[c]]
        kept = [c for c in df.columns if c not in self.columns]
        clash = set(new) & set(kept) or {n for n in new if new.count(n) > 1}
        if clash:
            raise ValueError(f"one-hot column names collide: {sorted(clash)}")
        exprs = [F.col(f"`{c}`") for c in kept]
        for c in self.columns:
            src = F.col(f"`{c}`")
            for cat, name in zip(self.categories[c], names[c]):
                exprs.append(F.coalesce(src == F.lit(cat), F.lit(False)).cast("int").alias(name))
        return df.select(*exprs)


def _typed(value: str, dtype) -> object:
    if isinstance(dtype, T.BooleanType):
        return value == "true"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float(value)
    return value


#: categories of a column that may become output columns
MAX_CATEGORIES = 10_000


def fit_one_hot(df: DataFrame, columns: Sequence[str], max_categories: int | None = MAX_CATEGORIES,
                separator: str = "") -> OneHotModel:
    """Sorted distinct non-null categories per column, by one scan and one distinct.  As many as there are
    become output columns; more than ``max_categories`` in a column are refused, and no more than that is collected
    (None: the caller answers for the width; :func:`one_hot_sparse` has no limit)."""
    columns = list(columns)
    df = canonicalize_missing(df.select(*[F.col(f"`{c}`") for c in columns]))
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    vocab = (text.unpivot([], [f"c{i}" for i in range(len(columns))], "_f", "_s")
                 .where("_s IS NOT NULL").distinct())
    if max_categories is not None:
        w = Window.partitionBy("_f").orderBy("_s")
        vocab = vocab.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_categories + 1)
    found: dict[str, list[str]] = {f"c{i}": [] for i in range(len(columns))}
    for r in vocab.select("_f", "_s").collect():
        found[r["_f"]].append(r["_s"])
    too_big = [columns[i] for i in range(len(columns))
               if max_categories is not None and len(found[f"c{i}"]) > max_categories]
    if too_big:
        raise ValueError(f"vocabulary above max_categories={max_categories}: {too_big}; use one_hot_sparse")
    categories = {c: sorted(_typed(v, df.schema[c].dataType) for v in found[f"c{i}"])
                  for i, c in enumerate(columns)}
    return OneHotModel(columns, categories, separator)


def fit_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B6 without a limit: ``feature, category, position`` of every non-null category (as text), positions from
    0 in the order of the columns and then of the categories.  Ranked by many tasks, never collected."""
    order = F.create_map(*[x for k, c in enumerate(columns) for x in (F.lit(c), F.lit(k))])
    vocab = (long_values(df, columns).where(F.col("category").isNotNull()).distinct()
             .withColumn("_column", order[F.col("feature")]))
    ranked = ordered_positions(vocab, [], [F.asc("_column"), F.asc("category")])
    return ranked.select("feature", "category", (F.col("_pos") - 1).cast("long").alias("position"))


def one_hot_sparse(df: DataFrame, vocabulary: DataFrame, columns: Sequence[str], into: str = "positions") -> DataFrame:
    """B7, sparse: ``columns`` replaced by ``into``, the ascending positions of the row's known categories (NULL and
    unseen ones have none).  Each lookup is size-checked."""
    names = [F.col(f"`{c}`") for c in df.columns]
    out, found = df, []
    for k, c in enumerate(columns):
        own = (vocabulary.where(F.col("feature") == c)
               .select(F.col("category").alias(f"_category{k}"), F.col("position").alias(f"_position{k}")))
        out = lookup(out, as_text(df, c), own, f"_category{k}", F.struct(*names))
        found.append(F.col(f"_position{k}"))
    return out.withColumn(into, F.array_sort(F.array_compact(F.array(*found)))).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in columns and c != into], into)


def one_hot_encoding(df: DataFrame, columns: Sequence[str], train: bool = True,
                     model: OneHotModel | None = None, max_categories: int | None = MAX_CATEGORIES):
    """Reference-style entry point: ``train=True`` returns ``(encoded, model)``, else ``encoded``."""
    if train:
        model = fit_one_hot(df, columns, max_categories)
        return model.transform(df), model
    if model is None:
        raise ValueError("a fitted model is required when train=False")
    return model.transform(df)
