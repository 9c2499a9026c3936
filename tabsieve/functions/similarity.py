"""``difflib.SequenceMatcher(None, a, b).ratio()`` as an Arrow-batched pandas UDF.

The ratio is not symmetric, so argument order is part of the contract.  The thresholded variant
first applies difflib's own upper bounds (``real_quick_ratio`` then ``quick_ratio``) and only runs
the full matcher when they pass; below the threshold it returns NULL."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve._ship import ship_by_value


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _score_batch(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, low in zip(a, b, t):
        m = None if x is None or y is None else SequenceMatcher(None, x, y)
        score = None if m is None or m.real_quick_ratio() < low or m.quick_ratio() < low else m.ratio()
        out.append((None, None) if score is None or score < low else (score, round(score, 3)))
    return pd.DataFrame(out, columns=["score", "rounded"], dtype="float64")


_ratio_udf = F.pandas_udf(_ratio_batch, T.DoubleType())
_score_udf = F.pandas_udf(_score_batch, T.StructType([T.StructField("score", T.DoubleType()),
                                                      T.StructField("rounded", T.DoubleType())]))


def similarity(a: Column, b: Column) -> Column:
    """Exact difflib ratio of ``a`` against ``b``."""
    return _ratio_udf(a, b)


def scored_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Struct of ``score`` (the ratio if it is ``threshold`` or more, else NULL; difflib's bounds are checked
    first) and ``rounded`` (Python ``round(score, 3)``).  Non-deterministic for the optimiser, so a filter on
    the score stays above it and the matcher runs once per pair."""
    return _score_udf.asNondeterministic()(a, b, F.lit(float(threshold)))


ship_by_value(__name__)
