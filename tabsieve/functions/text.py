"""Category text normalisers (I1, I2) as column expressions.

Both normalisers share one step that Spark has no function for: lower case and Unicode decomposition
without combining marks, as Python does them.  ASCII values get it from ``lower``; other values go to an
Arrow-batched pandas UDF that does only this step, on whole Series.  Stripping, replacing and
collapsing are column expressions for every value.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve._ship import ship_by_value
from tabsieve.functions.labels import NORMALISED_MISSING as MISSING_TOKEN
from tabsieve.functions.missing import PY_WS_CLASS, py_strip

_ASCII = "^[\\x00-\\x7F]*$"


def _combining_marks() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def _unmarked(values: pd.Series) -> pd.Series:
    if not values.notna().any():
        return pd.Series([None] * len(values), dtype=object)
    return values.str.lower().str.normalize("NFKD").str.translate(_combining_marks())


_unmarked_udf = F.pandas_udf(_unmarked, T.StringType())


def folded(c: Column) -> Column:
    """Lower case, decomposed, without combining marks."""
    plain = c.rlike(_ASCII)
    return F.when(plain, F.lower(c)).otherwise(_unmarked_udf(F.when(~plain, c)))


def normalize_category(c: Column) -> Column:
    """I1 (text input): folded, ``_`` and ``-`` as spaces, white space collapsed; NULL -> ``missing``."""
    spaced = F.regexp_replace(F.translate(folded(c), "_-", "  "), f"(?U){PY_WS_CLASS}+", " ")
    return F.coalesce(py_strip(spaced), F.lit(MISSING_TOKEN))


def normalize_text(c: Column) -> Column:
    """I2 (text input): folded, everything but ``a-z0-9`` as spaces, collapsed; NULL -> ``missing``."""
    spaced = F.regexp_replace(folded(c), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(spaced), F.lit(MISSING_TOKEN))


ship_by_value(__name__)
