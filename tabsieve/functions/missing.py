"""Missing-value canonicalisation and the scalar helpers every operator shares.

pandas has one "missing" marker; Spark has NULL and NaN.  Entry points call
:func:`canonicalize_missing` so NaN becomes NULL and SQL three-valued logic then behaves like the
pandas comparisons the operators are specified against.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens a pandas CSV read treats as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Python's str.strip()/split() whitespace = Java's Unicode White_Space plus the C0 separators 0x1C-0x1F.
PY_WS_CLASS = "[\\s\\x1c-\\x1f]"
_PY_WS_EDGES = f"(?U)^{PY_WS_CLASS}+|{PY_WS_CLASS}+$"

# Strings pandas.to_numeric accepts (after trimming): decimal / scientific notation and infinities.
_NUMERIC_TEXT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"
_INFINITY_TEXT = r"(?i)^[+-]?inf(inity)?$"  # only these spell an infinity; 1e999 overflows to NULL

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, CATEGORICAL_TYPES)


def canonicalize_missing(df: DataFrame) -> DataFrame:
    """Turn float/double NaN into NULL; every other column is passed through untouched."""
    exprs = []
    changed = False
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name))
            changed = True
        else:
            exprs.append(c)
    return df.select(*exprs) if changed else df


def null_tokens(df: DataFrame, columns: Iterable[str] | None = None,
                tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Recognise the pandas NA tokens in string columns (exact match, like the CSV reader)."""
    tokens = list(tokens)
    cols = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(F.col(f"`{f.name}`").isin(tokens), F.lit(None).cast("string"))
         .otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if f.name in cols else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trims all Unicode whitespace (Spark ``trim`` trims only spaces)."""
    return F.regexp_replace(c, _PY_WS_EDGES, "")


def to_number(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """``pandas.to_numeric(errors="coerce")`` as a column expression returning DOUBLE.

    Numeric input is cast (NaN -> NULL). Text is trimmed and must look like a decimal number or an
    infinity; ``1d``/``1f`` (accepted by a bare Spark cast), hex, ``1_000``, ``1,000`` and literals that
    overflow a double (``1e999``) become NULL.  Values are correctly rounded; pandas' fast parser can
    differ in the last bit for exponents beyond about 1e22.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and not isinstance(dtype, T.StringType):
        if isinstance(dtype, T.BooleanType):
            return col.cast("double")
        if is_numeric(dtype):
            return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        return F.lit(None).cast("double")
    text = py_strip(col.cast("string"))
    parsed = text.try_cast("double")
    overflow = (F.abs(parsed) == F.lit(float("inf"))) & ~text.rlike(_INFINITY_TEXT)
    return F.when(text.rlike(_NUMERIC_TEXT) & ~overflow, parsed).cast("double")


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """``round(num / den * 100, scale)`` with numpy's half-even rounding; NULL when ``den`` is 0."""
    return F.bround(F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0), scale)


def half_even_count(n: Column, fraction: float) -> Column:
    """``int(round(n * fraction))`` (Python rounds half to even)."""
    return F.bround(n.cast("double") * F.lit(float(fraction)), 0).cast("long")
