"""CSV scan with pandas ``read_csv`` semantics (A1, A2, A3) and previews (A5).

Differences handled: Spark names a blank header ``_c<N>`` (pandas: ``Unnamed: <N>``); Spark's reader
knows a single ``nullValue`` while pandas recognises a list of NA tokens; a column holding numbers
and NA tokens is numeric in pandas but text for Spark's inference.  Type refinement after the NA
pass is one extra one-row aggregate over the string columns, never a collect of data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.missing import NA_TOKENS, null_tokens, py_strip

_INDEX_NAME = re.compile(r"^(_c\d+|Unnamed:.*)$")
_INT_TEXT = r"^[+-]?[0-9]+$"
# The spellings pandas' CSV reader turns into booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
_FLOAT_TEXT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"


def index_columns(df: DataFrame) -> list[str]:
    """Columns written from a blank header (``_c<N>`` in Spark, ``Unnamed: <N>`` in pandas)."""
    return [c for c in df.columns if _INDEX_NAME.match(c)]


def refine_types(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Cast string columns whose non-null values are all integers (-> bigint), all numbers
    (-> double) or all boolean spellings (-> boolean), as pandas' inference does after NA tokens are
    removed.  One aggregate pass."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        t = py_strip(F.col(f"`{c}`"))
        aggs += [F.count(t).alias(f"n{i}"), F.count_if(t.rlike(_INT_TEXT)).alias(f"i{i}"),
                 F.count_if(t.rlike(_FLOAT_TEXT)).alias(f"f{i}"),
                 F.count_if(t.isin(list(TRUE_TOKENS + FALSE_TOKENS))).alias(f"b{i}")]
    stats = df.agg(*aggs).collect()[0]  # one row of counts
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in cols:
            i = cols.index(f.name)
            n = stats[f"n{i}"]
            if n and stats[f"i{i}"] == n:
                c = py_strip(c).try_cast("long")
            elif n and stats[f"f{i}"] == n:
                c = py_strip(c).try_cast("double")
            elif n and stats[f"b{i}"] == n:
                t = py_strip(c)
                c = F.when(t.isin(list(TRUE_TOKENS)), F.lit(True)).when(t.isin(list(FALSE_TOKENS)), F.lit(False))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def _files_by_breaks(spark: SparkSession, path: str | list[str]) -> dict[bool, list[str]]:
    """The files in which a line ends inside open quotes (True) and the others, from one pass over the lines.

    Doubled quotes leave a line's number of quotes even, so an odd one opens or closes a field over a line end.  (A stray
    quote in an unquoted field is odd too; its file is then read whole, with the same result.)"""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = lines.groupBy("file").agg(F.max(odd).alias("odd")).collect()  # names of files, which the driver lists anyway
    return {kind: sorted(unquote(r["file"]) for r in found if r["odd"] == kind) for kind in (True, False)}


def _literal_path(uri: str) -> str:
    """A file's name as a path pattern that names just it."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", uri)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
             drop_index_columns: bool = True, na_tokens: Iterable[str] = NA_TOKENS,
             infer_types: bool = True, multi_line: bool | None = None) -> DataFrame:
    """A1/A2/A3: header row, quoted fields with doubled quotes and line breaks, pandas NA tokens as NULL, and (without an
    explicit ``schema``) numeric columns recognised after the NA pass.

    A file with a line break inside quotes can't be split, so each such file is read by one task and the others are split as
    usual; which are such is found by one more pass over the lines.  ``multi_line`` skips that pass: True reads every file whole,
    False says that no field has a line break."""
    files = _files_by_breaks(spark, path) if multi_line is None else {True: [], False: []}
    reader = spark.read.option("header", True).option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE")
    if schema is None:
        named = reader.option("inferSchema", False).option("multiLine", bool(multi_line or files[True] and not files[False]))
        header = named.csv([_literal_path(files[False][0])] if files[True] and files[False] else path).schema
    else:
        header = schema
    reader = reader.schema(header)
    if files[True]:
        df = reader.option("multiLine", True).csv([_literal_path(f) for f in files[True]])
        if files[False]:
            df = df.unionByName(reader.option("multiLine", False).csv([_literal_path(f) for f in files[False]]))
    else:
        df = reader.option("multiLine", bool(multi_line)).csv(path)
    if drop_index_columns:
        df = df.drop(*index_columns(df))
    df = null_tokens(df, tokens=na_tokens)
    if schema is None and infer_types:
        df = refine_types(df)
    return df


def preview(df: DataFrame, n: int = 5, order_by: Iterable[str] | None = None) -> DataFrame:
    """A5: the first ``n`` rows in a stated order (Spark has no row order otherwise)."""
    cols = list(order_by) if order_by is not None else df.columns[:1]
    return df.orderBy(*cols).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """A5: ``(rows, columns)``; the row count is one aggregate job."""
    return df.count(), len(df.columns)
