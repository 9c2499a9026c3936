"""Registry of the queries run on the driver's tables, each paired with an equivalent DuckDB SQL
oracle (or none, for iterative operators checked against brute force in ``tests/``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        old = QUERIES.get(name)
        if old is not None and (old.__module__, old.__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query {name}")  # same function again = module reload
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Oracle hygiene for floating results: round half-even to 6 decimals (``round_even(x, 6)``)."""
    return F.bround(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])
