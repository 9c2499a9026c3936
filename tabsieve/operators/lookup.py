"""Joining rows to a small table derived from the data, whatever its size turns out to be.

A table estimated from a grouped count can look as large as its input, and then Spark shuffles the rows
on the lookup key before the real size is known: a key that holds a third of all rows lands in one task.
Here the table is materialised and counted first.  Up to ``BROADCAST_ROWS`` rows it is broadcast; beyond
that every lookup row is repeated once per salt and the rows are spread over the salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.session import checkpoint_dir

BROADCAST_ROWS = 50_000
SALTS = 32


def lookup(left: DataFrame, key: Column, table: DataFrame, table_key: str, spread: Column,
           counted: int | None = None) -> DataFrame:
    """Left join of ``left`` to ``table`` (one row per ``table_key``) on ``key <=> table_key``.  ``spread`` is any
    expression that differs between the rows of one key; ``counted`` is the table's size if known."""
    if counted is None:
        checkpoint_dir(left.sparkSession)
        table = table.checkpoint(eager=True)
        counted = table.count()
    if counted <= BROADCAST_ROWS:
        return left.join(F.broadcast(table), key.eqNullSafe(F.col(table_key)), "left").drop(table_key)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = left.withColumn("_row_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, key.eqNullSafe(F.col(table_key)) & (F.col("_row_salt") == F.col("_salt")), "left")
    return joined.drop(table_key, "_salt", "_row_salt")
