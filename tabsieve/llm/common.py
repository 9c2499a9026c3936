"""Helpers shared by the operators: shared scratch tables, Arrow batches and row expansion."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.session import checkpoint_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            remove_path(spark, path)
        except Exception:  # the session is already gone: the folder is the cluster's to expire
            pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder.  Unlike ``checkpoint()`` later reads are
    column-pruned and compressed, which matters for wide rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arrow batches to and from Python hold about this much, so a worker's memory follows neither the number of rows
#: that Spark would put in a batch nor the length of texts (one row at least)
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with ``BATCH_BYTES`` set for its session unless the application sets the limit itself."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def with_struct(df: DataFrame, udf, inputs: list[Column], into: str = "__r") -> DataFrame:
    """Add the struct that ``udf`` returns as one column.  Marked non-deterministic so that a filter on
    its fields is never pushed below it, which would evaluate the Python function twice."""
    return bounded_batches(df).withColumn(into, udf.asNondeterministic()(*inputs))


def replace_columns(df: DataFrame, struct: str, fields: list[str]) -> DataFrame:
    """Expand ``struct`` to top-level columns; an input column of the same name is replaced."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != struct and c not in fields]
    return df.select(*kept, *[F.col(f"{struct}.{f}").alias(f) for f in fields])


#: rows of a lookup table that may be broadcast (a few megabytes); counted before each use
BROADCAST_ROWS = 50_000
SALTS = 32


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of ``left`` to one row per ``key`` of ``right``.  Up to ``BROADCAST_ROWS`` counted rows are
    broadcast; beyond that each lookup row is repeated per salt, and a hot key's rows go to ``SALTS``
    partitions by a hash of ``spread``."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
            .join(salted, [key, "__salt"], "left").drop("__salt"))


def looked_up(left: DataFrame, key: str, table: DataFrame, heavy: Column, how: str = "inner") -> DataFrame:
    """Inner or left join of ``left`` (no null keys) to ``table`` (one row per ``key``), both read twice.  Rows of ``table`` where
    ``heavy`` holds are broadcast: the caller knows a bound of their number, and that no other key is hot."""
    hot = table.where(heavy).withColumn("__hot", F.lit(True))
    with_hot = left.join(F.broadcast(hot), key, "left")
    rest = with_hot.where("__hot IS NULL").select(*left.columns).join(table.where(~heavy), key, how)
    columns = [*left.columns, *[c for c in table.columns if c != key]]
    return with_hot.where("__hot").select(*columns).unionByName(rest.select(*columns))


def texts(column: pa.Array):
    """The strings of an Arrow column one at a time, so a batch is never held twice as Python objects."""
    for value in column:
        yield value.as_py()


ship_by_value(__name__)
