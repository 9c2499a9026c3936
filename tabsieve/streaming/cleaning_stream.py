"""Structured Streaming use of the row-level operators.

The reference has no streaming.  Its row-level cleaning operators (B2, B4, B5, C1, C5, J3 with a
static table, J5) are stateless DataFrame -> DataFrame functions, so they apply unchanged to a
streaming DataFrame; profiling, binning and splitting need the whole table and stay batch-only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


def read_parquet_stream(spark: SparkSession, directory: str, schema: T.StructType,
                        file_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def stream_checkpoint(spark: SparkSession, output: str) -> str:
    """The checkpoint folder of the stream that writes to ``output``: the same in every application and Python
    process, so a restarted job finds it.  Below the folder that ``spark.checkpoint.dir`` names
    (``getCheckpointDir()`` would add a new folder per application), or beside the output if unset."""
    name = hashlib.sha256(output.rstrip("/").encode()).hexdigest()[:32]
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{configured.rstrip('/')}/streams/{name}" if configured else f"{output.rstrip('/')}-checkpoint"


def write_parquet_stream(df: DataFrame, output: str, checkpoint: str | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Append the cleaned rows as Parquet; a restarted job resumes exactly once from the stream's checkpoint
    (``stream_checkpoint`` unless given)."""
    checkpoint = checkpoint or stream_checkpoint(df.sparkSession, output)
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
