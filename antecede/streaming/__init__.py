"""The append-only quote history fed by Structured Streaming.

The batch form adds one immutable capture per run. The streaming form does the same for capture
files as they arrive, and keeps the newest quote of every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from antecede.operators.market import latest_quotes


def read_captures(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_captures(captures: DataFrame, path: str, checkpoint: str, partition: str) -> StreamingQuery:
    """Each micro-batch appends its rows once, also after a restart, and then stops when the
    folder is drained."""
    return (
        captures.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(partition)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def current_board(history: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest quote of every key in the appended history."""
    return latest_quotes(history, key, order)
