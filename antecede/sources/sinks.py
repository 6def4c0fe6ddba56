"""Writing tables: season partitions, CSV reports and append-only snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_seasons(df: DataFrame, path: str, partition: str = "season") -> None:
    """One folder per season; only the seasons present are replaced.

    The rebalance hint sizes the write tasks at run time: a season that holds most of the data
    is split over many files, small seasons are not scattered. The commit protocol makes the
    replacement atomic.
    """
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_snapshot(board: DataFrame, path: str, captured_at, slate_date) -> None:
    """Adds one immutable capture of a quote board, in the folder of its slate date."""
    (
        board.withColumns(
            {
                "captured_at": F.lit(captured_at).cast("timestamp"),
                "slate_date": F.lit(slate_date).cast("date"),
            }
        )
        .write.mode("append")
        .partitionBy("slate_date")
        .parquet(path)
    )
