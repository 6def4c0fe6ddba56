"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.session import scratch_path, stage

BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only. Pure ASCII text takes the faster route with the same result."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % parts


def in_fold(doc_id: Column | str, parts: int, fold: int) -> Column:
    return F.coalesce(remainder(doc_id, parts) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, fold: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold.

    The documents with the smallest hash of their id are taken, so reruns agree and the size
    of what a classifier is fitted on does not grow with the corpus.
    """
    known = (
        labels.where(F.col(label).isNotNull() & (remainder("doc_id", parts) != fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``rows`` ids


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes: ten thousand long texts in one batch would not fit a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def stage_packed(df: DataFrame, label: str) -> DataFrame:
    """``stage`` with the denser codec, for columns of packed numbers that are large and read once or twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at a path of any store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(staged: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more, so scratch space does not pile up."""
    session = staged.sparkSession
    jvm, conf = session._jvm, session._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


__all__ = ["LOWER", "UPPER", "ascii_lower", "discard", "folder_exists", "in_fold", "labelled_sample", "map_batches", "remainder", "stage", "stage_packed", "table"]
