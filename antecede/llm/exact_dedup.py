"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are reduced to one row per digest
(a map-side combined aggregate, so a group of copies that holds a third of all rows is a single
row before the shuffle), joined to the index with a sort-merge anti join that reads the index
without an exchange, and what is new is appended. Only digests and ids are ever shuffled.

Defined cases: a null text counts as empty, equal texts are those identical after lower-casing
A-Z, of equal texts in one batch the largest id stays, a digest already in the index keeps its
row. A null id is smaller than any other id. Rows with one id and one text each get an output
row, and all of them are kept if one is. A long text is digested whole; an empty table gives no rows and leaves the
index as it is. Other columns are ignored and may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm.common import ascii_lower, folder_exists, stage
from antecede.session import scratch_path

BUCKETS = 64


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row, the digest as 32 bytes."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_sha256"))


class DigestIndex:
    """An append-only table (text_sha256, keep_id), bucketed and sorted by digest.

    ``location`` is a folder all executors share; without one a fresh folder below
    spark.checkpoint.dir is used. ``buckets`` is a property of the stored table: choose it so
    that a bucket's digests (40 bytes each) fit a task. It is written beside the table, so any later session opens an
    index by its location alone, with the buckets it was made with, whether or not its catalog knows the name. Files
    without that note are not an index, and nothing is written over them.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, location: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.location = (location or scratch_path(spark, self.name)).rstrip("/")
        note = f"{self.location}-buckets"
        if folder_exists(spark, note):
            self.buckets = int(spark.read.text(note).first()["value"])
            self._register()
        elif folder_exists(spark, self.location):
            raise ValueError(f"{self.location} holds files that are not a digest index")
        else:
            spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.text(note)

    def _register(self) -> None:
        """Makes the stored table known to this session's catalog."""
        if folder_exists(self.spark, self.location) and not self.exists():
            self.spark.sql(
                f"CREATE TABLE {self.name} (text_sha256 BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (text_sha256) "
                f"SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
            )

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Adds (doc_id, text_sha256) rows whose digest the index does not hold yet."""
        self._register()
        new = batch.groupBy("text_sha256").agg(F.max("doc_id").cast("bigint").alias("keep_id"))
        if self.exists():
            new = new.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        (
            new.repartition(self.buckets, "text_sha256")
            .write.mode("append").format("parquet").option("path", self.location)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (lowercase hex) of every row.

    The rows enter the index in ``batches`` ranges of the id, highest first, so that the row
    that stays is the one with the largest id whatever the number of batches.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows = stage(digests(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or high is None:
        index.add(rows)
    else:
        cuts = [high + 1] + [low + (high - low) * k // batches for k in range(batches - 1, 0, -1)] + [low - 1]
        for upper, lower in zip(cuts, cuts[1:]):
            index.add(rows.where((F.col("doc_id") < upper) & (F.col("doc_id") >= lower)))
        index.add(rows.where(F.col("doc_id").isNull()))
    sizes = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    groups = index.read().join(sizes, "text_sha256")
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )
