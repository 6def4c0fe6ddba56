"""Target-distribution importance resampling with segment deduplication.

A document's weight says how much likelier its hashed word n-grams are in a target set than in the corpus; adding one Gumbel
draw per document (a function of its id and the seed) and keeping the highest scores draws documents without replacement in
proportion to those likelihoods.

Separators of words include the line feed, so line feeds cut a text into lines whose n-grams stand inside them. Every
*distinct* line of the corpus is hashed once: its buckets are stored under its digest and count as often as the line
occurs, both in the corpus totals and, by a join on the digest, in the weights of the documents that hold it. The n-grams
that cross lines are made of the two words on either side of a line feed only; they are found per document and added.

Scale: lines are combined before they are shuffled, so a line that a third of all documents hold is one row per task; the
join that fetches line weights is keyed by digest, and a hot digest is split by adaptive skew handling. Bucket totals are
``BUCKETS`` numbers per task. Only those totals (two per bucket) reach the driver. Ranks come from a range partitioning by
score and id with row counts per partition, so no task sees all documents.

Defined cases: a null, empty or wordless text has no features, weight 0, and is never drawn; a long text counts whole; rows
equal in doc_id and text are documents of their own with equal scores and neighbouring ranks; a null doc_id draws like an
empty one and comes before others on equal scores; an empty target set or an empty corpus counts as zero features; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import ascii_lower, discard, map_batches, stage, stage_packed

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The first word of a line and the second, if there is one; on the reversed line the last two.
EDGE = re.compile(rb"[^0-9a-z\x80-\xff]*([0-9a-z\x80-\xff]+)(?:[^0-9a-z\x80-\xff]+([0-9a-z\x80-\xff]+))?")
BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20


def hashes(words: list[bytes]) -> list[int]:
    """crc32 of every run of one, two and three words; a longer run carries on the sum of the shorter one."""
    spaced = [b" " + w for w in words]
    one = [crc32(w) for w in words]
    two = list(map(crc32, spaced[1:], one))
    return one + two + list(map(crc32, spaced[2:], two))


def crossing(lines: list[bytes]) -> list[int]:
    """crc32 of the runs of two and three words that stand in more than one line."""
    found, tail = [], []
    for line in lines:
        head = EDGE.match(line)
        if head is None:
            continue
        first, second = head.groups()
        if tail:
            pair = crc32(b" " + first, crc32(tail[-1]))
            found.append(pair)
            if second is not None:
                found.append(crc32(b" " + second, pair))
            if len(tail) == 2:
                found.append(crc32(b" ".join((*tail, first))))
        if second is None:
            tail = [*tail[-1:], first]
        else:
            last, before = EDGE.match(line[::-1]).groups()
            tail = [before[::-1], last[::-1]]
    return found


def _kind(buckets: int) -> type:
    """The smallest number that holds a bucket; packed lists of them are most of what is staged."""
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _packed(values: list[int], buckets: int) -> bytes:
    return (np.array(values, np.uint32) % buckets).astype(_kind(buckets)).tobytes()


def read_documents(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row: the digests of its lines and the buckets of its crossing n-grams."""

    def run(batches):
        for batch in batches:
            lines = [(t.as_py() or b"").lower().split(b"\n") for t in batch.column("text").cast(pa.binary())]
            digests = [[hashlib.md5(x, usedforsecurity=False).digest() for x in ls] for ls in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(digests, pa.list_(pa.binary())), pa.array([_packed(crossing(ls), buckets) for ls in lines], pa.binary())],
                names=["row", "doc_id", "lines", "cross"],
            )

    return run


def read_lines(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per distinct line: its digest, words, the buckets of its n-grams and how often it occurs."""

    def run(batches):
        for batch in batches:
            lines = batch.column("line").cast(pa.binary()).to_pylist()
            words = [WORD.findall(x) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(x, usedforsecurity=False).digest() for x in lines], pa.binary()), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([_packed(hashes(w), buckets) for w in words], pa.binary()), batch.column("times")],
                names=["line", "words", "features", "times"],
            )

    return run


def _lists(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a binary column and how many each row has."""
    packed, kind = column.to_pylist(), np.dtype(_kind(buckets))
    return np.frombuffer(b"".join(packed), kind), np.array([len(x) for x in packed], np.int64) // kind.itemsize


def count_buckets(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of (features, times) over the rows of a task."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, sizes = _lists(batch.column("features"), buckets)
            times = np.repeat(batch.column("times").to_numpy(), sizes)
            total += np.bincount(values, times, buckets).astype(np.int64)  # below 2**53 in one batch, so exact
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return run


def weigh(gains: np.ndarray, column: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum of the gains of each row's buckets."""

    def run(batches):
        for batch in batches:
            values, sizes = _lists(batch.column(column), len(gains))
            summed = np.concatenate([[0], np.cumsum(gains[values])])
            ends = np.cumsum(sizes)
            weights = summed[ends] - summed[ends - sizes]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(weights)], names=[*keep, "weight"])

    return run


class Features:
    """The staged rows and distinct lines of a table of texts."""

    def __init__(self, docs: DataFrame, buckets: int):
        self.buckets = buckets
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        self.rows = stage_packed(map_batches(numbered, read_documents(buckets), "row bigint, doc_id bigint, lines array<binary>, cross binary"), "rows")
        lines = docs.select(F.explode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
        self.lines = stage_packed(map_batches(lines, read_lines(buckets), "line binary, words bigint, features binary, times bigint"), "lines")

    def totals(self) -> np.ndarray:
        """Features per bucket over the whole table."""
        parts = self.lines.select("features", "times").unionAll(self.rows.select(F.col("cross").alias("features"), F.lit(1).cast("bigint").alias("times")))
        counted = map_batches(parts, count_buckets(self.buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n"))
        total = np.zeros(self.buckets, np.int64)
        for bucket, n in counted.collect():  # one row per bucket
            total[bucket] = n
        return total

    def weights(self, gains: np.ndarray) -> DataFrame:
        """row, doc_id, n_words, weight."""
        lines = map_batches(self.lines.select("line", "words", "features"), weigh(gains, "features", ["line", "words"]), "line binary, words bigint, weight bigint")
        held = self.rows.select("row", F.explode("lines").alias("line")).join(lines, "line").groupBy("row").agg(F.sum("words").alias("n_words"), F.sum("weight").alias("inside"))
        own = map_batches(self.rows.select("row", "doc_id", "cross"), weigh(gains, "cross", ["row", "doc_id"]), "row bigint, doc_id bigint, weight bigint")
        return own.join(held, "row", "left").select(
            "row", "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), (F.col("weight") + F.coalesce("inside", F.lit(0))).alias("weight")
        )


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source share, per bucket."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.floor(1000 * np.log((target + 1) * (s + size) / ((source + 1) * (t + size)))).astype(np.int64)


def ranked(scored: DataFrame, quota: int) -> DataFrame:
    """(row, rank) of the ``quota`` highest scores, ties to the smaller doc_id."""
    order = [F.desc("score"), F.asc("doc_id")]
    dealt = stage(scored.select("row", "doc_id", "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = sorted((part, n) for part, n in dealt.groupBy("part").count().collect())  # one row per partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, before bigint"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(offsets, "part").select("row", (F.col("before") + place).cast("bigint").alias("rank")).where(F.col("rank") <= quota)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``target`` has a text column."""
    corpus = Features(docs, buckets)
    wanted = Features(target.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), buckets)
    gains = bucket_gains(corpus.totals(), wanted.totals())
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    n = F.col("n_words")
    scored = stage(
        corpus.weights(gains).withColumn("score", F.col("weight") + noise)
        .withColumn("n_features", n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))),
        "scored",
    )
    for staged in (corpus.rows, corpus.lines, wanted.rows, wanted.lines):
        discard(staged)
    eligible = scored.where(n >= least_words)
    drawn = ranked(eligible, percent * eligible.count() // 100)
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
