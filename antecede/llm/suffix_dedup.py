"""Exact substring dedup over a blockwise suffix array.

Every byte that a ``depth``-byte string covers which also starts earlier (smaller doc_id, or same document and earlier
start) is removed. Two strings of ``depth`` bytes are equal when their suffixes are neighbours in suffix order, so suffixes
are sorted, one bucket at a time.

Buckets. A suffix belongs to the ``GRAM``-byte string of least hash (leftmost on ties) in its first ``depth`` bytes: equal
strings choose the same one at the same place, so they meet in one bucket wherever they stand. Consecutive suffixes that
choose the same place form a *stretch*, whose bytes hold all their strings. Only stretches travel, about three for every
hundred bytes of text, and first without their bytes: as two 64-bit hashes, the bucket and the whole stretch.
  1. Buckets with one stretch in the whole corpus hold nothing repeated and are left.
  2. Of equal stretches (both hashes equal) the first stays to be looked at; in all others every string starts earlier.
  3. What remains are different stretches of one bucket. They get their bytes and their suffixes are sorted in blocks of
     whole buckets. ``suffix_ranks`` is a difference cover construction: the suffixes at the places of a cover modulo
     ``PERIOD`` are ranked first; the others are sorted by their first ``PERIOD`` bytes, and ties, however long, are
     resolved by the ranks of two cover places at equal distance. So a block holds a few numbers per byte, whatever the
     length of the repeats, and the first place of each run of equal strings is the one that stays.

Scale: shuffles carry a few numbers per stretch, and bytes only of the stretches of step 3. A stretch that a third of all
documents hold is combined before the shuffle. A bucket of more than ``BUCKET_LIMIT`` different stretches is not sorted in one
task: its strings are dealt by their own digest, where each distinct string is one row (``dealt_strings``, same result).
Long documents are read in windows of ``WINDOW`` suffixes.

Defined cases: null and empty texts have no bytes and keep nothing; texts shorter than ``depth`` lose nothing; a text of at
least ``depth`` bytes that equals an earlier one loses everything; rows equal in doc_id and text are one document with one result each; rows
equal in doc_id alone are ordered by a hash of their text; a null doc_id is smaller than any other; empty tables give no
rows; extra columns are not read. ``depth`` is between ``2 * GRAM`` and ``4 * GRAM``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import discard, map_batches, stage

DEPTH, GRAM = 100, 32
PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 is one of two members of the cover
WINDOW, OUT_ROWS, BLOCK_ROWS, BUCKET_LIMIT = 1 << 18, 50_000, 10_000, 5_000
KEY = ["doc_id", "text_key"]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _packed(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on as one number, first byte highest; width is at most 8."""
    out = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[k : len(data) - width + 1 + k]
    return out


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of strings of twice the width."""
    return _mix(_mix(h[:-width]) + h[width:])


def stretches(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, bucket, whole) of the stretches of a text: ``n`` suffixes from ``start`` on choose the same place."""
    suffixes = len(data) - depth + 1
    h = _packed(data, 8)
    for width in (8, 16):
        h = _doubled(h, width)
    least, span = h, 1
    reach = depth - GRAM + 1
    at = np.arange(len(h), dtype=np.int32)
    while span < reach:  # leftmost least hash of ever wider ranges
        step = min(span, reach - span)
        right = least[step:] < least[:-step]
        at, least = np.where(right, at[step:], at[:-step]), np.where(right, least[step:], least[:-step])
        span += step
    at, least = at[:suffixes], least[:suffixes]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.diff(np.append(start, suffixes))
    # Strings of 2 * GRAM bytes at both ends of the first and of the last suffix cover a stretch.
    wide, end = _doubled(h, GRAM), start + n - 1
    whole = n.astype(np.uint64)
    for place in (start, start + depth - 2 * GRAM, end, end + depth - 2 * GRAM):
        whole = _mix(whole * _M1 + wide[place])
    return start, n, least[start].view(np.int64), whole.view(np.int64)


def find_stretches(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, *_, n in found for _ in range(n)], pa.int64()), pa.array(np.repeat([x[1] for x in found], [x[-1] for x in found])),
             *[pa.array(np.concatenate([x[k] for x in found])) for k in range(2, 6)]],
            names=["doc_id", "text_key", "start", "n", "bucket", "whole"],
        )

    def run(batches):
        found, rows = [], 0
        for batch in batches:
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                for first in range(0, len(data) - depth + 1, WINDOW):
                    start, n, bucket, whole = stretches(data[first : first + WINDOW + depth - 1], depth)
                    found.append((doc_id, key, (start + first).astype(np.int64), n.astype(np.int64), bucket, whole, len(n)))
                    rows += len(n)
                    if rows > OUT_ROWS:
                        yield packed(found)
                        found, rows = [], 0
        if found:
            yield packed(found)

    return run


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys from 1 on, equal for equal keys."""
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def cover_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at every place of the cover, by at least ``depth`` bytes; 0 elsewhere and past the end."""
    padded = np.append(data, np.zeros(PERIOD, np.uint8))
    places = np.flatnonzero(np.isin(np.arange(len(data)) % PERIOD, COVER))
    rank = np.zeros(len(data) + depth + 2 * PERIOD, np.int64)
    rank[places] = _dense(_packed(padded, PERIOD)[places])
    width = PERIOD
    while width < depth:  # both halves start in the cover, because their distance is a multiple of the period
        rank[places] = _dense((rank[places] << 32) | rank[np.minimum(places + width, len(rank) - 1)])
        width *= 2
    return rank


def suffix_ranks(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """For each wanted place the number of wanted suffixes that are smaller, by at least ``depth`` bytes."""
    rank = cover_ranks(data, depth)
    head = _dense(_packed(np.append(data, np.zeros(PERIOD, np.uint8)), PERIOD)[wanted])
    kinds = [np.flatnonzero(wanted % PERIOD == r) for r in range(PERIOD)]
    smaller = np.zeros(len(wanted), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            step = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
            mine, other = ((head[k] << 32) | rank[wanted[k] + step] for k in (kinds[a], kinds[b]))
            smaller[kinds[a]] += np.searchsorted(np.sort(other), mine)
    return smaller


def repeated_suffixes(data: np.ndarray, wanted: np.ndarray, age: np.ndarray, depth: int) -> np.ndarray:
    """Which wanted suffixes share their first ``depth`` bytes with one of smaller age; ages differ."""
    order = np.argsort(suffix_ranks(data, wanted, depth), kind="stable")
    at = wanted[order]
    same = np.ones(max(len(at) - 1, 0), bool)
    words = _packed(data, 4)
    for k in (*range(0, depth - 4, 4), depth - 4):
        same &= words[at[1:] + k] == words[at[:-1] + k]
    run = np.cumsum(np.append(True, ~same)) - 1
    oldest = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(oldest, run, age[order])
    gone = np.zeros(len(wanted), bool)
    gone[order] = age[order] > oldest[run]
    return gone


def sort_block(depth: int) -> Callable[[pa.Table], pa.Table]:
    """Ranges (doc_id, text_key, start, n) of the suffixes of a block of buckets that start earlier elsewhere."""

    def run(table):
        ids = table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        keys, starts, sizes = (table.column(c).to_numpy() for c in ("text_key", "start", "n"))
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        offset = np.cumsum(sizes + depth - 1) - (sizes + depth - 1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Stretches of one document do not overlap in their suffixes, so ages differ.
        by_age = np.lexsort((starts[row] + inside, keys[row], ids[row]))
        age = np.empty(len(row), np.int64)
        age[by_age] = np.arange(len(row))
        gone = np.flatnonzero(repeated_suffixes(data, offset[row] + inside, age, depth))
        first = gone[np.flatnonzero(np.append(True, (np.diff(gone) != 1) | (np.diff(row[gone]) != 0)))] if len(gone) else gone
        n = np.diff(np.append(np.searchsorted(gone, first), len(gone)))
        held = row[first]
        return pa.table([table.column("doc_id").take(pa.array(held)), pa.array(keys[held]), pa.array(starts[held] + inside[first]), pa.array(n)], names=["doc_id", "text_key", "start", "n"])

    return run


def dealt_strings(crowded: DataFrame, depth: int) -> DataFrame:
    """``sort_block`` for buckets of any size: one row per string, dealt by its digest."""
    strings = crowded.select(*KEY, F.posexplode(F.expr(f"transform(sequence(1, int(n)), i -> unhex(sha2(substring(bytes, i, {depth}), 256)))")).alias("at", "string"), "start")
    strings = strings.select("string", F.struct(*KEY, (F.col("start") + F.col("at")).alias("start")).alias("place"))
    firsts = strings.groupBy("string").agg(F.min("place").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("string", "first")
    return strings.join(firsts, "string").where("place > first").select("place.*", F.lit(1).cast("bigint").alias("n"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def repeated(docs: DataFrame, depth: int = DEPTH, block_rows: int = BLOCK_ROWS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, text_key, start, n): ``n`` strings of ``depth`` bytes from ``start`` on also start earlier."""
    keyed = docs.where(F.octet_length("text") >= depth).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    ranges = "doc_id bigint, text_key bigint, start bigint, n bigint"
    found = stage(map_batches(keyed, find_stretches(depth), f"{ranges}, bucket bigint, whole bigint"), "stretches")
    shared = found.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1").select("bucket")
    every = stage(found.join(stage(shared, "shared-buckets"), "bucket"), "shared-stretches")  # both sides as written, so a hot bucket can be split
    discard(found)
    place = F.struct(*KEY, "start")
    distinct = every.groupBy("bucket", "whole").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.count("*").alias("copies"))
    distinct = stage(distinct, "distinct-stretches")
    later = every.join(distinct.where("copies > 1").select("bucket", "whole", "first"), ["bucket", "whole"]).where(place > F.col("first")).select(*KEY, "start", "n")

    sizes = distinct.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    listed = distinct.join(stage(sizes, "bucket-sizes"), "bucket").select("first.*", "n", "bucket", (F.col("held") > bucket_limit).alias("crowded"))
    wanted = listed.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "bucket", "crowded")).alias("stretch"))  # of one document
    pieces = keyed.join(wanted, same_document(keyed, wanted)).select(keyed["doc_id"], keyed["text_key"], F.col("text").cast("binary").alias("data"), F.explode("stretch").alias("s"))
    pieces = stage(pieces.select(*KEY, "s.*", F.expr(f"substring(data, int(s.start + 1), int(s.n + {depth - 1}))").alias("bytes")).distinct(), "pieces")
    blocks = max(1, -(-pieces.where("NOT crowded").count() // block_rows))
    sorted_ = (
        pieces.where("NOT crowded").withColumn("block", F.pmod(F.xxhash64("bucket"), F.lit(blocks)))
        .groupBy("block").applyInArrow(sort_block(depth), ranges)
    )
    return later.unionByName(sorted_).unionByName(dealt_strings(pieces.where("crowded"), depth))


def cut(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            out = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("gone").to_pylist(), strict=True):
                data, spans = text.as_py() or b"", []
                for r in ranges or []:
                    first, last = r["start"], r["start"] + r["n"] + depth - 1
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last)
                    else:
                        spans.append([first, last])
                ends = [0, *(e for s in spans for e in s), len(data)]
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["kept"].append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = {"spans": span, "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], names=["doc_id", *out]
            )

    return run


def substring_dedup(docs: DataFrame, depth: int = DEPTH, block_rows: int = BLOCK_ROWS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges) and kept (the bytes that are left)."""
    if not 2 * GRAM <= depth <= 4 * GRAM:
        raise ValueError(f"depth must be between {2 * GRAM} and {4 * GRAM}")
    gone = repeated(docs, depth, block_rows, bucket_limit).groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("gone"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    joined = keyed.join(gone, same_document(keyed, gone), "left").select(keyed["doc_id"], "text", "gone")
    return map_batches(joined, cut(depth), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(result: DataFrame) -> DataFrame:
    """The result with the kept bytes as a digest."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

