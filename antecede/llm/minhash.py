"""Near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidate edges.

A document's set holds its distinct word shingles as 64-bit hashes. One permutation deals a set into
``BANDS * ROWS`` bins, the smallest hash of each bin is the sketch; empty bins borrow from a full
bin found by a universal probe sequence (optimal densification). Every ``ROWS`` bins make a bucket key.

Documents with equal sets are one node, named by its smallest doc_id, so groups of copies never
multiply. In a bucket the member with the most company in all its buckets is the centre of a star (the text that a family of near
copies was made from, if it is there) and only pairs (member, centre) become candidates. A centre that has met all others leaves the bucket; a bucket whose members
are all in one component is settled. What is left are documents that share a bucket but no component: loose families, and texts that
only have a frequent passage in common. Their buckets are dealt anew by an exact filter: of two sets that reach the similarity, the
rarest shingles of both, as many as one may lack and one more, have one in common. So these shingles are the new buckets, and a
passage that a third of all documents hold is in none of them. A pair counts where its first common one stands: from the places of
a shingle in both sets follows how many more they can share. They get centres in the same way, ``SLOTS`` times as many each
round, until every bucket is settled; so no pair that could join two components goes untested.

Buckets hold ids, sizes and components only. Pairs are made of ids, and a pair that several buckets make is one before anything is
looked up for it. From the second round on an exact bound then drops hopeless pairs: 2048 bits per set, kept once per node, show
hashes that the other set cannot hold. Every candidate is confirmed by the intersection of the full sets. With 52 bands of 5 bins a link of similarity 0.8 shares
no bucket with probability (1 - 0.8**5)**52, about 1e-9; that is the only way to lose one.

Defined cases: null and empty texts have an empty set and link with nothing; fewer words than a shingle
make one shingle of the whole sequence; rows with one doc_id count as one document; a null doc_id is not linked,
its component is null and it is kept; long texts give whole sets; equal sets are one node, named by its smallest doc_id; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import discard, map_batches, stage
from antecede.llm.graph import components, together
from antecede.llm.tokens import Slice, mix, slices, words

BANDS, ROWS, BITS, SLOTS = 52, 5, 2048, 8
PERCENT = 80
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(piece: Slice, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a slice."""
    found = words(piece)
    rolled = found.hash.copy()
    for k in range(1, size):
        rolled = mix(rolled[:-1] * _STEP + (found.hash[k:] ^ (found.hash[k:] >> np.uint64(31))))
    sets = []
    for first, last in zip(found.bounds, found.bounds[1:]):
        if last - first >= size:
            sets.append(np.unique(rolled[first : last - size + 1]))
        elif last > first:  # the whole short sequence, marked by its length
            one = np.array([last - first], np.uint64)
            for k in range(first, last):
                one = mix(one * _STEP + found.hash[k : k + 1])
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketch(own: np.ndarray, bins: int, probes: list[np.ndarray]) -> np.ndarray:
    """Smallest hash per bin of a sorted set; ``probes`` is grown as far as it is needed."""
    place = ((own >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    at = place[first].astype(np.int64)
    out[at], full[at] = own[first], True
    empty, k = np.flatnonzero(~full), 0
    while len(empty):
        if k == len(probes):
            bin_and_try = (np.arange(bins, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(64 * k, 64 * k + 64, dtype=np.uint64)
            probes.append((mix(bin_and_try + _STEP) % np.uint64(bins)).astype(np.int64))
        hit = full[probes[k][empty]]
        found = hit.any(axis=1)
        lender = probes[k][empty[found], hit[found].argmax(axis=1)]
        out[empty[found]] = out[lender]
        empty, k = empty[~found], k + 1
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) bucket keys."""
    cells = sketches.reshape(len(sketches), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), cells.shape[:2])
    for r in range(rows):
        keys = mix(keys * _STEP + cells[:, :, r])
    return keys


def fingerprint(own: np.ndarray) -> np.ndarray:
    """``BITS`` bits, one set for every residue of the hashes, as 64-bit words."""
    marked = np.zeros(BITS, np.uint8)
    marked[(own % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(marked).view(np.int64)


def lacking(a: str, b: str) -> str:
    """SQL: a lower bound of the number of hashes of set ``a`` that set ``b`` lacks, from their bits."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x & ~y)), 0, (t, c) -> t + c)"


def reachable(percent: int) -> Column:
    """False only if the sets of a node and a centre cannot reach the similarity."""
    shared = F.least(
        F.col("n") - F.expr(lacking("bits", "centre_bits")), F.col("centre_n") - F.expr(lacking("centre_bits", "bits"))
    )
    return F.lit(100) * shared >= F.lit(percent) * (F.col("n") + F.col("centre_n") - shared)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, high, low, keys, bits): set size, 128-bit digest of the set, bucket keys, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: list[np.ndarray] = []
        for batch in batches:
            for piece in slices(batch.column(1)):
                sets = shingle_sets(piece, size)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = np.zeros((0, bands), np.uint64)
                if full:
                    keys = band_keys(np.stack([sketch(sets[k], bands * rows, probes) for k in full]), bands, rows)
                per_doc: list = [None] * len(sets)
                for k, own in zip(full, keys.view(np.int64)):
                    per_doc[k] = own
                digest = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()),
                        pa.array(per_doc, pa.list_(pa.int64())),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "high", "low", "keys", "bits"],
                )

    return map_batches(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_shingles bigint, high bigint, low bigint, keys array<bigint>, bits array<bigint>"
    )


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, members) with the sorted hashes of each set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                sets = shingle_sets(piece, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "members"],
                )

    return map_batches(docs.select("node", "text"), run, "node bigint, members binary")


def rare_buckets(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, component, weight, bucket, place): the nodes under each of their rarest shingles that another one of them holds too.

    ``place`` is the shingle's rank in the node's whole set.

    Rarity is counted among these nodes; ties go by the shingle, so the order is the same for all.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(own) if own else node)], ["node", "shingle"])

    own = sets.join(nodes.select("node"), "node").select("node", "members")
    held = stage(map_batches(own, spread, "node bigint, shingle bigint"), "shingles")
    shared = stage(held.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"), "shared-shingles")
    placed = held.join(shared, "shingle", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "shingle"))
    )
    known = nodes.join(placed.where("often IS NOT NULL").select("node", "place", F.col("shingle").alias("bucket")), "node")
    return known.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs whose sets can reach the similarity by their sizes and bits, which are looked up for distinct pairs only."""
    known = nodes.select("node", "n", "bits")
    both = pairs.join(known.toDF("u", "n", "bits"), "u").join(known.toDF("v", "centre_n", "centre_bits"), "v")
    return both.where(reachable(percent)).select("u", "v")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs whose full sets reach the similarity.

    Each side is attached by a shuffled join on the node, which adaptive execution splits where a centre has very many
    members.
    """
    whole = pairs
    for end in ("u", "v"):
        whole = whole.join(sets.select(F.col("node").alias(end), F.col("members").alias(f"members_{end}")), end)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (batch.column(c) for c in ("u", "v", "members_u", "members_v"))
            kept = pa.array(
                [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(a, b)],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays([u.filter(kept), v.filter(kept)], ["u", "v"])

    whole = whole.select("u", "v", "members_u", "members_v")
    return map_batches(whole, exact, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    sketched = stage(sketches(docs, size, bands, rows), "sketches")
    same_set = ["high", "low"]
    nodes = stage(
        sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*same_set).agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits")),
        "nodes",
    )
    entries = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    open_ = stage(entries.join(stage(shared, "shared-buckets"), "bucket").withColumn("component", F.col("node")), "shared-entries")
    weights = open_.groupBy("node").agg(F.sum("members").alias("weight"))
    open_ = stage(open_.drop("members").join(stage(weights, "weights"), "node").withColumn("place", F.lit(0)), "buckets")
    belongs = None  # (node, component) of nodes with links
    wanted = open_.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(wanted, "node")
    sets = stage(full_sets(texts, size), "sets")
    round_ = 0
    while True:
        # Centres: the node of most weight in each of SLOTS**round slots of a bucket.
        slots = SLOTS**round_
        slot = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(slots))
        centres = open_.groupBy("bucket", slot.alias("slot")).agg(
            F.max(F.struct("weight", "node", "n", "component", "place")).alias("c")
        ).select("bucket", "c.*")
        centres = centres.toDF("bucket", *[f"centre_{c}" for c in centres.columns[1:]])
        rest = F.least(F.col("n") - F.col("place"), F.col("centre_n") - F.col("centre_place"))
        pairs = (
            open_.join(centres, "bucket")
            .where(
                (F.col("component") != F.col("centre_component"))
                & (F.lit(100) * F.least("n", "centre_n") >= F.lit(percent) * F.greatest("n", "centre_n"))
                & ((F.lit(100 + percent) * (rest + 1) >= F.lit(percent) * (F.col("n") + F.col("centre_n"))) if round_ else F.lit(True))
            )
            .select(F.greatest("node", "centre_node").alias("u"), F.least("node", "centre_node").alias("v")).distinct()
        )
        if round_:
            pairs = bounded(stage(pairs, "pairs"), nodes, percent)
        pairs = stage(pairs, "candidates")
        links = stage(confirmed(pairs, sets, percent), "links")
        left = open_.join(centres.select("bucket", F.col("centre_node").alias("node")), ["bucket", "node"], "left_anti").drop("component")
        if belongs is None:
            belongs = stage(components(links), "components")
        else:
            belongs = stage(merged(belongs, links), "components")
        left = left.join(belongs, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = left.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") != F.col("b"))
        left = left.join(mixed.select("bucket"), "bucket")
        if not round_:
            left = rare_buckets(stage(left.select("node", "n", "component", "weight").distinct(), "unsettled"), sets, percent)
            mixed = left.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") != F.col("b"))
            left = left.join(mixed.select("bucket"), "bucket")
        older, open_ = open_, stage(left, "buckets")
        for used in (older, pairs):
            discard(used)
        if open_.isEmpty():
            break
        round_ += 1
    named = nodes.select(*same_set, "node").join(belongs, "node", "left").select(
        *same_set, F.coalesce("component", "node").alias("component")
    )
    empty = F.col("component").isNull() | F.col("doc_id").isNull()
    return sketched.drop("keys", "bits").join(named, same_set, "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        (empty | F.col("doc_id").eqNullSafe(F.col("component"))).alias("kept"),
    )


def merged(belongs: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links; only whole components are joined, not their members."""
    size = belongs.count() + links.count()
    belongs, joined = together(belongs, size), together(links, size)
    for end in ("u", "v"):
        known = belongs.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        joined = joined.join(known, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    renamed = components(joined.select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))
    renamed = together(renamed, size).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = belongs.join(renamed, belongs["component"] == renamed["old"], "left").select(
        "node", F.coalesce("new", "component").alias("component")
    )
    fresh = renamed.join(belongs, renamed["old"] == belongs["node"], "left_anti").select(
        F.col("old").alias("node"), F.col("new").alias("component")
    )
    return moved.unionByName(fresh)
