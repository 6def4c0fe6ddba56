"""Ranked lexical search: presence-mask grouping over blocks of documents.

Every document is scored against every item of a benchmark, and the best ``k`` of each item come back. Documents are first
reduced to the terms that any item has (term, count) and staged; document counts and lengths come from that table, so they
cover all documents. Then a task takes its documents in blocks of ``BLOCK``. A block keeps one bitmap of documents per term.
For an item the bitmaps of its terms are turned around, which gives each document its mask of matched terms; documents with
equal masks form a group. The most that a group can score is the sum, over the terms of its mask, of the largest
contribution of that term in the block. Groups are scored in descending order of that bound until ``k`` documents of the
task score more than what is left could. So common words, which match nearly every document, cost bit operations only.

A task keeps ``k`` documents per item and nothing else, so what is shuffled is items x k rows per task; the best of all
tasks are found in two steps, the first dealt over ``SLICES``. Items are taken in parts of at most ``PART_BYTES`` of text
(equal texts once), so that what the driver and the workers hold of the benchmark is bounded; each part is one pass.

Defined cases: a text that is null, empty or without terms is no document of the counts and is never returned; an item
without terms returns nothing; very long texts are whole documents like others; rows equal in doc_id and text are
documents of their own, each with a rank; equal scores go by ascending doc_id, null first; items equal in item_id and text
are one item, items equal in item_id alone are ranked each; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import map_batches, stage

#: Digits, letters A-Z and every character beyond ASCII; in UTF-8 the latter are bytes from 0x80 on.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK, TOGETHER, SLICES = 4096, 64, 64
PART_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id and sorts like one


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # bytes.lower() changes A-Z only


def matches(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents as (doc_id, n, terms, counts): the length in terms, and the terms of the vocabulary with their counts."""

    def run(batches):
        for batch in batches:
            ids, lengths, found, counts, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = terms(text.as_py() or b"")
                if not words:
                    continue
                seen = Counter(map(vocabulary.get, words))
                seen.pop(None, None)
                ids.append(doc_id)
                lengths.append(len(words))
                found.extend(seen.keys())
                counts.extend(seen.values())
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


class Block:
    """Postings and bitmaps of up to ``BLOCK`` documents."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, gain: np.ndarray):
        order = np.argsort(term, kind="stable")
        term, self.doc, self.gain, self.ids = term[order], owner[order], gain[order], ids
        self.terms, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.most = np.maximum.reduceat(self.gain, self.first) if len(term) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(self.terms)), self.last - self.first)
        self.width = -(-len(ids) // 8)
        cell, at = np.unique(row * self.width + self.doc // 8, return_index=True)  # postings are in this order already
        self.bits = np.zeros((len(self.terms), self.width), np.uint8)
        if len(cell):
            self.bits.reshape(-1)[cell] = np.add.reduceat((128 >> (self.doc % 8)).astype(np.uint8), at)

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted terms that occur in this block."""
        at = np.searchsorted(self.terms, wanted)
        return at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)] if len(self.terms) else at[:0]

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group number of each document and the presence of each term in each group."""
        present = np.unpackbits(self.bits[rows], axis=1, count=len(self.ids))
        masks = np.packbits(present, axis=0)
        masks = np.ascontiguousarray(np.pad(masks, ((0, -len(masks) % 8), (0, 0))).T).view(np.uint64)
        group = np.zeros(len(self.ids), np.int64)
        for word in masks.T:  # a further 64 terms each; numbers stay below the square of the block size
            code = np.unique(word, return_inverse=True)[1]
            group = np.unique(group * len(self.ids) + code, return_inverse=True)[1]
        sample = np.unique(group, return_index=True)[1]
        return group, present[:, sample]

    def score(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for row in rows:
            held = self.doc[self.first[row] : self.last[row]]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            total += np.where(held[at] == docs, self.gain[self.first[row] + at], 0)
        return total

    def best(self, wanted: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of this block and those given, highest first, equal scores by id."""
        rows = self.rows(wanted)
        if not len(rows):
            return scores, ids
        floor = scores[k - 1] if len(scores) == k else 0
        if self.most[rows].sum() < max(floor, 1):
            return scores, ids
        group, present = self.groups(rows)
        bound = self.most[rows] @ present.astype(np.int64)
        members, sizes = np.argsort(group, kind="stable"), np.bincount(group)
        start = np.cumsum(sizes) - sizes
        order = np.argsort(-bound, kind="stable")
        place = 0
        while place < len(order) and bound[order[place]] >= max(floor, 1):
            docs = []
            while place < len(order) and bound[order[place]] >= max(floor, 1) and sum(map(len, docs)) < TOGETHER:
                docs.append(members[start[order[place]] :][: sizes[order[place]]])
                place += 1
            docs = np.sort(np.concatenate(docs))
            scores, ids = np.append(scores, self.score(rows, docs)), np.append(ids, self.ids[docs])
            keep = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[keep], ids[keep]
            floor = scores[k - 1] if len(scores) == k else 0
        return scores[scores > 0], ids[scores > 0]


def search(items: list[np.ndarray], weight: np.ndarray, documents: int, length: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` documents of the task for each item, as (item, doc_id, score)."""

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids = piece.column("doc_id").fill_null(int(NO_ID)).to_numpy()
                n, listed = piece.column("n").to_numpy(), piece.column("terms")
                owner = np.repeat(np.arange(len(ids)), listed.value_lengths().to_numpy())
                tf = piece.column("counts").flatten().to_numpy()
                m = 10 + 90 * n * documents // length
                term = listed.flatten().to_numpy()
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
                block = Block(ids, owner, term, gain)
                best = [block.best(wanted, k, *kept) for wanted, kept in zip(items, best, strict=True)]
        ids = np.concatenate([x for _, x in best]) if items else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x, _ in best])), pa.array(ids, mask=ids == NO_ID),
             pa.array(np.concatenate([x for x, _ in best]) if items else ids)],
            names=["item", "doc_id", "score"],
        )

    return run


def _one_part(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(item, rank, doc_id, score) for the texts of one part, item being the place in the list."""
    vocabulary: dict[bytes, int] = {}
    items = [np.unique(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms(text.encode())], np.int32)) for text in texts]
    found = stage(map_batches(docs.select("doc_id", "text"), matches(vocabulary), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"), "matches")
    documents, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row per term of the part
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    best = map_batches(found, search(items, weight, documents, max(length, 1), k), "item int, doc_id bigint, score bigint")
    first = Window.partitionBy("item", "slice").orderBy(F.desc("score"), "doc_id")
    last = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return (
        best.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
        .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        .select("item", "rank", "doc_id", "score")
    )


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.select("text").distinct().agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    dealt = stage(items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts))), "items")
    result = None
    for part in range(parts):
        texts = sorted(t for (t,) in dealt.where(F.col("part") == part).select("text").distinct().collect())  # about part_bytes
        ranked = _one_part(docs, texts, k)
        names = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
        ranked = ranked.join(F.broadcast(names), "item").join(dealt.where(F.col("part") == part), "text").select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.union(ranked)
    return result
