"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the benchmark, not the corpus. An item has a question (all but its last sentence) and an answer (the last
sentence, or the last fifth of the words of a single sentence). The question is cut into segments of at most ``SEGMENT`` words;
a posting carries its BM25 share: the term's BM25 weight in the segment over the weight of all the segment's terms, so one
threshold fits short and long items. Postings lie in blocks with their largest share. The answer is no segment: it may stand
far from its question, and one of a common word would retrieve its item from nearly every document; verification needs
both, so an item whose question is not retrieved would not be kept.

A document is cut into overlapping passages of ``PASSAGE`` words. In each segment the terms with the longest posting lists are set
apart as common, as many as together stay below ``0.7 * THRESHOLD``; what they can add is known beforehand, so the key postings
that are left show for all passages of a slice at once which of them can reach the threshold somewhere. These run block-max WAND: cursors sorted by segment, the pivot where the list maxima reach the
threshold, a look at the block maxima before any posting is read, skips past blocks that cannot reach it. Every segment
at or above the threshold is retrieved; there is no top-k. An item of which any segment is retrieved is then verified against the
whole document: the shares of the word shingles of its question and of its answer must both be at least ``OVERLAP``.

Documents are looked through first for the
rarest shingles of each question, as many that a question without any of them cannot reach ``OVERLAP``; only documents that hold one are
searched. This leaves out nothing that verification would keep.

The benchmark is dealt into parts of about ``PART_BYTES`` of text by the hash of the row and its place, so repeated rows spread. The number
of segments, their mean length and the document frequencies are counted over the whole benchmark, so the number of parts
changes no result. Executors build the index of each part and write it below ``spark.checkpoint.dir``; one finished part at a time passes
through the driver to be broadcast, so what is broadcast has a fixed bound and a large benchmark means more passes. Documents are
never shuffled.

Words are runs of letters or of digits with A-Z made small; signs do not count. Defined cases: null and empty texts
match nothing, long ones are searched whole; items without words are never found; repeated items each match, items that tie in score
are all retrieved (there is no top-k), rows with equal doc_id are looked at each; without documents or without items nothing is found and
every document stays; extra columns pass through.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import map_batches, stage
from antecede.llm.tokens import CLASSES, mix, slices, words

SEGMENT, PASSAGE, SHINGLE = 64, 128, 5
THRESHOLD, OVERLAP = 0.7, 0.8
K1, B = 1.2, 0.75
POSTINGS_PER_BLOCK, PART_BYTES = 32, 8 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


class Index(NamedTuple):
    """``terms`` sorted; postings of term t are ``at[t]:at[t+1]`` of ``segments`` (ascending) and ``shares``;
    ``best`` is the largest share of a term and ``block_best`` of a block of its postings."""

    terms: np.ndarray
    at: np.ndarray
    segments: np.ndarray
    shares: np.ndarray
    best: np.ndarray
    block_best: list
    items: np.ndarray  # item row of each segment
    ids: list
    questions: list
    answers: list
    common: np.ndarray  # most that its common terms add to each segment
    key_at: np.ndarray  # the postings that are not common in their segment, as ``at``, ``segments`` and ``shares``
    key_segments: np.ndarray
    key_shares: np.ndarray
    rare: dict  # per shingle size the sorted hashes of the rarest shingles of the questions
    least: float  # question overlap that ``rare`` was made for


class Counts(NamedTuple):
    """Segments of a benchmark, their mean length, and in how many each of the sorted ``terms`` occurs."""

    segments: int
    average: float
    terms: np.ndarray
    often: np.ndarray


def rolled(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word."""
    out = hashed[: len(hashed) - size + 1].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(hashed) - size + 1 + k])
    return out


def shingles(hashed: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles; of the whole sequence if it is shorter."""
    return np.unique(rolled(hashed, max(1, min(size, len(hashed)))))


def rarest(questions: list[np.ndarray], least: float) -> dict[int, np.ndarray]:
    """Per shingle size the rarest shingles of each question, so many that one is in any text with overlap ``least``."""
    by_size: dict[int, list] = {}
    for question in questions:
        if len(question):
            by_size.setdefault(min(SHINGLE, len(question)), []).append(shingles(question))
    out = {}
    for size, sets in by_size.items():
        values, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        chosen = []
        for own in np.split(place, np.cumsum([len(x) for x in sets])[:-1]):
            needed = next((c for c in range(1, len(own) + 1) if c / len(own) >= least), len(own))
            chosen.append(own[np.argsort(often[own], kind="stable")][: len(own) - needed + 1])
        out[size] = values[np.unique(np.concatenate(chosen))]
    return out


def promising(index: Index, hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each document of a slice holds a rare shingle of a question, without which nothing of it is verified."""
    out = np.zeros(len(bounds) - 1, bool)
    for size, values in index.rare.items():
        if len(hashed) < size:
            continue
        found = rolled(hashed, size)
        at = np.flatnonzero(values[np.minimum(np.searchsorted(values, found), len(values) - 1)] == found)
        doc = np.searchsorted(bounds, at, "right") - 1
        out[doc[at + size <= bounds[doc + 1]]] = True
    return out


def text_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashes of its words, and for each whether a sentence ends after it."""
    for piece in slices(pa.array(texts, pa.large_string())):
        found = words(piece, CLASSES)
        ends = np.concatenate([[0], np.cumsum(_ENDS[piece.data])])
        for first, last in zip(found.bounds, found.bounds[1:]):
            own = np.flatnonzero(found.kind[first:last] < 3) + first
            after = np.zeros(len(own), bool)
            after[:-1] = ends[found.start[own[1:]]] > ends[found.end[own[:-1]]]
            yield found.hash[own], after


def parts_of(hashed: np.ndarray, after: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Question and answer of an item, and (terms, counts) of the segments of the question."""
    cuts = np.flatnonzero(after)
    split = int(cuts[-1]) + 1 if len(cuts) else len(hashed) - max(1, len(hashed) // 5)
    question, answer = hashed[:split] if split > 0 else hashed, hashed[max(split, 0) :]
    own = np.array_split(question, max(1, math.ceil(len(question) / segment)))
    return question, answer, [np.unique(part, return_counts=True) for part in own if len(part)]


def build(ids: list, texts: list[str | None], segment: int = SEGMENT, limit: float = 0.7 * THRESHOLD, least: float = OVERLAP, whole: Counts | None = None) -> Index:
    """Index of the items; common terms alone give every segment less than ``limit``, verified questions have at least ``least``.

    ``whole`` has the counts of the benchmark that the items are a part of; without it they are all of it.
    """
    items, bags, questions, answers = [], [], [], []
    for row, (hashed, after) in enumerate(text_words(texts)):
        question, answer, own = parts_of(hashed, after, segment)
        questions.append(question)
        answers.append(answer)
        items += [row] * len(own)
        bags += own
    count = len(bags)
    sizes = np.array([c.sum() for _, c in bags], float)
    term = np.concatenate([t for t, _ in bags]) if count else np.zeros(0, np.uint64)
    often = np.concatenate([c for _, c in bags]).astype(float) if count else np.zeros(0)
    where = np.repeat(np.arange(count), [len(t) for t, _ in bags])
    terms, place, df = np.unique(term, return_inverse=True, return_counts=True)
    average, total = sizes.mean() if count else 1.0, count
    if whole is not None:
        average, total, df = whole.average, whole.segments, whole.often[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    weight = idf[place] * often * (K1 + 1) / (often + K1 * (1 - B + B * sizes[where] / average))
    share = weight / np.bincount(where, weight, count)[where] if count else weight
    order = np.lexsort((where, place))
    at = np.searchsorted(place[order], np.arange(len(terms) + 1))
    shares, segments = share[order], where[order]
    best = np.maximum.reduceat(shares, at[:-1]) if len(terms) else shares
    blocks = [np.maximum.reduceat(shares[a:b], np.arange(0, b - a, POSTINGS_PER_BLOCK)) for a, b in zip(at, at[1:])]
    # Per segment the terms with the longest lists are common, as long as they stay below the limit together.
    length = np.repeat(np.diff(at), np.diff(at))
    by_segment = np.lexsort((-length, segments))
    running = np.cumsum(shares[by_segment])
    opens = np.searchsorted(segments[by_segment], np.arange(count))
    before = np.append(0.0, running)[opens]
    key = np.zeros(len(shares), bool)
    key[by_segment] = running - before[segments[by_segment]] >= limit
    common = np.bincount(segments[~key], shares[~key], count)
    key_at = np.append(0, np.cumsum(key))[at]
    return Index(
        terms, at, segments, shares, best, blocks, np.array(items, np.int64), ids, questions, answers, common, key_at, segments[key], shares[key],
        rarest(questions, least), least,
    )


def block_max_wand(index: Index, query: np.ndarray, threshold: float, segments: list[int] | None = None) -> list[tuple[int, float]]:
    """(segment, score) of every segment whose score reaches the threshold; ``query`` are places of terms.

    ``segments`` are those of the index as a list, for callers with many queries: cursors move by a few postings at a
    time, and bisecting a list costs a tenth of searching an array.
    """
    lists = []  # [cursor, first posting, end, largest share, block maxima]
    for t in query:
        lists.append([int(index.at[t]), int(index.at[t]), int(index.at[t + 1]), float(index.best[t]), index.block_best[t]])
    seg, out = segments or index.segments.tolist(), []

    def seek(x, target):
        x[0] = bisect_left(seg, target, x[0], x[2])

    while True:
        lists = sorted((x for x in lists if x[0] < x[2]), key=lambda x: seg[x[0]])
        reach, pivot = 0.0, None
        for k, x in enumerate(lists):
            reach += x[3]
            if reach >= threshold - 1e-9:
                pivot = seg[x[0]]
                break
        if pivot is None:
            return out
        while k + 1 < len(lists) and seg[lists[k + 1][0]] == pivot:
            k += 1
        inside, bound, skip = lists[: k + 1], 0.0, None
        for x in inside:  # block maxima at the pivot, without reading postings
            to = bisect_left(seg, pivot, x[0], x[2])
            if to < x[2]:
                block = (to - x[1]) // POSTINGS_PER_BLOCK
                bound += x[4][block]
                last = seg[min(x[1] + (block + 1) * POSTINGS_PER_BLOCK, x[2]) - 1]
                skip = last if skip is None else min(skip, last)
        if bound >= threshold - 1e-9:
            if seg[inside[0][0]] == pivot:
                score = math.fsum(float(index.shares[x[0]]) for x in inside)  # in any order the same
                if score >= threshold:
                    out.append((pivot, score))
                for x in inside:
                    x[0] += 1
            else:
                for x in inside:
                    seek(x, pivot)
        else:
            target = (pivot if skip is None else skip) + 1
            if k + 1 < len(lists):
                target = min(target, seg[lists[k + 1][0]])
            target = max(target, pivot + 1)
            for x in inside:
                seek(x, target)


def hopeful(index: Index, place: np.ndarray, known: np.ndarray, bounds: np.ndarray, threshold: float, passage: int):
    """(document, first word, end) of the passages of a slice whose score may reach the threshold.

    ``place`` is the term of every word where ``known``, ``bounds`` the word range of each document. Passages begin
    every half passage.
    """
    half = passage // 2
    sizes = np.diff(bounds)
    number = np.maximum(1, -(-(sizes - half) // half))
    base = np.concatenate([[0], np.cumsum(number)])
    at = np.flatnonzero(known & (np.diff(index.key_at) > 0)[place])
    doc = np.searchsorted(bounds, at, "right") - 1
    window = (at - bounds[doc]) // half
    pairs = []
    for shift in (0, 1):
        inside = (window >= shift) & (window - shift < number[doc])
        pairs.append(np.stack([(base[doc] + window - shift)[inside], place[at[inside]]]))
    if not len(at):
        return []
    own = np.unique(np.concatenate(pairs, axis=1).astype(np.int64).T @ np.array([len(index.terms), 1]))
    which, term = own // len(index.terms), own % len(index.terms)
    length = index.key_at[term + 1] - index.key_at[term]
    posting = np.repeat(index.key_at[term] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    cell, group = np.unique(np.repeat(which, length) * len(index.items) + index.key_segments[posting], return_inverse=True)
    mass = np.bincount(group, index.key_shares[posting])
    reached = mass + index.common[cell % len(index.items)] >= threshold - 1e-9
    out = np.unique(cell[reached] // len(index.items))
    owner = np.searchsorted(base, out, "right") - 1
    start = bounds[owner] + (out - base[owner]) * half
    return list(zip(owner, start, np.minimum(start + passage, bounds[owner + 1])))


def overlap(part: np.ndarray, whole: dict[int, np.ndarray], text: np.ndarray, own: np.ndarray | None = None) -> float:
    """Share of the shingles of a part that the text holds; 1 for a part without words. ``own`` has them if they are known."""
    if not len(part):
        return 1.0
    size = min(SHINGLE, len(part))
    if size not in whole:
        whole[size] = shingles(text, size) if len(text) >= size else np.zeros(0, np.uint64)
    return float(np.isin(shingles(part, size) if own is None else own, whole[size], assume_unique=True).mean())


def matches(index: Index, texts: pa.Array, threshold: float, limit: float, passage: int = PASSAGE) -> Iterator[tuple[int, int, float, float, float]]:
    """(row of the text, row of the item, score, question overlap, answer overlap) of verified items."""
    if not len(index.terms):
        return
    if limit < index.least:
        raise ValueError(f"the index was made for a question overlap of {index.least}")
    own_shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the items looked at, made once
    segments = index.segments.tolist()
    for piece in slices(texts):
        found = words(piece, CLASSES)
        own = found.kind < 3
        bounds = np.concatenate([[0], np.cumsum(own)])[found.bounds]
        hashed = found.hash[own]
        place = np.minimum(np.searchsorted(index.terms, hashed), len(index.terms) - 1)
        known = (index.terms[place] == hashed) & np.repeat(promising(index, hashed, bounds), np.diff(bounds))
        scores: dict[tuple[int, int], float] = {}
        for d, start, end in hopeful(index, place, known, bounds, threshold, passage):
            query = np.unique(place[start:end][known[start:end]])
            for segment, score in block_max_wand(index, query, threshold, segments):
                pair = (int(d), int(index.items[segment]))
                scores[pair] = max(scores.get(pair, 0.0), score)
        whole: dict = {}
        for (d, row), score in scores.items():
            text = hashed[bounds[d] : bounds[d + 1]]
            if row not in own_shingles:
                own_shingles[row] = tuple(shingles(part) if len(part) else part for part in (index.questions[row], index.answers[row]))
            question = overlap(index.questions[row], whole.setdefault(d, {}), text, own_shingles[row][0])
            answer = overlap(index.answers[row], whole[d], text, own_shingles[row][1])
            if question >= limit and answer >= limit:
                yield piece.first + d, row, score, question, answer


def parts(benchmark: DataFrame, threshold: float = THRESHOLD, part_bytes: int = PART_BYTES, limit: float = OVERLAP) -> Iterator[Index]:
    """Indexes of the parts of the benchmark, one at a time; executors build them."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, math.ceil(total / part_bytes))
    dealt = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(number)).cast("int")
    items = stage(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").withColumn("part", dealt), "benchmark")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, (hashed, after) in zip(batch.column(0).to_pylist(), text_words(batch.column(1).to_pylist())):
                rows += [(part, int(often.sum()), terms.view(np.int64)) for terms, often in parts_of(hashed, after, SEGMENT)[2]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["part", "size", "terms"])

    segments = stage(map_batches(items.select("part", "text"), cut, "part int, size bigint, terms array<bigint>"), "benchmark-segments")
    count, average = segments.agg(F.count("*"), F.avg("size")).first()
    terms = segments.select("part", F.explode("terms").alias("term"))
    often = terms.groupBy("term").agg(F.count("*").alias("often"))
    own = terms.distinct().join(often, "term").select("part", "term", "often")

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        known, df = (right.column(c).to_numpy() for c in ("term", "often"))
        order = np.argsort(known.view(np.uint64))
        whole = Counts(count, average, known.view(np.uint64)[order], df[order])
        ids, texts = left.column("item_id").to_pylist(), left.column("text").to_pylist()
        index = build(ids, texts, limit=0.7 * threshold, least=limit, whole=whole if count else None)
        return pa.table({"part": pa.array(left.column("part")[:1].to_pylist(), pa.int32()), "content": pa.array([pickle.dumps(tuple(index))], pa.binary())})

    built = stage(items.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(made, "part int, content binary"), "benchmark-index")
    for (part,) in sorted(built.select("part").collect()):
        yield Index(*pickle.loads(built.where(F.col("part") == part).first()["content"]))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document that holds an item."""
    context, out = docs.sparkSession.sparkContext, None
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    for index in parts(benchmark, threshold, part_bytes, limit):
        shared = context.broadcast(tuple(index))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.ids[r], *rest) for d, r, *rest in matches(index, batch.column(1), threshold, limit)]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        found = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    for index in parts(benchmark, threshold, part_bytes, limit):
        shared = context.broadcast(tuple(index))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(index, batch.column(at), threshold, limit)]] = False
                yield batch.filter(pa.array(clean))

        docs = map_batches(docs, keep, docs.schema)
    return docs
