"""Toxic spans by a linear-chain conditional random field.

Tokens carry one of two tags, harmless or toxic. The chain runs over a sentence; a token's evidence
is a sum of hashed weights of its word, its word beginning and its neighbours, plus transition
weights between the tags. Forward and backward passes run over all sentences of a slice at once.

Labelled tokens: documents carry labels, tokens do not. A token of a toxic document is labelled
toxic if its word, or the beginning of its word, is found in at least ``SHARE`` of the toxic documents
and is ``LIFT`` times as frequent there as in the others; every other token is harmless.

A document's score comes from the probability that at least one of its tokens is toxic, which the
forward pass gives exactly, put on the scale of the labels by a logistic curve. ``spans`` are the
code point ranges of tokens whose marginal is at least one half, neighbours joined.

Fitting: at most ``FIT_ROWS`` labelled documents outside the held-out fold, in ``SHARDS`` groups of
bounded size whose parameters are averaged each round. Scoring runs over every whole text.

Defined cases: null and empty texts have no token and get the score of a document without any
evidence; without toxic labels every score is 0; rows with equal ids are scored each; of several labels of one id
the largest counts; a marginal of exactly one half is toxic; long texts are tagged whole, sentence by sentence; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import in_fold, labelled_sample, map_batches, stage
from antecede.llm.tokens import CLASSES, Slice, Words, mix, prefixes, slices, words

BITS, FIT_ROWS, SHARDS, ROUNDS, PASSES = 18, 8_000, 4, 2, 3
SHARE, LIFT, LEAST = 0.01, 20.0, 3
RATE, BEGINNINGS, MINIBATCH = 0.3, (4, 5), 16 << 10
PARTS, FOLD, THRESHOLD = 5, 0, 0.5
FLOOR = 1e-9

ENDS = np.zeros(256, bool)
ENDS[[33, 46, 63]] = True


class Model(NamedTuple):
    """Evidence weights (the last is the intercept), log transition weights, seeds of the labels,
    and slope and intercept of the logistic curve."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]


class Chains(NamedTuple):
    """Sentences of a slice, longest first: first token and length of each, and its document."""

    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray


def chains(piece: Slice, found: Words) -> Chains:
    n = len(found.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Chains(none, none, none)
    first = np.zeros(n, bool)
    first[found.bounds[:-1][found.bounds[:-1] < n]] = True
    first[1:] |= ENDS[piece.data[found.start[:-1]]]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    order = np.argsort(-size, kind="stable")
    doc = np.searchsorted(found.bounds, start, "right") - 1
    return Chains(start[order], size[order], doc[order])


def marks(piece: Slice, found: Words) -> list[np.ndarray]:
    """Hashes of the word and of its beginnings."""
    return [found.hash, *(prefixes(piece, found, length) for length in BEGINNINGS)]


def evidence_index(piece: Slice, found: Words) -> np.ndarray:
    """(tokens, 4) weight indices: word, its beginnings, word before."""
    shift = np.uint64(64 - BITS)
    before = np.zeros_like(found.hash)
    before[1:] = found.hash[:-1]
    before[found.bounds[:-1][found.bounds[:-1] < len(before)]] = 0
    views = (*marks(piece, found), before)
    return np.stack([mix(v + np.uint64(k + 1)) >> shift for k, v in enumerate(views)], axis=1).astype(np.int64)


def forward_backward(log_odds: np.ndarray, moves: np.ndarray, at: Chains):
    """Marginal of the toxic tag per token, log probability of an all-harmless sentence, expected moves.

    Tokens are laid out by their place in the sentence, longest sentences first, so that a step works on one range of
    an array. A sentence begins as if after a harmless token.
    """
    n, (t00, t01), (t10, t11) = len(log_odds), *np.exp(moves)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros((2, 2))
    longest = int(at.size[0])
    active = np.searchsorted(-at.size, -np.arange(longest), "left")  # sentences longer than the step
    offset = np.concatenate([[0], np.cumsum(active)])
    layout = np.concatenate([at.start[:k] + step for step, k in enumerate(active)])
    toxic = np.exp(np.clip(log_odds, -30, 30))[layout]
    ahead, total, back = np.empty(n), np.empty(n), np.full(n, 0.5)  # shares of the toxic tag, and scale factors
    p = np.zeros(active[0])
    for step, k in enumerate(active):
        own = slice(offset[step], offset[step] + k)
        p = p[:k]
        u1 = (t01 + (t11 - t01) * p) * toxic[own]
        whole = t00 + (t10 - t00) * p + u1
        p = u1 / whole
        ahead[own], total[own] = p, whole
    for step in range(longest - 2, -1, -1):
        k = active[step + 1]
        later = slice(offset[step + 1], offset[step + 1] + k)
        harmless, harmful = 1.0 - back[later], toxic[later] * back[later]
        u1 = t10 * harmless + t11 * harmful
        back[offset[step] : offset[step] + k] = u1 / (u1 + t00 * harmless + t01 * harmful)
    joint = ahead * back
    share = joint / (joint + (1.0 - ahead) * (1.0 - back))
    log_z = np.bincount(np.concatenate([np.arange(k) for k in active]), np.log(total), len(at.start))
    expected = np.zeros((2, 2))
    if longest > 1:
        own = np.arange(offset[1], n)
        before = np.concatenate([np.arange(k) + offset[step] for step, k in enumerate(active[1:])])
        cells = np.array([
            [(1 - ahead[before]) * t00 * (1 - back[own]), (1 - ahead[before]) * t01 * toxic[own] * back[own]],
            [ahead[before] * t10 * (1 - back[own]), ahead[before] * t11 * toxic[own] * back[own]],
        ])
        expected = (cells / cells.sum(axis=(0, 1))).sum(axis=2)
    first = share[: active[0]].sum()
    expected[0] += len(at.start) - first, first
    marginal = np.empty(n)
    marginal[layout] = share
    return marginal, at.size * moves[0, 0] - log_z, expected


def log_odds_of(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[index].sum(axis=1) + weights[-1]


def harm(piece: Slice, model: Model):
    """Tokens with their marginals, and per document minus the log probability that none is toxic."""
    found = words(piece, CLASSES)
    at = chains(piece, found)
    marginal, harmless, _ = forward_backward(log_odds_of(evidence_index(piece, found), model.weights), model.moves, at)
    return found, marginal, np.bincount(at.doc, -harmless, piece.last - piece.first)


def step(piece: Slice, labels: np.ndarray, seeds: np.ndarray, weights, moves, seen_w, seen_m) -> None:
    """One adaptive gradient step on the log likelihood of a slice, in place."""
    found = words(piece, CLASSES)
    if not len(found.start):
        return
    at, index = chains(piece, found), evidence_index(piece, found)
    tag = np.any([np.isin(h, seeds) for h in marks(piece, found)], axis=0)
    tag &= (found.kind == 1) & np.repeat(labels == 1, np.diff(found.bounds))
    marginal, _, expected = forward_backward(log_odds_of(index, weights), moves, at)
    gap = tag - marginal
    used, place = np.unique(index, return_inverse=True)
    slope = np.append(np.bincount(place.ravel(), np.repeat(gap, index.shape[1]), len(used)), gap.sum())
    used = np.append(used, len(weights) - 1)
    before = np.zeros(len(tag), np.int64)
    before[1:] = tag[:-1]
    before[at.start] = 0
    actual = np.bincount(before * 2 + tag, minlength=4).reshape(2, 2)
    seen_w[used] += slope * slope
    weights[used] += RATE * slope / (np.sqrt(seen_w[used]) + 1e-8)
    change = actual - expected
    seen_m += change * change
    moves += RATE * change / (np.sqrt(seen_m) + 1e-8)
    moves -= moves[0, 0]


def seed_words(sample: DataFrame, share: float, lift: float) -> np.ndarray:
    """Hashes of the words that mark toxic documents. Bounded by the vocabulary of the sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(0)):
                found = words(piece, CLASSES)
                y = batch.column(1).to_numpy(zero_copy_only=False)[piece.first : piece.last]
                views = np.stack(marks(piece, found))
                once = []
                for d in range(len(y)):
                    own = slice(found.bounds[d], found.bounds[d + 1])
                    once.append(np.unique(views[:, own][:, found.kind[own] == 1]))
                word, at = np.unique(np.concatenate(once), return_inverse=True)
                toxic = np.bincount(at, np.repeat(y, [len(o) for o in once]), len(word))
                both = np.bincount(at, minlength=len(word))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((both - toxic).astype(np.int64))],
                    ["word", "toxic", "other"],
                )

    toxic, rows = sample.agg(F.sum("y"), F.count("*")).first()
    if not toxic:
        return np.zeros(0, np.uint64)
    other = max(1, rows - toxic)
    counts = map_batches(sample.select("text", "y"), counted, "word bigint, toxic bigint, other bigint")
    totals = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = totals.where(
        (F.col("toxic") >= max(LEAST, share * toxic))
        & ((F.col("toxic") + 0.5) / toxic >= lift * (F.col("other") + 0.5) / other)
    )
    return np.array([r["word"] for r in found.select("word").collect()], np.int64).view(np.uint64)


def fit(sample: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, passes: int = PASSES) -> Model:
    """Model from (doc_id, text, y) rows of bounded number."""
    size = (1 << BITS) + 1
    sample = stage(
        sample.withColumn("order", F.xxhash64(F.lit(11), "doc_id", "text")).withColumn("shard", F.pmod("order", F.lit(shards))),
        "toxicity-sample",
    )
    weights, moves = np.zeros(size), np.zeros((2, 2))
    weights[-1] = -4.0
    seeds = seed_words(sample, SHARE, LIFT)
    if not len(seeds):
        return Model(weights.astype(np.float32), moves, (0.0, -35.0))
    context = sample.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((weights, moves))

        def train(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["order", "doc_id"])
            w, m, y = shared.value[0].copy(), shared.value[1].copy(), group["y"].to_numpy()
            seen_w, seen_m = np.full(size, 1e-2), np.full((2, 2), 1.0)
            texts = pa.array(group["text"], pa.large_string())
            for _ in range(passes):
                for piece in slices(texts, size=MINIBATCH):
                    step(piece, y[piece.first : piece.last], seeds, w, m, seen_w, seen_m)
            return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "m": [m.tobytes()]})

        runs = sample.groupBy("shard").applyInPandas(train, "w binary, m binary").collect()
        weights = np.mean([np.frombuffer(r["w"], np.float32).astype(float) for r in runs], axis=0)
        moves = np.mean([np.frombuffer(r["m"], float).reshape(2, 2) for r in runs], axis=0)
    model = Model(weights.astype(np.float32), moves, (1.0, 0.0))
    points = sample.select(F.col("y").cast("bigint").alias("doc_id"), "text")
    known = np.array(tag(points, model, raw=True).select("doc_id", "score").collect(), float).reshape(-1, 2)
    return model._replace(curve=logistic(np.log(known[:, 1] + FLOOR), known[:, 0]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly penalised logistic curve, by Newton steps."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta += np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * beta)
    return max(float(beta[0]), 0.0), float(beta[1])


def calibrated(against: np.ndarray, model: Model) -> np.ndarray:
    slope, level = model.curve
    return 1 / (1 + np.exp(-np.clip(slope * np.log(np.maximum(against, 0.0) + FLOOR) + level, -35, 35)))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def spans_of(piece: Slice, found: Words, marginal: np.ndarray, d: int) -> list[dict]:
    """Joined code point ranges of the toxic tokens of document d of a slice."""
    at = np.arange(found.bounds[d], found.bounds[d + 1])
    at = at[marginal[at] >= 0.5]
    if not len(at):
        return []
    begin = piece.offsets[d]
    points = np.cumsum((piece.data[begin : piece.offsets[d + 1]] & 0xC0) != 0x80)
    out = []
    for k in at:
        start, end = int(points[found.start[k] - begin]) - 1, int(points[found.end[k] - begin - 1])
        if out and out[-1]["last"] == k - 1:
            out[-1] |= {"end": end, "score": max(out[-1]["score"], float(marginal[k])), "last": k}
        else:
            out.append({"start": start, "end": end, "score": float(marginal[k]), "last": k})
    return [{n: s[n] for n in ("start", "end", "score")} for s in out]


def tag(docs: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """(doc_id, score, spans) of every row; ``raw`` gives the evidence before the logistic curve."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), []  # the evidence at first
            for piece in slices(batch.column(1)):
                found, marginal, against = harm(piece, model)
                scores[piece.first : piece.last] = np.maximum(against, 0.0)
                suspect = np.zeros(piece.last - piece.first, bool)
                suspect[np.searchsorted(found.bounds, np.flatnonzero(marginal >= 0.5), "right") - 1] = True
                spans += [spans_of(piece, found, marginal, d) if s else [] for d, s in enumerate(suspect)]
            if not raw:
                scores = calibrated(scores, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    return map_batches(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), tagged, "doc_id bigint, score double, spans array<struct<start:bigint,end:bigint,score:double>>"
    )


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and spans of every row."""
    model = fit(labelled_sample(docs, labels, "toxic", PARTS, FOLD, fit_rows))
    return tag(docs, model).select(
        "doc_id", in_fold("doc_id", PARTS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they were; nothing is shuffled."""
    model = fit(labelled_sample(docs, labels, "toxic", PARTS, FOLD, fit_rows))
    shared, at = docs.sparkSession.sparkContext.broadcast(tuple(model)), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for piece in slices(batch.column(at)):
                scores[piece.first : piece.last] = calibrated(harm(piece, model)[2], model)
            yield batch.filter(pa.array(scores < threshold))

    return map_batches(docs, keep, docs.schema)
