"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Words are runs of letters, of digits or of signs; a word that repeats its neighbour becomes one
common word, so repetition is a feature whatever is repeated. One- and two-grams are hashed into
``2**BITS`` weights; a document is a sparse vector of damped counts of length one, its score a
sparse dot product.

Fitting: at most ``FIT_ROWS`` labelled documents outside the held-out fold, in ``SHARDS`` groups of
bounded size; each group runs FTRL over its rows in the order of a hash, the driver averages the
``SHARDS`` weight vectors of fixed size. Scoring runs over every whole text.

Defined cases: a null or empty text has no feature and gets the score of the intercept; without any
labelled row every score is 0.5; rows with equal ids are scored each; of several labels of one id the largest
counts, and the rows to fit on are those of smallest hash, then id; long texts count whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import in_fold, labelled_sample, map_batches
from antecede.llm.tokens import CLASSES, Slice, mix, pairs, slices, words

BITS, FIT_ROWS, SHARDS, EPOCHS = 18, 20_000, 4, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
REPEATED = np.uint64(0x5EED)
PARTS, FOLD, THRESHOLD = 4, 2, 0.7


def features(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, weight index and value of every non-zero feature of a slice, in document order."""
    found = words(piece, CLASSES)
    count = len(piece.offsets) - 1
    doc = np.repeat(np.arange(count), np.diff(found.bounds))
    if not len(doc):
        return doc, doc, doc.astype(float)
    hashed = found.hash.copy()
    again = np.zeros(len(hashed), bool)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (doc[1:] == doc[:-1])
    hashed[again] = REPEATED
    inside = doc[1:] == doc[:-1]
    shift = np.uint64(64 - BITS)
    keys = np.concatenate([
        (doc.astype(np.uint64) << np.uint64(BITS)) | (mix(hashed) >> shift),
        ((doc[:-1].astype(np.uint64) << np.uint64(BITS)) | (pairs(hashed) >> shift))[inside],
    ])
    keys, counts = np.unique(keys, return_counts=True)
    doc = (keys >> np.uint64(BITS)).astype(np.int64)
    value = 1.0 + np.log(counts)
    norm = np.sqrt(np.bincount(doc, value * value, count))
    return doc, (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), value / norm[doc]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after the given passes; the last one is the intercept, which has no L1 penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        penalty = np.where(at == 1 << BITS, 0.0, L1)
        w = -(z[at] - np.sign(z[at]) * penalty) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > penalty, w, 0.0)

    for _ in range(epochs):
        for index, value, y in rows:
            at, x = np.append(index, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            g = (sigmoid(w @ x) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def sparse_rows(texts: pd.Series, labels: np.ndarray):
    for piece in slices(pa.array(texts, pa.large_string())):
        doc, index, value = features(piece)
        cuts = np.searchsorted(doc, np.arange(piece.last - piece.first + 1))
        for k in range(piece.last - piece.first):
            yield index[cuts[k] : cuts[k + 1]], value[cuts[k] : cuts[k + 1]], int(labels[piece.first + k])


def fit(sample: DataFrame, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged weights of ``shards`` FTRL runs over (doc_id, text, y) rows."""

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id"])
        weights = ftrl(list(sparse_rows(group["text"], group["y"].to_numpy())), epochs)
        return pd.DataFrame({"weights": [weights.tobytes()]})

    order = F.xxhash64(F.lit(7), "doc_id", "text")
    runs = (
        sample.withColumn("order", order).withColumn("shard", F.pmod("order", F.lit(shards)))
        .groupBy("shard").applyInPandas(train, "weights binary").collect()
    )
    if not runs:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.mean([np.frombuffer(r["weights"], np.float32) for r in runs], axis=0)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, float(w[-1]))
            for piece in slices(batch.column(1)):
                doc, index, value = features(piece)
                out[piece.first : piece.last] += np.bincount(doc, w[index] * value, piece.last - piece.first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(out))], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), scored, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) of every row."""
    weights = fit(labelled_sample(docs, labels, "quality", PARTS, FOLD, fit_rows))
    return score(docs, weights).select(
        "doc_id", in_fold("doc_id", PARTS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
