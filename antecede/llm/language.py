"""Language by compression: the language whose dictionary shortens a text most.

Per language a zstandard raw-content dictionary of at most ``DICTIONARY`` bytes is made from a
bounded sample of documents; each gives an equal share of bytes (``DICTIONARY / FIT_ROWS``, 327, where there are enough), read on
from a place in the text that a hash chooses, so that common openings do not fill the dictionary. A text is cut into blocks, so that the dictionary and not the text's own
past does the work however long the text is; every block is compressed with every dictionary and
the sizes are added up. Letters A-Z count as small. A text below ``SHORT`` bytes is written several
times over, since the coder stores a short block raw; only its first copy costs anything. The smallest total wins. The margin is the relative gap to the second
best; a text whose margin is below ``MARGIN`` is rejected (``accepted`` is false), its best guess is
still given.

Fitting: per language at most ``FIT_ROWS`` texts outside the held-out fold, those with the smallest
hash. Defined cases: null texts and texts without a letter give ``und`` with score 0; with no
language to learn everything is ``und``; with one language it gets score 0; a tie goes to the
language that sorts first; long texts are coded whole, in blocks; rows with equal ids are classified each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import in_fold, map_batches, remainder

DICTIONARY, BLOCK, FIT_ROWS, MARGIN = 64 << 10, 8 << 10, 200, 0.02
LEVEL, SHORTEST_MATCH, SHORT = 6, 3, 512
PARTS, FOLD = 4, 2


def dictionaries(docs: DataFrame, rows: int = FIT_ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw dictionary per language: slices of the sampled texts, an equal share of bytes each.

    The window keeps ``rows`` rows per language and is cut down on the map side before the shuffle
    (a row-number limit), so no language is gathered whole. One dictionary of bounded size per
    language comes back to the driver.
    """
    known = docs.where(
        F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0) & (remainder("doc_id", PARTS) != FOLD)
    ).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    # The text turned so that it begins at its chosen place; of that no more than a dictionary is needed.
    start = F.pmod(F.xxhash64("doc_id", "text"), F.length("text")).cast("int")
    turned = F.concat(F.substr("text", start + 1), F.lit(" "), F.substr("text", F.lit(1), start))
    ranked = known.withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    ).where(F.col("place") <= rows).withColumn("text", F.substring(turned, 1, size))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode().lower() for t in group.sort_values("place")["text"]]
        share = max(64, size // len(texts))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "content": [b" ".join(t[:share] for t in texts)[:size]]})

    made = ranked.groupBy("lang").applyInPandas(joined, "lang string, content binary")
    return {r["lang"]: bytes(r["content"]) for r in made.collect()}


def classify(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(learned.items()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in shared.value]
        coders = []
        for _, content in shared.value:
            options = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, min_match=SHORTEST_MATCH, dict_size=len(content), source_size=BLOCK,
                write_checksum=0, write_content_size=0, write_dict_id=0,
            )
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=options)
            coders.append(zstandard.ZstdCompressor(compression_params=options, dict_data=raw))
        for batch in batches:
            best, gap = [], []
            for text in batch.column(1).to_pylist():
                if not coders or not text or not any(map(str.isalpha, text)):
                    best.append("und")
                    gap.append(0.0)
                    continue
                raw = text.encode().lower()
                if len(raw) < SHORT:
                    raw = (raw + b" ") * (SHORT // (len(raw) + 1) + 1)
                blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
                first, second = (sorted(sizes) + sizes)[:2]
                best.append(names[sizes.index(first)])
                gap.append((second - first) / second)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(gap, pa.float64()),
                 pa.array([b != "und" and g >= margin for b, g in zip(best, gap)], pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), predict, "doc_id bigint, lang_pred string, score double, accepted boolean"
    )


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row, learned from the other folds."""
    return classify(docs, dictionaries(docs)).select(
        "doc_id", in_fold("doc_id", PARTS, FOLD).alias("held_out"), "lang_pred", "score", "accepted"
    )
