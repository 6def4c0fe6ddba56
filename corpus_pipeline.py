"""Corpus pipeline: each stage reads what the one before it kept, written as Parquet.

Every stage works on all its documents and its decisions take effect: toxic documents go, repeated passages leave the
texts, one document of each near-duplicate group stays, documents that hold a benchmark item go, and the mix says
which words of which document are taken how often.

Defined cases, per stage. Toxicity: null and empty texts have no toxic token and stay; rows of one id are judged each. Line dedup: a null text
stays null; a document whose lines all stand elsewhere keeps its row with an empty text; repeated rows lose the same lines. Near
dedup: rows without words and rows without id all stay; rows of one id count as one document and stay or go together. Decontamination:
texts without words stay. Mixing: only documents the mix takes words of come back, so wordless ones do not; repeated rows are taken
each. All stages read long texts whole, give no rows for an empty table, and hand on further columns unchanged whatever their names;
where a document column has the name of one that the mix adds, the added one is called ``mix_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from antecede.llm.common import stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not call toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand elsewhere; the length column follows the text."""
    left = line_dedup.line_dedup(docs).select("row", F.col("text").alias("left"))
    changed = {"text": F.col("left"), "n_chars": F.when(F.col("left") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.char_length("left").cast("bigint"))}
    return left.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    groups = minhash.near_duplicates(docs, size=5, percent=80)
    going = groups.where(~F.col("kept")).select(F.col("doc_id").alias("going")).distinct()
    return docs.join(going, docs["doc_id"] == going["going"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the blocks of words it takes of each and how often."""
    mixed = mixing.mix(docs).where(F.col("taken") > 0)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    taken = {c.lower() for c in docs.columns}
    more = [F.col(c).alias(c if c not in taken else f"mix_{c}") for c in ("size", "source_size", "target", "taken", "blocks")]
    return mixed.select(*own, *more)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, so SQL cannot give these rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
