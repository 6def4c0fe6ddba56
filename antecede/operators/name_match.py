"""Matching written names to known people inside a block such as a team or an event.

Every rule is equality of a derived key, so matching is an equi-join. Candidates are reduced to
the first person per (block, key) before the join: however many people or mentions share a key,
a mention meets one row per key and no group of pairs is ever produced. A written name is spelled
out once per block, however many mentions write it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions.text import last_words, name_aliases, name_keys


EXACT, LAST_WORD = 0, 1


def tagged(kind: int, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def _ordered(order: Sequence[str]) -> Column:
    """Sort value of a candidate. One column stays plain, so that its minimum is a hash aggregate."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def candidate_keys(candidates: DataFrame, block: str, order: Sequence[str], name: str) -> DataFrame:
    """(block, kind, key) with the number of candidates that have it and the first of them."""
    keys = F.concat(tagged(EXACT, name_keys("aliases")), tagged(LAST_WORD, last_words("aliases")))
    return (
        candidates.select(
            F.col(block).alias("block"), _ordered(order).alias("candidate"), name_aliases(name).alias("aliases")
        )
        .select("block", "candidate", F.inline(keys))
        .groupBy("block", "kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate"))
    )


def match_names(
    mentions: DataFrame,
    candidates: DataFrame,
    mention_id: Sequence[str],
    mention_name: str,
    blocks: str,
    block: str,
    order: Sequence[str],
    name: str,
) -> DataFrame:
    """One row per mention with the matched candidate's ``order`` columns, NULL if none.

    ``blocks`` is an array column: the blocks a mention may match in. The first candidate in
    order that shares a name key wins; without one, a candidate that alone has the mention's
    last word. Candidates must be unique on (block, order).
    """
    mention_id, order = list(mention_id), list(order)
    wanted = mentions.select(
        *mention_id, F.col(mention_name).alias("_name"), F.explode_outer(F.array_distinct(blocks)).alias("_block")
    )
    spoken = F.element_at(F.split(F.get("aliases", F.lit(0)), " "), -1)
    keys = F.concat(tagged(EXACT, name_keys("aliases")), tagged(LAST_WORD, F.array(spoken)))
    written = wanted.select("_name", "_block").distinct()
    asked = written.select("_name", F.col("_block").alias("block"), name_aliases("_name").alias("aliases")).select(
        "_name", "block", F.inline(keys)
    )
    found = asked.join(candidate_keys(candidates, block, order, name), ["block", "kind", "key"])
    exact, last = F.col("kind") == EXACT, F.col("kind") == LAST_WORD
    answers = found.groupBy("_name", F.col("block").alias("_block")).agg(
        F.min(F.when(exact, F.col("candidate"))).alias("exact"),
        F.min(F.when(last, F.col("candidate"))).alias("only"),
        F.sum(F.when(last, F.col("n"))).alias("n"),
    )
    best = wanted.join(answers, ["_name", "_block"], "left").groupBy(*mention_id).agg(
        F.min("exact").alias("exact"), F.min("only").alias("only"), F.sum("n").alias("n")
    )
    chosen = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    parts = {c: F.col("found") if len(order) == 1 else F.col(f"found.{c}") for c in order}
    return best.withColumn("found", chosen).select(*mention_id, *[part.alias(c) for c, part in parts.items()])
