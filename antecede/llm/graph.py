"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import discard, stage

ONE_TASK_EDGES = 500_000  # 16 bytes each


def together(df: DataFrame, edges: int) -> DataFrame:
    """A graph of few edges in one partition: its groups and joins then need no exchange, which would cost far more
    than the work. Larger graphs stay dealt; the result is the same."""
    return df.coalesce(1) if edges <= ONE_TASK_EDGES else df


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the (u, v) edges; the component is its smallest node.

    Large and small stars take turns: every node hangs its larger (then all its smaller) neighbours on
    its smallest one, until nothing changes; the number of rounds grows with the logarithm of the
    number of nodes. Each round is a minimum per node, combined on the map side, and a
    shuffled join that adaptive execution can split, so a node with very many neighbours is no
    bottleneck. Rounds are written tables, so a lost executor costs no long lineage.
    """
    current = stage(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges",
    )
    before = _measure(current)
    while before[0]:
        edges = together(current, before[0])
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(smallest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps its link to the smallest of its neighbours
        large = together(large.unionByName(smallest.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))), before[0]).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        older, current = current, stage(together(small, before[0]).distinct(), "edges")
        discard(older)
        after = _measure(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
