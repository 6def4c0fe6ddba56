"""Exact, linearly interpolated quantiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which a large
continuous column outgrows. Here distinct values are counted first, a small sketch only picks
block borders, block totals are prefix-summed (one row per block) and just the blocks holding a
wanted rank are ordered. The sketch decides how work is split, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.session import stage

BLOCKS = 64
SKETCH_ACCURACY = 1000


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Occurrences of each distinct non-null value per group."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def block_counts(counts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Assigns ordered blocks to counted values and returns (values, block starts).

    ``starts`` has one row per group and block: ``below`` is the number of observations in
    lower blocks, ``total`` the size of the group.

    The borders are written: a sketch of many values depends on the order in which its parts arrive, and both results must
    be cut at the same ones.
    """
    borders = counts.groupBy(*by).agg(
        F.percentile_approx(
            "value",
            F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)]),
            F.lit(SKETCH_ACCURACY),
        ).alias("borders")
    )
    borders = stage(borders, "borders")
    joined = counts.join(borders, list(by)) if by else counts.crossJoin(borders)
    blocked = joined.withColumn(
        "block", F.expr("size(filter(borders, b -> b < value))")
    ).drop("borders")
    per_group = Window.partitionBy(*by)
    starts = (
        blocked.groupBy(*by, "block")
        .agg(F.sum("n").alias("block_n"))
        .select(
            *by,
            "block",
            F.coalesce(
                F.sum("block_n").over(
                    per_group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("below"),
            F.sum("block_n").over(per_group).alias("total"),
            "block_n",
        )
    )
    return blocked, starts


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """One row per group with ``quantiles``: an array in the order of ``probabilities``."""
    by = list(by)
    blocked, starts = block_counts(value_counts(df, by, value), by)
    wanted = starts.withColumn(
        "wanted",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("slot"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at"))
                    for i, p in enumerate(probabilities)
                ]
            )
        ),
    ).select(
        *by,
        "block",
        "below",
        "block_n",
        F.col("wanted.slot").alias("slot"),
        F.col("wanted.at").alias("at"),
        F.explode(F.array(F.floor("wanted.at"), F.ceil("wanted.at"))).alias("rank"),
    )
    wanted = (
        wanted.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("block_n")))
        .groupBy(*by, "block", "below")
        .agg(F.collect_set(F.struct("slot", "at", "rank")).alias("ranks"))
    )
    inside = Window.partitionBy(*by, "block").orderBy("value")
    ranked = blocked.join(wanted, [*by, "block"]).withColumn(
        "upto", F.col("below") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    hits = ranked.select(*by, "value", "n", "upto", F.explode("ranks").alias("r")).where(
        (F.col("r.rank") < F.col("upto")) & (F.col("r.rank") >= F.col("upto") - F.col("n"))
    )
    per_slot = hits.groupBy(*by, F.col("r.slot").alias("slot"), F.col("r.at").alias("at")).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    exact = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return per_slot.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slot", exact.alias("q")))), lambda s: s["q"]
        ).alias("quantiles")
    )
