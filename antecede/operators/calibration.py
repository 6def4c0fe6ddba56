"""Calibration tables of probability rows (target, line, probability_over, actual_over)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import fair_odds_clipped, flag
from antecede.operators.distributions import probability_scores
from antecede.operators.scoring import PREDICTION_KEYS
from antecede.session import stage

BINS = 10
STEP = 0.1
TOLERANCE = 1e-12


def probability_bin(probability: str = "probability_over") -> Column:
    """Equal bins closed on the right, the lowest also on the left: inner edges below p."""
    total = F.lit(0).cast("bigint")
    for k in range(1, BINS):
        total = total + flag(F.col(probability) > F.lit(k * STEP))
    return total


def calibration_table(rows: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Predicted and observed rate per bin; empty bins are kept with n = 0."""
    filled = rows.groupBy(*by, probability_bin().alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("probability_over").alias("predicted_probability"),
        F.avg("actual_over").alias("observed_rate"),
    )
    spine = filled.select(*by).distinct().withColumn(
        "bin", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(BINS)]))
    )
    return spine.join(filled, [*by, "bin"], "left").select(
        *by,
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        "predicted_probability",
        "observed_rate",
        (F.col("predicted_probability") - F.col("observed_rate")).alias("calibration_error"),
    )


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Count-weighted mean absolute gap; empty bins have no weight."""
    gap = F.abs(F.col("predicted_probability") - F.col("observed_rate"))
    return table.where(gap.isNotNull()).groupBy(*by).agg(
        (F.sum(gap * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("expected_calibration_error")
    )


def monotonicity_violations(
    rows: DataFrame,
    key: Sequence[str] = PREDICTION_KEYS,
    by: Sequence[str] = ("target",),
) -> DataFrame:
    """How often the probability rises from a line to the next line of the table.

    The next line is taken from the whole table, so a key that lacks a line is compared with
    neither neighbour. A key has at most one row per line, which bounds the window.
    """
    # The lines of a table are a short grid; Spark broadcasts them on their measured size.
    lines = rows.select(*by, "line").distinct()
    order = Window.partitionBy(*by).orderBy("line")
    spine = lines.withColumn("previous_line", F.lag("line").over(order))
    per_key = Window.partitionBy(*by, *key).orderBy("line")
    stepped = rows.join(spine, [*by, "line"]).select(
        *by,
        (
            F.col("previous_line").eqNullSafe(F.lag("line").over(per_key))
            & (F.col("probability_over") - F.lag("probability_over").over(per_key) > TOLERANCE)
        ).alias("rises"),
    )
    return stepped.groupBy(*by).agg(F.count_if("rises").alias("monotonicity_violations"))


def per_line_scores(rows: DataFrame, by: Sequence[str] = ("target", "line")) -> DataFrame:
    scores = probability_scores(rows, by)
    means = rows.groupBy(*by).agg(
        F.avg("probability_over").alias("mean_predicted_over"),
        F.avg("actual_over").alias("actual_over_rate"),
        (F.avg("probability_over") - F.avg("actual_over")).alias("calibration_error"),
    )
    return scores.join(means, list(by))


def calibration_at_lines(
    rows: DataFrame, checked: Mapping[str, Sequence[float]] = K.CHECKED_LINES, season: int | None = None
) -> DataFrame:
    """Predicted against observed at chosen lines of one season."""
    if season is not None:
        rows = rows.where(F.col("season") == season)
    wanted = F.lit(False)
    for target, lines in checked.items():
        for line in lines:
            near = F.abs(F.col("line") - F.lit(float(line))) <= 1e-8 + 1e-5 * abs(line)
            wanted = wanted | ((F.col("target") == target) & near)
    return rows.where(wanted).groupBy("target", "line").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("probability_over").alias("predicted"),
        F.avg("actual_over").alias("observed"),
        (F.avg("probability_over") - F.avg("actual_over")).alias("calibration_error"),
    )


def calibration_buckets(rows: DataFrame) -> DataFrame:
    """Calibration in the high-probability ranges, closed on the left."""
    p, bucket = F.col("probability_over"), None
    for label, low, high in K.HIGH_PROBABILITY_BUCKETS:
        test = (p >= low) & (p < high)
        bucket = F.when(test, label) if bucket is None else bucket.when(test, label)
    known = p.isNotNull() & F.col("actual_over").isNotNull()
    return rows.where(known).withColumn("bucket", bucket).where(
        F.col("bucket").isNotNull()
    ).groupBy("target", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("probability_over").alias("predicted"),
        F.avg("actual_over").alias("observed"),
        (F.avg("probability_over") - F.avg("actual_over")).alias("calibration_error"),
    )


def probability_summary(rows: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Scores, calibration error, spread and monotonicity per group, one row each.

    The probabilities are made once: five results read them as a written table.
    """
    used = dict.fromkeys([*by, *PREDICTION_KEYS, "line", "probability_over", "actual_over"])
    rows = stage(rows.select(*used), "probabilities")
    spread = rows.groupBy(*by).agg(F.stddev_samp("probability_over").alias("probability_std"))
    return (
        probability_scores(rows, by)
        .join(spread, list(by))
        .join(expected_calibration_error(calibration_table(rows, by), by), list(by))
        .join(monotonicity_violations(rows, by=by), list(by))
    )


def fair_odds_table(rows: DataFrame) -> DataFrame:
    """Adds the under side and the odds at which each side would be fair."""
    return rows.withColumn("probability_under", 1.0 - F.col("probability_over")).withColumns(
        {
            "fair_odds_over": fair_odds_clipped("probability_over"),
            "fair_odds_under": fair_odds_clipped("probability_under"),
        }
    )
