"""Where a winning model errs, and whether it overfits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.quantiles import exact_quantiles
from antecede.operators.scoring import PREDICTION_KEYS, signed_error

TIERS = ("low", "medium", "high")
EARLY_STARTS = 5
GROUP = ("target", "model", "split")


def projection_tier(edges: str = "tier_edges") -> Column:
    """Tercile of the prediction: bins closed on the right, equal edges merged."""
    below = F.expr(f"size(filter({edges}, e -> e < prediction))")
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), below + 1)


BUCKETS = ("season", "pitcher_handedness", "projection_tier", "experience_bucket")


def error_sums(predictions: DataFrame, context: DataFrame) -> DataFrame:
    """Counts and error sums per combination of all buckets: the mergeable table every grouping is made of.

    Terciles span all splits of a target. They are one row per model, so they go to the rows: dealt by target and model, all
    forecasts would meet in a handful of tasks.
    """
    terciles = exact_quantiles(
        predictions, ["target", "model"], "prediction", [1 / 3, 2 / 3]
    ).withColumn("tier_edges", F.array_distinct("quantiles"))
    experience = F.when(
        F.col("pitcher_starts_before_game") < EARLY_STARTS, "early_season"
    ).otherwise("established")
    columns = [*PREDICTION_KEYS, "pitcher_handedness", "pitcher_starts_before_game"]
    rows = predictions.join(context.select(*columns), list(PREDICTION_KEYS), "left").join(F.broadcast(terciles), ["target", "model"])
    values = {
        "season": F.col("season").cast("string"),
        "projection_tier": projection_tier(),
        "experience_bucket": experience,
        "error": signed_error(),
    }
    return rows.withColumns(values).groupBy(*GROUP, *BUCKETS).agg(
        F.sum(F.abs("error")).alias("abs_error"), F.sum("error").alias("error"), F.count(F.lit(1)).alias("n"), F.count("error").alias("known")
    )


def merged_errors(sums: DataFrame, totals: bool = False) -> DataFrame:
    """MAE, bias and n of every bucket from ``error_sums`` (or several of them in a union), in one pass of grouping sets.

    ``totals`` adds a row per group over all buckets. The sets expand the few rows of the sums, never the predictions.
    """
    group = [F.col(c) for c in GROUP]
    sets = [[*group, F.col(b)] for b in BUCKETS] + ([group] if totals else [])
    which = F.grouping_id()
    # In the grouping id the bit of a column is 0 where the column is grouped; the first bucket has the highest bit.
    every = (1 << len(BUCKETS)) - 1
    value, kind = F.lit(None).cast("string"), F.lit("all")
    for place, bucket in enumerate(BUCKETS):
        own = F.col("which") == every - (1 << (len(BUCKETS) - 1 - place))
        value, kind = F.when(own, F.col(bucket)).otherwise(value), F.when(own, bucket).otherwise(kind)
    out = sums.groupingSets(sets, *group, *[F.col(b) for b in BUCKETS]).agg(
        F.sum("abs_error").alias("abs_error"), F.sum("error").alias("error"), F.sum("n").alias("n"), F.sum("known").alias("known"), which.alias("which")
    )
    known = F.nullif(F.col("known"), F.lit(0))
    out = out.select(*GROUP, kind.alias("bucket_type"), value.alias("bucket_value"), (F.col("abs_error") / known).alias("mae"), (F.col("error") / known).alias("bias"), "n")
    return out.where((F.col("bucket_type") == "all") | F.col("bucket_value").isNotNull())


def bucketed_errors(predictions: DataFrame, context: DataFrame, totals: bool = False) -> DataFrame:
    """MAE, bias and n by season, hand, projection tier and experience, for each split."""
    return merged_errors(error_sums(predictions, context), totals)


def residual_summary(predictions: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Mean, spread, skew, tails and extremes of prediction minus actual.

    Skew is the sample form: the population form scaled by sqrt(n(n-1))/(n-2).
    """
    by = list(by)
    rows = predictions.withColumn("residual", signed_error())
    shape = rows.groupBy(*by).agg(
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_std"),
        F.skewness("residual").alias("population_skew"),
        F.count_if(F.col("prediction") <= 0).alias("zero_clipped_predictions"),
        F.count(F.lit(1)).alias("n"),
    )
    tails = exact_quantiles(rows, by, "residual", [0.05, 0.95])
    # The second pass needs the spread found by the first, one row per group.
    spread = shape.select(*by, "residual_std")
    extreme = rows.join(F.broadcast(spread), by).groupBy(*by).agg(
        F.count_if((F.col("residual_std") > 0) & (F.abs("residual") > 3 * F.col("residual_std"))).alias("extreme_residual_count_gt3sd")
    )
    n = F.col("n").cast("double")
    adjusted = F.when(
        n > 2, F.col("population_skew") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    )
    return shape.join(tails, by).join(extreme, by).select(
        *by,
        "residual_mean",
        "residual_std",
        adjusted.alias("residual_skew"),
        F.col("quantiles")[0].alias("residual_p05"),
        F.col("quantiles")[1].alias("residual_p95"),
        "extreme_residual_count_gt3sd",
        "zero_clipped_predictions",
        "n",
    )


def overfit_gap(validation: DataFrame, holdout: DataFrame, last_split: str) -> DataFrame:
    """Holdout MAE against the last validation fold, absolute and in percent."""
    last = validation.where(F.col("split") == last_split).select(
        "target", "model", F.col("mae").alias("validation_mae")
    )
    gap = F.col("holdout_mae") - F.col("validation_mae")
    return last.join(
        holdout.select("target", "model", F.col("mae").alias("holdout_mae")), ["target", "model"]
    ).select(
        "target", "model", "validation_mae", "holdout_mae", gap.alias("gap"),
        (gap / F.nullif(F.col("validation_mae"), F.lit(0.0)) * 100).alias("gap_pct"),
    )


def family_deltas(scores: DataFrame, families: Sequence[str] = K.FAMILIES) -> DataFrame:
    """Mean MAE per family and its change from the family before it."""
    means = scores.groupBy("target").agg(
        *[F.avg(F.when(F.col("feature_family") == f, F.col("mae"))).alias(f) for f in families]
    )
    return means.withColumns(
        {
            f"delta_vs_prior_adding_{after}": F.col(after) - F.col(before)
            for before, after in zip(families, families[1:])
        }
    )
