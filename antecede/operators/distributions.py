"""From point forecasts to over/under probabilities on a grid of lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import clip_probability
from antecede.functions.quantiles import BLOCKS, SKETCH_ACCURACY, exact_quantiles
from antecede.functions.tails import dispersion, negative_binomial_over, poisson_over
from antecede.session import stage

# Decimals at which a residual and a threshold count as equal.
DIGITS = 9
ALL_ROWS = -1
METHODS = ("poisson", "negative_binomial", "empirical", "conditional_empirical")


def _per_target(grids: Mapping[str, Sequence[float]], item) -> Column:
    """Array of structs per row, chosen by the row's target."""
    chosen = None
    for target, lines in grids.items():
        entries = F.array(*[item(float(line)) for line in lines])
        test = F.col("target") == target
        chosen = F.when(test, entries) if chosen is None else chosen.when(test, entries)
    return chosen


def _with_lines(points: DataFrame, grids, item) -> DataFrame:
    rows = points.withColumn("_g", F.explode(_per_target(grids, item)))
    return rows.select(
        *points.columns,
        "_g.*",
        F.when(F.col("actual") > F.col("_g.line"), 1).when(F.col("actual").isNotNull(), 0)
        .cast("bigint").alias("actual_over"),
    )


def line_grid(points: DataFrame, grids: Mapping[str, Sequence[float]] = K.LINE_GRID) -> DataFrame:
    """Every prediction with every line of its target and whether the actual went over."""
    return _with_lines(points, grids, lambda line: F.struct(F.lit(line).alias("line")))


def poisson_probabilities(points: DataFrame, grids=K.LINE_GRID) -> DataFrame:
    """Lines are literals, so each tail is one arithmetic expression before the explode."""
    return _with_lines(
        points,
        grids,
        lambda line: F.struct(
            F.lit(line).alias("line"),
            clip_probability(poisson_over("prediction", line)).alias("probability_over"),
        ),
    ).withColumn("method", F.lit("poisson"))


def fit_dispersion(history: DataFrame, by: Sequence[str]) -> DataFrame:
    return history.groupBy(*by).agg(dispersion("actual", "prediction").alias("alpha"))


def negative_binomial_probabilities(
    points: DataFrame, history: DataFrame, by: Sequence[str], grids=K.LINE_GRID
) -> DataFrame:
    # Staged, so the join is planned on its real size: one row per fitted group.
    fitted = stage(fit_dispersion(history, by), "dispersion")
    rows = _with_lines(
        points.join(fitted, list(by), "left"),  # no history: no probability
        grids,
        lambda line: F.struct(
            F.lit(line).alias("line"),
            clip_probability(negative_binomial_over("prediction", line, "alpha")).alias(
                "probability_over"
            ),
        ),
    )
    return rows.drop("alpha").withColumn("method", F.lit("negative_binomial"))


# --- residual distributions --------------------------------------------------------------------

def bin_edges(history: DataFrame, by: Sequence[str], bins: int = K.QUANTILE_BINS) -> DataFrame:
    """Inner edges of the prediction quantile bins per group; fewer than three distinct edges
    leave one bin for everything."""
    probabilities = [k / bins for k in range(bins + 1)]
    edges = stage(exact_quantiles(history, by, "prediction", probabilities), "edges")
    distinct = F.array_distinct("quantiles")
    return edges.select(
        *by,
        F.when(F.size(distinct) >= 3, F.slice(distinct, 2, F.size(distinct) - 2))
        .otherwise(F.array().cast("array<double>")).alias("edges"),
    )


def bin_of(prediction: str = "prediction") -> Column:
    """Number of inner edges at or below the prediction."""
    return F.expr(f"size(filter(edges, e -> e <= `{prediction}`))").cast("bigint")


def residual_counts(
    history: DataFrame, by: Sequence[str], edges: DataFrame | None, min_size: int
) -> DataFrame:
    """Distinct residuals per (group, bin) with counts. Every residual is in the bin of all
    rows; with ``edges`` also in its own bin, where that bin is large enough."""
    rows = history.where(F.col("prediction").isNotNull() & F.col("actual").isNotNull()).withColumn(
        "value", F.round(F.col("actual") - F.col("prediction"), DIGITS)
    )
    everything = F.lit(ALL_ROWS).cast("bigint")
    if edges is None:
        bins = F.array(everything)
    else:
        rows = rows.join(edges, list(by))
        bins = F.array(everything, bin_of())
    counts = rows.select(*by, "value", F.explode(bins).alias("bin")).groupBy(*by, "bin", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = stage(counts, "residual-counts") if edges is not None else counts
    sizes = counts.groupBy(*by, "bin").agg(F.sum("n").alias("bin_n")).where(
        (F.col("bin") == ALL_ROWS) | (F.col("bin_n") >= min_size)
    )
    return stage(counts.join(sizes, [*by, "bin"]), "residuals")


def shares_above(
    counts: DataFrame, thresholds: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Share of each group's counted values strictly above each distinct threshold.

    Values and thresholds are cut into the same ordered blocks. What lies in higher or lower
    blocks comes from block totals; only inside one block are the two merged in order. No pair
    of value and threshold is ever formed and no group is ordered as a whole.

    The borders are written: a sketch depends on the order in which its parts arrive, and values and thresholds must be cut
    at the same ones.
    """
    key = list(key)
    borders = counts.groupBy(*key).agg(
        F.percentile_approx(
            "value", F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)]), F.lit(SKETCH_ACCURACY)
        ).alias("borders")
    )
    borders = stage(borders, "borders")
    block = F.expr("size(filter(borders, b -> b < value))")
    # One row per group, each with a bounded list of borders.
    values = counts.join(borders, key).withColumn("block", block)
    totals = values.groupBy(*key, "block").agg(F.sum("n").alias("block_n")).groupBy(*key).agg(
        F.collect_list(F.struct("block", "block_n")).alias("blocks"), F.sum("block_n").alias("total")
    )
    asked = (
        thresholds.select(*key, F.col("threshold").alias("value")).distinct()
        .join(borders.join(totals, key), key)
        .withColumn("block", block)
    )
    lower = F.expr(
        "aggregate(filter(blocks, x -> x.block < block), 0L, (s, x) -> s + x.block_n)"
    )
    merged = values.select(*key, "block", "value", "n", F.lit(0).alias("kind")).unionByName(
        asked.select(
            *key, "block", "value", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("kind"),
            lower.alias("lower"), "total",
        ),
        allowMissingColumns=True,
    )
    upto = Window.partitionBy(*key, "block").orderBy("value", "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    at_or_below = F.col("lower") + F.col("inside")
    return merged.withColumn("inside", F.sum("n").over(upto)).where(F.col("kind") == 1).select(
        *key,
        F.col("value").alias("threshold"),
        ((F.col("total") - at_or_below) / F.col("total")).alias("share"),
    )


def within_bounds(share, bounds: Mapping[str, tuple[float, float]]):
    out = share
    for target, (low, high) in bounds.items():
        own = F.col("target") == target
        out = F.when(share.isNotNull() & own & (F.col("line") >= high), 0.0).when(
            share.isNotNull() & own & (F.col("line") < low), 1.0
        ).otherwise(out)
    return out


def empirical_probabilities(
    points: DataFrame,
    history: DataFrame,
    by: Sequence[str],
    conditional: bool,
    grids=K.LINE_GRID,
    bins: int = K.QUANTILE_BINS,
    min_size: int = K.MIN_BIN_SIZE,
    bounds: Mapping[str, tuple[float, float]] = K.VALUE_BOUNDS,
) -> DataFrame:
    """P(over) from past residuals, of the prediction's quantile bin when ``conditional``.

    A simulated value is kept inside its target's bounds: nothing is over a line at or beyond the upper
    bound, everything is over a line below the lower one, and in between the bounds move no value across a
    line. Without past residuals of the group the probability is NULL.
    """
    by = list(by)
    edges = bin_edges(history, by, bins) if conditional else None
    counts = residual_counts(history, by, edges, min_size)
    rows = line_grid(points.where(F.col("prediction").isNotNull()), grids).withColumn(
        "threshold", F.round(F.col("line") - F.col("prediction"), DIGITS)
    )
    everything = F.lit(ALL_ROWS).cast("bigint")
    if conditional:
        large = counts.select(*by, "bin").distinct().withColumn("large", F.lit(True))
        rows = rows.join(edges, by, "left").withColumn("bin", bin_of())
        rows = rows.join(large, [*by, "bin"], "left").withColumn(
            "bin", F.when(F.col("large"), F.col("bin")).otherwise(everything)
        )
    else:
        rows = rows.withColumn("bin", everything)
    shares = shares_above(counts.drop("bin_n"), rows.select(*by, "bin", "threshold"), [*by, "bin"])
    return rows.join(shares, [*by, "bin", "threshold"], "left").select(
        *points.columns,
        "line",
        "actual_over",
        clip_probability(within_bounds(F.col("share"), bounds)).alias("probability_over"),
        F.lit("conditional_empirical" if conditional else "empirical").alias("method"),
    )


def probabilities(
    method: str, points: DataFrame, history: DataFrame, by: Sequence[str], grids=K.LINE_GRID, **options
) -> DataFrame:
    """Probability rows of one method fitted on ``history``; groups match on ``by``."""
    if method == "poisson":
        return poisson_probabilities(points, grids)
    if method == "negative_binomial":
        return negative_binomial_probabilities(points, history, by, grids)
    if method in ("empirical", "conditional_empirical"):
        return empirical_probabilities(
            points, history, by, method == "conditional_empirical", grids, **options
        )
    raise ValueError(f"unknown method: {method}")


# --- scores and selection -------------------------------------------------------------------------

def probability_scores(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier score, log loss and count of bounded probabilities."""
    p, y = clip_probability("probability_over"), F.col("actual_over").cast("double")
    return rows.groupBy(*by).agg(
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(F.when(y == 1, -F.ln(p)).otherwise(-F.ln(1.0 - p))).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
    )


def expanding_folds(points: DataFrame, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(validation rows, history rows) keyed by ``fold``: each season against all before it."""
    seasons = points.select("season").distinct()
    folds = seasons.select(F.col("season").alias("fold"))
    if first is not None:
        folds = folds.where(F.col("fold") >= first)
    pairs = folds.join(seasons, F.col("season") < F.col("fold"))
    history = points.join(pairs, "season")
    valid = points.join(pairs.select("fold").distinct(), F.col("season") == F.col("fold"))
    return valid, history


def validate_methods(
    points: DataFrame, first_fold: int | None = None, methods: Sequence[str] = METHODS, **options
) -> DataFrame:
    """Score of every method on every expanding fold: (target, fold, method, scores)."""
    valid, history = expanding_folds(points, first_fold)
    out = None
    for method in methods:
        rows = probabilities(method, valid, history, ["target", "fold"], **options)
        scores = probability_scores(rows, ["target", "fold", "method"])
        out = scores if out is None else out.unionByName(scores)
    return out


def select_distribution(scores: DataFrame) -> DataFrame:
    """Method with the lowest mean Brier score, then log loss, then name."""
    means = scores.groupBy("target", "method").agg(
        F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss")
    )
    rank = F.struct(
        F.round("brier", 12).alias("b"), F.round("log_loss", 12).alias("l"), F.col("method")
    )
    best = F.min_by(F.struct("method", "brier", "log_loss"), rank).alias("best")
    return means.groupBy("target").agg(best).select("target", "best.*")
