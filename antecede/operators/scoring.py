"""Chronological evaluation: splits, naive forecasts, point scores and winners."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import as_col

PREDICTION_KEYS = ("season", "game_id", "pitcher_mlbam_id")
NOT_FEATURES = (
    "season", "game_date", "game_id", "pitcher_mlbam_id", "pitcher_name", "team", "opponent",
    "home_away", "pitcher_handedness", *K.TARGETS,
)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
ROLLING = ("last3_", "last5_", "last10_", "last30d_", "last60d_")


# --- feature lists (schema only) -------------------------------------------------------------

def feature_columns(
    df: DataFrame, family: str = "full", rolling: Sequence[str] = ROLLING
) -> list[str]:
    """Model inputs of a family; each family contains the ones listed before it."""
    if family not in K.FAMILIES:
        raise ValueError(f"unknown feature family: {family}")
    numeric = [
        c for c, kind in df.dtypes
        if c not in NOT_FEATURES and (kind in NUMERIC or kind.startswith("decimal"))
    ]

    def member(column: str) -> int:
        if column in K.WORKLOAD_COLUMNS:
            return 1
        if column.startswith("season_") or column in ("month", "home_indicator"):
            return 0
        if column.startswith("opponent_"):
            return 2
        return 3 if column.startswith(tuple(rolling)) else 4

    return [c for c in numeric if member(c) <= K.FAMILIES.index(family)]


def observed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column whether the frame holds any value: (column_name, n)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, n)")


def fold_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value in the training fold, read from one small row."""
    counts = train.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if counts[c]]


# --- splits ------------------------------------------------------------------------------------

def chronological_splits(df: DataFrame, holdout: int, first_train: int = 1) -> DataFrame:
    """(split, train_season, validation_season): each season before the holdout is validated
    once, on all seasons before it."""
    seasons = df.select("season").distinct()
    validation = seasons.where(F.col("season") < holdout).select(
        F.col("season").alias("validation_season")
    )
    pairs = seasons.withColumnRenamed("season", "train_season").join(
        validation, F.col("train_season") < F.col("validation_season")
    )
    bounds = pairs.groupBy("validation_season").agg(
        F.min("train_season").alias("low"), F.max("train_season").alias("high"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= first_train)
    name = F.concat(
        F.lit("train_"), F.col("low"), F.lit("_"), F.col("high"), F.lit("_validate_"), F.col("validation_season"),
    )
    return pairs.join(bounds, "validation_season").select(
        name.alias("split"), "train_season", "validation_season"
    )


def training_means(df: DataFrame, splits: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(split, validation_season, target means over the training seasons)."""
    per_season = df.groupBy("season").agg(
        *[F.sum(t).alias(f"sum_{t}") for t in targets],
        *[F.count(t).alias(f"n_{t}") for t in targets],
    )
    joined = splits.join(per_season, F.col("train_season") == F.col("season"))
    return joined.groupBy("split", "validation_season").agg(
        *[(F.sum(f"sum_{t}") / F.sum(f"n_{t}")).alias(f"mean_{t}") for t in targets]
    )


# A closed-form model maps (target, training mean) to a forecast column.
ClosedModel = Callable[[str, Column], Column]


def naive(target: str, mean: Column) -> Column:
    """The entity's own prior mean this season, else the training mean."""
    return F.coalesce(F.col(K.NAIVE_FEATURE[target]), mean)


def recent(target: str, mean: Column) -> Column:
    return F.coalesce(F.col(K.NAIVE_FEATURE[target].replace("season_", "last3_")), mean)


def constant(target: str, mean: Column) -> Column:
    return mean


CLOSED_MODELS: Mapping[str, ClosedModel] = {"naive": naive, "recent": recent, "constant": constant}


def closed_form_predictions(
    features: DataFrame,
    splits: DataFrame,
    models: Mapping[str, ClosedModel] = CLOSED_MODELS,
    targets: Sequence[str] = K.TARGETS,
) -> DataFrame:
    """Long predictions of closed-form models: every split, target and model in one pass."""
    means = training_means(features, splits, targets)
    # One row per split; dealt by season, all rows would meet in one task per season.
    rows = features.join(F.broadcast(means), F.col("season") == F.col("validation_season"))
    forecasts = [
        F.struct(
            F.lit(target).alias("target"),
            F.lit(name).alias("model"),
            F.col(target).cast("double").alias("actual"),
            model(target, F.col(f"mean_{target}")).alias("prediction"),
        )
        for target in targets
        for name, model in models.items()
    ]
    return rows.select(
        *PREDICTION_KEYS, "split", F.explode(F.array(*forecasts)).alias("f")
    ).select(*PREDICTION_KEYS, "f.target", "f.model", "split", "f.actual", "f.prediction")


def holdout_split(df: DataFrame, holdout: int) -> DataFrame:
    """The single split that trains on everything before the holdout season."""
    return (
        df.select("season").distinct().where(F.col("season") < holdout)
        .select(
            F.lit(f"holdout_{holdout}").alias("split"),
            F.col("season").alias("train_season"),
            F.lit(holdout).cast("bigint").alias("validation_season"),
        )
    )


# --- scores --------------------------------------------------------------------------------------

def point_scores(predictions: DataFrame, by: Sequence[str] = ("target", "model", "split")) -> DataFrame:
    """MAE, RMSE, bias, correlation, Poisson deviance and n of predictions bounded at 0.

    Correlation is 0 where either side is constant.
    """
    p = F.greatest(F.col("prediction"), F.lit(0.0))
    y = F.col("actual")
    mu = F.greatest(p, F.lit(1e-9))
    term = F.when(y > 0, y * F.ln(y / mu)).otherwise(F.lit(0.0))
    flat = (F.min(y) == F.max(y)) | (F.min(p) == F.max(p))
    spread = F.nullif(F.stddev_pop(y) * F.stddev_pop(p), F.lit(0.0))
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(p - y)).alias("mae"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        F.avg(p - y).alias("bias"),
        F.when(flat, F.lit(0.0)).otherwise(F.covar_pop(y, p) / spread).alias("correlation"),
        F.avg(2.0 * (term - y + mu)).alias("poisson_deviance"),
        F.count(F.lit(1)).alias("n"),
    )


def select_winners(scores: DataFrame) -> DataFrame:
    """Model with the lowest mean MAE over the splits, per target; ties by name."""
    means = scores.groupBy("target", "model").agg(F.avg("mae").alias("mae"))
    best = F.struct(F.round("mae", 12).alias("r"), F.col("model"))
    return means.groupBy("target").agg(
        F.min_by("model", best).alias("model"), F.min("mae").alias("mae")
    )


def baseline_improvement(scores: DataFrame, winners: DataFrame, baseline: str = "naive") -> DataFrame:
    """Percent by which the winner's mean MAE is below the baseline's."""
    means = scores.groupBy("target", "model").agg(F.avg("mae").alias("mean_mae"))
    chosen = winners.select("target", F.col("model").alias("winner"))
    base = F.max(F.when(F.col("model") == baseline, F.col("mean_mae")))
    won = F.max(F.when(F.col("model") == F.col("winner"), F.col("mean_mae")))
    return means.join(chosen, "target").groupBy("target", "winner").agg(
        base.alias("baseline_mae"), won.alias("winner_mae"),
        F.round((base - won) / F.nullif(base, F.lit(0.0)) * 100, 2).alias("improvement_pct"),
    )


def score_pivot(scores: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Mean MAE per target with one column per value of a fixed list."""
    return scores.groupBy("target").agg(
        *[F.avg(F.when(F.col(column) == v, F.col("mae"))).alias(v) for v in values]
    )


def winners_only(predictions: DataFrame, winners: DataFrame) -> DataFrame:
    """Forecasts of the winning models. Winners are one row per target and go to the forecasts."""
    return predictions.join(F.broadcast(winners.select("target", "model")), ["target", "model"], "left_semi")


def signed_error(prediction="prediction", actual="actual") -> Column:
    return as_col(prediction) - as_col(actual)
