"""Data-quality checks. Every report is one aggregation over the input; only a finished,
one-row report is ever read on the driver, by the gates that stop a run."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antecede.functions import constants as K
from antecede.functions.expr import flag, null_free_sum


class QualityError(ValueError):
    """Input that breaks a rule the run depends on."""


# --- column and argument gates (no job) ---------------------------------------------------

def require_columns(df: DataFrame, required: Sequence[str], label: str = "input") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise QualityError(f"{label} is missing columns: {missing}")
    return df


def require_cutoff(cutoff: datetime) -> datetime:
    """A cutoff must be an instant, so it needs a time zone."""
    if cutoff.tzinfo is None or cutoff.utcoffset() is None:
        raise QualityError("cutoff must carry a time zone")
    return cutoff


def require_iso_date(text: str) -> date:
    """Only YYYY-MM-DD is accepted."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise QualityError(f"not a YYYY-MM-DD date: {text!r}")
    return date.fromisoformat(text)


def before_cutoff(df: DataFrame, time_column: str, cutoff) -> DataFrame:
    """Rows observed strictly before the cutoff; the filter reaches the scan."""
    if isinstance(cutoff, datetime):
        cutoff = require_cutoff(cutoff)
        if isinstance(df.schema[time_column].dataType, T.TimestampNTZType):
            from datetime import timezone

            cutoff = cutoff.astimezone(timezone.utc).replace(tzinfo=None)
    return df.where(F.col(time_column) < F.lit(cutoff))


# --- profiles -------------------------------------------------------------------------------

def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that contain NULLs and how many."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, nulls)").where(
        "nulls > 0"
    )


def duplicate_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key; missing key parts equal each other."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def _outside(column: Column, bounds: tuple[int, int]) -> Column:
    number = column.try_cast("double")
    return (number < bounds[0]) | (number > bounds[1])


def validity_checks(columns: Sequence[str]) -> dict[str, Column]:
    """Counts of every value rule of the raw event feed, as aggregates of one pass: for a report or to observe a write."""
    missing = sorted(set(K.REQUIRED_COLUMNS) - set(columns))
    if missing:
        raise QualityError(f"raw feed is missing columns: {missing}")
    side = F.lower(F.col("inning_topbot").cast("string"))
    side = F.when(side == "bot", F.lit("bottom")).otherwise(side)
    text_type = F.col("pitch_type").cast("string")
    return {
        "rows": F.count(F.lit(1)),
        "invalid_dates": F.count_if(F.col("game_date").try_cast("date").isNull()),
        **{
            f"invalid_{c}": F.count_if(F.col(c).try_cast("double").isNull())
            for c in K.IDENTIFIER_COLUMNS
        },
        "invalid_sides": F.count_if(F.col("inning_topbot").isNotNull() & ~side.isin(*K.SIDES)),
        **{
            f"invalid_{c}": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*K.HAND_CODES))
            for c in ("stand", "p_throws")
        },
        "invalid_innings": F.count_if(_outside(F.col("inning"), K.INNING_RANGE)),
        "invalid_pitch_numbers": F.count_if(_outside(F.col("pitch_number"), K.PITCH_NUMBER_RANGE)),
        "invalid_pitch_types": F.count_if(F.length(text_type) != K.PITCH_TYPE_LENGTH),
    }


def validity_report(df: DataFrame) -> DataFrame:
    """One row with the counts of every value rule of the raw event feed."""
    return df.agg(*[expr.alias(name) for name, expr in validity_checks(df.columns).items()])


def missing_critical() -> Column:
    """How many values of the critical columns are missing, as an aggregate."""
    return null_free_sum([F.count_if(F.col(c).isNull()) for c in K.CRITICAL_COLUMNS])


def full_report(df: DataFrame) -> DataFrame:
    """Validity counts plus duplicates and missing critical values, still one row."""
    missing = df.agg(missing_critical().alias("missing_critical_values"))
    return validity_report(df).crossJoin(duplicate_count(df, K.DUPLICATE_KEY)).crossJoin(missing)


def findings(report: DataFrame) -> DataFrame:
    """The non-zero counts of a one-row report, one finding per row."""
    names = [c for c in report.columns if c != "rows"]
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return report.selectExpr(f"stack({len(names)}, {pairs}) as (finding, n)").where("n > 0")


# Named checks that stop a run, in the order they are reported. Fixed values.
CRITICAL_CHECKS: Mapping[str, tuple[str, ...]] = {
    "duplicate_pitch_records": ("duplicate_rows",),
    "invalid_dates": ("invalid_dates",),
    "invalid_identifiers": tuple(f"invalid_{c}" for c in K.IDENTIFIER_COLUMNS),
    "invalid_inning_sides": ("invalid_sides",),
    "invalid_innings": ("invalid_innings",),
    "invalid_pitch_numbers": ("invalid_pitch_numbers",),
    "invalid_pitch_types": ("invalid_pitch_types",),
    "missing_critical_values": ("missing_critical_values",),
}


def failed_checks(report: DataFrame) -> DataFrame:
    """Names of the critical checks a one-row report fails."""
    named = [
        F.when(null_free_sum([F.col(c) for c in columns]) > 0, F.lit(name))
        for name, columns in CRITICAL_CHECKS.items()
    ]
    return report.select("rows", F.array_compact(F.array(*named)).alias("failed"))


def critical_gate(df: DataFrame, label: str = "raw feed") -> DataFrame:
    """Stops the run when any critical check fails; returns the input otherwise."""
    require_columns(df, K.REQUIRED_COLUMNS, label)
    failed = failed_checks(full_report(df)).first()["failed"]
    if failed:
        raise QualityError(f"{label} failed critical validation: {', '.join(failed)}")
    return df


def require_zero(report: DataFrame, message: str) -> None:
    """Stops the run when any count of a one-row report is not zero."""
    found = {k: v for k, v in report.first().asDict().items() if v}
    if found:
        raise QualityError(f"{message}: {found}")


# --- table rules ----------------------------------------------------------------------------

def group_size_anomalies(df: DataFrame, key: Sequence[str], expected: int) -> DataFrame:
    """Groups that do not have the expected number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def season_report(events: DataFrame, appearances: DataFrame) -> DataFrame:
    """Per-season volume: rows, games, appearances, entities, date span, complete games.

    Distinct counts come from pre-aggregated keys, so no season is gathered anywhere.
    """
    games = (
        events.groupBy("season", "game_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("game_date").alias("first_date"),
            F.max("game_date").alias("last_date"),
        )
        .groupBy("season")
        .agg(
            F.sum("n").alias("raw_rows"),
            F.count("game_id").alias("games"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )
    per_game = appearances.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("n"))
    shape = per_game.groupBy("season").agg(
        F.sum("n").alias("appearances"),
        F.count_if(F.col("n") == 2).alias("normal_games"),
        F.count_if(F.col("n") != 2).alias("unusual_games"),
    )
    entities = (
        appearances.select("season", "pitcher_mlbam_id")
        .distinct()
        .groupBy("season")
        .agg(F.count("pitcher_mlbam_id").alias("entities"))
    )
    return games.join(shape, "season", "left").join(entities, "season", "left")


def normalize_schema(
    df: DataFrame, renames: Mapping[str, str], date_column: str, season_column: str = "season"
) -> DataFrame:
    """Alias columns renamed (an existing target wins), dates cut to days, season filled."""
    wanted = {old: new for old, new in renames.items() if old in df.columns and new not in df.columns}
    out = df.withColumnsRenamed(wanted)
    day = F.to_date(F.col(date_column))
    year = F.year(day).cast("bigint")
    season = (
        F.coalesce(F.col(season_column).try_cast("bigint"), year)
        if season_column in out.columns
        else year
    )
    return out.withColumns({date_column: day, season_column: season})


def blank_partial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``fill_state``: blank (nothing set), partial, or complete."""
    missing = null_free_sum([flag(F.col(c).isNull()) for c in columns])
    return df.withColumn(
        "fill_state",
        F.when(missing == len(columns), "blank").when(missing > 0, "partial").otherwise("complete"),
    )


def completed_rows(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Drops blank rows; partly filled ones stop the run when ``strict``."""
    staged = blank_partial(df, columns)
    if strict:
        require_zero(
            staged.agg(F.count_if(F.col("fill_state") == "partial").alias("partial_rows")),
            "partially filled rows",
        )
    return staged.where(F.col("fill_state") == "complete").drop("fill_state")


def target_leaks(df: DataFrame, targets: Sequence[str], date_column: str, slate) -> DataFrame:
    """Counts that must all be 0 before an event: known targets and rows off the slate date."""
    return df.agg(
        *[F.count(F.col(t)).alias(f"known_{t}") for t in targets],
        F.count_if(~F.col(date_column).eqNullSafe(F.lit(slate).cast("date"))).alias("off_date_rows"),
    )


def row_missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn(
        "missing_features", null_free_sum([flag(F.col(c).isNull()) for c in columns])
    )


def missingness_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, maximum and overall share of missing feature cells."""
    return row_missingness(df, columns).agg(
        F.avg("missing_features").alias("mean_missing"),
        F.max("missing_features").alias("max_missing"),
        (F.sum("missing_features") / (F.count(F.lit(1)) * F.lit(len(columns)))).alias("missing_rate"),
    )


def parity_report(left: DataFrame, right: DataFrame, column: str, value) -> DataFrame:
    """Row-count difference of two tables and rows of the second outside one allowed value."""
    first = left.agg(F.count(F.lit(1)).alias("left_rows"))
    second = right.agg(
        F.count(F.lit(1)).alias("right_rows"),
        F.count_if(~F.col(column).eqNullSafe(F.lit(value))).alias("other_values"),
    )
    return first.crossJoin(second).select(
        "left_rows", "right_rows", (F.col("left_rows") - F.col("right_rows")).alias("gap"), "other_values"
    )


# --- feature dictionary -----------------------------------------------------------------------

CONTEXT_COLUMNS = (
    "season", "game_date", "game_id", "pitcher_mlbam_id", "opponent", "home_away",
    "pitcher_handedness",
)


def describe_column(name: str) -> str:
    """Description by naming rule. The sentences are fixed values."""
    if name in K.TARGETS:
        return "Post-game target; never used as an input feature."
    if "insufficient_history" in name:
        return "Flag that the minimum historical sample was not available before this game."
    if name.endswith("_pct") or "rate" in name:
        return "Historical rate calculated using observations strictly before the game date."
    if any(word in name for word in ("last", "season", "previous")):
        return "Pre-game historical aggregate, shifted to exclude the current appearance."
    return "Pre-game context or historical feature."


def column_role(name: str) -> str:
    if name in K.TARGETS:
        return "target"
    return "identifier/context" if name in CONTEXT_COLUMNS else "feature"


def feature_dictionary(df: DataFrame) -> DataFrame:
    """One row per column: role, type, missing values and description."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(column_role(c)).alias("role"),
            F.lit(kind).alias("dtype"),
            F.col(f"`{c}`").alias("missing_count"),
            F.lit(describe_column(c)).alias("description"),
        )
        for c, kind in df.dtypes
    ]
    return counts.select(F.inline(F.array(*rows)))
