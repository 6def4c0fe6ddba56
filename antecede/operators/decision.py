"""Decision side, stress test, tier and order of priced markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import clip, expected_value, lookup
from antecede.functions.text import normalize_flags

# Output column and its source for each side. Fixed correspondence.
SIDE_SOURCES = {
    "selected_probability": ("model_over_probability", "model_under_probability"),
    "selected_market_no_vig": ("market_over_no_vig", "market_under_no_vig"),
    "selected_odds": ("over_odds", "under_odds"),
    "selected_fair_odds": ("model_fair_over_odds", "model_fair_under_odds"),
    "selected_edge": ("over_probability_edge", "under_probability_edge"),
    "selected_ev": ("over_ev", "under_ev"),
    "opposite_side_ev": ("under_ev", "over_ev"),
}


def side_columns() -> dict[str, Column]:
    """The side with the higher expected value and its attributes; a tie goes to OVER."""
    over = F.col("over_ev") >= F.col("under_ev")
    columns = {"model_side": F.when(over, "OVER").otherwise("UNDER")}
    for name, (if_over, if_under) in SIDE_SOURCES.items():
        columns[name] = F.when(over, F.col(if_over)).otherwise(F.col(if_under)).cast("double")
    return columns


def extra_stress() -> Column:
    """Additional stress, in points, of the lines known to be miscalibrated."""
    extra = F.lit(0.0)
    for target, line, points in K.EXTRA_STRESS:
        near = F.abs(F.col("line") - F.lit(line)) <= 1e-8 + 1e-5 * abs(line)
        extra = F.when((F.col("target") == target) & near, F.lit(points)).otherwise(extra)
    return extra


def stress_columns(base_points: float) -> dict[str, Column]:
    """Probability lowered by the stress, bounded, and its expected value."""
    applied = F.lit(float(base_points)) + extra_stress()
    stressed = clip(F.col("selected_probability") - applied / 100.0, 0.001, 0.999)
    return {
        "base_stress_pp": F.lit(float(base_points)),
        "line_calibration_stress_pp": extra_stress(),
        "stress_pp": applied,
        "stressed_probability": stressed,
        "stressed_ev": expected_value(stressed, "selected_odds"),
    }


def signal_tier(ev="selected_ev", edge="selected_edge", stressed="stressed_ev", flags="role_flags") -> Column:
    """First rule that holds. The limits are fixed values."""
    value, gap, worst = F.col(ev), F.col(edge), F.col(stressed)
    return (
        F.when(normalize_flags(flags) != "NONE", "PASS_ROLE_RISK")
        .when(value <= 0, "PASS")
        .when(worst <= 0, "WATCH_FRAGILE")
        .when((value >= 0.06) & (gap >= 0.05) & (worst >= 0.015), "STRONG_CANDIDATE")
        .when((value >= 0.03) & (gap >= 0.03), "CANDIDATE")
        .otherwise("WATCH")
    )


def stale_tier(tier, age_days) -> Column:
    """Tier after data older than one day lowered it."""
    return F.when(age_days > 1, F.coalesce(lookup(K.STALE_TIER, tier), tier)).otherwise(tier)


def decide(df: DataFrame, base_points: float, as_of, slate) -> DataFrame:
    """Every decision column of a priced market; data age is slate date minus as-of date."""
    as_of_day, slate_day = F.lit(as_of).cast("date"), F.lit(slate).cast("date")
    rows = df.withColumn("role_flags", normalize_flags("role_flags")).withColumns(side_columns())
    rows = rows.withColumns(stress_columns(base_points)).withColumns(
        {
            "data_as_of": as_of_day,
            "data_age_days": F.date_diff(slate_day, as_of_day).cast("bigint"),
        }
    )
    return rows.withColumn("signal_tier", stale_tier(signal_tier(), F.col("data_age_days")))


def tier_rank(tier="signal_tier") -> Column:
    return lookup({name: rank for rank, name in enumerate(K.TIER_ORDER)}, tier, 99)


def ranked_decisions(df: DataFrame, ties=()) -> DataFrame:
    """Display percentages, strongest tier first, then value, then edge."""
    percent = {
        "selected_probability_pct": "selected_probability",
        "selected_market_no_vig_pct": "selected_market_no_vig",
        "stressed_probability_pct": "stressed_probability",
        "selected_edge_pp": "selected_edge",
        "selected_ev_pct": "selected_ev",
        "opposite_side_ev_pct": "opposite_side_ev",
        "stressed_ev_pct": "stressed_ev",
    }
    return df.withColumns({name: F.col(c) * 100.0 for name, c in percent.items()}).orderBy(
        tier_rank(), F.desc("selected_ev"), F.desc("selected_edge"), *ties
    )


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("signal_tier").agg(F.count(F.lit(1)).alias("n"))
