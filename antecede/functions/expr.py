"""Small column expressions shared by the operators. All stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from antecede.functions.constants import PROBABILITY_FLOOR


def as_col(value) -> Column:
    """Column for a name, a Column or a plain literal."""
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(value)


def safe_rate(numerator, denominator) -> Column:
    """Ratio as double; NULL where the denominator is zero or missing."""
    return as_col(numerator).cast("double") / F.nullif(
        as_col(denominator).cast("double"), F.lit(0.0)
    )


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def clip(value, low: float, high: float) -> Column:
    """Bounds a value; NULL stays NULL."""
    column = as_col(value)
    return F.when(
        column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high))
    )


def clip_probability(value) -> Column:
    return clip(value, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)


def lookup(mapping: dict, key, default=None) -> Column:
    """Value of a small fixed mapping, ``default`` where the key is not listed."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    found = F.element_at(F.create_map(*pairs), as_col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def null_free_sum(columns: Iterable[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for column in columns:
        total = total + column
    return total


# --- prices -----------------------------------------------------------------------------

def implied_probability(odds) -> Column:
    """Probability implied by American odds."""
    price = as_col(odds).cast("double")
    size = F.abs(price)
    return F.when(price > 0, 100.0 / (price + 100.0)).otherwise(size / (size + 100.0))


def fair_odds(probability) -> Column:
    """American odds of a probability strictly between 0 and 1; NULL outside it."""
    p = as_col(probability).cast("double")
    inside = F.when((p > 0) & (p < 1), p)
    return F.when(inside >= 0.5, -100.0 * inside / (1.0 - inside)).otherwise(
        100.0 * (1.0 - inside) / inside
    )


def fair_odds_clipped(probability) -> Column:
    """American odds after bounding the probability away from 0 and 1."""
    return fair_odds(clip_probability(probability))


def profit_per_unit(odds) -> Column:
    price = as_col(odds).cast("double")
    return F.when(price > 0, price / 100.0).otherwise(
        100.0 / F.nullif(F.abs(price), F.lit(0.0))
    )


def expected_value(probability, odds) -> Column:
    """Expected profit of one unit staked; NULL for odds of 0."""
    p = as_col(probability).cast("double")
    return p * profit_per_unit(odds) - (1.0 - p)
