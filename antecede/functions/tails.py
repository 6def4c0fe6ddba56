"""Upper tails of count distributions as plain arithmetic columns.

With a literal line the finite sum is written out in nested (Horner) form, so the whole tail
is one generated arithmetic expression. With a line column the same sum is a fold over
``sequence``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from antecede.functions.expr import as_col

MEAN_FLOOR = 1e-6
DISPERSION_FLOOR = 1e-6


def floored_mean(mean) -> Column:
    return F.greatest(as_col(mean).cast("double"), F.lit(MEAN_FLOOR))


def _nested_sum(step, last: int) -> Column:
    """1 + step(1) * (1 + step(2) * (...)) with terms up to ``last``."""
    total = F.lit(1.0)
    for k in range(last, 0, -1):
        total = F.lit(1.0) + step(k) * total
    return total


def _folded_sum(first: Column, step, last: Column) -> Column:
    """first + first*step(1) + first*step(1)*step(2) + ... over a per-row upper end."""
    start = F.struct(first.alias("term"), first.alias("total"))

    def advance(acc: Column, k: Column) -> Column:
        term = acc["term"] * step(k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ranks = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(ranks, start, advance, lambda acc: acc["total"])


def poisson_over(mean, line) -> Column:
    """P(X > line) for a Poisson count with the given mean."""
    mu = floored_mean(mean)
    start = F.exp(-mu)
    if isinstance(line, (int, float)):
        last = math.floor(line)
        if last < 0:
            return F.lit(1.0)
        return 1.0 - start * _nested_sum(lambda k: mu / float(k), last)
    last = F.floor(as_col(line)).cast("int")
    body = _folded_sum(start, lambda k: mu / k, last)
    return F.when(last < 0, F.lit(1.0)).otherwise(1.0 - body)


def negative_binomial_over(mean, line, alpha) -> Column:
    """P(X > line) with variance mu + alpha * mu^2; Poisson where alpha is at its floor."""
    mu = floored_mean(mean)
    a = as_col(alpha).cast("double")
    size = 1.0 / F.greatest(a, F.lit(DISPERSION_FLOOR))
    p = size / (size + mu)
    q = mu / (size + mu)
    start = F.exp(size * F.ln(p))
    if isinstance(line, (int, float)):
        last = math.floor(line)
        if last < 0:
            return F.lit(1.0)
        over = 1.0 - start * _nested_sum(lambda k: (size + float(k - 1)) / float(k) * q, last)
    else:
        last = F.floor(as_col(line)).cast("int")
        body = _folded_sum(start, lambda k: (size + k - 1.0) / k * q, last)
        over = F.when(last < 0, F.lit(1.0)).otherwise(1.0 - body)
    return F.when(a <= DISPERSION_FLOOR, poisson_over(mean, line)).otherwise(over)


def dispersion(actual, mean) -> Column:
    """Aggregate: method-of-moments dispersion, never below its floor."""
    mu = floored_mean(mean)
    gap = as_col(actual).cast("double") - mu
    estimate = F.avg((gap * gap - mu) / (mu * mu))
    return F.greatest(F.coalesce(estimate, F.lit(DISPERSION_FLOOR)), F.lit(DISPERSION_FLOOR))
