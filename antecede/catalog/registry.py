"""Names the queries and keeps the check SQL next to each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.plans.standin import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables; ``sql`` is the equivalent for DuckDB."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def r6(column) -> Column:
    """Six decimals, with negative zero turned into zero, for comparison across engines."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds the named columns, or every double column when none is named."""
    names = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: r6(c) for c in names})


# --- check SQL ------------------------------------------------------------------------------

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    """A named subquery that check SQL can build on."""
    PARTS[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    """The statement with every subquery it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in PARTS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in ordered) + "\n" + select


def r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"
