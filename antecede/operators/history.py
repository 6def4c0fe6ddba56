"""Point-in-time history: every frame ends strictly before the current row.

Plan shape. Windows over an entity across periods are added first; they hash-partition on the
entity and sort by (entity, period, date, game). Windows per (entity, period) then need neither
a new exchange nor a new sort, because hashing on the entity already clusters (entity, period)
and the sort order already has the right prefix. RANGE frames order by the date alone, which is
again a prefix. One shuffle and one sort serve all frames.

Size of a partition. These windows run on one row per (entity, game): however many raw rows one
entity holds, it has at most one row per game. Where even that is too much for one task,
``blocked_history`` computes the same columns with every (entity, period) cut into date blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions.expr import flag
from antecede.session import stage


@dataclass(frozen=True)
class Spec:
    """Names of the columns that identify and order a history."""

    entity: tuple[str, ...] = ("pitcher_mlbam_id",)
    period: tuple[str, ...] = ("season",)
    date: str = "game_date"
    game: str = "game_id"

    @property
    def key(self) -> list[str]:
        return [*self.entity, *self.period]

    def in_period(self):
        return Window.partitionBy(*self.key).orderBy(self.date, self.game)

    def across(self):
        return Window.partitionBy(*self.entity).orderBy(*self.period, self.date, self.game)


@dataclass(frozen=True)
class Frame:
    """A prior window: everything before, the last ``rows`` games or the last ``days`` days."""

    name: str
    rows: int | None = None
    days: int | None = None

    def over(self, spec: Spec) -> str:
        """The frame as SQL text; one parsed expression costs far less to build than a chain of
        column calls, and the feature table has hundreds of them."""
        keys = ", ".join(f"`{c}`" for c in spec.key)
        if self.days is not None:
            return days_before(keys, spec.date, self.days)
        first = "unbounded" if self.rows is None else str(self.rows)
        return (
            f"(partition by {keys} order by `{spec.date}`, `{spec.game}` "
            f"rows between {first} preceding and 1 preceding)"
        )


def days_before(keys: str, date: str, days: int) -> str:
    """Frame over [date - days, date). The order is a date, so the bounds are intervals."""
    return (
        f"(partition by {keys} order by `{date}` "
        f"range between interval {days} days preceding and interval 1 day preceding)"
    )


SEASON = Frame("season")
DEFAULT_FRAMES = (
    SEASON,
    Frame("last3", rows=3),
    Frame("last5", rows=5),
    Frame("last10", rows=10),
    Frame("last30d", days=30),
    Frame("last60d", days=60),
)


def prior_sums(frame: Frame, spec: Spec, metrics: Sequence[str]) -> dict[str, Column]:
    """Sums over the frame, NULL where the frame is empty."""
    over = frame.over(spec)
    return {f"{frame.name}_{m}": F.expr(f"sum(`{m}`) over {over}") for m in metrics}


def prior_starts(frame: Frame, spec: Spec) -> Column:
    """Games in the frame: 0 before the first game, but NULL for an empty span of days."""
    count = f"count(1) over {frame.over(spec)}"
    return F.expr(f"nullif({count}, 0)" if frame.days is not None else count)


def with_prior(
    df: DataFrame, spec: Spec, frames: Sequence[Frame], metrics: Sequence[str]
) -> DataFrame:
    """Adds ``<frame>_<metric>`` sums and ``<frame>_history_starts`` for every frame.

    Row frames and day frames go into one projection each so that each shares one sort.
    """
    for group in (
        [f for f in frames if f.days is None],
        [f for f in frames if f.days is not None],
    ):
        columns: dict[str, Column] = {}
        for frame in group:
            columns |= prior_sums(frame, spec, metrics)
            columns[f"{frame.name}_history_starts"] = prior_starts(frame, spec)
        if columns:
            df = df.withColumns(columns)
    return df


# Rates of a frame as (suffix, numerator, denominator). ``starts`` is the frame's game count.
RATES = (
    ("k_pct", "k_count", "bf_metric"),
    ("k_per_start", "k_count", "starts"),
    ("pitches_per_start", "pitches", "starts"),
    ("bf_per_start", "bf_metric", "starts"),
    ("outs_per_start", "outs_history", "starts"),
    ("bb_pct", "bb_count", "bf_metric"),
    ("hits_per_bf", "hits_count", "bf_metric"),
    ("swstr_pct", "whiff_count", "pitches"),
    ("csw_pct", "csw_count", "pitches"),
    ("called_strike_pct", "called_strike_count", "pitches"),
    ("chase_rate", "chase_swing_count", "chase_pitch_count"),
    ("contact_rate", "contact_count", "swing_count"),
    ("zone_contact_rate", "zone_contact_count", "zone_swing_count"),
    ("first_pitch_strike_rate", "first_pitch_strike_count", "first_pitch_pa_count"),
    ("strike_pct", "strike_count", "pitches"),
)
RATE_METRICS = tuple(
    sorted({m for _, *pair in RATES for m in pair if m != "starts"})
)


def ratio(numerator: str, denominator: str) -> str:
    """SQL text of a ratio as double, NULL where the denominator is zero or missing."""
    return f"cast({numerator} as double) / nullif(cast({denominator} as double), 0.0D)"


def rate_columns(frame: Frame, minimum: int, rates=RATES) -> dict[str, Column]:
    """Rates of a frame, NULL below the minimum history, plus the flag that says so."""
    starts = f"`{frame.name}_history_starts`"

    def term(name: str) -> str:
        return starts if name == "starts" else f"`{frame.name}_{name}`"

    columns = {
        f"{frame.name}_{suffix}": F.expr(
            f"case when coalesce({starts} < {minimum}, false) then null "
            f"else {ratio(term(top), term(bottom))} end"
        )
        for suffix, top, bottom in rates
    }
    columns[f"{frame.name}_insufficient_history"] = F.expr(
        f"case when {starts} < {minimum} then 1L else 0L end"
    )
    return columns


def expanding_median(spec: Spec, value: str) -> Column:
    """Median of the prior values of the period."""
    frame = spec.in_period().rowsBetween(Window.unboundedPreceding, -1)
    return F.percentile(F.col(value), F.lit(0.5)).over(frame)


def days_since_previous(spec: Spec) -> Column:
    """Days since the previous game of the entity, also across periods."""
    return F.date_diff(F.col(spec.date), F.lag(spec.date).over(spec.across())).cast("bigint")


def prior_count(spec: Spec) -> Column:
    return (F.row_number().over(spec.in_period()) - 1).cast("bigint")


def previous_value(spec: Spec, value: str, offset: int = 1) -> Column:
    """Value of an earlier game of the entity, also across periods."""
    return F.lag(value, offset).over(spec.across())


def prior_at_least(spec: Spec, value: str, threshold: float) -> Column:
    """How many prior games of the period reached the threshold."""
    frame = spec.in_period().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(flag(F.col(value) >= threshold)).over(frame), F.lit(0))


def trend(spec: Spec, value: str, offset: int = 3) -> Column:
    return F.col(value) - previous_value(spec, value, offset)


def month_of(date_column: str) -> Column:
    return F.month(date_column).cast("bigint")


def indicator(column: str, value) -> Column:
    return flag(F.col(column) == F.lit(value))


# --- expanding median of long histories --------------------------------------------------------

RADIX = 16


def running_median(df: DataFrame, spec: Spec, value: str, name: str) -> DataFrame:
    """Keys and the median of the prior values of the period, in near-linear time.

    ``expanding_median`` sorts all earlier values again for every row; that suits a season of games. Here values get
    dense ranks, and each row asks for the one or two middle ranks of the values before it. The answer is found digit by
    digit, highest first: running counts of the next digit, among values that share the digits found so far, say which digit
    the wanted value has and how many values stand below it. A digit costs one pass over the rows and their questions, dealt
    by (entity, digits found), so all but the first pass also split a single huge entity; the number of digits grows
    with the logarithm of the distinct values. Missing values count for nothing, and rows without prior values get NULL.
    """
    key, order = spec.key, list(dict.fromkeys([spec.date, spec.game]))
    ordered = Window.partitionBy(*key).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    ranked = stage(
        df.select(
            *key, *order, F.col(value).alias("_value"),
            F.row_number().over(ordered).cast("bigint").alias("_at"), F.count(value).over(before).alias("_n"),
            (F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col(value).asc_nulls_last())) - 1).cast("bigint").alias("_rank"),
        ),
        "ranked",
    )
    highest = ranked.agg(F.max("_rank")).first()[0] or 0
    digits = 1
    while RADIX**digits <= highest:
        digits += 1
    data = ranked.where(F.col("_value").isNotNull())
    middle = F.array_distinct(F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    asked = ranked.where("_n > 0").select(*key, "_at", F.explode(middle.cast("array<bigint>")).alias("_k"), F.lit(0).cast("bigint").alias("_node"))
    for level in reversed(range(digits)):
        step = RADIX**level
        known = data.select(
            *key, "_at", F.lit(None).cast("bigint").alias("_k"), F.floor(F.col("_rank") / (step * RADIX)).cast("bigint").alias("_node"),
            F.pmod(F.floor(F.col("_rank") / step), F.lit(RADIX)).cast("int").alias("_digit"),
        )
        both = known.unionByName(asked, allowMissingColumns=True)
        # At its own row a question stands before the value, so it counts prior values only.
        over = Window.partitionBy(*key, "_node").orderBy("_at", F.col("_digit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        upto = [F.count_if(F.col("_digit") <= d).over(over).alias(f"_c{d}") for d in range(RADIX)]
        counted = both.select(*key, "_at", "_k", "_node", *upto).where(F.col("_k").isNotNull())
        counts = F.array(*[F.col(f"_c{d}") for d in range(RADIX)])
        found = counted.withColumn("_counts", counts).withColumn("_found", F.size(F.filter("_counts", lambda c: c < F.col("_k"))))
        below = F.coalesce(F.try_element_at("_counts", F.nullif(F.col("_found"), F.lit(0))), F.lit(0))
        asked = found.select(*key, "_at", (F.col("_k") - below).alias("_k"), (F.col("_node") * RADIX + F.col("_found")).cast("bigint").alias("_node"))
    values = data.groupBy(*key, "_rank").agg(F.first("_value").alias("_value"))
    answers = asked.withColumnRenamed("_node", "_rank").join(values, [*key, "_rank"]).groupBy(*key, "_at").agg(F.avg("_value").alias(name))
    return ranked.join(answers, [*key, "_at"], "left").select(*key, *order, name)


# --- the same columns for entities too large for one task -----------------------------------

@dataclass(frozen=True)
class Blocks:
    """Date blocks of a history. ``width`` days must cover the longest day frame."""

    width: int = 64
    column: str = field(default="_block")

    def of(self, date: str) -> Column:
        return F.floor(F.unix_date(F.col(date)) / self.width).cast("bigint")


def blocked_history(
    df: DataFrame,
    spec: Spec,
    frames: Sequence[Frame],
    metrics: Sequence[str],
    blocks: Blocks = Blocks(),
) -> DataFrame:
    """``with_prior`` with no more than one date block of an entity in a task.

    Block totals are prefix-summed (one row per block). Each block is then windowed on its own,
    preceded by what it needs from earlier blocks: one carry row with the totals so far, and
    copies of the last rows that row frames and day frames can still reach. Those helper rows
    are dropped afterwards; the result equals the plain windows exactly.
    """
    reach = max((f.rows for f in frames if f.rows is not None), default=0)
    longest = max((f.days for f in frames if f.days is not None), default=0)
    if longest > blocks.width:
        raise ValueError("block width must cover the longest day frame")
    key, block = spec.key, blocks.column
    rows = df.withColumn(block, blocks.of(spec.date))

    totals = rows.groupBy(*key, block).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(f"_t_{m}") for m in metrics]
    )
    by_block = Window.partitionBy(*key).orderBy(block)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *key,
        block,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before_n"),
        *[F.sum(f"_t_{m}").over(before).alias(f"_before_{m}") for m in metrics],
    )

    # Rows of earlier blocks that a row frame of this block can still reach. A block has at
    # least one row, so they lie within the ``reach`` previous non-empty blocks.
    newest = Window.partitionBy(*key, block).orderBy(F.desc(spec.date), F.desc(spec.game))
    tails = (
        rows.select(*key, block, spec.date, spec.game, *metrics)
        .withColumn("_from_end", F.row_number().over(newest))
        .where(F.col("_from_end") <= max(reach, 1))
    )
    next_blocks = F.collect_list(F.col(block)).over(by_block.rowsBetween(1, max(reach, 1)))
    later = totals.select(*key, block, next_blocks.alias("_next")).select(
        *key, block, F.explode("_next").alias("_into")
    )
    row_halo = tails.join(later, [*key, block]).withColumn(block, F.col("_into"))
    nearest = Window.partitionBy(*key, block).orderBy(F.desc(spec.date), F.desc(spec.game))
    row_halo = (
        row_halo.withColumn("_back", F.row_number().over(nearest))
        .where(F.col("_back") <= reach)
        .select(*key, block, spec.date, spec.game, *metrics, F.lit(1).alias("_kind"))
    )
    # Rows of the previous block that a day frame can reach.
    day_halo = rows.where(
        F.lit(longest > 0)
        & (F.unix_date(F.col(spec.date)) >= (F.col(block) + 1) * blocks.width - longest)
    ).select(
        *key, (F.col(block) + 1).alias(block), spec.date, spec.game, *metrics, F.lit(2).alias("_kind")
    )
    staged = rows.withColumn("_kind", F.lit(0)).join(
        carries, [*key, block], "left"
    )
    everything = staged.unionByName(row_halo, allowMissingColumns=True).unionByName(
        day_halo, allowMissingColumns=True
    )

    inside = Window.partitionBy(*key, block)
    own, near_rows, near_days = F.col("_kind") == 0, F.col("_kind") <= 1, F.col("_kind") != 1
    ordered = inside.orderBy(spec.date, spec.game)
    # Copies of either kind sort before the block's own rows, so a row's own block position
    # is counted over own rows only and row frames run in a partition without day copies.
    columns: dict[str, Column] = {}
    row_part = Window.partitionBy(*key, block, "_rows_side").orderBy(spec.date, spec.game)
    day_keys = ", ".join(f"`{c}`" for c in (*key, block, "_days_side"))
    for frame in frames:
        if frame.days is not None:
            over = days_before(day_keys, spec.date, frame.days)
            columns |= {f"{frame.name}_{m}": F.expr(f"sum(`{m}`) over {over}") for m in metrics}
            columns[f"{frame.name}_history_starts"] = F.expr(f"nullif(count(1) over {over}, 0)")
        elif frame.rows is not None:
            window = row_part.rowsBetween(-frame.rows, -1)
            columns |= {f"{frame.name}_{m}": F.sum(m).over(window) for m in metrics}
            columns[f"{frame.name}_history_starts"] = F.count(F.lit(1)).over(window)
        else:
            window = ordered.rowsBetween(Window.unboundedPreceding, -1)
            for m in metrics:
                local = F.sum(F.when(own, F.col(m))).over(window)
                columns[f"{frame.name}_{m}"] = F.when(
                    local.isNotNull() | F.col(f"_before_{m}").isNotNull(),
                    F.coalesce(local, F.lit(0)) + F.coalesce(F.col(f"_before_{m}"), F.lit(0)),
                )
            columns[f"{frame.name}_history_starts"] = (
                F.coalesce(F.sum(flag(own)).over(window), F.lit(0)) + F.col("_before_n")
            )
    helper = [block, "_kind", "_rows_side", "_days_side", "_before_n"]
    helper += [f"_before_{m}" for m in metrics]
    return (
        everything.withColumns({"_rows_side": near_rows, "_days_side": near_days})
        .withColumns(columns)
        .where(own)
        .drop(*helper)
    )
