"""From one row per pitch to one row per entity and game.

The raw table is the only large input, so each step aggregates it with map-side partial
sums before anything is shuffled, and joins happen on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import flag, lookup

GAME = ("game_id", "game_date")
ENTITY = "pitcher_mlbam_id"

# Additive counts of one pitch, by output name.
COUNTS = (
    "pitches", "bf_metric", "k_count", "bb_count", "hits_count", "strike_count",
    "called_strike_count", "whiff_count", "csw_count", "swing_count", "contact_count",
    "zone_pitch_count", "zone_swing_count", "zone_contact_count", "chase_swing_count",
    "chase_pitch_count",
)
FIRST_PITCH_COUNTS = ("first_pitch_strike_count", "first_pitch_pa_count")
VELOCITY = ("velocity_sum", "velocity_count")
ENTITY_METRICS = COUNTS + FIRST_PITCH_COUNTS + VELOCITY
CATEGORY_METRICS = (
    "pitch_count", "velocity_sum", "velocity_count", "whiff_count", "strike_count", "csw_count",
)
TEAM_METRICS = (
    "team_bf", "k_count", "bb_count", "pitches", "whiff_count", "swing_count", "contact_count",
    "chase_swing_count", "chase_pitch_count",
)


def _any_of(column: str, codes: Sequence[str]) -> str:
    return f"{column} in ({', '.join(repr(c) for c in codes)})"


PITCH = f"(pitch_number is not null and not (description <=> '{K.NOT_A_PITCH}'))"
IN_ZONE = f"(zone between {K.ZONE_RANGE[0]} and {K.ZONE_RANGE[1]})"
SWING = _any_of("description", K.SWING_CODES)
CONTACT = _any_of("description", K.CONTACT_CODES)
WHIFF = _any_of("description", K.WHIFF_CODES)
CALLED = f"description = '{K.CALLED_STRIKE}'"
FLAG_RULES = {
    "pitches": PITCH,
    "bf_metric": f"events <> '{K.TRUNCATED_EVENT}'",
    "k_count": _any_of("events", K.STRIKEOUT_EVENTS),
    "bb_count": _any_of("events", K.WALK_EVENTS),
    "hits_count": _any_of("events", K.HIT_EVENTS),
    "strike_count": f"{PITCH} and {_any_of('description', K.STRIKE_CODES)}",
    "called_strike_count": f"{PITCH} and {CALLED}",
    "whiff_count": f"{PITCH} and {WHIFF}",
    "csw_count": f"{PITCH} and ({CALLED} or {WHIFF})",
    "swing_count": f"{PITCH} and {SWING}",
    "contact_count": f"{PITCH} and {CONTACT}",
    "zone_pitch_count": f"{PITCH} and {IN_ZONE}",
    "zone_swing_count": f"{PITCH} and {IN_ZONE} and {SWING}",
    "zone_contact_count": f"{PITCH} and {IN_ZONE} and {CONTACT}",
    "chase_swing_count": f"{PITCH} and not {IN_ZONE} and {SWING}",
    "chase_pitch_count": f"{PITCH} and not {IN_ZONE}",
    "velocity_count": f"{PITCH} and release_speed is not null",
}
SPEED = f"case when {PITCH} then coalesce(cast(release_speed as double), 0.0D) else 0.0D end"


def row_flag(name: str) -> Column:
    """A row flag. A missing code or zone makes it 0; a missing description is a pitch."""
    if name == "velocity_sum":
        return F.expr(SPEED)
    return F.expr(f"case when {FLAG_RULES[name]} then 1L else 0L end")


def flag_columns(names: Sequence[str] = (*COUNTS, *VELOCITY)) -> dict[str, Column]:
    return {name: row_flag(name) for name in names}


def event_flags(pitches: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Row flags next to the kept columns, in one projection."""
    return pitches.select(*keep, *[c.alias(n) for n, c in flag_columns().items()])


def first_in_group(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Marks every row that carries the lowest value of its group.

    The group must be small by nature (one at-bat), which spreads a busy entity over as many
    tasks as it has at-bats.
    """
    lowest = F.min(value).over(Window.partitionBy(*group))
    return df.withColumn(name, flag(F.col(value) == lowest))


def _first_pitch_flags(pitches: DataFrame) -> DataFrame:
    marked = first_in_group(
        pitches, ["game_id", ENTITY, "at_bat_number"], "pitch_number", "first_in_at_bat"
    )
    first = F.col("first_in_at_bat") == 1
    # A row whose at-bat is unknown belongs to no group and is never first.
    first = first & F.col("at_bat_number").isNotNull()
    return marked.withColumns(
        {
            "first_pitch_strike_count": flag(first & F.col("description").isin(*K.STRIKE_CODES)),
            "first_pitch_pa_count": flag(first & F.col("pitch_number").isNotNull()),
        }
    )


def _summed(df: DataFrame, keys: Sequence[str], names: Sequence[str], extra=None) -> DataFrame:
    """Sums flags per key; rows with a missing key part are dropped."""
    extra = extra or {}
    flags = flag_columns([n for n in names if n not in extra]) | extra
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(*[F.sum(flags[n]).alias(n) for n in names])


def entity_game_metrics(pitches: DataFrame) -> DataFrame:
    """The additive metrics of each entity in each game."""
    extra = {n: F.col(n) for n in FIRST_PITCH_COUNTS}
    return _summed(_first_pitch_flags(pitches), [*GAME, ENTITY], ENTITY_METRICS, extra).withColumn(
        "season", F.year("game_date").cast("bigint")
    )


def category_game_metrics(pitches: DataFrame) -> DataFrame:
    """Category use of each entity in each game; rows without a category are left out."""
    flags = ("pitches", *CATEGORY_METRICS[1:])
    return (
        _summed(pitches, [*GAME, ENTITY, "pitch_type"], flags)
        .withColumnRenamed("pitches", "pitch_count")
        .withColumn("season", F.year("game_date").cast("bigint"))
    )


def entity_games(
    pitches: DataFrame, weights: Mapping[str, Column], totals: Mapping[str, Column], anywhere: Mapping[str, Column]
) -> DataFrame:
    """Everything counted per entity and game in one aggregate: one row per (season, game_date, game_id, entity).

    Gives the metrics of ``entity_game_metrics``, those of ``category_game_metrics`` as ``<metric>_<category>``, the at-bats
    without a truncated row (``batters_faced``), sums of ``totals`` and whether ``anywhere`` holds in some row. ``weights``
    says how often a row counts for each category. Pitches are dealt once by (game, entity), which a game keeps small; the
    window over at-bats and the aggregate use that deal, and no category becomes a row. Where a key is missing the
    metrics are 0, as for rows that find no partner in a join.
    """
    keys = ["season", "game_date", "game_id", ENTITY]
    flags = flag_columns() | {
        "_strike": flag(F.col("description").isin(*K.STRIKE_CODES)),
        "_cut": flag(F.coalesce(F.col("events") == K.TRUNCATED_EVENT, F.lit(False))),
    }
    # Flags are made before the deal: with window, flags and sums in one step its code is too long to be compiled.
    rows = pitches.select(
        *keys, "at_bat_number", "pitch_number", *[c.alias(n) for n, c in flags.items()], *[c.alias(f"_total_{n}") for n, c in totals.items()],
        *[c.alias(f"_any_{n}") for n, c in anywhere.items()], *[F.coalesce(w, F.lit(0)).alias(f"_weight_{c}") for c, w in weights.items()],
    ).repartition("game_id", ENTITY)
    at_bat = Window.partitionBy("game_id", ENTITY, "at_bat_number").orderBy(F.col("pitch_number").asc_nulls_last())
    whole = at_bat.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.withColumns(
        {
            "_lowest": F.min("pitch_number").over(whole),
            "_truncated": F.max("_cut").over(whole),
            "_place": F.row_number().over(at_bat),
        }
    )
    first = (F.col("pitch_number") == F.col("_lowest")) & F.col("at_bat_number").isNotNull()
    sums = {m: F.sum(m) for m in (*COUNTS, *VELOCITY)}
    sums |= {"first_pitch_strike_count": F.sum(F.when(first, F.col("_strike")).otherwise(F.lit(0).cast("bigint"))), "first_pitch_pa_count": F.count_if(first)}
    for c in weights:
        weight = F.col(f"_weight_{c}")
        sums |= {f"{m}_{c}": F.sum(F.when(weight > 0, F.col("pitches" if m == "pitch_count" else m) * weight)) for m in CATEGORY_METRICS}
    counted = marked.groupBy(*keys).agg(
        *[v.alias(n) for n, v in sums.items()], F.count_if((F.col("_place") == 1) & (F.col("_truncated") == 0)).alias("batters_faced"),
        *[F.sum(f"_total_{n}").alias(n) for n in totals], *[F.bool_or(f"_any_{n}").alias(n) for n in anywhere],
    )
    known = null_free_and([F.col(k).isNotNull() for k in keys])
    return counted.withColumns({n: F.coalesce(F.when(known, F.col(n)), F.lit(0)) for n in sums})


def batting_team() -> Column:
    """Top half: the away team bats. Anything else, also unknown: the home team."""
    top = F.lower(F.col("inning_topbot").cast("string")).eqNullSafe(F.lit("top"))
    return F.when(top, F.col("away_team")).otherwise(F.col("home_team"))


def team_hand_metrics(pitches: DataFrame, team: str = "team") -> DataFrame:
    """Metrics of the batting team in each game against each pitching hand."""
    keyed = pitches.withColumnRenamed("p_throws", "opponent_hand")
    names = ["bf_metric" if n == "team_bf" else n for n in TEAM_METRICS]
    return (
        _summed(keyed, [*GAME, team, "opponent_hand"], names)
        .withColumnRenamed("bf_metric", "team_bf")
        .withColumn("season", F.year("game_date").cast("bigint"))
    )


def event_outs(event: str = "events") -> Column:
    return lookup(K.EVENT_OUTS, event, 0).cast("bigint")


def in_order(order: Sequence[str]) -> Column:
    """Sort key of the columns with missing values last."""
    return F.struct(*[part for c in order for part in (F.isnull(c).alias(f"no_{c}"), F.col(c))])


def first_actor(
    pitches: DataFrame, group: Sequence[str], order: Sequence[str], actor: str
) -> DataFrame:
    """First known actor of each group in order: a partial aggregate, no sort of the group.

    Rows with a missing position come last; of actors at one position the smallest is taken.
    """
    return (
        pitches.where(F.col(actor).isNotNull())
        .groupBy(*group)
        .agg(F.min(F.struct(in_order(order).alias("at"), F.col(actor).alias("who")))["who"].alias(actor))
    )


def keep_first_actor_rows(
    pitches: DataFrame, group: Sequence[str], order: Sequence[str], actor: str
) -> DataFrame:
    """Rows of each group's first actor. Missing group parts equal each other."""
    starters = first_actor(pitches, group, order, actor).select(
        *[F.col(c).alias(f"_first_{c}") for c in (*group, actor)]
    )
    matched = [F.col(c).eqNullSafe(F.col(f"_first_{c}")) for c in group]
    matched.append(F.col(actor) == F.col(f"_first_{actor}"))
    condition = matched[0]
    for part in matched[1:]:
        condition = condition & part
    return pitches.join(starters, condition, "left_semi")


def semi_join_keys(pitches: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return pitches.join(keys.select(*on), list(on), "left_semi")


def distinct_excluding_marked(
    df: DataFrame, keys: Sequence[str], item: str, marked: Column, name: str
) -> DataFrame:
    """Items per key, not counting any item that holds a marked row."""
    items = df.groupBy(*keys, item).agg(
        F.bool_or(F.coalesce(marked, F.lit(False))).alias("marked")
    )
    return items.groupBy(*keys).agg(
        F.count_if(~F.col("marked") & F.col(item).isNotNull()).alias(name)
    )


def inning_reconciliation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outs per key: credited outs plus those missing from innings known to be complete.

    Every inning but the key's last one is complete; when it started with no outs and fewer
    than three were credited, the rest is added.
    """
    innings = df.groupBy(*keys, "inning").agg(
        F.sum(event_outs()).alias("outs"), F.min("outs_when_up").alias("outs_at_start")
    )
    last = F.max("inning").over(Window.partitionBy(*keys))
    gap = F.when(
        (F.col("inning") < last) & (F.col("outs_at_start") == 0) & (F.col("outs") < 3),
        3 - F.col("outs"),
    ).otherwise(0)
    return (
        innings.withColumn("inferred", gap)
        .groupBy(*keys)
        .agg(
            F.sum("outs").alias("explicit_outs"),
            F.sum("inferred").alias("inferred_outs"),
            F.sum(F.col("outs") + F.col("inferred")).alias("outs_recorded"),
        )
    )


def score_delta(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Highest minus first known score, never negative; NULL when no score is known."""
    known = F.col(score).isNotNull()
    position = F.when(known, in_order(order))
    return df.groupBy(*keys).agg(
        non_negative(F.max(score) - F.min_by(F.col(score), position)).alias("runs")
    )


def non_negative(difference: Column) -> Column:
    """At least 0; NULL stays NULL, which ``greatest`` alone would turn into 0."""
    return F.when(difference.isNotNull(), F.greatest(F.lit(0), difference)).cast("bigint")


def appearance_table(
    pitches: DataFrame, order: Sequence[str] = ("at_bat_number", "pitch_number")
) -> DataFrame:
    """One row per game side for the pitcher who threw its first pitch (the smallest id of several).

    Pitches collapse to at-bats first; the starter of a side is then chosen among the few
    aggregated pitchers of that side, so the raw rows are never joined.
    """
    keys = ["game_id", "inning_topbot", ENTITY]
    side = F.lower(F.col("inning_topbot").cast("string"))
    score = F.when(side == "top", F.col("post_away_score")).otherwise(F.col("post_home_score"))
    thrown = row_flag("pitches")
    # The earliest row and the earliest scored row, each as one value ordered by position.
    position = in_order(order).alias("at")
    details = F.struct("game_date", "player_name", "home_team", "away_team", "p_throws").alias("row")
    scored = F.when(score.isNotNull(), F.struct(position, score.alias("score")))
    at_bats = pitches.groupBy(*keys, "at_bat_number").agg(
        F.min(F.struct(position, details)).alias("first"),
        F.sum(thrown).alias("pitches_thrown"),
        F.sum(flag(F.col("events").isin(*K.STRIKEOUT_EVENTS))).alias("strikeouts"),
        F.sum(flag(F.col("events").isin(*K.HIT_EVENTS))).alias("hits"),
        F.sum(flag(F.col("events").isin(*K.WALK_EVENTS))).alias("walks"),
        F.count(F.lit(1)).alias("source_rows"),
        F.bool_or(F.coalesce(F.col("events") == K.TRUNCATED_EVENT, F.lit(False))).alias("truncated"),
        F.max(score).alias("top_score"),
        F.min(scored).alias("first_score"),
    )
    people = at_bats.groupBy(*keys).agg(
        F.min("first").alias("first"),
        *[F.sum(c).alias(c) for c in ("pitches_thrown", "strikeouts", "hits", "walks", "source_rows")],
        F.count_if(~F.col("truncated") & F.col("at_bat_number").isNotNull()).alias("batters_faced"),
        non_negative(F.max("top_score") - F.min("first_score")["score"]).alias("runs"),
    )
    starters = people.where(F.col(ENTITY).isNotNull()).withColumn(
        "is_first",
        F.struct("first.at", ENTITY)
        == F.min(F.struct("first.at", ENTITY)).over(Window.partitionBy("game_id", "inning_topbot")),
    ).where("is_first")
    outs = inning_reconciliation(pitches, keys).select(
        *[F.col(c).alias(f"o_{c}") for c in keys], "outs_recorded"
    )
    same = null_free_and([F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in keys])
    home = F.coalesce(side == "top", F.lit(False))
    return starters.join(outs, same, "left").select(
        F.to_date("first.row.game_date").alias("game_date"),
        "game_id",
        ENTITY,
        F.col("first.row.player_name").alias("pitcher_name"),
        F.when(home, F.col("first.row.home_team")).otherwise(F.col("first.row.away_team")).alias("team"),
        F.when(home, F.col("first.row.away_team")).otherwise(F.col("first.row.home_team")).alias("opponent"),
        F.when(home, "home").otherwise("away").alias("home_away"),
        F.col("first.row.p_throws").alias("pitcher_handedness"),
        "pitches_thrown", "batters_faced", "strikeouts", "outs_recorded", "hits", "walks", "runs",
        "source_rows",
        F.lit(K.OUTS_METHOD).alias("outs_method"),
    )


def null_free_and(conditions: Sequence[Column]) -> Column:
    combined = conditions[0]
    for condition in conditions[1:]:
        combined = combined & condition
    return combined


