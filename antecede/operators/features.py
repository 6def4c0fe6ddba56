"""The wide feature table: entity history, category mix and opponent history per appearance.

Categories and hands are pivoted to columns before any window runs. A dense scaffold of
(appearance x category) rows would multiply the rows by the number of categories and need its
own shuffle; as columns the same zero-filled history shares the entity's single sort.
The scaffold form is kept as an operator of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import flag
from antecede.operators import events as E
from antecede.operators import history as H
from antecede.operators.quality import QualityError, require_columns, require_zero
from antecede.session import stage

KEYS = ("season", "game_date", "game_id", "pitcher_mlbam_id")
TEAM_KEYS = ("season", "game_date", "game_id", "team")
SPEC = H.Spec()
TEAM_SPEC = H.Spec(entity=("team",))
LEAKED = ("hits", "walks", "runs", "source_rows", "outs_method")


@dataclass(frozen=True)
class FeatureConfig:
    frames: tuple[H.Frame, ...] = H.DEFAULT_FRAMES
    categories: tuple[str, ...] = K.PITCH_TYPES
    hands: tuple[str, ...] = K.HANDS
    minimum: int = 3


# --- joins and scaffolds ------------------------------------------------------------------

def left_join_zero_fill(
    left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Left join whose joined columns are 0 where nothing matched."""
    return left.join(right, list(on), "left").fillna(0, list(columns))


def dense_scaffold(df: DataFrame, keys: Sequence[str], name: str, values: Sequence) -> DataFrame:
    """Every distinct key with every value of a short fixed list."""
    return df.select(*keys).distinct().withColumn(
        name, F.explode(F.array(*[F.lit(v) for v in values]))
    )


def category_history(
    appearances: DataFrame, type_metrics: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """Prior and prior-3 sums per appearance and category in long form."""
    keys = [*KEYS, "pitch_type"]
    dense = left_join_zero_fill(
        dense_scaffold(appearances, KEYS, "pitch_type", categories),
        type_metrics.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in E.CATEGORY_METRICS]),
        keys,
        E.CATEGORY_METRICS,
    )
    spec = H.Spec(entity=("pitcher_mlbam_id",), period=("season", "pitch_type"))
    columns = H.prior_sums(H.Frame("prior"), spec, E.CATEGORY_METRICS)
    columns |= H.prior_sums(H.Frame("prior3", rows=3), spec, E.CATEGORY_METRICS)
    return dense.withColumns(columns).select(*keys, *columns)


def quoted(value: str) -> str:
    """Text usable between single quotes in SQL."""
    return str(value).replace("\\", "\\\\").replace("'", "\\'")


def category_pivot(
    long: DataFrame, keys: Sequence[str], metrics: Sequence[str], categories: Sequence[str],
    category: str = "pitch_type",
) -> DataFrame:
    """Wide form over a fixed category list: ``<metric>_<category>``; one partial aggregate."""
    return long.groupBy(*keys).agg(
        *[
            F.expr(f"sum(case when `{category}` = '{quoted(c)}' then `{m}` end) as `{m}_{c}`")
            for c in categories
            for m in metrics
        ]
    )


CATEGORY_FEATURES = (
    "usage", "velocity", "whiff_rate", "strike_rate", "csw_rate", "usage_change_vs_season",
    "velocity_change_vs_season", "insufficient_history",
)


def category_columns(category: str, total: str, recent_total: str) -> dict[str, Column]:
    """Rates of one category from its prior and prior-3 sums, as one expression each."""

    def prior(metric: str) -> str:
        return f"coalesce(`prior_{metric}_{category}`, 0)"

    def recent(metric: str) -> str:
        return f"`prior3_{metric}_{category}`"

    usage = H.ratio(prior("pitch_count"), total)
    velocity = H.ratio(prior("velocity_sum"), prior("velocity_count"))
    recent_usage = H.ratio(f"coalesce({recent('pitch_count')}, 0)", recent_total)
    recent_velocity = H.ratio(recent("velocity_sum"), recent("velocity_count"))
    values = (
        usage,
        velocity,
        H.ratio(prior("whiff_count"), prior("pitch_count")),
        H.ratio(prior("strike_count"), prior("pitch_count")),
        H.ratio(prior("csw_count"), prior("pitch_count")),
        f"({recent_usage}) - ({usage})",
        f"({recent_velocity}) - ({velocity})",
        f"case when {prior('pitch_count')} < {K.CATEGORY_MIN_SAMPLE} then 1L else 0L end",
    )
    return {
        f"pitch_{category}_{suffix}": F.expr(text) for suffix, text in zip(CATEGORY_FEATURES, values)
    }


# --- entity part ----------------------------------------------------------------------------

def with_game_metrics(
    appearances: DataFrame,
    pitcher_metrics: DataFrame,
    type_metrics: DataFrame | None,
    config: FeatureConfig,
) -> DataFrame:
    """Appearances with this game's entity and category metrics, zero where nothing was seen."""
    metrics = pitcher_metrics.select(*KEYS, *E.ENTITY_METRICS)
    frame = left_join_zero_fill(appearances, metrics, KEYS, E.ENTITY_METRICS)
    # Credited outs follow the entity metrics: absent metrics mean no outs in the history.
    if "outs_history" not in frame.columns:
        frame = frame.withColumn("outs_history", F.coalesce(F.col("outs_recorded"), F.lit(0)))
    if type_metrics is not None:
        wide = category_pivot(type_metrics, KEYS, E.CATEGORY_METRICS, config.categories)
        names = [c for c in wide.columns if c not in KEYS]
        frame = left_join_zero_fill(frame, wide, KEYS, names)
    return frame


def entity_features(frame: DataFrame, config: FeatureConfig, categories: bool) -> DataFrame:
    """All windows of the entity on one exchange and one sort, then the rates."""
    frame = frame.withColumns(
        {
            "pitcher_days_rest": H.days_since_previous(SPEC),
            "pitches_previous_start": H.previous_value(SPEC, "pitches_thrown"),
        }
    )
    row_columns: dict[str, Column] = {
        "pitches_median_before_game": H.expanding_median(SPEC, "pitches_thrown"),
        "pitcher_starts_before_game": H.prior_count(SPEC),
        **{
            f"starts_reaching_{t}_before_game": H.prior_at_least(SPEC, "pitches_thrown", t)
            for t in K.WORKLOAD_THRESHOLDS
        },
    }
    if categories:
        names = [f"{m}_{c}" for c in config.categories for m in E.CATEGORY_METRICS]
        names.append("pitches_thrown")
        row_columns |= H.prior_sums(H.Frame("prior"), SPEC, names)
        row_columns |= H.prior_sums(H.Frame("prior3", rows=3), SPEC, names)
    for window in [f for f in config.frames if f.days is None]:
        row_columns |= H.prior_sums(window, SPEC, H.RATE_METRICS)
        row_columns[f"{window.name}_history_starts"] = H.prior_starts(window, SPEC)
    frame = frame.withColumns(row_columns)
    frame = H.with_prior(
        frame, SPEC, [f for f in config.frames if f.days is not None], H.RATE_METRICS
    )

    return entity_rates(frame, config, categories)


def entity_rates(frame: DataFrame, config: FeatureConfig, categories: bool) -> DataFrame:
    """Rates and indicators from the sums of every frame, and the trend over them."""
    rates: dict[str, Column] = {}
    for window in config.frames:
        rates |= H.rate_columns(window, config.minimum)
    rates |= {"month": H.month_of("game_date"), "home_indicator": H.indicator("home_away", "home")}
    if categories:
        for c in config.categories:
            rates |= category_columns(c, "prior_pitches_thrown", "prior3_pitches_thrown")
    frame = frame.withColumns(rates)
    if any(f.name == "last3" for f in config.frames):
        frame = frame.withColumn(
            "workload_trend_last3_vs_prior3", H.trend(SPEC, "last3_pitches_per_start")
        )
    return frame


def entity_feature_names(config: FeatureConfig, categories: bool) -> list[str]:
    names = []
    for window in config.frames:
        names += [f"{window.name}_{suffix}" for suffix, *_ in H.RATES]
        names += [f"{window.name}_history_starts", f"{window.name}_insufficient_history"]
    names += [
        "pitches_median_before_game", "pitcher_days_rest", "pitcher_starts_before_game", "month",
        "home_indicator", "pitches_previous_start",
        *[f"starts_reaching_{t}_before_game" for t in K.WORKLOAD_THRESHOLDS],
    ]
    if any(f.name == "last3" for f in config.frames):
        names.append("workload_trend_last3_vs_prior3")
    if categories:
        names += [f"pitch_{c}_{suffix}" for c in config.categories for suffix in CATEGORY_FEATURES]
    return names


def arsenal_features(
    appearances: DataFrame, type_metrics: DataFrame, config: FeatureConfig
) -> DataFrame:
    """Only the category columns of the feature table, per appearance."""
    wide = category_pivot(type_metrics, KEYS, E.CATEGORY_METRICS, config.categories)
    names = [c for c in wide.columns if c not in KEYS]
    frame = left_join_zero_fill(
        appearances.select(*KEYS, "pitches_thrown"), wide, KEYS, names
    )
    columns: dict[str, Column] = {}
    for window in (H.Frame("prior"), H.Frame("prior3", rows=3)):
        columns |= H.prior_sums(window, SPEC, [*names, "pitches_thrown"])
    frame = frame.withColumns(columns)
    rates: dict[str, Column] = {}
    for c in config.categories:
        rates |= category_columns(c, "prior_pitches_thrown", "prior3_pitches_thrown")
    return frame.select(*KEYS, *[value.alias(name) for name, value in rates.items()])


# --- opponent part --------------------------------------------------------------------------

def team_games(
    appearances: DataFrame, team_metrics: DataFrame, hands: Sequence[str]
) -> DataFrame:
    """One row per opposing team and game with zero-filled metrics per hand as columns."""
    games = appearances.select(
        "season", "game_date", "game_id", F.col("opponent").alias("team")
    ).distinct()
    wide = category_pivot(team_metrics, TEAM_KEYS, E.TEAM_METRICS, hands, "opponent_hand")
    names = [f"{m}_{h}" for h in hands for m in E.TEAM_METRICS]
    dense = left_join_zero_fill(games, wide, TEAM_KEYS, names)
    overall = {m: F.expr(" + ".join(f"`{m}_{h}`" for h in hands)) for m in E.TEAM_METRICS}
    observed = {f"observed_{h}": flag(F.col(f"team_bf_{h}") > 0) for h in hands}
    return dense.withColumns(overall | observed)


def team_history(games: DataFrame, hands: Sequence[str]) -> DataFrame:
    """Prior sums of each team, overall and by hand, and how many prior games there were."""
    names = [*E.TEAM_METRICS, *[f"{m}_{h}" for h in hands for m in E.TEAM_METRICS]]
    before = TEAM_SPEC.in_period().rowsBetween(Window.unboundedPreceding, -1)
    columns = H.prior_sums(H.Frame("prior"), TEAM_SPEC, names)
    columns["prior_games"] = H.prior_count(TEAM_SPEC)
    for h in hands:
        columns[f"prior_games_{h}"] = F.coalesce(
            F.sum(f"observed_{h}").over(before), F.lit(0)
        )
    return games.withColumns(columns).select(*TEAM_KEYS, *columns)


def opponent_columns(hands: Sequence[str], minimum: int) -> dict[str, Column]:
    """Overall rates treat a missing history as zero; rates by hand keep it missing."""

    def overall(top: str, bottom: str) -> Column:
        return F.expr(H.ratio(f"coalesce(prior_{top}, 0)", f"coalesce(prior_{bottom}, 0)"))

    columns = {
        "opponent_team_k_pct": overall("k_count", "team_bf"),
        "opponent_team_bb_pct": overall("bb_count", "team_bf"),
        "opponent_team_swstr_pct": overall("whiff_count", "pitches"),
        "opponent_team_contact_pct": overall("contact_count", "swing_count"),
        "opponent_team_chase_pct": overall("chase_swing_count", "chase_pitch_count"),
        "opponent_team_history_games": F.col("prior_games"),
        "opponent_team_insufficient_history": F.expr(
            f"case when coalesce(prior_games, 0) < {minimum} then 1L else 0L end"
        ),
    }
    for h in hands:
        columns |= {
            f"opponent_k_pct_vs_{h}HP": F.expr(H.ratio(f"`prior_k_count_{h}`", f"`prior_team_bf_{h}`")),
            f"opponent_contact_pct_vs_{h}HP": F.expr(
                H.ratio(f"`prior_contact_count_{h}`", f"`prior_swing_count_{h}`")
            ),
            f"opponent_{h}_history_games": F.col(f"prior_games_{h}"),
        }
    return columns


def opponent_feature_names(hands: Sequence[str]) -> list[str]:
    names = [f"opponent_team_{n}_pct" for n in ("k", "bb", "swstr", "contact", "chase")]
    names += ["opponent_team_history_games", "opponent_team_insufficient_history"]
    for h in hands:
        names += [f"opponent_k_pct_vs_{h}HP", f"opponent_contact_pct_vs_{h}HP", f"opponent_{h}_history_games"]
    return names


def opponent_features(
    appearances: DataFrame, team_metrics: DataFrame, hands: Sequence[str], minimum: int
) -> DataFrame:
    """One row per opposing team and game, keyed by the opponent's name."""
    history = team_history(team_games(appearances, team_metrics, hands), hands)
    columns = opponent_columns(hands, minimum)
    return history.select(
        "season", "game_date", "game_id", F.col("team").alias("opponent"),
        *[c.alias(n) for n, c in columns.items()],
    )


# --- whole table ------------------------------------------------------------------------------

REQUIRED = (
    "season", "game_date", "game_id", "pitcher_mlbam_id", "opponent", "home_away",
    "pitcher_handedness", *K.TARGETS,
)


def feature_table(
    appearances: DataFrame,
    pitcher_metrics: DataFrame,
    type_metrics: DataFrame | None = None,
    team_metrics: DataFrame | None = None,
    config: FeatureConfig = FeatureConfig(),
) -> DataFrame:
    """One leak-free row per appearance: context, features, then the targets."""
    require_columns(appearances, REQUIRED, "appearances")
    context = [c for c in appearances.columns if c not in LEAKED and c not in K.TARGETS]
    frame = with_game_metrics(appearances.drop(*LEAKED), pitcher_metrics, type_metrics, config)
    opponents = None
    if team_metrics is not None:
        opponents = opponent_features(appearances, team_metrics, config.hands, config.minimum)
    return feature_table_of_games(frame, context, opponents, config, type_metrics is not None)


def feature_table_of_games(
    games: DataFrame, context: Sequence[str], opponents: DataFrame | None,
    config: FeatureConfig = FeatureConfig(), categories: bool = True,
) -> DataFrame:
    """``feature_table`` from rows as ``with_game_metrics`` and ``opponent_features`` give them. Where opponents are written,
    their known size spares the wide rows a shuffle."""
    frame = entity_features(games, config, categories)
    names = entity_feature_names(config, categories)
    frame = frame.select(*context, *names, *K.TARGETS)
    if opponents is not None:
        frame = frame.join(opponents, ["season", "game_date", "game_id", "opponent"], "left")
        names += opponent_feature_names(config.hands)
    return frame.select(*context, *names, *K.TARGETS)


def feature_table_from_pitches(
    pitches: DataFrame, appearances: DataFrame, config: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """Metrics and features in one lazy plan."""
    starters = E.semi_join_keys(
        pitches, appearances.select("game_id", "pitcher_mlbam_id"), ["game_id", "pitcher_mlbam_id"]
    )
    teams = pitches.withColumn("team", E.batting_team()) if "team" not in pitches.columns else pitches
    return feature_table(
        appearances,
        E.entity_game_metrics(starters),
        E.category_game_metrics(starters),
        E.team_hand_metrics(teams),
        config,
    )


def require_frozen_schema(df: DataFrame, frozen: Sequence[str]) -> DataFrame:
    """The features a fitted model was trained on must all be present."""
    missing = [c for c in frozen if c not in df.columns]
    if missing:
        raise QualityError(f"missing {len(missing)} frozen features: {missing[:20]}")
    return df


# --- forward and pre-event builds ----------------------------------------------------------

TREND_GAMES = 3
SOURCE_RANK = ("historical", "completed", "scheduled")


def union_sources(**sources: DataFrame) -> DataFrame:
    """Union by name; columns a source lacks are NULL. ``source_rank`` follows SOURCE_RANK."""
    out = None
    for rank, name in enumerate(SOURCE_RANK):
        if name in sources:
            part = sources[name].withColumn("source_rank", F.lit(rank).cast("bigint"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in order; an aggregate, so a hot key is combined map-side."""
    others = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*").select(*df.columns)


def forward_features(
    history: DataFrame,
    season_appearances: DataFrame,
    pitches: DataFrame,
    season: int,
    config: FeatureConfig = FeatureConfig(),
    frozen: Sequence[str] = (),
) -> DataFrame:
    """Features of one new season. Earlier appearances only feed the cross-season windows."""
    both = union_sources(historical=history, completed=season_appearances).drop("source_rank")
    features = feature_table_from_pitches(
        pitches.where(F.col("season") == season), both, config
    ).where(F.col("season") == season)
    return require_frozen_schema(features, frozen)


def pre_event_features(
    historical: DataFrame,
    completed: DataFrame,
    scheduled: DataFrame,
    pitches: DataFrame,
    slate_date,
    config: FeatureConfig = FeatureConfig(),
) -> DataFrame:
    """Feature rows of scheduled appearances whose targets are still unknown.

    ``pitches`` may hold the completed games only; anything on or after the slate date is cut. Appearances are combined once and
    written; only games that a feature of the slate depends on are counted and given windows.
    """
    slate = F.lit(slate_date).cast("date")
    combined = keep_last(
        union_sources(
            historical=historical,
            completed=completed.where(F.col("game_date") < slate),
            scheduled=scheduled,
        ),
        ["game_id", "pitcher_mlbam_id"],
        ["game_date", "source_rank"],
    ).drop("source_rank")
    asked = scheduled.select("game_id", "pitcher_mlbam_id").distinct().withColumn("_asked", F.lit(True))
    marked = stage(combined.join(asked, ["game_id", "pitcher_mlbam_id"], "left").withColumn(
        "_asked", F.coalesce(F.col("_asked") & (F.col("game_date") == slate), F.lit(False))
    ), "combined")
    reached = stage(rows_in_reach(marked, config), "reached")
    games = stage(reached.select("game_id").distinct(), "games-in-reach")
    own = pitches.where(F.col("game_date") < slate).join(games, "game_id", "left_semi")
    features = feature_table_from_pitches(own, reached.drop("_asked"), config)
    return features.join(
        reached.where("_asked").select("game_id", "pitcher_mlbam_id"), ["game_id", "pitcher_mlbam_id"], "left_semi"
    )


def rows_in_reach(marked: DataFrame, config: FeatureConfig) -> DataFrame:
    """The rows that features of the ``_asked`` ones depend on.

    Histories of entities and teams stay within a season, so these are the seasons of the asked rows. Only lags cross seasons:
    the trend looks three games back, at a mean over the games of one frame before that one.
    """
    trend = [f for f in config.frames if f.name == "last3"]
    if any(f.rows is None for f in trend):
        return marked
    back = TREND_GAMES + max((f.rows for f in trend), default=0)
    seasons = marked.where("_asked").select(F.col("season").alias("_season"), F.lit(True).alias("_same")).distinct()
    placed = marked.withColumn("_at", F.row_number().over(SPEC.across())).withColumn(
        "_first", F.min(F.when(F.col("_asked"), F.col("_at"))).over(Window.partitionBy(*SPEC.entity))
    )
    # A slate lies in one season or two, so its seasons go to the rows.
    both = placed.join(F.broadcast(seasons), F.col("season").eqNullSafe(F.col("_season")), "left")
    near = F.col("_at") >= F.col("_first") - back
    return both.where(F.coalesce("_same", near, F.lit(False))).select(*marked.columns)


def one_to_one_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], check: bool = True
) -> DataFrame:
    """Left join of two tables that must both be unique on the key."""
    if check:
        for side, label in ((left, "left"), (right, "right")):
            counts = side.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
            require_zero(
                counts.agg(F.count_if(F.col("n") > 1).alias("repeated_keys")),
                f"{label} side is not unique on {list(on)}",
            )
    return left.join(right, list(on), "left")
