"""Carried-over history: what every later feature needs of the games up to a cutoff.

The state is four small tables instead of all earlier games:

``totals``   one row per entity: its last season, games, sums of every metric and threshold counts of that season.
``values``   the counted values of the season whose running median is a feature, one row per entity and distinct value.
``recent``   the games that row frames, day frames and lags can still reach, with this game's metrics.
``teams``    one row per opposing team: its last season, games and sums, overall and by hand.

``new_state`` makes it from games, ``advance`` from a state and the games after it, and both give the same tables.
``entity_features`` and ``feature_table`` give the rows of games after the state, equal to a build over everything: frames
run over the new games and the reachable ones, season sums add the carried totals, and the median runs over carried
counts. So a slate or a season costs the new games and one row per entity, however long the history is. Totals and counts
are mergeable sums, combined map-side; every window is dealt by entity, one exchange.

New games must be later than the state in (season, date, game) order of their entity, which ``require_later`` checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import flag
from antecede.operators import events as E
from antecede.operators import features as X
from antecede.operators import history as H
from antecede.operators.quality import require_zero

ENTITY = "pitcher_mlbam_id"
MEDIAN_OF = "pitches_thrown"
TREND_OF = "last3_pitches_per_start"
LAGS = 3  # how far back features look across seasons
TABLES = ("totals", "values", "recent", "teams")


def summed_metrics(config: X.FeatureConfig, categories: bool) -> list[str]:
    """Metrics with a season-to-date sum, in a fixed order."""
    names = [f"{m}_{c}" for c in config.categories for m in E.CATEGORY_METRICS] if categories else []
    return [*H.RATE_METRICS, *names, MEDIAN_OF]


def team_metrics(config: X.FeatureConfig) -> list[str]:
    return [*E.TEAM_METRICS, *[f"{m}_{h}" for h in config.hands for m in E.TEAM_METRICS]]


@dataclass(frozen=True)
class HistoryState:
    totals: DataFrame
    values: DataFrame
    recent: DataFrame
    teams: DataFrame

    def save(self, path: str) -> None:
        """One folder per table. ``totals`` is written last, so a state without it is unfinished."""
        for name in reversed(TABLES):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HistoryState:
        return HistoryState(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})


# --- sums ---------------------------------------------------------------------------------------

def _merged(parts: DataFrame, entity: str, sums: Sequence[str]) -> DataFrame:
    """Sums per entity of its last season. ``parts`` are rows of carried totals and of new games alike."""
    seasons = parts.groupBy(entity, "season").agg(*[F.sum(c).alias(c) for c in sums])
    return X.keep_last(seasons, [entity], ["season"])


def _reached(t: int) -> str:
    return f"reached_{t}"


def _game_parts(games: DataFrame, metrics: Sequence[str]) -> DataFrame:
    reached = [flag(F.col(MEDIAN_OF) >= t).alias(_reached(t)) for t in K.WORKLOAD_THRESHOLDS]
    return games.select(ENTITY, "season", F.lit(1).cast("bigint").alias("games"), *metrics, *reached)


def _team_parts(team_games: DataFrame, metrics: Sequence[str], hands: Sequence[str]) -> DataFrame:
    return team_games.select("team", "season", F.lit(1).cast("bigint").alias("games"), *metrics, *[f"observed_{h}" for h in hands])


def _last_season(rows: DataFrame, totals: DataFrame, entity: str = ENTITY) -> DataFrame:
    return rows.join(totals.select(entity, "season"), [entity, "season"], "left_semi")


def _recent(rows: DataFrame, totals: DataFrame, config: X.FeatureConfig) -> DataFrame:
    """The last games of each entity, and those of its season that a day frame of a later game can reach."""
    rows_back = max([f.rows for f in config.frames if f.rows is not None] + [3, LAGS])
    days_back = max([f.days for f in config.frames if f.days is not None] + [0])
    order = [F.desc("season"), F.desc("game_date"), F.desc("game_id")]
    whole = Window.partitionBy(ENTITY)
    placed = rows.withColumns(
        {
            "_back": F.row_number().over(whole.orderBy(*order)),
            "_season": F.max("season").over(whole),
            "_last": F.max(F.struct("season", "game_date")).over(whole)["game_date"],
        }
    )
    near = (F.col("season") == F.col("_season")) & (F.col("game_date") >= F.date_sub("_last", days_back))
    return placed.where((F.col("_back") <= rows_back) | near).select(*rows.columns)


def _recent_columns(config: X.FeatureConfig, categories: bool) -> list[str]:
    trend = [TREND_OF] if any(f.name == "last3" for f in config.frames) else []
    return [*X.KEYS, *summed_metrics(config, categories), *trend]


def _team_games(appearances: DataFrame, teams: DataFrame | None, config: X.FeatureConfig) -> DataFrame | None:
    return None if teams is None else X.team_games(appearances, teams, config.hands)


def new_state(
    games: DataFrame, appearances: DataFrame, teams: DataFrame, config: X.FeatureConfig = X.FeatureConfig(), categories: bool = True
) -> HistoryState:
    """State after ``games`` (rows of ``features.with_game_metrics``) and the appearances and team metrics they belong to."""
    metrics, tm = summed_metrics(config, categories), team_metrics(config)
    parts = _game_parts(games, metrics)
    totals = _merged(parts, ENTITY, [c for c in parts.columns if c not in (ENTITY, "season")])
    values = games.where(F.col(MEDIAN_OF).isNotNull()).groupBy(ENTITY, "season", F.col(MEDIAN_OF).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    recent = X.entity_features(games, config, categories).select(*_recent_columns(config, categories))
    team_parts = _team_parts(_team_games(appearances, teams, config), tm, config.hands)
    return HistoryState(
        totals, _last_season(values, totals), _recent(recent, totals, config),
        _merged(team_parts, "team", [c for c in team_parts.columns if c not in ("team", "season")]),
    )


# --- features of later games ---------------------------------------------------------------------

def _carried(df: DataFrame, totals: DataFrame, entity: str) -> DataFrame:
    """Adds ``_carry_<sum>``, NULL where the state is of another season."""
    sums = [c for c in totals.columns if c not in (entity, "season")]
    side = totals.select(entity, F.col("season").alias("_carry_season"), *[F.col(c).alias(f"_carry_{c}") for c in sums])
    same = F.col("season") == F.col("_carry_season")
    joined = df.join(side, entity, "left")
    return joined.withColumns({f"_carry_{c}": F.when(same, F.col(f"_carry_{c}")) for c in sums})


def _with_carry(local: Column, carry: str) -> Column:
    """Sum of both, NULL only where neither has seen anything."""
    kept = F.col(f"_carry_{carry}")
    return F.when(local.isNotNull() | kept.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(kept, F.lit(0)))


def _median(state: HistoryState, games: DataFrame) -> DataFrame:
    """Keys and the running median, over carried counts and the new games before each."""
    keys = list(X.KEYS)
    new = games.select(*keys, F.col(MEDIAN_OF).alias("value"), F.lit(1).cast("bigint").alias("n"), F.lit(1).alias("_new"))
    old = state.values.select(ENTITY, "season", "value", "n", F.lit(0).alias("_new"))
    order = Window.partitionBy(ENTITY, "season").orderBy("_new", "game_date", "game_id")
    median = F.percentile("value", F.lit(0.5), F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return new.unionByName(old, allowMissingColumns=True).withColumn("pitches_median_before_game", median).where("_new = 1").select(*keys, "pitches_median_before_game")


def entity_features(state: HistoryState, games: DataFrame, config: X.FeatureConfig = X.FeatureConfig(), categories: bool = True) -> DataFrame:
    """``games`` with every entity feature, as ``features.entity_features`` over the whole history gives them."""
    spec, new = X.SPEC, F.col("_new") == 1
    metrics = summed_metrics(config, categories)
    has_trend = any(f.name == "last3" for f in config.frames)
    reachable = state.recent.withColumn("_new", F.lit(0))
    if has_trend:
        reachable = reachable.withColumnRenamed(TREND_OF, "_kept_trend")
    rows = games.withColumn("_new", F.lit(1)).unionByName(reachable, allowMissingColumns=True)
    rows = _carried(rows, state.totals, ENTITY)

    before = spec.in_period().rowsBetween(Window.unboundedPreceding, -1)
    own = {m: _with_carry(F.sum(F.when(new, F.col(m))).over(before), m) for m in metrics}
    games_before = F.coalesce(F.sum(flag(new)).over(before), F.lit(0)) + F.coalesce(F.col("_carry_games"), F.lit(0))
    columns: dict[str, Column] = {
        "pitcher_days_rest": H.days_since_previous(spec),
        "pitches_previous_start": H.previous_value(spec, "pitches_thrown"),
        "pitcher_starts_before_game": games_before,
        **{
            f"starts_reaching_{t}_before_game": F.coalesce(F.sum(F.when(new, flag(F.col(MEDIAN_OF) >= t))).over(before), F.lit(0))
            + F.coalesce(F.col(f"_carry_{_reached(t)}"), F.lit(0))
            for t in K.WORKLOAD_THRESHOLDS
        },
    }
    if categories:
        names = [m for m in metrics if m not in H.RATE_METRICS]
        columns |= {f"prior_{m}": own[m] for m in names}
        columns |= H.prior_sums(H.Frame("prior3", rows=3), spec, names)
    for frame in config.frames:
        if frame.rows is None and frame.days is None:
            columns |= {f"{frame.name}_{m}": own[m] for m in H.RATE_METRICS}
            columns[f"{frame.name}_history_starts"] = games_before
        elif frame.days is None:
            columns |= H.prior_sums(frame, spec, H.RATE_METRICS)
            columns[f"{frame.name}_history_starts"] = H.prior_starts(frame, spec)
    rows = H.with_prior(rows.withColumns(columns), spec, [f for f in config.frames if f.days is not None], H.RATE_METRICS)
    # The trend is a lag of a rate, so reachable games keep the rate they had.
    rows = X.entity_rates(rows, config, categories)
    if has_trend:
        rows = rows.withColumn("_trend_base", F.when(new, F.col(TREND_OF)).otherwise(F.col("_kept_trend")))
        rows = rows.withColumn("workload_trend_last3_vs_prior3", H.trend(spec, "_trend_base"))
    rows = rows.where(new).drop("_new", "_kept_trend", "_trend_base", *[c for c in rows.columns if c.startswith("_carry_")])
    return rows.join(_median(state, games), list(X.KEYS), "left")


def opponent_features(state: HistoryState, team_games: DataFrame, config: X.FeatureConfig) -> DataFrame:
    """One row per opposing team and new game, as ``features.opponent_features`` gives them."""
    rows = _carried(team_games, state.teams, "team")
    before = X.TEAM_SPEC.in_period().rowsBetween(Window.unboundedPreceding, -1)
    columns = {f"prior_{m}": _with_carry(F.sum(m).over(before), m) for m in team_metrics(config)}
    columns["prior_games"] = H.prior_count(X.TEAM_SPEC) + F.coalesce(F.col("_carry_games"), F.lit(0))
    for h in config.hands:
        columns[f"prior_games_{h}"] = F.coalesce(F.sum(f"observed_{h}").over(before), F.lit(0)) + F.coalesce(F.col(f"_carry_observed_{h}"), F.lit(0))
    named = X.opponent_columns(config.hands, config.minimum)
    return rows.withColumns(columns).select(
        "season", "game_date", "game_id", F.col("team").alias("opponent"), *[c.alias(n) for n, c in named.items()]
    )


def feature_table(
    state: HistoryState,
    appearances: DataFrame,
    pitcher_metrics: DataFrame,
    type_metrics: DataFrame,
    teams: DataFrame,
    config: X.FeatureConfig = X.FeatureConfig(),
) -> DataFrame:
    """``features.feature_table`` of appearances after the state; nothing before the state is read."""
    X.require_columns(appearances, X.REQUIRED, "appearances")
    context = [c for c in appearances.columns if c not in X.LEAKED and c not in K.TARGETS]
    games = X.with_game_metrics(appearances.drop(*X.LEAKED), pitcher_metrics, type_metrics, config)
    rows = entity_features(state, games, config)
    names = X.entity_feature_names(config, True)
    opponents = opponent_features(state, X.team_games(appearances, teams, config.hands), config)
    rows = rows.select(*context, *names, *K.TARGETS).join(opponents, ["season", "game_date", "game_id", "opponent"], "left")
    return rows.select(*context, *names, *X.opponent_feature_names(config.hands), *K.TARGETS)


# --- advancing -----------------------------------------------------------------------------------

def require_later(state: HistoryState, games: DataFrame) -> None:
    """New games must follow the last game of their entity and stand in the state's season or a later one."""
    last = state.recent.groupBy(ENTITY).agg(F.max(F.struct("season", "game_date", "game_id")).alias("_last"))
    early = games.select(ENTITY, F.struct("season", "game_date", "game_id").alias("_at")).join(last, ENTITY)
    require_zero(early.agg(F.count_if(F.col("_at") <= F.col("_last")).alias("games_not_after_state")), "games overlap the state")


def advance(
    state: HistoryState, games: DataFrame, appearances: DataFrame, teams: DataFrame,
    config: X.FeatureConfig = X.FeatureConfig(), categories: bool = True, check: bool = True,
) -> HistoryState:
    """State after more games, from the state and those games alone."""
    if check:
        require_later(state, games)
    metrics, tm = summed_metrics(config, categories), team_metrics(config)
    parts = _game_parts(games, metrics).unionByName(state.totals)
    totals = _merged(parts, ENTITY, [c for c in parts.columns if c not in (ENTITY, "season")])
    counted = games.where(F.col(MEDIAN_OF).isNotNull()).select(ENTITY, "season", F.col(MEDIAN_OF).alias("value"), F.lit(1).cast("bigint").alias("n"))
    values = counted.unionByName(state.values).groupBy(ENTITY, "season", "value").agg(F.sum("n").alias("n"))
    recent = entity_features(state, games, config, categories).select(*_recent_columns(config, categories)).unionByName(state.recent)
    team_parts = _team_parts(_team_games(appearances, teams, config), tm, config.hands).unionByName(state.teams)
    return HistoryState(
        totals, _last_season(values, totals), _recent(recent, totals, config),
        _merged(team_parts, "team", [c for c in team_parts.columns if c not in ("team", "season")]),
    )
