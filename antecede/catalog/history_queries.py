"""Point-in-time window queries (W1-W22) on the pitch-shaped stand-in."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from antecede.catalog import parts as P
from antecede.catalog.registry import big, query, rounded, sql
from antecede.operators import events as E
from antecede.operators import features as X
from antecede.operators import history as H
from antecede.operators import state as ST
from antecede.operators.quality import row_missingness
from antecede.plans.standin import APPEARANCE, CATEGORIES, CONFIG, FRAMES
from antecede.session import scratch_path, stage

SPEC = H.Spec()
K4 = list(X.KEYS)
SOME = ["k_count", "bf_metric", "pitches", "outs_history"]
BY_NAME = {f.name: f for f in FRAMES}


def _sums_sql(frame: str) -> str:
    cells = P.prior(frame, SOME).replace(f"{frame}_n", f"{frame}_history_starts")
    return sql(f"SELECT {P.KEYS}, {cells} FROM g", "g")


def _sums(t, frame: str):
    df = H.with_prior(t.game_rows, SPEC, [BY_NAME[frame]], SOME)
    return df.select(*K4, *[f"{frame}_{m}" for m in SOME], f"{frame}_history_starts")


@query("season_to_date", _sums_sql("season"))
def season_to_date(t):
    return _sums(t, "season")


def _many_sql(frames) -> str:
    cells = ", ".join(P.prior(f, SOME).replace(f"{f}_n", f"{f}_history_starts") for f in frames)
    return sql(f"SELECT {P.KEYS}, {cells} FROM g", "g")


def _many(t, frames):
    df = H.with_prior(t.game_rows, SPEC, [BY_NAME[f] for f in frames], SOME)
    names = [f"{f}_{m}" for f in frames for m in [*SOME, "history_starts"]]
    return df.select(*K4, *names)


@query("last_n_games", _many_sql(["last3", "last5", "last10"]))
def last_n_games(t):
    return _many(t, ["last3", "last5", "last10"])


@query("trailing_days", _many_sql(["last60d", "last120d"]))
def trailing_days(t):
    return _many(t, ["last60d", "last120d"])


# A denser source of days: one row per user and day.
def user_days(t):
    return t.events.groupBy(
        F.col("user_id"), F.to_date("ts").alias("day")
    ).agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n_events"), F.sum(F.rint(F.col("value") * 100).cast("bigint")).alias("cents"))


USER_SPEC = H.Spec(entity=("user_id",), period=(), date="day", game="first_event")
USER_FRAMES = (H.SEASON, H.Frame("last3", rows=3), H.Frame("last3d", days=3), H.Frame("last7d", days=7))
USER_DAYS = """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events,
 sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY user_id, CAST(ts AS DATE)"""


def _user_sql() -> str:
    cells = []
    for f in USER_FRAMES:
        if f.days:
            over = f"(PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL {f.days} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"
            cells.append(f"{big(f'nullif(count(*) OVER {over}, 0)')} AS {f.name}_history_starts")
        else:
            over = f"(PARTITION BY user_id ORDER BY day ROWS BETWEEN {f.rows or 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)"
            cells.append(f"{big(f'count(*) OVER {over}')} AS {f.name}_history_starts")
        cells += [f"{big(f'sum({m}) OVER {over}')} AS {f.name}_{m}" for m in ("n_events", "cents")]
    return f"WITH d AS ({USER_DAYS}) SELECT user_id, day, {', '.join(cells)} FROM d"


USER_OUT = ["user_id", "day"] + [
    f"{f.name}_{m}" for f in USER_FRAMES for m in ("n_events", "cents", "history_starts")
]


@query("trailing_days_dense", _user_sql())
def trailing_days_dense(t):
    return H.with_prior(user_days(t), USER_SPEC, USER_FRAMES, ["n_events", "cents"]).select(*USER_OUT)


@query("history_in_blocks", _user_sql())
def history_in_blocks(t):
    """The same columns with every user cut into 8-day blocks."""
    return H.blocked_history(
        user_days(t), USER_SPEC, USER_FRAMES, ["n_events", "cents"], H.Blocks(width=8)
    ).select(*USER_OUT)


RATE_NAMES = [n for n, *_ in P.RATES] + ["history_starts", "insufficient_history"]


@query("windowed_rates", sql(
    f"SELECT {P.KEYS}, {', '.join(P.rates(f, 3) for f in P.FRAMES)} FROM hist", "hist"))
def windowed_rates(t):
    df = H.with_prior(t.game_rows, SPEC, FRAMES, H.RATE_METRICS)
    columns = {}
    for f in FRAMES:
        columns |= H.rate_columns(f, 3)
    return df.withColumns(columns).select(*K4, *[f"{f.name}_{n}" for f in FRAMES for n in RATE_NAMES])


def _app(select: str) -> str:
    return sql(f"SELECT {P.KEYS}, {select} FROM app", "app")


@query("expanding_median", _app(
    f"median(pitches_thrown) OVER ({P.FRAMES['season']}) AS pitches_median_before_game"))
def expanding_median(t):
    return t.appearances.select(
        *K4, H.expanding_median(SPEC, "pitches_thrown").alias("pitches_median_before_game")
    )


@query("running_median", """SELECT user_id, ts, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) + 0.0 AS median_before FROM events""")
def running_median(t):
    """The expanding median of long histories: every event of a user, by counted value ranks."""
    spec = H.Spec(entity=("user_id",), period=(), date="ts", game="event_id")
    return rounded(H.running_median(t.events.select("user_id", "ts", "event_id", "value"), spec, "value", "median_before"))


@query("days_rest", _app(
    f"{big(f'''date_diff('day', lag(game_date) OVER ({P.ACROSS}), game_date)''')} AS pitcher_days_rest"))
def days_rest(t):
    return t.appearances.select(*K4, H.days_since_previous(SPEC).alias("pitcher_days_rest"))


@query("prior_count", _app(
    f"{big(f'row_number() OVER ({P.IN_SEASON} {P.ORDER}) - 1')} AS pitcher_starts_before_game"))
def prior_count(t):
    return t.appearances.select(*K4, H.prior_count(SPEC).alias("pitcher_starts_before_game"))


@query("lag_value", _app(f"lag(pitches_thrown) OVER ({P.ACROSS}) AS pitches_previous_start"))
def lag_value(t):
    return t.appearances.select(*K4, H.previous_value(SPEC, "pitches_thrown").alias("pitches_previous_start"))


@query("prior_threshold_count", _app(", ".join(
    f"{big(f'coalesce(sum(CASE WHEN pitches_thrown >= {n} THEN 1 ELSE 0 END) OVER ({P.FRAMES["season"]}), 0)')} AS starts_reaching_{n}"
    for n in (5, 8))))
def prior_threshold_count(t):
    return t.appearances.select(
        *K4, *[H.prior_at_least(SPEC, "pitches_thrown", n).alias(f"starts_reaching_{n}") for n in (5, 8)]
    )


@query("trend_vs_lag", sql(
    f"""SELECT {P.KEYS}, p - lag(p, 3) OVER ({P.ACROSS}) AS trend FROM (
      SELECT {P.KEYS}, CAST(sum(pitches) OVER ({P.FRAMES['last3']}) AS DOUBLE)
        / nullif(count(*) OVER ({P.FRAMES['last3']}), 0) AS p FROM g)""", "g"))
def trend_vs_lag(t):
    frame = BY_NAME["last3"]
    df = H.with_prior(t.game_rows, SPEC, [frame], ["pitches"])
    df = df.withColumns(H.rate_columns(frame, 1, [("pitches_per_start", "pitches", "starts")]))
    return df.select(*K4, H.trend(SPEC, "last3_pitches_per_start").alias("trend"))


@query("calendar_indicator", _app(
    f"{big('month(game_date)')} AS month, {big('''CASE WHEN home_away = 'home' THEN 1 ELSE 0 END''')} AS home_indicator"))
def calendar_indicator(t):
    return t.appearances.select(
        *K4, H.month_of("game_date").alias("month"), H.indicator("home_away", "home").alias("home_indicator")
    )


PRIOR_TYPE = [f"{p}_{m}" for p in ("prior", "prior3") for m in P.CATEGORY]


@query("category_history", sql(
    f"SELECT {P.KEYS}, pitch_type, "
    + ", ".join(PRIOR_TYPE) + " FROM ch", "ch"))
def category_history(t):
    return X.category_history(t.appearances, t.type_metrics, CATEGORIES).select(
        *K4, "pitch_type", *PRIOR_TYPE
    )


@query("category_pivot", sql(
    f"SELECT {P.KEYS}, " + ", ".join(
        f"{big(f'''sum(CASE WHEN pitch_type='{c}' THEN {m} END)''')} AS {m}_{c}"
        for c in CATEGORIES for m in ("pitch_count", "whiff_count")) + f" FROM tm GROUP BY {P.KEYS}", "tm"))
def category_pivot(t):
    return X.category_pivot(t.type_metrics, K4, ("pitch_count", "whiff_count"), CATEGORIES)


def _arsenal_sql(*names: str) -> str:
    cells = [f"pitch_{c}_{n}" for c in CATEGORIES for n in names]
    return sql(f"SELECT {P.KEYS}, {', '.join(cells)} FROM type_wide", "type_wide")


def _arsenal(t, *names: str):
    df = X.arsenal_features(t.appearances, t.type_metrics, CONFIG)
    return df.select(*K4, *[f"pitch_{c}_{n}" for c in CATEGORIES for n in names])


RATE_PARTS = ("usage", "velocity", "whiff_rate", "strike_rate", "csw_rate")
CHANGE_PARTS = ("usage_change_vs_season", "velocity_change_vs_season")


@query("category_rates", _arsenal_sql(*RATE_PARTS))
def category_rates(t):
    return _arsenal(t, *RATE_PARTS)


@query("category_change", _arsenal_sql(*CHANGE_PARTS))
def category_change(t):
    return _arsenal(t, *CHANGE_PARTS)


@query("category_min_sample", _arsenal_sql("insufficient_history"))
def category_min_sample(t):
    return _arsenal(t, "insufficient_history")


T4 = list(X.TEAM_KEYS)
TEAM_PRIOR = [f"prior_{m}" for m in E.TEAM_METRICS]


def _team_history(t):
    return X.team_history(X.team_games(t.appearances, t.team_metrics, CONFIG.hands), CONFIG.hands)


@query("team_history", sql(
    f"SELECT {', '.join(T4)}, {', '.join(TEAM_PRIOR)}, prior_games FROM team_hist", "team_hist"))
def team_history(t):
    return _team_history(t).select(*T4, *TEAM_PRIOR, "prior_games")


@query("team_split_history", sql(
    f"SELECT {', '.join(T4)}, " + ", ".join(
        f"max(CASE WHEN opponent_hand='{h}' THEN {m} END) AS {m}_{h}"
        for h in ("R", "L") for m in [*TEAM_PRIOR, "prior_games"])
    + f" FROM hand_hist GROUP BY {', '.join(T4)}", "hand_hist"))
def team_split_history(t):
    return _team_history(t).select(
        *T4, *[f"{m}_{h}" for h in ("R", "L") for m in [*TEAM_PRIOR, "prior_games"]]
    )


@query("opponent_features", sql("SELECT * FROM opponents", "opponents"))
def opponent_features(t):
    return X.opponent_features(t.appearances, t.team_metrics, CONFIG.hands, CONFIG.minimum)


# --- whole feature table ------------------------------------------------------------------------

CONTEXT = [*K4, "team", "opponent", "home_away", "pitcher_handedness"]
FEATURES = X.entity_feature_names(CONFIG, True) + X.opponent_feature_names(CONFIG.hands)
TARGETS = ["strikeouts", "outs_recorded", "pitches_thrown", "batters_faced"]
FEATURE_SELECT = f"SELECT {', '.join(CONTEXT)}, {', '.join(FEATURES)}, {', '.join(TARGETS)} FROM features"


@query("feature_table", sql(FEATURE_SELECT, "features"))
def feature_table(t):
    return t.features


def _forward(t, season):
    old = t.appearances.where(F.col("season") < season)
    new = t.appearances.where(F.col("season") == season)
    pitches = t.typed_pitches.join(
        t.team_pitches.select("at_bat_number", "team").distinct(), "at_bat_number", "left"
    ).where(F.col("season") == season)
    return X.forward_features(old, new, pitches, season, CONFIG, FEATURES)


@query("forward_features", sql(
    FEATURE_SELECT.replace("workload_trend_last3_vs_prior3", "forward_trend AS workload_trend_last3_vs_prior3")
    + f" JOIN forward_trend USING ({P.KEYS}) WHERE season = 2001", "features", "forward_trend"))
def forward_features(t):
    return _forward(t, 2001).select(*CONTEXT, *FEATURES, *TARGETS)


SLATE = date(2001, 8, 1)


def pre_event(t):
    """Scheduled rows of one game date: targets removed, all other dates as history."""
    appearances = stage(t.appearances, "appearances")
    scheduled = appearances.where(F.col("game_date") == F.lit(SLATE)).withColumns(
        {c: F.lit(None).cast("bigint") for c in TARGETS}
    )
    historical = appearances.where(F.col("season") < 2001)
    completed = appearances.where((F.col("season") == 2001) & (F.col("game_date") < F.lit(SLATE)))
    pitches = t.typed_pitches.join(t.at_bat_teams.distinct(), "at_bat_number", "left")
    return X.pre_event_features(historical, completed, scheduled, pitches, SLATE, CONFIG)


PRE_SELECT = f"""SELECT {', '.join(CONTEXT)}, {', '.join(FEATURES)},
 {', '.join(f'CAST(NULL AS BIGINT) AS {c}' for c in TARGETS)},
 {big(' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in FEATURES))} AS missing_features
 FROM features WHERE game_date = DATE '2001-08-01'"""


@query("pre_event_features", sql(PRE_SELECT, "features"))
def pre_event_features(t):
    df = row_missingness(pre_event(t), FEATURES)
    return df.select(*CONTEXT, *FEATURES, *TARGETS, "missing_features")


# --- carried-over state: later features from a state and the new games alone ----------------------


def _inputs(t, keep):
    """(appearances, pitcher, type and team metrics) of the games ``keep`` admits."""
    return (
        t.games.where(keep).select(*APPEARANCE), E.entity_game_metrics(t.pitches.where(keep)),
        E.category_game_metrics(t.typed_pitches.where(keep)), E.team_hand_metrics(t.team_pitches.where(keep)),
    )


def _written(t, state: ST.HistoryState) -> ST.HistoryState:
    path = scratch_path(t.spark, "state")
    state.save(path)
    return ST.HistoryState.load(t.spark, path)


def state_before_2001(t) -> ST.HistoryState:
    keep = F.col("season") < 2001
    inputs = _inputs(t, keep)
    return _written(t, ST.new_state(t.games.where(keep), inputs[0], inputs[3], CONFIG))


def state_before_slate(t) -> ST.HistoryState:
    """The state of the season's start, advanced by the games up to the slate."""
    keep = (F.col("season") == 2001) & (F.col("game_date") < F.lit(SLATE))
    inputs = _inputs(t, keep)
    return _written(t, ST.advance(state_before_2001(t), t.games.where(keep), inputs[0], inputs[3], CONFIG))


@query("state_season_features", sql(FEATURE_SELECT + " WHERE season = 2001", "features"))
def state_season_features(t):
    """A new season from the state after all earlier ones."""
    appearances, pitcher, types, teams = _inputs(t, F.col("season") == 2001)
    df = ST.feature_table(state_before_2001(t), appearances, pitcher, types, teams, CONFIG)
    return df.select(*CONTEXT, *FEATURES, *TARGETS)


@query("state_slate_features", sql(PRE_SELECT, "features"))
def state_slate_features(t):
    """One slate from an advanced state; the games of the slate have no metrics yet."""
    unknown = {c: F.lit(None).cast("bigint") for c in TARGETS}
    scheduled = t.appearances.where(F.col("game_date") == F.lit(SLATE)).withColumns(unknown)
    nothing = _inputs(t, F.lit(False))
    df = ST.feature_table(state_before_slate(t), scheduled, nothing[1], nothing[2], nothing[3], CONFIG)
    return row_missingness(df, FEATURES).select(*CONTEXT, *FEATURES, *TARGETS, "missing_features")


STATE_SUMS = ["k_count", "bf_metric", "pitches", "outs_history"]


@query("state_totals", sql(f"""SELECT pitcher_mlbam_id, season, count(*) AS games, {', '.join(f'{big(f"sum({m})")} AS {m}' for m in STATE_SUMS)},
  {big('count(DISTINCT pitches_thrown)')} AS distinct_values, {big('count(pitches_thrown)')} AS counted_games
  FROM g WHERE game_date < DATE '2001-08-01'
   AND (pitcher_mlbam_id, season) IN (SELECT (pitcher_mlbam_id, max(season)) FROM app WHERE game_date < DATE '2001-08-01' GROUP BY pitcher_mlbam_id)
  GROUP BY pitcher_mlbam_id, season""", "g", "app"))
def state_totals(t):
    """The carried totals and value counts after one advance."""
    state = state_before_slate(t)
    counted = state.values.groupBy("pitcher_mlbam_id").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("counted_games"))
    totals = state.totals.select("pitcher_mlbam_id", "season", "games", *STATE_SUMS)
    return totals.join(counted, "pitcher_mlbam_id", "left").fillna(0, ["distinct_values", "counted_games"])
