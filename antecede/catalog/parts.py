"""Subqueries of the check SQL: the stand-in tables and their features, written for DuckDB."""

from __future__ import annotations

from antecede.catalog.registry import big, part
from antecede.plans.standin import CATEGORIES

SWING = "('foul','foul_bunt','foul_tip','hit_into_play','missed_bunt','swinging_strike','swinging_strike_blocked')"
CONTACT = "('foul','foul_bunt','foul_tip','hit_into_play','missed_bunt')"
WHIFF = "('swinging_strike','swinging_strike_blocked')"
STRIKE = SWING[:-1] + ",'called_strike')"

part("pitches", f"""
SELECT {big('year(l_shipdate)')} AS season,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS game_date,
  {big('(year(l_shipdate)-1995)*12 + month(l_shipdate) - 1')} AS game_id,
  l_suppkey AS pitcher_mlbam_id, l_partkey AS batter, l_orderkey AS at_bat_number,
  {big('l_linenumber')} AS pitch_number,
  {big('l_quantity')} % 9 + 1 AS inning,
  CASE WHEN l_linestatus='F' THEN 'Top' ELSE 'Bot' END AS inning_topbot,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_returnflag='R' THEN 'strikeout'
       WHEN l_returnflag='A' THEN 'field_out'
       WHEN l_partkey % 3 = 0 THEN 'single' WHEN l_partkey % 3 = 1 THEN 'walk'
       ELSE 'truncated_pa' END AS events,
  CASE l_partkey % 7 WHEN 0 THEN 'called_strike' WHEN 1 THEN 'swinging_strike' WHEN 2 THEN 'foul'
       WHEN 3 THEN 'ball' WHEN 4 THEN 'hit_into_play' WHEN 5 THEN 'automatic_ball'
       ELSE 'foul_tip' END AS description,
  CASE WHEN l_tax <> 0 THEN {big('l_quantity')} % 14 + 1 END AS zone,
  CASE WHEN l_discount <> 0 THEN floor(l_extendedprice) / 64.0 END AS release_speed,
  CASE WHEN l_linestatus='F' THEN 'R' ELSE 'L' END AS p_throws,
  {big('l_quantity')} % 3 AS outs_when_up,
  CASE WHEN l_partkey % 11 <> 0 THEN {big('l_quantity')} + l_linenumber END AS score
FROM lineitem""")

FLAGS = {
    "pitches": "pitch",
    "bf_metric": "events <> 'truncated_pa'",
    "k_count": "events IN ('strikeout','strikeout_double_play')",
    "bb_count": "events IN ('walk','intent_walk')",
    "hits_count": "events IN ('single','double','triple','home_run')",
    "strike_count": f"pitch AND description IN {STRIKE}",
    "called_strike_count": "pitch AND description = 'called_strike'",
    "whiff_count": f"pitch AND description IN {WHIFF}",
    "csw_count": f"pitch AND (description = 'called_strike' OR description IN {WHIFF})",
    "swing_count": f"pitch AND description IN {SWING}",
    "contact_count": f"pitch AND description IN {CONTACT}",
    "zone_pitch_count": "pitch AND zone BETWEEN 1 AND 9",
    "zone_swing_count": f"pitch AND zone BETWEEN 1 AND 9 AND description IN {SWING}",
    "zone_contact_count": f"pitch AND zone BETWEEN 1 AND 9 AND description IN {CONTACT}",
    "chase_swing_count": f"pitch AND NOT (zone BETWEEN 1 AND 9) AND description IN {SWING}",
    "chase_pitch_count": "pitch AND NOT (zone BETWEEN 1 AND 9)",
    "velocity_count": "pitch AND release_speed IS NOT NULL",
    "first_pitch_strike_count": f"is_first AND description IN {STRIKE}",
    "first_pitch_pa_count": "is_first AND pitch_number IS NOT NULL",
}
ENTITY_METRICS = [*FLAGS, "velocity_sum"]
TEAM = ["bf_metric", "k_count", "bb_count", "pitches", "whiff_count", "swing_count",
        "contact_count", "chase_swing_count", "chase_pitch_count"]
CATEGORY = ["pitch_count", "velocity_sum", "velocity_count", "whiff_count", "strike_count", "csw_count"]

part("marked", """
SELECT *, (pitch_number IS NOT NULL AND description IS DISTINCT FROM 'automatic_ball') AS pitch,
  pitch_number = min(pitch_number) OVER (PARTITION BY game_id, pitcher_mlbam_id, at_bat_number) AS is_first
FROM pitches""", "pitches")
part("flagged", "SELECT *, "
     + ", ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END AS {name}" for name, rule in FLAGS.items())
     + ", CASE WHEN pitch THEN coalesce(release_speed, 0.0) ELSE 0.0 END AS velocity_sum FROM marked",
     "marked")


def sums(names, prefix="") -> str:
    return ", ".join(
        f"sum({n}) AS {n}" if n == "velocity_sum" else f"{big(f'sum({prefix}{n})')} AS {n}" for n in names
    )


KEYS = "season, game_date, game_id, pitcher_mlbam_id"
part("em", f"SELECT {KEYS}, {sums(ENTITY_METRICS)} FROM flagged GROUP BY ALL", "flagged")
part("tm", f"""SELECT {KEYS}, p_type AS pitch_type, {big('sum(pitches)')} AS pitch_count, {sums(CATEGORY[1:])}
FROM flagged JOIN part ON batter = p_partkey WHERE p_type IS NOT NULL
GROUP BY {KEYS}, p_type""", "flagged")
part("team_flagged", f"""SELECT flagged.*, {big('c_nationkey')} AS team FROM flagged
LEFT JOIN orders ON at_bat_number = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""", "flagged")
part("hm", f"""SELECT season, game_date, game_id, team, p_throws AS opponent_hand,
  {sums(TEAM).replace('AS bf_metric', 'AS team_bf')} FROM team_flagged WHERE team IS NOT NULL
GROUP BY season, game_date, game_id, team, p_throws""", "team_flagged")
part("at_bats", f"""SELECT {KEYS}, at_bat_number,
  sum(CASE WHEN events='strikeout' THEN 1 ELSE 0 END) AS k,
  sum(CASE WHEN events IN ('strikeout','field_out') THEN 1 ELSE 0 END) AS o,
  sum(pitches) AS p, bool_or(coalesce(events='truncated_pa', false)) AS cut,
  bool_or(p_throws='L') AS lefty
FROM flagged GROUP BY {KEYS}, at_bat_number""", "flagged")
part("app", f"""SELECT {KEYS}, {big('s_nationkey')} AS team,
  {big('(s_nationkey + game_id) % 25')} AS opponent,
  CASE WHEN (s_nationkey + game_id) % 2 = 0 THEN 'home' ELSE 'away' END AS home_away,
  CASE WHEN bool_or(lefty) THEN 'L' ELSE 'R' END AS pitcher_handedness,
  {big('sum(k)')} AS strikeouts, {big('sum(o)')} AS outs_recorded, {big('sum(p)')} AS pitches_thrown,
  {big('count(*) FILTER (NOT cut)')} AS batters_faced
FROM at_bats LEFT JOIN supplier ON pitcher_mlbam_id = s_suppkey
GROUP BY {KEYS}, s_nationkey""", "at_bats")
part("g", f"""SELECT app.*, outs_recorded AS outs_history,
  {", ".join(f"coalesce(em.{m}, 0) AS {m}" for m in ENTITY_METRICS)}
FROM app LEFT JOIN em USING ({KEYS})""", "app", "em")

ORDER = "ORDER BY game_date, game_id"
IN_SEASON = "PARTITION BY pitcher_mlbam_id, season"
ACROSS = "PARTITION BY pitcher_mlbam_id ORDER BY season, game_date, game_id"
FRAMES = {
    "season": (f"{IN_SEASON} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"),
    "last3": f"{IN_SEASON} {ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING",
    "last5": f"{IN_SEASON} {ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING",
    "last10": f"{IN_SEASON} {ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING",
    "last60d": f"{IN_SEASON} ORDER BY game_date RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING",
    "last120d": f"{IN_SEASON} ORDER BY game_date RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING",
}
RATES = [
    ("k_pct", "k_count", "bf_metric"), ("k_per_start", "k_count", "n"),
    ("pitches_per_start", "pitches", "n"), ("bf_per_start", "bf_metric", "n"),
    ("outs_per_start", "outs_history", "n"), ("bb_pct", "bb_count", "bf_metric"),
    ("hits_per_bf", "hits_count", "bf_metric"), ("swstr_pct", "whiff_count", "pitches"),
    ("csw_pct", "csw_count", "pitches"), ("called_strike_pct", "called_strike_count", "pitches"),
    ("chase_rate", "chase_swing_count", "chase_pitch_count"),
    ("contact_rate", "contact_count", "swing_count"),
    ("zone_contact_rate", "zone_contact_count", "zone_swing_count"),
    ("first_pitch_strike_rate", "first_pitch_strike_count", "first_pitch_pa_count"),
    ("strike_pct", "strike_count", "pitches"),
]


def prior(frame: str, metrics) -> str:
    over = f"OVER ({FRAMES[frame]})"
    count = f"count(*) {over}"
    count = f"nullif({count}, 0)" if frame.endswith("d") else count
    cells = [f"{big(f'sum({m}) {over}')} AS {frame}_{m}" for m in metrics]
    return ", ".join([*cells, f"{big(count)} AS {frame}_n"])


RATE_METRICS = sorted({m for _, *pair in RATES for m in pair if m != "n"})


def rates(frame: str, minimum: int) -> str:
    cells = [
        f"CASE WHEN NOT coalesce({frame}_n < {minimum}, false) THEN "
        f"CAST({frame}_{top} AS DOUBLE) / nullif(CAST({frame}_{bottom} AS DOUBLE), 0) END AS {frame}_{name}"
        for name, top, bottom in RATES
    ]
    cells.append(f"{frame}_n AS {frame}_history_starts")
    cells.append(f"{big(f'CASE WHEN {frame}_n < {minimum} THEN 1 ELSE 0 END')} AS {frame}_insufficient_history")
    return ", ".join(cells)


part("hist", f"SELECT *, {', '.join(prior(f, RATE_METRICS) for f in FRAMES)} FROM g", "g")
WORKLOAD = f"""
  {big(f"date_diff('day', lag(game_date) OVER ({ACROSS}), game_date)")} AS pitcher_days_rest,
  {big(f"row_number() OVER ({IN_SEASON} {ORDER}) - 1")} AS pitcher_starts_before_game,
  {big("month(game_date)")} AS month,
  {big("CASE WHEN home_away = 'home' THEN 1 ELSE 0 END")} AS home_indicator,
  lag(pitches_thrown) OVER ({ACROSS}) AS pitches_previous_start,
  {big(f"coalesce(sum(CASE WHEN pitches_thrown >= 90 THEN 1 ELSE 0 END) OVER ({FRAMES['season']}), 0)")} AS starts_reaching_90_before_game,
  {big(f"coalesce(sum(CASE WHEN pitches_thrown >= 100 THEN 1 ELSE 0 END) OVER ({FRAMES['season']}), 0)")} AS starts_reaching_100_before_game,
  median(pitches_thrown) OVER ({FRAMES['season']}) AS pitches_median_before_game"""
part("entity_rates", f"""SELECT {KEYS}, opponent, team, home_away, pitcher_handedness, strikeouts,
  outs_recorded, pitches_thrown, batters_faced, {', '.join(rates(f, 1) for f in FRAMES)}, {WORKLOAD}
FROM hist""", "hist")
part("entity_features", f"""SELECT *, last3_pitches_per_start
  - lag(last3_pitches_per_start, 3) OVER ({ACROSS}) AS workload_trend_last3_vs_prior3
FROM entity_rates""", "entity_rates")

# Categories in long form: a dense scaffold, then windows per category.
names = ", ".join(f"('{c}')" for c in CATEGORIES)
part("dense", f"""SELECT {', '.join('app.' + k.strip() for k in KEYS.split(','))}, app.pitches_thrown, pitch_type
FROM app CROSS JOIN (VALUES {names}) v(pitch_type)""", "app")
BY_TYPE = f"PARTITION BY pitcher_mlbam_id, season, pitch_type {ORDER} ROWS BETWEEN"
part("ch", "SELECT *, " + ", ".join(
    (f"sum({m}) OVER ({BY_TYPE} {start} PRECEDING AND 1 PRECEDING) AS {p}_{m}" if m == "velocity_sum" else
     f"{big(f'sum({m}) OVER ({BY_TYPE} {start} PRECEDING AND 1 PRECEDING)')} AS {p}_{m}")
    for p, start in (("prior", "UNBOUNDED"), ("prior3", "3")) for m in [*CATEGORY, "pitches_thrown"])
     + f""" FROM (SELECT dense.*, {", ".join(f"coalesce(tm.{m}, 0) AS {m}" for m in CATEGORY)}
  FROM dense LEFT JOIN tm USING ({KEYS}, pitch_type)) x""", "dense", "tm")


def ratio(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


USAGE = ratio("coalesce(prior_pitch_count,0)", "prior_pitches_thrown")
VELOCITY = ratio("coalesce(prior_velocity_sum,0)", "coalesce(prior_velocity_count,0)")
TYPE_COLUMNS = {
    "usage": USAGE,
    "velocity": VELOCITY,
    "whiff_rate": ratio("coalesce(prior_whiff_count,0)", "coalesce(prior_pitch_count,0)"),
    "strike_rate": ratio("coalesce(prior_strike_count,0)", "coalesce(prior_pitch_count,0)"),
    "csw_rate": ratio("coalesce(prior_csw_count,0)", "coalesce(prior_pitch_count,0)"),
    "usage_change_vs_season": f"{ratio('coalesce(prior3_pitch_count,0)', 'prior3_pitches_thrown')} - {USAGE}",
    "velocity_change_vs_season": f"{ratio('prior3_velocity_sum', 'prior3_velocity_count')} - {VELOCITY}",
    "insufficient_history": big("CASE WHEN coalesce(prior_pitch_count,0) < 20 THEN 1 ELSE 0 END"),
}
part("type_rates", f"SELECT {KEYS}, pitch_type, "
     + ", ".join(f"{e} AS {n}" for n, e in TYPE_COLUMNS.items()) + " FROM ch", "ch")
part("type_wide", f"SELECT {KEYS}, " + ", ".join(
    f"max(CASE WHEN pitch_type='{c}' THEN {n} END) AS pitch_{c}_{n}" for c in CATEGORIES for n in TYPE_COLUMNS)
    + f" FROM type_rates GROUP BY {KEYS}", "type_rates")

# Opponents: scaffold of games x hands, windows per team and per team and hand.
TEAM_METRICS = ["team_bf", *TEAM[1:]]
part("opp_dense", f"""SELECT season, game_date, game_id, team, opponent_hand,
  {", ".join(f"coalesce(hm.{m}, 0) AS {m}" for m in TEAM_METRICS)}
FROM (SELECT DISTINCT season, game_date, game_id, opponent AS team FROM app)
CROSS JOIN (VALUES ('R'), ('L')) v(opponent_hand)
LEFT JOIN hm USING (season, game_date, game_id, team, opponent_hand)""", "app", "hm")
BEFORE = f"{ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
part("team_hist", "SELECT season, game_date, game_id, team, " + ", ".join(
    f"{big(f'sum({m}) OVER (PARTITION BY team, season {BEFORE})')} AS prior_{m}" for m in TEAM_METRICS)
    + f", {big(f'row_number() OVER (PARTITION BY team, season {ORDER}) - 1')} AS prior_games FROM ("
    + f"SELECT season, game_date, game_id, team, {', '.join(f'sum({m}) AS {m}' for m in TEAM_METRICS)} "
    + "FROM opp_dense GROUP BY season, game_date, game_id, team) x", "opp_dense")
part("hand_hist", "SELECT season, game_date, game_id, team, opponent_hand, " + ", ".join(
    f"{big(f'sum({m}) OVER (PARTITION BY team, season, opponent_hand {BEFORE})')} AS prior_{m}" for m in TEAM_METRICS)
    + f""", {big(f'coalesce(sum(CASE WHEN team_bf > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY team, season, opponent_hand {BEFORE}), 0)')} AS prior_games
FROM opp_dense""", "opp_dense")


def z(column: str) -> str:
    return f"coalesce(t.{column}, 0)"


OPPONENT = {
    "opponent_team_k_pct": ratio(z("prior_k_count"), z("prior_team_bf")),
    "opponent_team_bb_pct": ratio(z("prior_bb_count"), z("prior_team_bf")),
    "opponent_team_swstr_pct": ratio(z("prior_whiff_count"), z("prior_pitches")),
    "opponent_team_contact_pct": ratio(z("prior_contact_count"), z("prior_swing_count")),
    "opponent_team_chase_pct": ratio(z("prior_chase_swing_count"), z("prior_chase_pitch_count")),
    "opponent_team_history_games": "t.prior_games",
    "opponent_team_insufficient_history": big("CASE WHEN t.prior_games < 1 THEN 1 ELSE 0 END"),
}
for h in ("R", "L"):
    OPPONENT |= {
        f"opponent_k_pct_vs_{h}HP": ratio(f"{h}.prior_k_count", f"{h}.prior_team_bf"),
        f"opponent_contact_pct_vs_{h}HP": ratio(f"{h}.prior_contact_count", f"{h}.prior_swing_count"),
        f"opponent_{h}_history_games": f"{h}.prior_games",
    }
part("opponents", f"""SELECT t.season, t.game_date, t.game_id, t.team AS opponent,
  {", ".join(f"{e} AS {n}" for n, e in OPPONENT.items())}
FROM team_hist t
JOIN hand_hist R ON R.season=t.season AND R.game_date=t.game_date AND R.game_id=t.game_id AND R.team=t.team AND R.opponent_hand='R'
JOIN hand_hist L ON L.season=t.season AND L.game_date=t.game_date AND L.game_id=t.game_id AND L.team=t.team AND L.opponent_hand='L'
""", "team_hist", "hand_hist")
part("features", f"""SELECT e.*, w.* EXCLUDE ({KEYS}), o.* EXCLUDE (season, game_date, game_id, opponent)
FROM entity_features e JOIN type_wide w USING ({KEYS})
JOIN opponents o USING (season, game_date, game_id, opponent)""", "entity_features", "type_wide", "opponents")

# A forward build reads the pitches of the new season only, so earlier games count as zero.
part("forward_trend", f"""SELECT {KEYS}, p - lag(p, 3) OVER ({ACROSS}) AS forward_trend FROM (
  SELECT {KEYS}, CAST(sum(CASE WHEN season < 2001 THEN 0 ELSE pitches END) OVER ({FRAMES['last3']}) AS DOUBLE)
    / nullif(count(*) OVER ({FRAMES['last3']}), 0) AS p FROM g) x""", "g")
