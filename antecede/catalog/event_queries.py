"""Row flags, event aggregates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog import parts as P
from antecede.catalog.registry import big, part, query, sql
from antecede.operators import events as E
from antecede.operators import features as X
from antecede.operators import market as M
from antecede.plans.standin import CATEGORIES, bigint

ROW_KEYS = ["game_id", "pitcher_mlbam_id", "at_bat_number", "pitch_number", "batter"]
ROW = ", ".join(ROW_KEYS)
ROW_FLAGS = [f for f in P.FLAGS if not f.startswith("first_pitch")]


@query("event_flags", sql(
    f"SELECT {ROW}, {', '.join(f'{big(f)} AS {f}' for f in ROW_FLAGS)}, velocity_sum FROM flagged", "flagged"))
def event_flags(t):
    return E.event_flags(t.pitches, ROW_KEYS).select(*ROW_KEYS, *ROW_FLAGS, "velocity_sum")


@query("first_in_group_flag", sql(
    f"SELECT {ROW}, {big('CASE WHEN is_first THEN 1 ELSE 0 END')} AS first_in_at_bat FROM marked", "marked"))
def first_in_group_flag(t):
    return E.first_in_group(
        t.pitches, ["game_id", "pitcher_mlbam_id", "at_bat_number"], "pitch_number", "first_in_at_bat"
    ).select(*ROW_KEYS, "first_in_at_bat")


@query("entity_game_metrics", sql("SELECT * FROM em", "em"))
def entity_game_metrics(t):
    return t.pitcher_metrics


@query("category_game_metrics", sql("SELECT * FROM tm", "tm"))
def category_game_metrics(t):
    return t.type_metrics


@query("team_hand_metrics", sql("SELECT * FROM hm", "hm"))
def team_hand_metrics(t):
    return t.team_metrics


part("first_actor", """SELECT game_id, inning_topbot,
  arg_min(pitcher_mlbam_id, (at_bat_number, pitch_number, batter, pitcher_mlbam_id)) AS pitcher_mlbam_id
FROM pitches WHERE pitcher_mlbam_id IS NOT NULL GROUP BY game_id, inning_topbot""", "pitches")
ORDER = ["at_bat_number", "pitch_number", "batter", "pitcher_mlbam_id"]
SIDE = ["game_id", "inning_topbot"]


@query("first_actor", sql("SELECT * FROM first_actor", "first_actor"))
def first_actor(t):
    return E.first_actor(t.pitches, SIDE, ORDER, "pitcher_mlbam_id")


@query("first_actor_rows", sql(f"""SELECT {ROW}, inning_topbot FROM pitches
  JOIN first_actor USING (game_id, inning_topbot, pitcher_mlbam_id)""", "first_actor"))
def first_actor_rows(t):
    return E.keep_first_actor_rows(t.pitches, SIDE, ORDER, "pitcher_mlbam_id").select(*ROW_KEYS, "inning_topbot")


@query("semi_join_starters", sql(f"""SELECT {ROW} FROM pitches WHERE (game_id, pitcher_mlbam_id) IN
  (SELECT (game_id, pitcher_mlbam_id) FROM first_actor)""", "first_actor"))
def semi_join_starters(t):
    starters = E.first_actor(t.pitches, SIDE, ORDER, "pitcher_mlbam_id")
    return E.semi_join_keys(t.pitches, starters, ["game_id", "pitcher_mlbam_id"]).select(*ROW_KEYS)


@query("left_join_zero_fill", sql(
    f"""SELECT {', '.join('a.' + k for k in X.KEYS)}, coalesce(tm.pitch_count, 0) AS pitch_count,
    coalesce(tm.whiff_count, 0) AS whiff_count FROM app a LEFT JOIN tm ON a.game_id = tm.game_id
    AND a.pitcher_mlbam_id = tm.pitcher_mlbam_id AND tm.pitch_type = 'PROMO'""", "app", "tm"))
def left_join_zero_fill(t):
    promo = t.type_metrics.where(F.col("pitch_type") == "PROMO").select(*X.KEYS, "pitch_count", "whiff_count")
    return X.left_join_zero_fill(
        t.appearances.select(*X.KEYS), promo, X.KEYS, ["pitch_count", "whiff_count"]
    )


@query("dense_scaffold", sql(f"SELECT {P.KEYS}, pitch_type FROM dense", "dense"))
def dense_scaffold(t):
    return X.dense_scaffold(t.appearances, X.KEYS, "pitch_type", CATEGORIES)


OUTS_SQL = "CASE WHEN events IN ('strikeout','field_out') THEN 1 ELSE 0 END"


@query("event_value_lookup", sql(f"SELECT {ROW}, {big(OUTS_SQL)} AS outs FROM pitches", "pitches"))
def event_value_lookup(t):
    return t.pitches.select(*ROW_KEYS, E.event_outs().alias("outs"))


part("innings", f"""SELECT game_id, pitcher_mlbam_id, inning, sum({OUTS_SQL}) AS outs, min(outs_when_up) AS at_start
FROM pitches GROUP BY game_id, pitcher_mlbam_id, inning""", "pitches")
part("inning_gaps", """SELECT *, CASE WHEN inning < max(inning) OVER (PARTITION BY game_id, pitcher_mlbam_id)
  AND at_start = 0 AND outs < 3 THEN 3 - outs ELSE 0 END AS gap FROM innings""", "innings")


@query("inning_reconciliation", sql(f"""SELECT game_id, pitcher_mlbam_id, {big('sum(outs)')} AS explicit_outs,
  {big('sum(gap)')} AS inferred_outs, {big('sum(outs + gap)')} AS outs_recorded
  FROM inning_gaps GROUP BY game_id, pitcher_mlbam_id""", "inning_gaps"))
def inning_reconciliation(t):
    return E.inning_reconciliation(t.pitches, ["game_id", "pitcher_mlbam_id"])


@query("distinct_excluding_marked", sql(f"""SELECT game_id, pitcher_mlbam_id,
  {big('count(DISTINCT at_bat_number) FILTER (NOT cut)')} AS batters_faced FROM (
   SELECT *, bool_or(coalesce(events = 'truncated_pa', false))
     OVER (PARTITION BY game_id, pitcher_mlbam_id, at_bat_number) AS cut FROM pitches)
  GROUP BY game_id, pitcher_mlbam_id""", "pitches"))
def distinct_excluding_marked(t):
    return E.distinct_excluding_marked(
        t.pitches, ["game_id", "pitcher_mlbam_id"], "at_bat_number",
        F.col("events") == "truncated_pa", "batters_faced",
    )


SCORE_ORDER = "(at_bat_number, pitch_number, batter, score)"


@query("score_delta", sql(f"""SELECT game_id, pitcher_mlbam_id, CASE WHEN max(score) IS NOT NULL THEN
  {big(f'greatest(0, max(score) - arg_min(score, {SCORE_ORDER}) FILTER (score IS NOT NULL))')} END AS runs
  FROM pitches GROUP BY game_id, pitcher_mlbam_id""", "pitches"))
def score_delta(t):
    return E.score_delta(
        t.pitches, ["game_id", "pitcher_mlbam_id"], "score",
        ["at_bat_number", "pitch_number", "batter", "score"],
    )


# --- the appearance record ----------------------------------------------------------------------

def side_pitches(t):
    """Adds team names and running scores per half inning."""
    return t.pitches.withColumns(
        {
            "player_name": F.concat(F.lit("Supplier "), F.col("pitcher_mlbam_id")),
            "home_team": F.col("game_id") % 25,
            "away_team": (F.col("game_id") + 7) % 25,
            "post_away_score": F.col("score"),
            "post_home_score": F.col("score") + 1,
        }
    )


part("rec", """SELECT *, CASE WHEN inning_topbot = 'Top' THEN score ELSE score + 1 END AS side_score,
  bool_or(coalesce(events = 'truncated_pa', false)) OVER
    (PARTITION BY game_id, inning_topbot, pitcher_mlbam_id, at_bat_number) AS cut,
  (pitch_number IS NOT NULL AND description IS DISTINCT FROM 'automatic_ball') AS pitch
FROM pitches JOIN first_actor USING (game_id, inning_topbot, pitcher_mlbam_id)""", "first_actor")
part("rec_innings", f"""SELECT game_id, inning_topbot, pitcher_mlbam_id, inning, sum({OUTS_SQL}) AS outs,
  min(outs_when_up) AS at_start FROM rec GROUP BY ALL""", "rec")
part("rec_outs", """SELECT game_id, inning_topbot, pitcher_mlbam_id, sum(outs + gap) AS outs_recorded FROM (
  SELECT *, CASE WHEN inning < max(inning) OVER (PARTITION BY game_id, inning_topbot, pitcher_mlbam_id)
   AND at_start = 0 AND outs < 3 THEN 3 - outs ELSE 0 END AS gap FROM rec_innings)
  GROUP BY ALL""", "rec_innings")


@query("appearance_table", sql(f"""SELECT game_date, game_id, pitcher_mlbam_id,
  'Supplier ' || pitcher_mlbam_id AS pitcher_name,
  CASE WHEN inning_topbot='Top' THEN game_id % 25 ELSE (game_id + 7) % 25 END AS team,
  CASE WHEN inning_topbot='Top' THEN (game_id + 7) % 25 ELSE game_id % 25 END AS opponent,
  CASE WHEN inning_topbot='Top' THEN 'home' ELSE 'away' END AS home_away,
  CASE WHEN inning_topbot='Top' THEN 'R' ELSE 'L' END AS pitcher_handedness,
  count(*) FILTER (pitch) AS pitches_thrown,
  count(DISTINCT at_bat_number) FILTER (NOT cut) AS batters_faced,
  count(*) FILTER (events = 'strikeout') AS strikeouts,
  {big('any_value(outs_recorded)')} AS outs_recorded,
  count(*) FILTER (events = 'single') AS hits, count(*) FILTER (events = 'walk') AS walks,
  CASE WHEN max(side_score) IS NOT NULL THEN {big(
    'greatest(0, max(side_score) - arg_min(side_score, (at_bat_number, pitch_number, batter, side_score)) FILTER (side_score IS NOT NULL))'
  )} END AS runs,
  count(*) AS source_rows, 'statcast_events_with_completed_inning_reconciliation' AS outs_method
  FROM rec JOIN rec_outs USING (game_id, inning_topbot, pitcher_mlbam_id)
  GROUP BY game_date, game_id, pitcher_mlbam_id, inning_topbot""", "rec", "rec_outs"))
def appearance_table(t):
    return E.appearance_table(
        side_pitches(t), ("at_bat_number", "pitch_number", "batter", "pitcher_mlbam_id", "score")
    )


# --- guarded joins and last-row-wins --------------------------------------------------------------

@query("validated_join", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_type, p_size
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def validated_join(t):
    right = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    left = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return M.validated_join(left, right, ["l_partkey"], "p_type")


@query("one_to_one_join", sql(f"""SELECT {', '.join('app.' + k for k in X.KEYS)}, app.strikeouts, em.k_count,
  em.pitches FROM app LEFT JOIN em USING ({P.KEYS})""", "app", "em"))
def one_to_one_join(t):
    return X.one_to_one_join(
        t.appearances.select(*X.KEYS, "strikeouts"),
        t.pitcher_metrics.select(*X.KEYS, "k_count", "pitches"),
        X.KEYS,
    )


@query("dedupe_keep_last", """SELECT l_suppkey, l_linenumber,
  unnest(max({'l_shipdate': CAST(l_shipdate AS DATE), 'l_orderkey': l_orderkey, 'l_partkey': l_partkey,
   'cents': CAST(round(l_extendedprice * 100) AS BIGINT)})) FROM lineitem GROUP BY l_suppkey, l_linenumber""")
def dedupe_keep_last(t):
    rows = t.lineitem.select(
        "l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("l_shipdate"), "l_orderkey", "l_partkey",
        bigint(F.round(F.col("l_extendedprice") * 100)).alias("cents"),
    )
    return X.keep_last(
        rows, ["l_suppkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_partkey", "cents"]
    )
