"""Quotes, prices, payloads, names and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog.probability_queries import clipped, poisson_sql
from antecede.catalog.registry import big, part, query, r, r6, rounded, sql
from antecede.functions import constants as K
from antecede.functions import text as T
from antecede.functions.expr import (
    expected_value,
    fair_odds,
    implied_probability,
)
from antecede.operators import decision as D
from antecede.operators import distributions as X
from antecede.operators import market as M
from antecede.operators.name_match import match_names
from antecede.plans.standin import bigint
from antecede.session import stage
from antecede.sources import payloads

# --- quotes: every line item is one capture of a two-way quote ------------------------------------

part("quotes", """SELECT l_suppkey AS pitcher_mlbam_id,
  CASE WHEN l_linestatus = 'F' THEN 'strikeouts' ELSE 'outs_recorded' END AS target, l_linenumber - 0.5::DOUBLE AS line,
  l_returnflag AS sportsbook, CAST(l_shipdate AS DATE) AS quote_date, l_orderkey, l_partkey,
  CASE WHEN l_partkey % 2 = 0 THEN -(100 + l_partkey % 60) ELSE 100 + l_partkey % 80 END AS over_odds,
  CASE WHEN l_orderkey % 2 = 0 THEN -(100 + l_orderkey % 60) ELSE 100 + l_orderkey % 80 END AS under_odds FROM lineitem""")
QUOTE = ["pitcher_mlbam_id", "target", "line", "sportsbook"]
part("market", f"""SELECT {', '.join(QUOTE)}, unnest(max({{'quote_date': quote_date, 'l_orderkey': l_orderkey,
  'l_partkey': l_partkey, 'over_odds': over_odds, 'under_odds': under_odds}})) FROM quotes GROUP BY {', '.join(QUOTE)}""", "quotes")


def quotes(t):
    def odds(key):
        return F.when(F.col(key) % 2 == 0, -(100 + F.col(key) % 60)).otherwise(100 + F.col(key) % 80)

    return t.lineitem.select(
        F.col("l_suppkey").alias("pitcher_mlbam_id"),
        F.when(F.col("l_linestatus") == "F", "strikeouts").otherwise("outs_recorded").alias("target"),
        (F.col("l_linenumber") - F.lit(0.5)).alias("line"),
        F.col("l_returnflag").alias("sportsbook"),
        F.to_date("l_shipdate").alias("quote_date"), "l_orderkey", "l_partkey",
        odds("l_partkey").alias("over_odds"), odds("l_orderkey").alias("under_odds"),
    )


def market(t):
    return M.latest_quotes(quotes(t), QUOTE, ["quote_date", "l_orderkey", "l_partkey", "over_odds", "under_odds"])


@query("quote_history_latest", sql("SELECT * FROM market", "market"))
def quote_history_latest(t):
    return market(t)


ODDS_IN = ["l_orderkey", "l_partkey", "pitcher_mlbam_id", "line"]


def implied_sql(odds: str) -> str:
    return f"CASE WHEN {odds} > 0 THEN 100.0 / ({odds} + 100.0) ELSE abs({odds}) / (abs({odds}) + 100.0) END::DOUBLE"


def ev_sql(p: str, odds: str) -> str:
    return f"({p} * CASE WHEN {odds} > 0 THEN {odds} / 100.0 ELSE 100.0 / abs({odds}) END - (1.0 - {p}))"


@query("implied_probability", sql(f"""SELECT {', '.join(ODDS_IN)}, {r(implied_sql('over_odds'))} AS over_raw_implied,
  {r(implied_sql('under_odds'))} AS under_raw_implied FROM quotes""", "quotes"))
def implied(t):
    return quotes(t).select(
        *ODDS_IN, r6(implied_probability("over_odds")).alias("over_raw_implied"),
        r6(implied_probability("under_odds")).alias("under_raw_implied"),
    )


@query("fair_odds", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN p <= 0 OR p >= 1 THEN NULL
  WHEN p >= 0.5 THEN -100.0 * p / (1.0 - p) ELSE 100.0 * (1.0 - p) / p END, 4) + 0.0 AS odds
  FROM (SELECT *, l_quantity / 50 AS p FROM lineitem)""")
def fair(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.round(fair_odds(F.col("l_quantity") / 50), 4) + F.lit(0.0)).alias("odds"),
    )


@query("no_vig", sql(f"""SELECT {', '.join(ODDS_IN)}, {r('o / (o + u)')} AS over_no_vig, {r('u / (o + u)')} AS under_no_vig,
  {r('o + u - 1.0')} AS hold FROM (SELECT *, {implied_sql('over_odds')} AS o, {implied_sql('under_odds')} AS u FROM quotes)""", "quotes"))
def no_vig(t):
    columns = M.no_vig_columns()
    return rounded(quotes(t).select(*ODDS_IN, *[columns[n].alias(n) for n in ("over_no_vig", "under_no_vig", "hold")]))


@query("expected_value", sql(f"SELECT {', '.join(ODDS_IN)}, {r(ev_sql('(l_partkey % 97 / 100.0::DOUBLE)', 'over_odds'))} AS ev FROM quotes", "quotes"))
def ev(t):
    p = F.col("l_partkey") % 97 / 100.0
    return rounded(quotes(t).select(*ODDS_IN, expected_value(p, "over_odds").alias("ev")))


# --- model side: one forecast per entity --------------------------------------------------------

part("forecast", """SELECT pitcher_mlbam_id, count(*) % 10 AS pitcher_starts_before_game, (pitcher_mlbam_id * 7) % 130 AS missing_features,
  avg(strikeouts) AS projected_strikeouts, avg(outs_recorded) * 4 AS projected_outs_recorded,
  avg(batters_faced) * 3 AS projected_batters_faced, avg(pitches_thrown) * 12 AS projected_pitches_thrown,
  avg(outs_recorded) AS outs FROM app GROUP BY pitcher_mlbam_id""", "app")
part("model", f"""SELECT pitcher_mlbam_id, target, projection, line, {clipped(poisson_sql('projection'))} AS probability_over FROM (
  SELECT pitcher_mlbam_id, 'strikeouts' AS target, projected_strikeouts AS projection FROM forecast UNION ALL
  SELECT pitcher_mlbam_id, 'outs_recorded', outs FROM forecast) CROSS JOIN (SELECT unnest([0.5,1.5,2.5,3.5,4.5,5.5,6.5]::DOUBLE[]) AS line)""", "forecast")
LINES = {t: tuple(0.5 + k for k in range(7)) for t in K.LINE_GRID}


def forecast(t):
    return t.appearances.groupBy("pitcher_mlbam_id").agg(
        (F.count(F.lit(1)) % 10).alias("pitcher_starts_before_game"),
        (F.col("pitcher_mlbam_id") * 7 % 130).alias("missing_features"),
        F.avg("strikeouts").alias("projected_strikeouts"),
        (F.avg("outs_recorded") * 4).alias("projected_outs_recorded"),
        (F.avg("batters_faced") * 3).alias("projected_batters_faced"),
        (F.avg("pitches_thrown") * 12).alias("projected_pitches_thrown"),
        F.avg("outs_recorded").alias("outs"),
    )


def model(points):
    pairs = F.array(
        F.struct(F.lit("strikeouts").alias("target"), F.col("projected_strikeouts").alias("prediction")),
        F.struct(F.lit("outs_recorded").alias("target"), F.col("outs").alias("prediction")),
    )
    rows = points.select("pitcher_mlbam_id", F.inline(pairs)).withColumn("actual", F.lit(None).cast("double"))
    return X.poisson_probabilities(rows, LINES).select(
        "pitcher_mlbam_id", "target", F.col("prediction").alias("projection"), "line", "probability_over"
    )


JOINED = [*QUOTE, "over_odds", "under_odds", "projection", "probability_over", "pitcher_starts_before_game",
          "missing_features", "projected_pitches_thrown", "projected_batters_faced", "projected_outs_recorded"]
part("joined", """SELECT market.*, projection, probability_over, forecast.* EXCLUDE (pitcher_mlbam_id) FROM market
  LEFT JOIN model USING (pitcher_mlbam_id, target, line) LEFT JOIN forecast USING (pitcher_mlbam_id)""", "market", "model", "forecast")


def joined(t, strict=False):
    """Forecasts feed two joins, and with guards every table is read by their checks as well, so they are written."""
    points = stage(forecast(t), "points")
    latest = stage(market(t), "market") if strict else market(t)
    priced = stage(model(points), "priced") if strict else model(points)
    return M.market_join(latest, priced, points, strict)


@query("market_join", sql(f"""SELECT {', '.join(r(c) + ' AS ' + c if c.startswith(('proj', 'prob')) else c for c in JOINED)}
  FROM joined""", "joined"))
def market_join(t):
    """With its guards: unique right sides and no unmatched quote."""
    df = joined(t, strict=True).select(*JOINED)
    return rounded(df, "projection", "probability_over", "projected_pitches_thrown", "projected_batters_faced", "projected_outs_recorded")


part("priced", f"""SELECT *, 1.0 - p AS q, o / (o + u) AS mo, u / (o + u) AS mu, o + u - 1.0 AS hold,
  {ev_sql('p', 'over_odds')} AS over_ev, {ev_sql('(1.0 - p)', 'under_odds')} AS under_ev,
  CASE WHEN p >= 0.5 THEN -100.0 * p / (1.0 - p) ELSE 100.0 * (1.0 - p) / p END AS fo,
  CASE WHEN 1.0 - p >= 0.5 THEN -100.0 * (1.0 - p) / p ELSE 100.0 * p / (1.0 - p) END AS fu
  FROM (SELECT *, probability_over AS p, {implied_sql('over_odds')} AS o, {implied_sql('under_odds')} AS u FROM joined)""", "joined")


def r3(name):
    return (F.round(name, 3) + F.lit(0.0)).alias(name)


@query("market_analysis", sql(f"""SELECT {', '.join(QUOTE)}, {r('p')} AS model_over_probability, {r('q')} AS model_under_probability,
  {r('mo')} AS market_over_no_vig, {r('mu')} AS market_under_no_vig, {r('p - mo')} AS over_probability_edge,
  {r('q - mu')} AS under_probability_edge, {r('over_ev')} AS over_ev, {r('under_ev')} AS under_ev,
  round(fo, 3) + 0.0 AS model_fair_over_odds, round(fu, 3) + 0.0 AS model_fair_under_odds, {r('hold')} AS sportsbook_hold FROM priced""", "priced"))
def market_analysis(t):
    names = list(M.market_columns())
    df = M.market_analysis(joined(t))
    return df.select(*QUOTE, *[r3(n) if "fair" in n else r6(n).alias(n) for n in names])


@query("role_flags", sql("""SELECT pitcher_mlbam_id, coalesce(nullif(concat_ws('|',
  CASE WHEN pitcher_starts_before_game < 4 THEN 'LIMITED_START_HISTORY' END,
  CASE WHEN projected_pitches_thrown < 60 THEN 'LOW_PROJECTED_PITCH_COUNT' END,
  CASE WHEN projected_batters_faced < 15 THEN 'LOW_PROJECTED_BF' END,
  CASE WHEN projected_outs_recorded < 9 THEN 'LOW_PROJECTED_OUTS' END,
  CASE WHEN missing_features >= 100 THEN 'HIGH_FEATURE_MISSINGNESS' END), ''), 'NONE') AS role_flags FROM forecast""", "forecast"))
def role_flags(t):
    return forecast(t).select("pitcher_mlbam_id", M.role_flags().alias("role_flags"))


part("sided", """SELECT *, CASE WHEN greatest(over_ev, under_ev) <= 0 THEN 'PASS' WHEN over_ev > under_ev THEN 'OVER' ELSE 'UNDER' END AS higher_ev_side,
  greatest(over_ev, under_ev) AS higher_ev, CASE WHEN over_ev > under_ev OR (over_ev = under_ev AND over_ev <= 0) THEN p - mo ELSE q - mu END AS edge FROM priced""", "priced")


@query("ev_side", sql(f"""SELECT {', '.join(QUOTE)}, higher_ev_side, {r('higher_ev')} AS higher_ev, {r('edge')} AS higher_probability_edge FROM sided""", "sided"))
def ev_side(t):
    df = M.market_analysis(joined(t)).withColumns(M.ev_side_columns())
    return df.select(*QUOTE, "higher_ev_side", r6("higher_ev").alias("higher_ev"), r6("higher_probability_edge").alias("higher_probability_edge"))


@query("market_ranking", sql(f"""SELECT {', '.join(QUOTE)}, higher_ev_side, {r('higher_ev * 100')} AS higher_ev_pct, {r('over_ev * 100')} AS over_ev_pct,
  {r('edge * 100')} AS higher_probability_edge_pp, {r('hold * 100')} AS sportsbook_hold_pct, {r('mo * 100')} AS market_over_no_vig_pct
  FROM sided ORDER BY higher_ev DESC, edge DESC""", "sided"))
def market_ranking(t):
    df = M.market_analysis(joined(t)).withColumns(M.ev_side_columns())
    ranked = M.ranked_markets(df, QUOTE)
    names = ["higher_ev_pct", "over_ev_pct", "higher_probability_edge_pp", "sportsbook_hold_pct", "market_over_no_vig_pct"]
    return ranked.select(*QUOTE, "higher_ev_side", *[r6(n).alias(n) for n in names])


@query("market_grid_gaps", sql(f"""SELECT s_suppkey AS pitcher_mlbam_id, target FROM supplier
  CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in K.TARGETS)}) v(target) WHERE (s_suppkey, target) NOT IN
  (SELECT (pitcher_mlbam_id, target) FROM quotes)""", "quotes"))
def market_grid_gaps(t):
    """Markets of all targets that no quote of any date covers."""
    return M.market_grid_gaps(t.supplier.select(F.col("s_suppkey").alias("pitcher_mlbam_id")), quotes(t), K.TARGETS)


# --- decisions ---------------------------------------------------------------------------------------

part("chosen", """SELECT *, over_ev >= under_ev AS over, CASE WHEN over_ev >= under_ev THEN p ELSE q END AS sp,
  CASE WHEN over_ev >= under_ev THEN over_odds ELSE under_odds END AS so, greatest(over_ev, under_ev) AS sev,
  CASE WHEN over_ev >= under_ev THEN p - mo ELSE q - mu END AS sedge,
  4.0 + CASE WHEN target = 'outs_recorded' AND line IN (15.5, 16.5, 18.5) THEN 1.0 ELSE 0.0 END AS stress FROM priced""", "priced")
part("stressed", f"SELECT *, {ev_sql('stp', 'so')} AS stev FROM (SELECT *, least(greatest(sp - stress / 100.0, 0.001), 0.999) AS stp FROM chosen)", "chosen")
part("tiered", """SELECT *, CASE WHEN missing_features >= 100 THEN 'PASS_ROLE_RISK' WHEN sev <= 0 THEN 'PASS' WHEN stev <= 0 THEN 'WATCH_FRAGILE'
  WHEN sev >= 0.06 AND sedge >= 0.05 AND stev >= 0.015 THEN 'STRONG_CANDIDATE' WHEN sev >= 0.03 AND sedge >= 0.03 THEN 'CANDIDATE'
  ELSE 'WATCH' END AS tier FROM stressed""", "stressed")
DOWN = """CASE WHEN {age} <= 1 THEN tier WHEN tier = 'STRONG_CANDIDATE' THEN 'CANDIDATE_STALE_DATA' WHEN tier IN ('CANDIDATE', 'WATCH') THEN 'WATCH_STALE_DATA'
  WHEN tier = 'WATCH_FRAGILE' THEN 'WATCH_FRAGILE_STALE_DATA' ELSE tier END"""


def decided(t, slate="2001-11-05"):
    priced = M.market_analysis(joined(t)).withColumn(
        "role_flags", F.when(F.col("missing_features") >= 100, "HIGH_FEATURE_MISSINGNESS").otherwise(" nan ")
    )
    return D.decide(priced, 4.0, "2001-11-04", slate)


@query("decision_side", sql(f"""SELECT {', '.join(QUOTE)}, CASE WHEN over THEN 'OVER' ELSE 'UNDER' END AS model_side, {r('sp')} AS selected_probability,
  so::DOUBLE AS selected_odds, {r('sev')} AS selected_ev, {r('least(over_ev, under_ev)')} AS opposite_side_ev, {r('sedge')} AS selected_edge,
  {r('CASE WHEN over THEN mo ELSE mu END')} AS selected_market_no_vig FROM chosen""", "chosen"))
def decision_side(t):
    df = M.market_analysis(joined(t)).withColumns(D.side_columns())
    names = ["selected_probability", "selected_ev", "opposite_side_ev", "selected_edge", "selected_market_no_vig"]
    return df.select(*QUOTE, "model_side", "selected_odds", *[r6(n).alias(n) for n in names])


@query("stressed_ev", sql(f"""SELECT {', '.join(QUOTE)}, stress::DOUBLE AS stress_pp, {r('stp')} AS stressed_probability, {r('stev')} AS stressed_ev FROM stressed""", "stressed"))
def stressed_ev(t):
    return decided(t).select(*QUOTE, "stress_pp", r6("stressed_probability").alias("stressed_probability"), r6("stressed_ev").alias("stressed_ev"))


@query("line_stress", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linestatus = 'O' AND l_linenumber + 12.5 IN (15.5, 16.5, 18.5)
  THEN 1.0::DOUBLE ELSE 0.0 END AS extra_stress FROM lineitem""")
def line_stress(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") + 12.5).alias("line"),
        F.when(F.col("l_linestatus") == "O", "outs_recorded").otherwise("strikeouts").alias("target"),
    )
    return rows.withColumn("extra_stress", D.extra_stress()).drop("line", "target")


@query("signal_tier", sql(f"SELECT {', '.join(QUOTE)}, tier AS signal_tier FROM tiered", "tiered"))
def signal_tier(t):
    return decided(t).select(*QUOTE, "signal_tier")


@query("stale_downgrade", sql(f"SELECT {', '.join(QUOTE)}, {DOWN.format(age='pitcher_mlbam_id % 4')} AS signal_tier FROM tiered", "tiered"))
def stale_downgrade(t):
    return decided(t).select(*QUOTE, D.stale_tier(F.col("signal_tier"), F.col("pitcher_mlbam_id") % 4).alias("signal_tier"))


@query("decision_ranking", sql(f"""SELECT {', '.join(QUOTE)}, {DOWN.format(age='3')} AS signal_tier, {r('sp * 100')} AS selected_probability_pct,
  {r('sev * 100')} AS selected_ev_pct, {r('sedge * 100')} AS selected_edge_pp, {r('stev * 100')} AS stressed_ev_pct,
  DATE '2001-11-04' AS data_as_of, CAST(3 AS BIGINT) AS data_age_days FROM tiered""", "tiered"))
def decision_ranking(t):
    names = ["selected_probability_pct", "selected_ev_pct", "selected_edge_pp", "stressed_ev_pct"]
    df = D.ranked_decisions(decided(t, "2001-11-07"), QUOTE)
    return df.select(*QUOTE, "signal_tier", *[r6(n).alias(n) for n in names], "data_as_of", "data_age_days")


@query("tier_counts", sql("SELECT tier AS signal_tier, count(*) AS n FROM tiered GROUP BY tier", "tiered"))
def tier_counts(t):
    return D.tier_counts(decided(t))


WORDS = ["NONE", " none ", "NaN", "<NA>", "null", "", " LOW_PROJECTED_BF ", "A|B"]


@query("normalize_flags", f"""SELECT flags, count(*) AS n FROM (SELECT CASE WHEN w IS NULL OR trim(w) = '' OR lower(trim(w)) IN ('none', 'nan', '<na>', 'null')
  THEN 'NONE' ELSE trim(w) END AS flags FROM (SELECT CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE ({WORDS})[l_partkey % 8 + 1] END AS w FROM lineitem)) GROUP BY flags""")
def normalize_flags(t):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("l_partkey") % 8 + 1).cast("int"))
    return t.lineitem.select(
        T.normalize_flags(F.when(F.col("l_orderkey") % 9 != 0, word)).alias("flags")
    ).groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


# --- text and names -------------------------------------------------------------------------------------

NORM = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents")
def normalize_text(t):
    return t.documents.select("doc_id", T.normalize_text("text").alias("normalized"))


CODES = list(K.TEAM_CODES)
NAMES = [names[0] for names in K.TEAM_CODES.values()]


@query("team_normalize", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' WHEN o_orderkey % 5 = 3 THEN 'ATH' ELSE ({CODES})[o_custkey % 30 + 1] END AS team FROM orders""")
def team_normalize(t):
    at = (F.col("o_custkey") % 30 + 1).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), at)
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), at)
    kind = F.col("o_orderkey") % 5
    written = (
        F.when(kind == 0, F.lower(code)).when(kind == 1, F.initcap(name))
        .when(kind == 2, F.concat(F.lit("  "), F.replace(F.upper(name), F.lit(" "), F.lit(". "))))
        .when(kind == 3, "oak").otherwise("No Such Team")
    )
    return t.orders.select("o_orderkey", T.team_code(written).alias("team"))


part("mention", """SELECT p_partkey AS mention_id, p_size AS block, CASE p_partkey % 5 WHEN 0 THEN upper(p_name)
   WHEN 1 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) WHEN 2 THEN left(p_name, 1) || '. ' || split_part(p_name, ' ', 2)
   WHEN 3 THEN 'zz ' || split_part(p_name, ' ', 2) ELSE p_name || ' Jr.' END AS name FROM part""")
part("person", """SELECT p_partkey AS candidate_id, p_size AS block, split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS name FROM part""")


def alias_sql(source: str, key: str) -> str:
    swapped = "CASE WHEN name LIKE '%,%' THEN trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) ELSE name END"
    return f"""SELECT DISTINCT {key}, block, alias, string_split(alias, ' ') AS words FROM (
      SELECT {key}, block, unnest([a, b, trim(regexp_replace(a, '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g')), trim(regexp_replace(b, '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g'))]) AS alias
      FROM (SELECT {key}, block, {NORM.format('name')} AS a, {NORM.format(swapped)} AS b FROM {source})) WHERE alias <> ''"""


part("said", alias_sql("mention", "mention_id"), "mention")
part("known", alias_sql("person", "candidate_id"), "person")


@query("name_match", sql("""SELECT m.mention_id, coalesce(e.c, l.c) AS candidate_id FROM mention m
  LEFT JOIN (SELECT s.mention_id, min(k.candidate_id) AS c FROM said s JOIN known k ON k.block IN (s.block, s.block + 1)
    AND (s.alias = k.alias OR (len(s.words) >= 2 AND len(k.words) >= 2 AND list_sort(list_distinct(s.words)) = list_sort(list_distinct(k.words)))
      OR (s.words[-1] = k.words[-1] AND left(s.words[1], 1) = left(k.words[1], 1))) GROUP BY s.mention_id) e USING (mention_id)
  LEFT JOIN (SELECT f.mention_id, min(k.candidate_id) AS c FROM (SELECT mention_id, block, string_split(min(alias), ' ')[-1] AS w FROM said GROUP BY mention_id, block) f
    JOIN known k ON k.block IN (f.block, f.block + 1) AND k.words[-1] = f.w GROUP BY f.mention_id HAVING count(DISTINCT k.candidate_id) = 1) l USING (mention_id)
  """, "mention", "said", "known"))
def name_match(t):
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    kind = F.col("p_partkey") % 5
    name = (
        F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat(last, F.lit(", "), first))
        .when(kind == 2, F.concat(F.substring("p_name", 1, 1), F.lit(". "), last))
        .when(kind == 3, F.concat(F.lit("zz "), last)).otherwise(F.concat("p_name", F.lit(" Jr.")))
    )
    mentions = t.part.select(
        F.col("p_partkey").alias("mention_id"), name.alias("name"),
        F.array(F.col("p_size"), F.col("p_size") + 1).alias("blocks"),
    )
    people = t.part.select(
        F.col("p_partkey").alias("candidate_id"), "p_size", F.concat(last, F.lit(", "), first).alias("name")
    )
    return match_names(mentions, people, ["mention_id"], "name", "blocks", "p_size", ["candidate_id"], "name")


# --- odds payloads: every event row becomes one nested document ------------------------------------------

part("offer", f"""SELECT e.*, c_mktsegment, c_nationkey,
  ({CODES})[CASE WHEN event_id % 4 = 3 THEN (c_nationkey + 11) % 30 ELSE c_nationkey END + 1] AS home,
  ({CODES})[(c_nationkey + 1 + event_id % 7) % 30 + 1] AS away,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN c_mktsegment || ' - C' || user_id
    WHEN event_id % 3 = 1 THEN lower(c_mktsegment) || ' C' || user_id || ' Jr' ELSE left(c_mktsegment, 1) || '. c' || user_id END AS player,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 7 + 0.5::DOUBLE END AS point,
  CASE WHEN event_id % 5 = 0 THEN event_type ELSE upper(event_type) END AS book
  FROM events e JOIN customer ON user_id = c_custkey""")
part("flat", """SELECT 'ev' || event_id AS event_id, book AS sportsbook, target, side, player AS player_name, point AS line, price, home, away, user_id, c_nationkey, c_mktsegment FROM (
  SELECT *, unnest([{'target': 'strikeouts', 'side': 'over', 'price': 100 + event_id % 50}, {'target': 'strikeouts', 'side': 'under', 'price': -(110 + event_id % 40)},
    {'target': 'outs_recorded', 'side': 'over', 'price': 105 + event_id % 30}, {'target': 'outs_recorded', 'side': 'under', 'price': CASE WHEN event_id % 3 = 0 THEN NULL ELSE -(120 + event_id % 20) END}], recursive := true)
  FROM offer) WHERE player IS NOT NULL AND point IS NOT NULL AND price IS NOT NULL""", "offer")


def documents(t):
    n = F.col("event_id")
    code = F.array(*[F.lit(c) for c in CODES])
    names = F.array(*[F.lit(x) for x in NAMES])
    rows = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"))
    nation = F.col("c_nationkey")
    player = F.when(n % 11 == 0, F.lit(None)).when(
        n % 3 == 0, F.concat("c_mktsegment", F.lit(" - C"), "user_id")
    ).when(
        n % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit(" C"), "user_id", F.lit(" Jr"))
    ).otherwise(F.concat(F.substring("c_mktsegment", 1, 1), F.lit(". c"), "user_id"))
    point = F.when(n % 13 != 0, (n % 7 + 0.5).cast("double"))

    def outcome(name, price):
        return F.struct(
            F.lit(name).alias("name"), player.alias("description"), point.alias("point"), price.cast("double").alias("price")
        )

    def market_of(key, outcomes):
        return F.struct(F.lit(key).alias("key"), F.lit("2024-01-01T00:00:00Z").alias("last_update"), F.array(*outcomes).alias("outcomes"))

    book = F.struct(
        F.col("event_type").alias("key"),
        F.when(n % 5 != 0, F.upper("event_type")).alias("title"),
        F.lit("2024-01-01T00:00:00Z").alias("last_update"),
        F.array(
            market_of("pitcher_strikeouts", [
                outcome("Over", 90 + n % 50), outcome("Push", n), outcome("Under", -(110 + n % 40)), outcome(" OVER ", 100 + n % 50 + 0.25)]),
            market_of("batter_hits", [outcome("Over", n), outcome("Under", n)]),
            market_of("pitcher_outs", [
                outcome("over", 105 + n % 30), outcome("Under", F.when(n % 3 != 0, -(120 + n % 20)))]),
        ).alias("markets"),
    )
    home_at = (F.when(n % 4 == 3, (nation + 11) % 30).otherwise(nation) + 1).cast("int")
    away_at = ((nation + 1 + n % 7) % 30 + 1).cast("int")
    return rows.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("ev"), n).alias("id"),
                F.col("ts").cast("string").alias("commence_time"),
                F.element_at(names, home_at).alias("home_team"),
                F.element_at(code, away_at).alias("away_team"),
                F.array(book).alias("bookmakers"),
            )
        ).alias("payload")
    )


@query("odds_flatten", sql("""SELECT event_id, sportsbook, target, side, player_name, line, CAST(price AS BIGINT) AS price FROM flat UNION ALL
  SELECT 'ev' || event_id, book, 'strikeouts', 'over', player, point, 90 + event_id % 50 FROM offer WHERE player IS NOT NULL AND point IS NOT NULL""", "flat", "offer"))
def odds_flatten(t):
    return payloads.flatten_odds(documents(t)).select("event_id", "sportsbook", "target", "side", "player_name", "line", "price")


PAIRED = """SELECT event_id, sportsbook, target, player_name, line, max(price) FILTER (side = 'over') AS over_odds,
  max(price) FILTER (side = 'under') AS under_odds, any_value(home) AS home, any_value(away) AS away, any_value(user_id) AS user_id,
  any_value(c_nationkey) AS nation, any_value(c_mktsegment) AS seg FROM flat
  GROUP BY event_id, sportsbook, target, player_name, line HAVING count(DISTINCT side) = 2"""
part("paired", PAIRED, "flat")


@query("over_under_pairing", sql("""SELECT event_id, sportsbook, target, player_name, line, CAST(over_odds AS BIGINT) AS over_odds,
  CAST(under_odds AS BIGINT) AS under_odds FROM paired""", "paired"))
def over_under_pairing(t):
    return M.pair_sides(
        payloads.flatten_odds(documents(t)), ["event_id", "sportsbook", "target", "player_name", "line"]
    )


def starters(t):
    code = F.array(*[F.lit(c) for c in CODES])
    return t.customer.select(
        F.col("c_custkey").alias("pitcher_mlbam_id"),
        F.concat(F.lit("c"), "c_custkey", F.lit(", "), "c_mktsegment").alias("pitcher_name"),
        F.element_at(code, (F.col("c_nationkey") + 1).cast("int")).alias("team"),
    )


def matched_outcomes(t):
    outcomes = stage(payloads.flatten_odds(documents(t)), "outcomes")
    people = starters(t)
    mentions = outcomes.select("event_id", "player_name", F.array("home_code", "away_code").alias("teams")).distinct()
    matched = match_names(
        mentions, people, ["event_id", "player_name"], "player_name", "teams", "team",
        ["pitcher_mlbam_id", "pitcher_name", "team"], "pitcher_name",
    )
    return outcomes.join(matched, ["event_id", "player_name"], "left")


BOARD = ["pitcher_mlbam_id", "pitcher_name", "team", "event_id", "target", "line", "sportsbook"]


def odds_board_rows(t):
    known = matched_outcomes(t).where(F.col("pitcher_name").isNotNull())
    return M.board(M.pair_sides(known, BOARD, ["bookmaker_last_update"]))


part("board", f"""SELECT user_id AS pitcher_mlbam_id, 'c' || user_id || ', ' || seg AS pitcher_name, ({CODES})[nation + 1] AS team, event_id, target, line, sportsbook,
  CAST(over_odds AS BIGINT) AS over_odds, CAST(under_odds AS BIGINT) AS under_odds FROM paired WHERE ({CODES})[nation + 1] IN (home, away)""", "paired")


@query("odds_board", sql("SELECT * FROM board", "board"))
def odds_board(t):
    return odds_board_rows(t).drop("bookmaker_last_update")


@query("board_coverage", sql("""SELECT count(*) AS market_rows, count(*) FILTER (target = 'strikeouts') AS strikeouts_rows,
  count(*) FILTER (target = 'outs_recorded') AS outs_recorded_rows, count(DISTINCT pitcher_name) AS pitchers_covered,
  count(DISTINCT sportsbook) AS sportsbooks_covered FROM board""", "board"))
def board_coverage(t):
    return M.board_coverage(odds_board_rows(t))


@query("unmatched_names", sql(f"""SELECT DISTINCT player_name FROM flat WHERE ({CODES})[c_nationkey + 1] NOT IN (home, away)""", "flat"))
def unmatched_names(t):
    return matched_outcomes(t).where(F.col("pitcher_name").isNull()).select("player_name").distinct()


@query("unordered_pair_join", sql("""SELECT o_orderkey, o_custkey % 25 AS home, o_orderkey % 25 AS away FROM orders
  WHERE (least(o_custkey % 25, o_orderkey % 25), greatest(o_custkey % 25, o_orderkey % 25)) IN
  (SELECT (least(team, opponent), greatest(team, opponent)) FROM app WHERE game_date = DATE '2001-08-01')""", "app"))
def unordered_pair_join(t):
    games = t.orders.select("o_orderkey", (F.col("o_custkey") % 25).alias("home"), (F.col("o_orderkey") % 25).alias("away"))
    slate = t.appearances.where(F.col("game_date") == F.lit("2001-08-01").cast("date"))
    return M.unordered_pair_join(games, slate, ("home", "away"), ("team", "opponent"))


# --- schedules: every order becomes one game document ----------------------------------------------------

def schedules(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def side(team, person, name, known):
        return F.struct(
            F.struct(team.alias("id")).alias("team"),
            F.when(known, F.struct(person.alias("id"), name.alias("fullName"))).alias("probablePitcher"),
        )

    away = side(cust % 25, cust, F.concat(F.lit("Ann Mary P"), cust), cust % 7 != 0)
    home = side(key % 25, key % 1000, F.when(key % 9 != 0, F.concat(F.lit("Bo Q"), key % 1000)), key % 5 != 0)
    game = F.struct(key.alias("gamePk"), F.struct(away.alias("away"), home.alias("home")).alias("teams"))
    day = F.struct(F.to_date("o_orderdate").cast("string").alias("date"), F.array(game).alias("games"))
    return t.orders.select(F.to_json(F.struct(F.array(day).alias("dates"))).alias("payload"))


part("sides", """SELECT CAST(o_orderdate AS DATE) AS game_date, o_orderkey AS game_id, 'away' AS home_away, o_custkey % 25 AS team, o_orderkey % 25 AS opponent,
   CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS pitcher_mlbam_id, 'P' || o_custkey || ', Ann Mary' AS pitcher_name FROM orders UNION ALL
  SELECT CAST(o_orderdate AS DATE), o_orderkey, 'home', o_orderkey % 25, o_custkey % 25, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 END,
   CASE WHEN o_orderkey % 9 <> 0 THEN 'Q' || o_orderkey % 1000 || ', Bo' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END FROM orders""")
EMPTY = ", ".join(f"CAST(NULL AS BIGINT) AS {c}" for c in (*K.TARGETS, "hits", "walks", "runs"))


@query("schedule_rows", sql(f"""SELECT game_date, game_id, pitcher_mlbam_id, pitcher_name, team, opponent, home_away, {EMPTY}, CAST(0 AS BIGINT) AS source_rows,
  'pregame_unplayed' AS outs_method FROM sides WHERE pitcher_mlbam_id IS NOT NULL""", "sides"))
def schedule_rows(t):
    return payloads.scheduled_appearances(payloads.schedule_sides(schedules(t)))


@query("missing_starters", sql("SELECT game_id, team, opponent, home_away FROM sides WHERE pitcher_mlbam_id IS NULL", "sides"))
def missing_starters(t):
    return payloads.missing_starters(payloads.schedule_sides(schedules(t)))
