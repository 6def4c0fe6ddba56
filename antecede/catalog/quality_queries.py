"""Data-quality queries (V1-V20) over a raw feed with faults derived from the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from antecede.catalog import parts as P
from antecede.catalog.history_queries import CONTEXT, FEATURES, SLATE, TARGETS, pre_event
from antecede.catalog.registry import big, part, query, r, r6, sql
from antecede.operators import quality as Q
from antecede.operators.market import normalize_target
from antecede.plans.standin import bigint
from antecede.session import scratch_path
from antecede.sources import publish

# The raw feed: pitches as text with bad dates, ids, sides, hands, innings and types mixed in.
part("feed", f"""SELECT
  CASE WHEN l_partkey % 97 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS game_date,
  CAST(l_orderkey AS VARCHAR) AS game_pk,
  CASE WHEN l_orderkey % 101 = 0 THEN 'x' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END AS pitcher,
  CASE WHEN l_partkey % 50 = 1 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS batter,
  l_suppkey AS at_bat_number, {big('l_quantity')} AS inning,
  CASE WHEN l_partkey % 53 = 0 THEN 'Mid' WHEN l_linestatus = 'F' THEN 'Top' ELSE 'Bot' END AS inning_topbot,
  {big('l_linenumber')} * 30 AS pitch_number, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END AS events,
  l_returnflag AS description, CASE WHEN l_partkey % 41 = 0 THEN 'B' ELSE 'R' END AS stand,
  CASE WHEN l_tax = 0 THEN NULL ELSE 'L' END AS p_throws,
  CASE WHEN l_discount = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 'FFF' ELSE 'FF' END AS pitch_type
FROM lineitem""")


def feed(t):
    part_key, text = F.col("l_partkey"), "string"
    return t.lineitem.select(
        F.when(part_key % 97 == 0, "unknown").otherwise(F.to_date("l_shipdate").cast(text)).alias("game_date"),
        F.col("l_orderkey").cast(text).alias("game_pk"),
        F.when(F.col("l_orderkey") % 101 == 0, F.concat(F.lit("x"), F.col("l_suppkey")))
        .otherwise(F.col("l_suppkey").cast(text)).alias("pitcher"),
        F.when(part_key % 50 != 1, part_key.cast(text)).alias("batter"),
        F.col("l_suppkey").alias("at_bat_number"),
        bigint("l_quantity").alias("inning"),
        F.when(part_key % 53 == 0, "Mid").when(F.col("l_linestatus") == "F", "Top").otherwise("Bot")
        .alias("inning_topbot"),
        (bigint("l_linenumber") * 30).alias("pitch_number"),
        F.when(F.col("l_linenumber") % 2 != 0, F.col("l_returnflag")).alias("events"),
        F.col("l_returnflag").alias("description"),
        F.when(part_key % 41 == 0, "B").otherwise("R").alias("stand"),
        F.when(F.col("l_tax") != 0, F.lit("L")).alias("p_throws"),
        F.when(F.col("l_discount") == 0, F.lit(None)).when(part_key % 31 == 0, "FFF").otherwise("FF")
        .alias("pitch_type"),
    )


FEED_COLUMNS = [
    "game_date", "game_pk", "pitcher", "batter", "at_bat_number", "inning", "inning_topbot",
    "pitch_number", "events", "description", "stand", "p_throws", "pitch_type",
]


@query("null_profile", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM feed" for c in FEED_COLUMNS)
    + ") WHERE nulls > 0", "feed"))
def null_profile(t):
    return Q.null_profile(feed(t))


DUPLICATES = """(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM feed
  GROUP BY game_pk, at_bat_number, pitch_number, pitcher, batter))"""


@query("duplicate_count", sql(f"SELECT {big(DUPLICATES)} AS duplicate_rows", "feed"))
def duplicate_count(t):
    return Q.duplicate_count(feed(t), ("game_pk", "at_bat_number", "pitch_number", "pitcher", "batter"))


CHECKS = {
    "rows": "count(*)",
    "invalid_dates": "count(*) FILTER (try_cast(game_date AS DATE) IS NULL)",
    "invalid_game_pk": "count(*) FILTER (try_cast(game_pk AS DOUBLE) IS NULL)",
    "invalid_pitcher": "count(*) FILTER (try_cast(pitcher AS DOUBLE) IS NULL)",
    "invalid_batter": "count(*) FILTER (try_cast(batter AS DOUBLE) IS NULL)",
    "invalid_sides": "count(*) FILTER (inning_topbot IS NOT NULL AND lower(inning_topbot) NOT IN ('top', 'bot', 'bottom'))",
    "invalid_stand": "count(*) FILTER (stand NOT IN ('L', 'R', 'S'))",
    "invalid_p_throws": "count(*) FILTER (p_throws NOT IN ('L', 'R', 'S'))",
    "invalid_innings": "count(*) FILTER (inning < 1 OR inning > 30)",
    "invalid_pitch_numbers": "count(*) FILTER (pitch_number < 1 OR pitch_number > 200)",
    "invalid_pitch_types": "count(*) FILTER (length(pitch_type) <> 2)",
}
part("validity", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CHECKS.items()) + " FROM feed", "feed")


@query("validity_report", sql("SELECT * FROM validity", "validity"))
def validity_report(t):
    return Q.validity_report(feed(t))


@query("validity_problems", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS finding, {c} AS n FROM validity" for c in CHECKS if c != "rows") + ") WHERE n > 0", "validity"))
def validity_problems(t):
    return Q.findings(Q.validity_report(feed(t)))


MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in (
    "game_date", "game_pk", "pitcher", "batter", "inning", "inning_topbot", "at_bat_number", "pitch_number"))


@query("critical_gate", sql(f"""SELECT rows, array_to_string(list_filter([
  CASE WHEN {DUPLICATES} > 0 THEN 'duplicate_pitch_records' END,
  CASE WHEN invalid_dates > 0 THEN 'invalid_dates' END,
  CASE WHEN invalid_game_pk + invalid_pitcher + invalid_batter > 0 THEN 'invalid_identifiers' END,
  CASE WHEN invalid_sides > 0 THEN 'invalid_inning_sides' END,
  CASE WHEN invalid_innings > 0 THEN 'invalid_innings' END,
  CASE WHEN invalid_pitch_numbers > 0 THEN 'invalid_pitch_numbers' END,
  CASE WHEN invalid_pitch_types > 0 THEN 'invalid_pitch_types' END,
  CASE WHEN (SELECT {MISSING} FROM feed) > 0 THEN 'missing_critical_values' END
 ], lambda x: x IS NOT NULL), '|') AS failed FROM validity""", "validity", "feed"))
def critical_gate(t):
    return Q.failed_checks(Q.full_report(feed(t))).select("rows", F.array_join("failed", "|").alias("failed"))


CLEAN = """try_cast(game_date AS DATE) IS NOT NULL AND try_cast(pitcher AS DOUBLE) IS NOT NULL AND batter IS NOT NULL
  AND inning BETWEEN 1 AND 30 AND inning_topbot <> 'Mid' AND pitch_number <= 200 AND coalesce(length(pitch_type), 2) = 2"""


@query("gated_feed", sql(f"""SELECT 'clean' AS part, 'complete' AS status, count(*) AS row_count, '' AS failed, {big('sum(invalid_stand)')} AS invalid_stand,
   count(*) AS published_rows FROM (SELECT game_pk, at_bat_number, pitch_number, pitcher, batter, min(CASE WHEN stand = 'B' THEN 1 ELSE 0 END) AS invalid_stand
   FROM feed WHERE {CLEAN} GROUP BY ALL)
  UNION ALL SELECT 'raw', CASE WHEN failed = '' THEN 'complete' ELSE 'failed' END, rows, failed, invalid_stand, CASE WHEN failed = '' THEN rows ELSE 0 END FROM (
   SELECT rows, invalid_stand, array_to_string(list_filter([
    CASE WHEN {DUPLICATES} > 0 THEN 'duplicate_pitch_records' END,
    CASE WHEN invalid_dates > 0 THEN 'invalid_dates' END,
    CASE WHEN invalid_game_pk + invalid_pitcher + invalid_batter > 0 THEN 'invalid_identifiers' END,
    CASE WHEN invalid_sides > 0 THEN 'invalid_inning_sides' END,
    CASE WHEN invalid_innings > 0 THEN 'invalid_innings' END,
    CASE WHEN invalid_pitch_numbers > 0 THEN 'invalid_pitch_numbers' END,
    CASE WHEN invalid_pitch_types > 0 THEN 'invalid_pitch_types' END,
    CASE WHEN (SELECT {MISSING} FROM feed) > 0 THEN 'missing_critical_values' END], lambda x: x IS NOT NULL), '|') AS failed FROM validity)""", "validity", "feed"))
def gated_feed(t):
    """The raw feed and its clean rows as two parts: each written and checked in one scan, only the clean one published."""
    root = scratch_path(t.spark, "feed")
    key = ["game_pk", "at_bat_number", "pitch_number", "pitcher", "batter"]
    # Of repeated keys any row would do; the one with the largest stand is one that passes where there is one.
    others = [c for c in FEED_COLUMNS if c not in key]
    last = F.max_by(F.struct(*others), F.struct("stand", *[c for c in others if c != "stand"])).alias("kept")
    clean = feed(t).where(CLEAN).groupBy(*key).agg(last).select(*key, "kept.*")
    for name, rows in (("raw", feed(t)), ("clean", clean)):
        publish.publish_feed(rows.withColumn("part", F.lit(name)), root, name, strict=False)
    back = publish.published(t.spark, root).groupBy("part").agg(F.count(F.lit(1)).alias("published_rows"))
    log = publish.manifest(t.spark, root).withColumn("failed", F.array_join(publish.failed_checks(), "|"))
    return log.join(back, "part", "left").select(
        "part", "status", "row_count", "failed", F.col("findings")["invalid_stand"].alias("invalid_stand"), F.coalesce("published_rows", F.lit(0)).alias("published_rows")
    )


@query("group_size_anomalies", """SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey
  HAVING count(*) <> 4""")
def group_size_anomalies(t):
    return Q.group_size_anomalies(t.lineitem, ["l_orderkey"], 4)


@query("season_report", sql(f"""SELECT * FROM (SELECT season, count(*) AS raw_rows,
   count(DISTINCT game_id) AS games, min(game_date) AS first_date, max(game_date) AS last_date
   FROM pitches GROUP BY season)
 JOIN (SELECT season, {big('sum(n)')} AS appearances, count(*) FILTER (n = 2) AS normal_games,
   count(*) FILTER (n <> 2) AS unusual_games FROM
   (SELECT season, game_id, count(*) AS n FROM app GROUP BY season, game_id) GROUP BY season) USING (season)
 JOIN (SELECT season, count(DISTINCT pitcher_mlbam_id) AS entities FROM app GROUP BY season) USING (season)
 """, "pitches", "app"))
def season_report(t):
    return Q.season_report(t.pitches, t.appearances)


@query("normalize_schema", """SELECT CAST(o_orderdate AS DATE) AS game_date, o_orderkey AS game_id,
  o_custkey AS pitcher_mlbam_id, CASE WHEN o_custkey % 3 = 0 THEN CAST(year(o_orderdate) AS BIGINT)
   WHEN o_custkey % 3 = 1 THEN 1990 + o_custkey % 7 ELSE CAST(year(o_orderdate) AS BIGINT) END AS season,
  o_orderpriority AS pitcher_handedness FROM orders""")
def normalize_schema(t):
    season = F.when(F.col("o_custkey") % 3 == 1, (1990 + F.col("o_custkey") % 7).cast("string")).when(
        F.col("o_custkey") % 3 == 2, "n/a"
    )
    rows = t.orders.select(
        F.col("o_orderdate").alias("game_date"), F.col("o_orderkey").alias("game_pk"),
        F.col("o_custkey").alias("pitcher_mlbam_id"), season.alias("season"),
        F.col("o_orderpriority").alias("pitcher_hand"),
    )
    return Q.normalize_schema(
        rows, {"game_pk": "game_id", "pitcher_hand": "pitcher_handedness"}, "game_date"
    )


@query("blank_partial_rows", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN (l_tax = 0)::INT + (l_discount = 0)::INT + (l_quantity > 25)::INT = 3 THEN 'blank'
   WHEN (l_tax = 0)::INT + (l_discount = 0)::INT + (l_quantity > 25)::INT > 0 THEN 'partial'
   ELSE 'complete' END AS fill_state FROM lineitem""")
def blank_partial_rows(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("line"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("over_odds"),
        F.when(F.col("l_quantity") <= 25, F.col("l_quantity")).alias("under_odds"),
    )
    return Q.blank_partial(rows, ["line", "over_odds", "under_odds"]).drop("line", "over_odds", "under_odds")


@query("alias_normalize", """SELECT event_type, target, count(*) AS n FROM (SELECT event_type,
  CASE lower(trim(alias)) WHEN 'k' THEN 'strikeouts' WHEN 'ks' THEN 'strikeouts' WHEN 'strikeout' THEN 'strikeouts'
   WHEN 'outs' THEN 'outs_recorded' WHEN 'out' THEN 'outs_recorded' END AS target FROM (
   SELECT event_type, CASE event_id % 6 WHEN 0 THEN ' K' WHEN 1 THEN 'ks ' WHEN 2 THEN 'Strikeout' WHEN 3 THEN 'OUTS'
     WHEN 4 THEN 'out' ELSE 'hits' END AS alias FROM events)) GROUP BY event_type, target""")
def alias_normalize(t):
    alias = F.element_at(
        F.array(*[F.lit(a) for a in (" K", "ks ", "Strikeout", "OUTS", "out", "hits")]),
        (F.col("event_id") % 6 + 1).cast("int"),
    )
    return t.events.select("event_type", normalize_target(alias).alias("target")).groupBy(
        "event_type", "target"
    ).agg(F.count(F.lit(1)).alias("n"))


CUTOFF = date(1999, 1, 15)


@query("pit_cutoff", """SELECT CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem WHERE l_shipdate < DATE '1999-01-15'""")
def pit_cutoff(t):
    rows = Q.before_cutoff(t.lineitem, "l_shipdate", CUTOFF)
    return rows.select(
        F.to_date("l_shipdate").alias("ship_date"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )


@query("target_leak_gate", sql(f"""SELECT {", ".join(f"CAST(0 AS BIGINT) AS known_{c}" for c in TARGETS)},
  count(*) FILTER (game_date IS DISTINCT FROM DATE '2001-08-01') AS off_date_rows
  FROM app WHERE game_date = DATE '2001-08-01'""", "app"))
def target_leak_gate(t):
    return Q.target_leaks(pre_event(t), TARGETS, "game_date", SLATE)


MISSING_FEATURES = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FEATURES)


@query("row_missingness", sql(f"SELECT {P.KEYS}, {big(MISSING_FEATURES)} AS missing_features FROM features", "features"))
def row_missingness(t):
    return Q.row_missingness(t.features, FEATURES).select("season", "game_date", "game_id", "pitcher_mlbam_id", "missing_features")


@query("missingness_summary", sql(f"""SELECT {r('avg(m)')} AS mean_missing, {big('max(m)')} AS max_missing,
  {r(f'sum(m) / (count(*) * {len(FEATURES)})')} AS missing_rate FROM (SELECT {MISSING_FEATURES} AS m FROM features)""", "features"))
def missingness_summary(t):
    df = Q.missingness_summary(t.features, FEATURES)
    return df.select(r6("mean_missing").alias("mean_missing"), "max_missing", r6("missing_rate").alias("missing_rate"))


@query("parity_gate", sql(f"""SELECT (SELECT count(*) FROM app WHERE season = 2001) AS left_rows,
  (SELECT count(*) FROM em WHERE season = 2001) AS right_rows,
  (SELECT count(*) FROM app WHERE season = 2001) - (SELECT count(*) FROM em WHERE season = 2001) AS gap,
  CAST(0 AS BIGINT) AS other_values""", "app", "em"))
def parity_gate(t):
    season = F.col("season") == 2001
    return Q.parity_report(t.appearances.where(season), t.pitcher_metrics.where(season), "season", 2001)


def _dictionary_sql() -> str:
    rows = []
    for c in [*CONTEXT, *FEATURES, *TARGETS]:
        rows.append(
            f"SELECT '{c}' AS column_name, '{Q.column_role(c)}' AS role, "
            f"count(*) FILTER ({c} IS NULL) AS missing_count, '{Q.describe_column(c)}' AS description FROM features"
        )
    return sql(" UNION ALL ".join(rows), "features").replace("features AS (", "features AS MATERIALIZED (")


@query("feature_dictionary", _dictionary_sql())
def feature_dictionary(t):
    return Q.feature_dictionary(t.features).drop("dtype")
