"""Scans, sinks, calendars and unions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from antecede.catalog import parts as P
from antecede.catalog.registry import big, part, query, r, r6, sql
from antecede.operators import features as X
from antecede.plans.standin import bigint
from antecede.session import scratch_path
from antecede.sources import publish, scan, sinks

SCAN = ["game_date", "game_id", "pitcher_mlbam_id", "batter", "events", "description", "p_throws",
        "inning_topbot", "zone", "release_speed", "at_bat_number", "pitch_number"]


@query("scan_project", sql(f"SELECT {', '.join(SCAN)} FROM pitches", "pitches"))
def scan_project(t):
    return t.pitches.select(*SCAN)


def _seasons_written(t) -> str:
    path = scratch_path(t.spark, "seasons")
    sinks.write_seasons(t.appearances.select("season", "game_date", "game_id", "pitcher_mlbam_id", "strikeouts"), path)
    return path


@query("season_write_readback", sql("""SELECT season, count(*) AS n, CAST(sum(strikeouts) AS BIGINT) AS strikeouts,
  min(game_date) AS first_date FROM app GROUP BY season""", "app"))
def season_write_readback(t):
    back = t.spark.read.parquet(_seasons_written(t))
    return back.groupBy(bigint("season").alias("season")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("strikeouts").alias("strikeouts"), F.min("game_date").alias("first_date")
    )


@query("scan_partition_prune", sql("""SELECT season, game_date, game_id, pitcher_mlbam_id, strikeouts FROM app
  WHERE season IN (1997, 2000)""", "app"))
def scan_partition_prune(t):
    rows = scan.scan_seasons(t.spark, _seasons_written(t), [1997, 2000])
    return rows.withColumn("season", bigint("season"))


DAYS = "CAST(l_shipdate AS DATE)"
START = date(1995, 1, 1)
ADMIT = date(1999, 1, 15)
part("chunked", f"""SELECT l_orderkey, l_linenumber, {DAYS} AS d, l_quantity, l_tax,
  {big(f"floor(date_diff('day', DATE '1995-01-01', {DAYS}) / 7.0)")} AS chunk FROM lineitem""")


@query("chunk_admission", sql("""SELECT chunk, min(d) AS first_date, max(d) AS last_date, count(*) AS row_count,
  DATE '1995-01-01' + CAST(chunk * 7 + 6 AS INT) < DATE '1999-01-15' AS admitted FROM chunked GROUP BY chunk""", "chunked"))
def chunk_admission(t):
    """A chunk is admitted only when its whole range ends before the cutoff."""
    days = t.lineitem.select(F.to_date("l_shipdate").alias("d"))
    end = F.date_add(F.lit(START), (F.col("chunk") * 7 + 6).cast("int"))
    return (
        days.groupBy(scan.chunk_of("d", START, 7).alias("chunk"))
        .agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("row_count"))
        .withColumn("admitted", end < F.lit(ADMIT))
    )


CSV_COLUMNS = ["pitcher_mlbam_id", "target", "line", "over_odds", "under_odds"]


@query("csv_coerce", """SELECT l_suppkey AS pitcher_mlbam_id, l_returnflag AS target, count(*) AS n,
  count(*) FILTER (l_partkey % 9 <> 0) AS with_line,
  CAST(sum(CASE WHEN l_partkey % 9 <> 0 THEN l_linenumber * 10 + 5 END) AS BIGINT) AS line_tenths,
  CAST(sum(CASE WHEN l_orderkey % 7 <> 0 THEN 100 + l_partkey % 80 END) AS BIGINT) AS over_odds,
  count(*) FILTER (l_tax <> 0) AS with_under FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def csv_coerce(t):
    """Quotes written as CSV text with bad numbers, read back with late coercion."""
    path = scratch_path(t.spark, "quotes-csv")
    text = t.lineitem.select(
        F.col("l_suppkey").alias("pitcher_mlbam_id"),
        F.col("l_returnflag").alias("target"),
        F.when(F.col("l_partkey") % 9 == 0, "tbd").otherwise((F.col("l_linenumber") + 0.5).cast("string")).alias("line"),
        F.when(F.col("l_orderkey") % 7 == 0, "").otherwise((100 + F.col("l_partkey") % 80).cast("string")).alias("over_odds"),
        F.when(F.col("l_tax") != 0, "-110").otherwise("-").alias("under_odds"),
    )
    sinks.write_report(text, path)
    kinds = {"pitcher_mlbam_id": "bigint", "line": "double", "over_odds": "bigint", "under_odds": "bigint"}
    rows = scan.read_csv_coerced(t.spark, path, CSV_COLUMNS, kinds)
    return rows.groupBy("pitcher_mlbam_id", "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("line").alias("with_line"),
        F.sum(bigint(F.col("line") * 10)).alias("line_tenths"),
        F.sum("over_odds").alias("over_odds"),
        F.count("under_odds").alias("with_under"),
    )


part("span", f"SELECT min({DAYS}) AS low, max({DAYS}) AS high FROM lineitem")
part("calendar", """SELECT CAST(i AS BIGINT) AS chunk, low + CAST(i * 7 AS INT) AS chunk_start,
  least(low + CAST(i * 7 + 6 AS INT), high) AS chunk_end
  FROM span, unnest(range(0, CAST(date_diff('day', low, high) // 7 + 1 AS BIGINT))) u(i)""", "span")


def _ship_days(t):
    return t.lineitem.select(F.to_date("l_shipdate").alias("d"), "l_quantity", "l_tax", "l_discount")


@query("date_chunks", sql("SELECT * FROM calendar", "calendar"))
def date_chunks(t):
    return scan.calendar_of(_ship_days(t), "d", 7)


MANIFEST = """SELECT chunk, min(d) AS first_date, max(d) AS last_date, count(*) AS row_count,
  count(*) FILTER (l_quantity > 49) AS high_quantity, count(*) FILTER (l_tax >= 0.08 AND l_quantity < 2) AS odd_tax,
  CASE WHEN count(*) FILTER (l_quantity > 49) + count(*) FILTER (l_tax >= 0.08 AND l_quantity < 2) = 0
   THEN 'complete' ELSE 'failed' END AS status FROM (
  SELECT CAST(l_shipdate AS DATE) AS d, l_quantity, l_tax,
   CAST(date_diff('day', (SELECT low FROM span), CAST(l_shipdate AS DATE)) // 7 AS BIGINT) AS chunk FROM lineitem)
  GROUP BY chunk"""
part("manifest", MANIFEST, "span")


def _manifest(t):
    days = _ship_days(t)
    spanned = days.crossJoin(F.broadcast(days.agg(F.min("d").alias("low"))))
    checks = {
        "high_quantity": F.col("l_quantity") > 49,
        "odd_tax": (F.col("l_tax") >= 0.08) & (F.col("l_quantity") < 2),
    }
    return scan.chunk_manifest(spanned, "d", F.col("low"), 7, checks)


@query("chunk_manifest", sql("SELECT * FROM manifest", "manifest"))
def chunk_manifest(t):
    return _manifest(t)


@query("missing_chunks", sql("""SELECT * FROM calendar WHERE chunk NOT IN
  (SELECT chunk FROM manifest WHERE status = 'complete')""", "calendar", "manifest"))
def missing_chunks(t):
    return scan.missing_chunks(scan.calendar_of(_ship_days(t), "d", 7), _manifest(t))


@query("date_completeness", """SELECT d, coalesce(raw_rows, 0) AS raw_rows, coalesce(derived_rows, 0) AS derived_rows,
  coalesce(raw_rows, 0) > 0 AND coalesce(derived_rows, 0) > 0 AS available FROM
  (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS raw_rows FROM lineitem GROUP BY 1)
  FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS derived_rows FROM orders GROUP BY 1) USING (d)""")
def date_completeness(t):
    raw = t.lineitem.select(F.to_date("l_shipdate").alias("d"))
    derived = t.orders.select(F.to_date("o_orderdate").alias("d"))
    return scan.date_completeness(raw, derived, "d")


@query("latest_completed_date", """SELECT max(CAST(l_shipdate AS DATE)) AS latest_date FROM lineitem
  WHERE l_shipdate < DATE '1999-01-15'""")
def latest_completed_date(t):
    return scan.latest_completed(t.lineitem.select(F.to_date("l_shipdate").alias("d")), "d", ADMIT)


@query("union_history_live", sql(f"""SELECT season, source_rank, count(*) AS n,
  CAST(sum(strikeouts) AS BIGINT) AS strikeouts, count(home_away) AS with_side FROM (
   SELECT season, CAST(0 AS BIGINT) AS source_rank, strikeouts, home_away FROM app WHERE season < 2001
   UNION ALL SELECT season, 1, strikeouts, NULL FROM app WHERE season = 2001)
  GROUP BY season, source_rank""", "app"))
def union_history_live(t):
    old = t.appearances.where(F.col("season") < 2001)
    live = t.appearances.where(F.col("season") == 2001).drop("home_away")
    both = X.union_sources(historical=old, completed=live)
    return both.groupBy("season", "source_rank").agg(
        F.count(F.lit(1)).alias("n"), F.sum("strikeouts").alias("strikeouts"), F.count("home_away").alias("with_side")
    )


# --- gated and resumable writes ----------------------------------------------------------------

SURPLUS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
LIMITS = {"surplus_keys": 0, "late_small": 2}


@query("gated_publish", f"""WITH l AS (SELECT year(l_shipdate) AS season, *, row_number() OVER (PARTITION BY year(l_shipdate), {SURPLUS}) AS place FROM lineitem),
 c AS (SELECT season, count(*) AS row_count, count(*) FILTER (place > 1) AS surplus_keys,
  count(*) FILTER (month(l_shipdate) = 12 AND l_quantity < 2 AND l_discount = 0) AS late_small, {big('sum(l_linenumber)')} AS line_sum FROM l GROUP BY season)
 SELECT CAST(season AS VARCHAR) AS season, CASE WHEN surplus_keys > 0 OR late_small > 2 THEN 'failed' ELSE 'complete' END AS status, row_count,
  surplus_keys, late_small, CASE WHEN surplus_keys > 0 OR late_small > 2 THEN 0 ELSE row_count END AS published_rows,
  CASE WHEN surplus_keys > 0 OR late_small > 2 THEN NULL ELSE line_sum END AS line_sum FROM c""")
def gated_publish(t):
    """Every season in one scan each: written, observed, and published only where the checks pass."""
    root = scratch_path(t.spark, "published")
    rows = t.lineitem.select(F.year("l_shipdate").alias("season"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount")
    late = (F.month("l_shipdate") == 12) & (F.col("l_quantity") < 2) & (F.col("l_discount") == 0)
    for (season,) in sorted(rows.select("season").distinct().collect()):  # a handful of seasons
        part, surplus = publish.with_duplicates(rows.where(F.col("season") == season), SURPLUS.split(", "), "surplus_keys")
        publish.publish(part, root, season, surplus | {"late_small": F.count_if(late)}, LIMITS, drop=["_place"], strict=False)
    log = publish.manifest(t.spark, root)
    back = publish.published(t.spark, root)
    sums = back.groupBy(F.col("season").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("published_rows"), F.sum("l_linenumber").cast("bigint").alias("line_sum"))
    return log.join(sums, "part", "left").select(
        F.col("part").alias("season"), "status", "row_count", F.col("findings")["surplus_keys"].alias("surplus_keys"),
        F.col("findings")["late_small"].alias("late_small"), F.coalesce("published_rows", F.lit(0)).alias("published_rows"), "line_sum",
    )


INGEST_DAYS = 150


@query("resumed_ingest", sql(f"""SELECT chunk, min(d) AS first_date, max(d) AS last_date, count(*) AS row_count, {big('sum(l_linenumber)')} AS line_sum, CAST(1 AS BIGINT) AS n_reads
  FROM (SELECT CAST(l_shipdate AS DATE) AS d, l_linenumber,
   CAST(date_diff('day', (SELECT low FROM span), CAST(l_shipdate AS DATE)) // {INGEST_DAYS} AS BIGINT) AS chunk FROM lineitem) GROUP BY chunk""", "span"))
def resumed_ingest(t):
    """A run that dies between chunks, repeated: finished chunks are not read again and the result is that of one run."""
    root = scratch_path(t.spark, "ingest")
    rows = t.lineitem.select(F.to_date("l_shipdate").alias("d"), "l_linenumber")
    calendar, reads = scan.calendar_of(rows, "d", INGEST_DAYS), []

    def read(row):
        if len(reads) == 3:
            reads.append(None)
            raise ConnectionError("source went away")
        reads.append(row.chunk)
        return rows.where(F.col("d").between(row.chunk_start, row.chunk_end)).withColumn("chunk", F.lit(row.chunk).cast("bigint"))

    checks = {"missing_dates": F.count_if(F.col("d").isNull())}
    try:
        publish.ingest(calendar, root, read, checks)
    except ConnectionError:
        publish.ingest(calendar, root, read, checks)
    times = F.lit(0).cast("bigint")
    for chunk in sorted({r for r in reads if r is not None}):
        times = F.when(F.col("chunk") == chunk, F.lit(reads.count(chunk)).cast("bigint")).otherwise(times)
    return publish.published(t.spark, root).groupBy("chunk").agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("row_count"), F.sum("l_linenumber").cast("bigint").alias("line_sum")
    ).withColumn("n_reads", times)
