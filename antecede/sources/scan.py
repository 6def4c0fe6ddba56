"""Reading event chunks: pruned scans, date-range admission, calendars and completeness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antecede.operators.quality import QualityError, require_zero

EVENT_COLUMNS = (
    "game_date", "game_pk", "pitcher", "batter", "events", "description", "p_throws", "home_team",
    "away_team", "inning_topbot", "zone", "release_speed", "pitch_type", "at_bat_number",
    "pitch_number",
)
CHUNK_NAME = r"_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.parquet$"


def scan_events(spark: SparkSession, root: str, columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """Only the named columns leave the Parquet scan."""
    return spark.read.parquet(root).select(*columns)


def scan_seasons(spark: SparkSession, root: str, seasons: Sequence[int]) -> DataFrame:
    """Season folders as partitions; folders of other seasons are not opened."""
    return spark.read.parquet(root).where(F.col("season").isin(*seasons))


def admitted_chunks(
    spark: SparkSession, root: str, cutoff: date, time_column: str = "game_date", strict: bool = True
) -> DataFrame:
    """Rows of chunk files whose whole named range ends before the cutoff.

    File names only admit; any row of an admitted file at or after the cutoff is an error.
    """
    last = F.regexp_extract(F.col("_metadata.file_name"), CHUNK_NAME, 2)
    rows = spark.read.parquet(root)
    rows = rows.where(last.try_cast("date") < F.lit(cutoff))
    if strict:
        late = F.col(time_column).cast("date") >= F.lit(cutoff)
        require_zero(rows.agg(F.count_if(late).alias("late_rows")), "rows at or after the cutoff")
    return rows


def read_csv_coerced(
    spark: SparkSession, path: str, columns: Sequence[str], numeric: dict[str, str]
) -> DataFrame:
    """CSV read as text with a declared schema; bad numbers become NULL instead of failing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in numeric.items()})


# --- chunk calendar --------------------------------------------------------------------------

def date_chunks(spark: SparkSession, start: date, end: date, days: int = 7) -> DataFrame:
    """Inclusive date ranges of ``days`` days; the last one stops at ``end``."""
    if start > end:
        raise QualityError("start date must not be after end date")
    if days < 1:
        raise QualityError("chunk length must be positive")
    starts = F.sequence(
        F.lit(start), F.lit(end), F.expr(f"interval {int(days)} days")
    )
    return spark.range(1).select(F.posexplode(starts).alias("chunk", "chunk_start")).select(
        F.col("chunk").cast("bigint").alias("chunk"),
        "chunk_start",
        F.least(F.date_add("chunk_start", days - 1), F.lit(end)).alias("chunk_end"),
    )


def calendar_of(df: DataFrame, day: str, days: int) -> DataFrame:
    """The chunk calendar that spans the dates of a table, without reading them on the driver."""
    span = df.agg(F.min(day).alias("low"), F.max(day).alias("high"))
    starts = F.sequence(F.col("low"), F.col("high"), F.expr(f"interval {int(days)} days"))
    return span.select("high", F.posexplode(starts).alias("chunk", "chunk_start")).select(
        F.col("chunk").cast("bigint").alias("chunk"),
        "chunk_start",
        F.least(F.date_add("chunk_start", days - 1), F.col("high")).alias("chunk_end"),
    )


def chunk_of(day: str, start, days: int) -> Column:
    """Number of the chunk a date falls into; ``start`` may be a column or a date."""
    first = start if isinstance(start, Column) else F.lit(start)
    return F.floor(F.date_diff(F.col(day), first) / days).cast("bigint")


def chunk_manifest(df: DataFrame, day: str, start, days: int, checks: dict[str, Column]) -> DataFrame:
    """Per chunk: range, rows, failed value checks and whether it counts as complete."""
    rows = df.groupBy(chunk_of(day, start, days).alias("chunk")).agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(bad).alias(name) for name, bad in checks.items()],
    )
    problems = F.lit(0).cast("bigint")
    for name in checks:
        problems = problems + F.col(name)
    return rows.withColumn("status", F.when(problems == 0, "complete").otherwise("failed"))


def missing_chunks(calendar: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks a rerun still has to fetch."""
    done = manifest.where(F.col("status") == "complete").select("chunk")
    return calendar.join(done, "chunk", "left_anti")


def date_completeness(raw: DataFrame, derived: DataFrame, day: str) -> DataFrame:
    """Per date: rows in both layers; available only when neither is empty."""
    counts = raw.groupBy(day).agg(F.count(F.lit(1)).alias("raw_rows")).join(
        derived.groupBy(day).agg(F.count(F.lit(1)).alias("derived_rows")), day, "full_outer"
    )
    counts = counts.fillna(0, ["raw_rows", "derived_rows"])
    return counts.withColumn(
        "available", (F.col("raw_rows") > 0) & (F.col("derived_rows") > 0)
    )


def latest_completed(df: DataFrame, day: str, cutoff) -> DataFrame:
    """The last date strictly before the cutoff, one row."""
    return df.where(F.col(day) < F.lit(cutoff).cast("date")).agg(F.max(day).alias("latest_date"))
