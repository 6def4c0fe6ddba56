"""Gated, resumable writes: a part is scanned once, checked while it is written, and published only if it passes.

A part (a season, a chunk of days) is written to a folder of its own version. The metrics of its checks are observed on the
rows that feed the writer, so checking costs no further scan. One row per attempt is appended to a manifest; that single
small file is the commit. Readers take the last complete version of each part from the manifest, so an attempt that failed
its checks, or was killed half-way, is never seen, and what was published before stays. A rerun asks the manifest which
parts are still missing and reads only those.

The loop over parts is one Spark job per part and short on the driver: it holds calendar rows and metrics, never data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from antecede.functions import constants as K
from antecede.operators import quality as Q
from antecede.operators.quality import QualityError

MANIFEST = "part string, version string, status string, row_count bigint, findings map<string,bigint>, committed timestamp"
ROWS = "row_count"
ANY = 1 << 62


def with_duplicates(df: DataFrame, key: Iterable[str], name: str = "duplicate_rows") -> tuple[DataFrame, dict[str, Column]]:
    """Rows with their place among rows of equal key, and the metric that counts the surplus ones.

    Distinct counts cannot be observed, but a place within the key can: one exchange by key, kept by the writer.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    return df.withColumn("_place", place), {name: F.count_if(F.col("_place") > 1)}


def observed_write(df: DataFrame, path: str, metrics: Mapping[str, Column], drop: Iterable[str] = ()) -> dict[str, int]:
    """Writes ``df`` and returns the metrics of exactly the rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias(ROWS), *[c.alias(n) for n, c in metrics.items()]).drop(*drop).write.mode("overwrite").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def _record(spark: SparkSession, root: str, part: str, version: str, found: Mapping[str, int], allowed: Mapping[str, int]) -> str:
    findings = {k: int(v) for k, v in found.items() if k != ROWS}
    status = "complete" if all(v <= allowed.get(k, 0) for k, v in findings.items()) else "failed"
    row = (part, version, status, int(found[ROWS]), findings, datetime.now(timezone.utc))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return status


def publish(
    df: DataFrame, root: str, part: str, metrics: Mapping[str, Column], allowed: Mapping[str, int] | None = None,
    drop: Iterable[str] = (), strict: bool = True,
) -> str:
    """Writes one part and commits it if no metric exceeds what is allowed (0 where not named); returns its status."""
    version = uuid.uuid4().hex
    found = observed_write(df, f"{root}/data/{version}", metrics, drop)
    status = _record(df.sparkSession, root, str(part), version, found, allowed or {})
    if strict and status == "failed":
        bad = {k: v for k, v in found.items() if k != ROWS and v > (allowed or {}).get(k, 0)}
        raise QualityError(f"part {part} not published: {bad}")
    return status


def publish_feed(df: DataFrame, root: str, part: str, strict: bool = True) -> str:
    """Publishes a part of the raw event feed only if every critical check holds; all checks are recorded.

    The value rules and the surplus of repeated keys are observed on the rows being written: one scan, one exchange by key.
    """
    rows, surplus = with_duplicates(df, K.DUPLICATE_KEY)
    rules = {name: rule for name, rule in Q.validity_checks(df.columns).items() if name != "rows"}
    metrics = rules | {"missing_critical_values": Q.missing_critical()} | surplus
    critical = {name for names in Q.CRITICAL_CHECKS.values() for name in names}
    return publish(rows, root, part, metrics, {name: ANY for name in metrics if name not in critical}, ["_place"], strict)


def failed_checks() -> Column:
    """Names of the critical checks that an attempt's findings fail, in the order they are reported."""
    named = []
    for check, names in Q.CRITICAL_CHECKS.items():
        found = [F.coalesce(F.try_element_at("findings", F.lit(n)), F.lit(0)) for n in names]
        named.append(F.when(sum(found[1:], found[0]) > 0, F.lit(check)))
    return F.array_compact(F.array(*named))


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the manifest; none where nothing was written yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The last complete attempt of each part, or its last failed one where none is complete."""
    others = [c for c in ("version", "status", "row_count", "findings", "committed")]
    order = F.struct((F.col("status") == "complete").alias("done"), "committed")
    last = F.max_by(F.struct(*others), order).alias("last")
    return attempts(spark, root).groupBy("part").agg(last).select("part", "last.*")


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of all published parts, or None where there are none."""
    versions = [r.version for r in manifest(spark, root).where("status = 'complete'").select("version").collect()]  # one per part
    return spark.read.parquet(*[f"{root}/data/{v}" for v in versions]) if versions else None


def pending(calendar: DataFrame, done: DataFrame, part: str = "chunk") -> DataFrame:
    """Rows of the calendar without a complete attempt."""
    complete = done.where("status = 'complete'").select(F.col("part").alias("_part"))
    return calendar.join(complete, F.col(part).cast("string") == F.col("_part"), "left_anti")


def ingest(
    calendar: DataFrame, root: str, read: Callable[[Row], DataFrame], metrics: Mapping[str, Column],
    allowed: Mapping[str, int] | None = None, part: str = "chunk", strict: bool = False,
) -> list[str]:
    """Reads, checks and publishes every pending part in order; returns the parts it worked on.

    ``read`` gets a calendar row and is not called for parts that are complete already. A part that fails its checks is
    recorded and the run goes on, unless ``strict``; any other error ends the run and leaves finished parts published.
    """
    todo = pending(calendar, manifest(calendar.sparkSession, root), part).orderBy(part).collect()  # one row per part
    worked = []
    for row in todo:
        publish(read(row), root, row[part], metrics, allowed, strict=strict)
        worked.append(str(row[part]))
    return worked
