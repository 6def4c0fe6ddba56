"""Frozen artefacts: counted residuals that can be merged, and a versioned bundle of model and distribution.

``ResidualTable`` counts the residuals of a forecast by group, prediction bin and value. Its bin edges are frozen with it, so a
new season is counted alone and added: sums of counts, combined map-side. ``suffix_sums`` orders the counts once, in blocks
with block totals, and keeps how many residuals lie above each value; probabilities are then looked up from thresholds
without reading the history again, and nothing is ordered as a whole.

``freeze`` writes one folder per version: a fitted pipeline per target, the feature list, the edges, the counts and a
manifest with schemas and row counts, written last. ``load`` refuses a version without manifest or with other contents.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import clip_probability
from antecede.functions.quantiles import BLOCKS, SKETCH_ACCURACY
from antecede.operators import distributions as D
from antecede.operators.quality import QualityError
from antecede.operators.scoring import PREDICTION_KEYS
from antecede.session import stage


@dataclass(frozen=True)
class ResidualTable:
    """``counts``: (by..., bin, value, n), where bin ``distributions.ALL_ROWS`` holds every residual; ``edges``: (by..., edges)."""

    counts: DataFrame
    edges: DataFrame
    by: tuple[str, ...]

    @staticmethod
    def of(history: DataFrame, by: Sequence[str], edges: DataFrame | None = None, bins: int = K.QUANTILE_BINS) -> ResidualTable:
        """Counts of the known residuals of ``history``, in bins of its own predictions or of the given edges."""
        edges = D.bin_edges(history, list(by), bins) if edges is None else edges
        rows = history.where(F.col("prediction").isNotNull() & F.col("actual").isNotNull()).join(edges, list(by))
        pairs = F.explode(F.array(F.lit(D.ALL_ROWS).cast("bigint"), D.bin_of()))
        value = F.round(F.col("actual") - F.col("prediction"), D.DIGITS).alias("value")
        counts = rows.select(*by, value, pairs.alias("bin")).groupBy(*by, "bin", "value").agg(F.count(F.lit(1)).alias("n"))
        return ResidualTable(counts, edges, tuple(by))

    def merged(self, *others: ResidualTable) -> ResidualTable:
        """Counts of all tables together; they must have been made with the same edges."""
        counts = self.counts
        for other in others:
            counts = counts.unionByName(other.counts)
        return ResidualTable(counts.groupBy(*self.by, "bin", "value").agg(F.sum("n").alias("n")), self.edges, self.by)

    def with_history(self, history: DataFrame) -> ResidualTable:
        """Adds newer rows, counted in the frozen bins."""
        return self.merged(ResidualTable.of(history, self.by, self.edges))

    def suffix_sums(self) -> tuple[DataFrame, DataFrame]:
        """(values with ``above``, the residuals strictly above each; one row per group and bin with borders, blocks and total).

        The borders are written, since a sketch made twice may cut values and thresholds differently.
        """
        key = [*self.by, "bin"]
        counts = stage(self.counts, "counts")
        share = F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)])
        borders = counts.groupBy(*key).agg(F.percentile_approx("value", share, F.lit(SKETCH_ACCURACY)).alias("borders"))
        borders = stage(borders, "borders")
        values = stage(counts.join(borders, key).withColumn("block", F.expr("size(filter(borders, b -> b < value))")).drop("borders"), "blocked")
        blocks = values.groupBy(*key, "block").agg(F.sum("n").alias("n"))
        higher = Window.partitionBy(*key).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        later = blocks.withColumn("higher", F.coalesce(F.sum("n").over(higher), F.lit(0)))  # at most BLOCKS rows of a group
        inside = Window.partitionBy(*key, "block").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
        above = values.join(later.select(*key, "block", "higher"), [*key, "block"]).select(
            *key, "block", "value", (F.col("higher") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above")
        )
        groups = later.groupBy(*key).agg(
            F.sum("n").alias("total"), F.collect_list(F.struct("block", (F.col("higher") + F.col("n")).alias("from_block"))).alias("blocks")
        )
        return stage(above, "suffix-sums"), stage(groups.join(borders, key), "suffix-groups")

    def shares_above(self, thresholds: DataFrame, sums: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Share of each (group, bin)'s residuals strictly above each distinct ``threshold``."""
        key = [*self.by, "bin"]
        above, groups = sums or self.suffix_sums()
        asked = thresholds.select(*key, "threshold").distinct().join(groups, key)
        asked = asked.withColumn("block", F.expr("size(filter(borders, b -> b < threshold))"))
        # Above the values of lower blocks stand exactly the residuals of this block and of the higher ones.
        start = F.expr("aggregate(filter(blocks, x -> x.block >= block), 0L, (s, x) -> greatest(s, x.from_block))")
        points = asked.select(*key, "block", F.col("threshold").alias("value"), F.lit(1).alias("kind"), start.alias("start"), "total")
        both = above.withColumn("kind", F.lit(0)).unionByName(points, allowMissingColumns=True)
        upto = Window.partitionBy(*key, "block").orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("seen", F.last("above", ignorenulls=True).over(upto)).where("kind = 1").select(
            *key, F.col("value").alias("threshold"), (F.coalesce("seen", "start") / F.col("total")).alias("share")
        )

    def probabilities(
        self, points: DataFrame, grids: Mapping[str, Sequence[float]] = K.LINE_GRID, min_size: int = K.MIN_BIN_SIZE,
        bounds: Mapping[str, tuple[float, float]] = K.VALUE_BOUNDS, sums: tuple[DataFrame, DataFrame] | None = None,
    ) -> DataFrame:
        """P(over) of every line from the residuals of the prediction's bin, or of all rows where that bin is small."""
        by, sums = list(self.by), sums or self.suffix_sums()
        everything = F.lit(D.ALL_ROWS).cast("bigint")
        large = sums[1].where((F.col("bin") != everything) & (F.col("total") >= min_size)).select(*by, "bin", F.lit(True).alias("large"))
        rows = D.line_grid(points.where(F.col("prediction").isNotNull()), grids).join(self.edges, by, "left")
        rows = rows.withColumn("threshold", F.round(F.col("line") - F.col("prediction"), D.DIGITS)).withColumn("bin", D.bin_of())
        rows = rows.join(large, [*by, "bin"], "left").withColumn("bin", F.when(F.col("large"), F.col("bin")).otherwise(everything))
        shares = self.shares_above(rows.select(*by, "bin", "threshold"), sums)
        return rows.join(shares, [*by, "bin", "threshold"], "left").select(
            *points.columns, "line", "actual_over", clip_probability(D.within_bounds(F.col("share"), bounds)).alias("probability_over"),
            F.lit("conditional_empirical").alias("method"),
        )


# --- bundles ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bundle:
    """Models by target, their feature list, the residual table and what the manifest says."""

    models: Mapping[str, PipelineModel]
    features: tuple[str, ...]
    residuals: ResidualTable
    manifest: Mapping

    def forecasts(self, rows: DataFrame) -> DataFrame:
        """Long forecasts of every target, with the actual where it is known."""
        missing = [c for c in self.features if c not in rows.columns]
        if missing:
            raise QualityError(f"missing {len(missing)} frozen features: {missing[:20]}")
        out = None
        for target, model in self.models.items():
            own = model.transform(rows).select(
                *PREDICTION_KEYS, F.lit(target).alias("target"), F.col(target).cast("double").alias("actual"), F.col("prediction")
            )
            out = own if out is None else out.unionByName(own)
        return out

    def probabilities(self, rows: DataFrame, grids: Mapping[str, Sequence[float]] = K.LINE_GRID, **options) -> DataFrame:
        forecasts = stage(self.forecasts(rows).where(F.col("target").isin(*grids)), "forecasts")
        return self.residuals.probabilities(forecasts, grids, **options)


def _described(df: DataFrame) -> dict:
    return {"schema": df.schema.simpleString(), "rows": df.count()}


def freeze(path: str, models: Mapping[str, PipelineModel], features: Sequence[str], residuals: ResidualTable, version: str) -> None:
    """Writes a bundle below ``path/version``; an existing version is never changed."""
    spark, folder = residuals.counts.sparkSession, f"{path}/{version}"
    if _manifest(spark, folder) is not None:
        raise QualityError(f"version {version} exists already")
    for target, model in models.items():
        model.write().overwrite().save(f"{folder}/models/{target}")
    tables = {"counts": residuals.counts, "edges": residuals.edges}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = {
        "version": version, "targets": list(models), "features": list(features), "by": list(residuals.by),
        "tables": {name: _described(spark.read.parquet(f"{folder}/{name}")) for name in tables},
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    from pyspark.sql.utils import AnalysisException

    try:
        return json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    except AnalysisException:
        return None


def load(spark: SparkSession, path: str, version: str) -> Bundle:
    """A frozen bundle, after its tables have been held against the manifest."""
    folder = f"{path}/{version}"
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise QualityError(f"no complete bundle {version}")
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}
    for name, table in tables.items():
        if _described(table) != manifest["tables"][name]:
            raise QualityError(f"table {name} of bundle {version} is not what was frozen")
    models = {target: PipelineModel.load(f"{folder}/models/{target}") for target in manifest["targets"]}
    return Bundle(models, tuple(manifest["features"]), ResidualTable(tables["counts"], tables["edges"], tuple(manifest["by"])), manifest)
