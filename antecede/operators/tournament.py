"""The model tournament as a resumable grid of cells.

A cell is one (split, target, model, family). Every cell is fitted on its own training seasons, its forecasts are written as
one part of a published table (see ``sources.publish``) and committed by a manifest row. A run that ends early is simply
repeated: finished cells are skipped, and what depends on the fold alone (medians, indicators, scales) is fitted once per
fold and family, however many cells share it. The loop on the driver runs over cells; every fit and forecast is distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.operators import models as M
from antecede.operators.packed import Packed
from antecede.operators.scoring import feature_columns
from antecede.sources import publish


@dataclass(frozen=True)
class Cell:
    split: str
    seasons: tuple[int, ...]
    season: int
    target: str
    model: str
    family: str = "full"

    @property
    def name(self) -> str:
        return "|".join((self.family, self.split, self.target, self.model))


def grid(
    splits: Sequence[tuple[str, Sequence[int], int]], targets: Sequence[str] = K.TARGETS, models: Sequence[str] = M.MODELS,
    families: Sequence[str] = ("full",),
) -> list[Cell]:
    """Every cell, those of one fold and family next to each other. Product models exist for the targets with a rate."""
    return [
        Cell(split, tuple(seasons), season, target, model, family)
        for family in families for split, seasons, season in splits for target in targets for model in models
        if model != "volume_rate" or target in M.RATE_LIMIT
    ]


def finished(spark: SparkSession, root: str) -> set[str]:
    """Names of the cells with a complete part; one row per cell."""
    return {r.part for r in publish.manifest(spark, root).where("status = 'complete'").select("part").collect()}


def packed(features: DataFrame, family: str = "full", rolling: Sequence[str] | None = None) -> Packed:
    """The table of a family, written once for all its folds and runs."""
    columns = feature_columns(features, family, rolling) if rolling else feature_columns(features, family)
    return Packed.of(features, columns, ["season"])


def run(
    features: DataFrame | Packed, cells: Sequence[Cell], root: str, rounds: int = M.TREE_ROUNDS, rolling: Sequence[str] | None = None,
    before: Callable[[Cell], None] | None = None,
) -> list[str]:
    """Fits and publishes every cell that is not finished; returns the names of those it worked on.

    A cell whose forecasts hold a missing value is recorded as failed and not published. ``before`` is called before each fit.
    A table that is packed already serves the cells of its family without being written again.
    """
    given = isinstance(features, Packed)
    done, folds, worked, tables = finished((features.source if given else features).sparkSession, root), {}, [], {}
    for cell in cells:
        if cell.name in done:
            continue
        if before is not None:
            before(cell)
        key = (cell.family, cell.split)
        if key not in folds:  # cells of one fold follow each other, so one fold is held at a time
            if cell.family not in tables:
                tables = {cell.family: features if given else packed(features, cell.family, rolling)}
            for held, _ in folds.values():
                held.release()
            columns = tables[cell.family].columns
            folds = {key: (M.Fold(tables[cell.family].where(F.col("season").isin(*cell.seasons)), columns), columns)}
        fold, columns = folds[key]
        test = tables[cell.family].where(F.col("season") == cell.season)
        rows = M.fold_predictions(fold, test, columns, cell.target, cell.split, (cell.model,), rounds)
        rows = rows.withColumn("feature_family", F.lit(cell.family))
        missing = {"missing_forecasts": F.count_if(F.col("prediction").isNull() | F.isnan("prediction"))}
        publish.publish(rows, root, cell.name, missing, strict=False)
        worked.append(cell.name)
    for held, _ in folds.values():
        held.release()
    return worked


def forecasts(spark: SparkSession, root: str) -> DataFrame | None:
    """The long forecasts of all finished cells."""
    return publish.published(spark, root)
