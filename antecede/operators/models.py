"""Spark ML estimators on the feature table, evaluated in time order.

Preparation is fitted on the training fold only and stored inside the fitted pipeline, so a
saved model carries its medians, indicators and scales. Loops on the driver run over the small
grid of splits, targets and models; every fit and every prediction is distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import RLock

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from antecede.functions import constants as K
from antecede.functions.quantiles import exact_quantiles
from antecede.operators.packed import Packed
from antecede.operators.scoring import (
    PREDICTION_KEYS,
    feature_columns,
    point_scores,
)
from antecede.session import ensure_checkpoints, stage

# Settings of the published models.
RIDGE_ALPHA = 10.0
POISSON_ALPHA = 0.1
TREE_ROUNDS = 180
TREE_RATE = 0.05
TREE_DEPTH = 4
SEED = 42
IMPORTANCE_GROUP = 4096
IMPORTANCE_REPEATS = 3
IMPORTANCE_TOP = 15


# --- preparation -------------------------------------------------------------------------------

def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, value)")


BRACKET_ACCURACY = 2000
BRACKET_ROWS = 50_000
READY_BYTES = 64 << 20


def column_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Per column the rows, the known values and their mean, variance, least and largest."""
    return Packed(df, columns).facts


def column_medians(df: DataFrame | Packed, columns: Sequence[str], facts: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(column_name, median, missing): exact medians of the known values of each column.

    ``df`` should be a written table. A sketch over some rows only proposes a bracket around each median. In one pass over
    every row values are counted as below the bracket, on its lower or its upper end, and values strictly inside by themselves.
    Where the counts show that a bracket missed, that column takes the way of ``exact_quantiles``. So hundreds of
    columns do not multiply the rows, and neither the sketch nor its rows decide the result.
    """
    packed = df if isinstance(df, Packed) else Packed(df, columns)
    table, spark = packed.table, packed.table.sparkSession
    facts = facts or packed.facts
    place = {c: k for k, c in enumerate(packed.columns)}
    value = {c: F.col("values")[place[c]] for c in columns}
    known = [c for c in columns if facts[c]["n"]]
    missing = {c: facts[c]["rows"] - facts[c]["n"] for c in columns}
    medians: dict[str, float] = {c: facts[c]["low"] for c in known if facts[c]["low"] == facts[c]["high"]}
    open_ = [c for c in known if c not in medians]
    if open_:
        share = min(1.0, BRACKET_ROWS / facts[open_[0]]["rows"])

        def bracket(c):
            near = 3.0 / BRACKET_ACCURACY + (2.5 / (share * facts[c]["n"]) ** 0.5 if share < 1.0 else 0.0)
            ends = F.array(F.lit(max(0.0, 0.5 - near)), F.lit(min(1.0, 0.5 + near)))
            return F.percentile_approx(value[c], ends, BRACKET_ACCURACY).alias(c)

        some = table if share == 1.0 else table.sample(share, SEED)
        ends = some.agg(*[bracket(c) for c in open_]).first().asDict()  # two values per column
        low, high = ({c: (ends[c] or (facts[c]["low"], facts[c]["high"]))[k] for c in open_} for k in (0, 1))
        around = packed.around(low, high)
        counted = {(r.pos, r.kind): r.n for r in around.where("kind <> 'inside'").collect()}  # four values per column
        at: dict[str, list] = {}
        searched = []  # (column, rank from 0 among the values strictly inside), one row or two per column
        for c in open_:
            below, upto = counted[place[c], "below"], counted[place[c], "below"] + counted[place[c], "low"]
            under = counted[place[c], "under"]
            at[c] = []
            for rank in sorted({(facts[c]["n"] - 1) // 2, facts[c]["n"] // 2}):
                if below <= rank < upto:
                    at[c].append(low[c])
                elif under <= rank < under + counted[place[c], "high"]:
                    at[c].append(high[c])
                elif upto <= rank < under:
                    searched.append((c, rank - upto))
                else:
                    at[c] = None
                    break
        searched = [(c, place[c], rank) for c, rank in searched if at[c] is not None]
        if searched:
            upto = F.sum("n").over(Window.partitionBy("pos").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
            ranks = spark.createDataFrame(searched, "column_name string, pos int, rank bigint")
            asked = F.col("pos").isin(sorted({p for _, p, _ in searched}))
            placed = around.where((F.col("kind") == "inside") & asked).withColumn("upto", upto).join(F.broadcast(ranks), "pos")
            hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
            for x in placed.where(hit).select("column_name", "value").collect():  # one row or two per column
                at[x.column_name].append(x.value)
        medians |= {c: min(v) + (max(v) - min(v)) * 0.5 for c, v in at.items() if v}
        missed = [c for c in open_ if c not in medians]
        if missed:
            exact = exact_quantiles(_long(packed.source, missed), ["column_name"], "value", [0.5])
            medians |= {x.column_name: x.quantiles[0] for x in exact.collect()}
    rows = [(c, medians.get(c), missing[c]) for c in columns]
    return spark.createDataFrame(rows, "column_name string, median double, missing bigint")


def imputed(columns: Sequence[str], medians: Mapping[str, float], flagged: Sequence[str]) -> dict[str, str]:
    """SQL of each model input: the value or its median, then indicators of missing values."""
    inputs = {c: f"coalesce(cast(`{c}` as double), {float(medians[c])!r}D)" for c in columns}
    inputs |= {f"missing_{c}": f"(case when `{c}` is null then 1.0D else 0.0D end)" for c in flagged}
    return inputs


def imputed_scale(facts: Mapping[str, Mapping], medians: Mapping[str, float], flagged: Sequence[str]) -> dict[str, float]:
    """Mean and population standard deviation of every model input, from the facts of the known values and the medians.

    Gaps hold one value, so the moments of the filled column follow from those of the known values without a pass.
    """
    out = {}
    for c, m in medians.items():
        rows, n, mean = facts[c]["rows"], facts[c]["n"], facts[c]["mean"]
        gaps, apart = rows - n, mean - m
        constant = facts[c]["low"] == facts[c]["high"]
        out[f"mean_{c}"] = m if constant else (n * mean + gaps * m) / rows
        out[f"std_{c}"] = 0.0 if constant else ((n * facts[c]["var"] + apart * apart * n * gaps / rows) / rows) ** 0.5
    for c in flagged:
        share = 1.0 - facts[c]["n"] / facts[c]["rows"]
        out[f"mean_missing_{c}"], out[f"std_missing_{c}"] = share, (share * (1.0 - share)) ** 0.5
    return out


def scaled(inputs: Mapping[str, str], scale: Mapping[str, float]) -> dict[str, str]:
    """Inputs centred and divided by their spread; a constant input is only centred."""
    return {
        n: f"(({sql}) - {float(scale[f'mean_{n}'])!r}D) / {float(scale[f'std_{n}'] or 1.0)!r}D"
        for n, sql in inputs.items()
    }


class Inputs:
    """What turns the columns of a table into model inputs: medians, indicators and spreads, a few values per column."""

    def __init__(self, packed: Packed, columns: Sequence[str] | None = None):
        facts = packed.facts
        self.packed, self.columns = packed, [c for c in columns or packed.columns if facts[c]["n"]]
        if packed.medians is None:  # of every column once, since families share a packed fold
            known = [c for c in packed.columns if facts[c]["n"]]
            packed.medians = {r["column_name"]: r["median"] for r in column_medians(packed, known, facts).collect()}
        self.medians = {c: packed.medians[c] for c in self.columns}
        self.flagged = [c for c in self.columns if facts[c]["n"] < facts[c]["rows"]]
        self.spread = imputed_scale(facts, self.medians, self.flagged)

    def kept(self) -> list[tuple]:
        """(column, indicator?, filling, mean, spread) of every scaled input.

        A constant input is zero once centred; leaving it out changes no forecast and keeps the equations regular.
        """
        every = [(c, False, c, self.medians[c]) for c in self.columns] + [(c, True, f"missing_{c}", 0.0) for c in self.flagged]
        return [(c, gap, m, self.spread[f"mean_{n}"], self.spread[f"std_{n}"]) for c, gap, n, m in every if self.spread[f"std_{n}"]]

    def stages(self, scale: bool) -> list[Transformer]:
        inputs = imputed(self.columns, self.medians, self.flagged)
        if scale:
            inputs = scaled({n: sql for n, sql in inputs.items() if self.spread[f"std_{n}"]}, self.spread)
        cells = ", ".join(f"{sql} as `x_{n}`" for n, sql in inputs.items())
        return [
            SQLTransformer(statement=f"select *, {cells} from __THIS__"),
            VectorAssembler(inputCols=[f"x_{n}" for n in inputs], outputCol="inputs"),
        ]


def preparation(packed: Packed, columns: Sequence[str] | None = None) -> Inputs:
    """Model inputs fitted on a training fold. Only statistics, a few values per column, reach the driver."""
    return Inputs(packed, columns)


class Fold:
    """A training fold with its columns. What depends on the rows only is fitted and assembled once for all targets and
    models of the fold; a target with missing labels has rows of its own and is fitted on them. A model asked for
    again is not fitted again. ``release`` drops the assembled rows."""

    def __init__(self, train: DataFrame | Packed, columns: Sequence[str]):
        self._packed = train if isinstance(train, Packed) else None
        self.train = self._packed.source if self._packed else train
        self.columns, self._made, self._known, self._ready, self.fitted = list(columns), {}, {}, {}, {}
        self._stages: dict = {}
        self.shared = RLock()  # held while something that several fits of the fold read is made

    @property
    def light(self) -> DataFrame:
        """The rows without what is packed, for whatever reads labels only."""
        return self._packed.table if self._packed else self.train

    def _rows(self, target: str, label: Column | None = None) -> tuple[DataFrame, str | None]:
        label = F.col(target) if label is None else label
        if target not in self._known:
            self._known[target] = (self.train if target in self.columns else self.light).where(label.isNull()).isEmpty()
        return (self.train, None) if self._known[target] else (self.train.where(label.isNotNull()), target)

    def inputs(self, target: str, label: Column | None = None) -> tuple[DataFrame, str | None, Inputs]:
        rows, name = self._rows(target, label)
        if name not in self._made:
            if self._packed is None or target in self.columns:
                packed = Packed.of(rows, self.columns)
            else:
                packed = self._packed if name is None else self._packed.where((F.col(target) if label is None else label).isNotNull())
            self._made[name] = preparation(packed, self.columns)
        return rows, name, self._made[name]

    def preparation(self, target: str, scale: bool, label: Column | None = None) -> tuple[DataFrame, list[Transformer]]:
        rows, name, made = self.inputs(target, label)
        if (name, scale) not in self._stages:
            self._stages[name, scale] = made.stages(scale)
        return rows, self._stages[name, scale]

    def equations(self, target: str, label: Column | None = None) -> np.ndarray:
        """Sums of products of the scaled inputs, the label and 1 over the rows of the target, in one pass."""
        _, _, made = self.inputs(target, label)
        table = made.packed.lines(target) if target in self.columns else None  # a label that is also an input
        return made.packed.products(made.kept(), F.col(target) if label is None else label, table)

    def poisson(self, target: str, label: Column | None = None) -> np.ndarray:
        """Weights of the scaled inputs and the intercept of the penalised Poisson fit, by Newton steps of one pass each."""
        _, _, made = self.inputs(target, label)
        plan, label = made.kept(), F.col(target) if label is None else label
        table = made.packed.lines(target) if target in self.columns else None
        return newton_poisson(lambda weights: made.packed.poisson_sums(plan, label, weights, table), len(plan))

    def ready(self, target: str, scale: bool, label: Column | None = None) -> tuple[DataFrame, list[Transformer]]:
        """The model inputs with the label, and the stages that made them."""
        rows, stages = self.preparation(target, scale, label)
        label = (F.col(target) if label is None else label).cast("double").alias("label")
        key = (self._rows(target, label)[1], scale)
        if key not in self._ready:
            others = [c for c in rows.columns if c not in self.columns or c == target]
            dealt = self._dealt(rows.select(*dict.fromkeys([*self.columns, *others])), len(stages[-1].getInputCols()))
            self._ready[key] = PipelineModel(stages=stages).transform(dealt).select("inputs", *others).persist()
        table = self._ready[key]
        if target in self.columns and target not in table.columns:  # a label that is also an input
            table = PipelineModel(stages=stages).transform(rows)
        return table.select("inputs", label), stages

    @staticmethod
    def _dealt(rows: DataFrame, inputs: int) -> DataFrame:
        """The rows in parts of about READY_BYTES of assembled inputs: files of repeated values are small, their vectors are not,
        and a task of a fit reads a whole part."""
        parts = -(-rows.count() * inputs * 8 // READY_BYTES)
        if parts <= 1:
            return rows
        keys = [c for c in PREDICTION_KEYS if c in rows.columns]
        return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *keys)

    def release(self) -> None:
        for table in self._ready.values():
            table.unpersist()
        self._ready = {}


# --- estimators -----------------------------------------------------------------------------------

def ridge(label: str, rows: int, mean: float, spread: float):
    """Squared error plus alpha times squared weights.

    Spark averages the error over rows and measures the label in units of its spread, so the
    published alpha is converted to those units.
    """
    return LinearRegression(
        featuresCol="inputs", labelCol=label, elasticNetParam=0.0, regParam=RIDGE_ALPHA / rows * (spread or 1.0),
        standardization=False, solver="normal", maxIter=1000, tol=1e-12,
    )


def condensed(spark: SparkSession, sums: np.ndarray) -> tuple[DataFrame, dict]:
    """A few rows with the means, variances and covariances of inputs and label that ``sums`` of products were taken of, and
    the count, mean and spread of that label. Least squares see nothing else of the rows, so a fit on these is the same fit.

    There are two rows for each input, on either side of the means along a main axis of the covariance.
    """
    count = sums[-1, -1]
    means = sums[-1, :-1] / count
    covariance = sums[:-1, :-1] / count - np.outer(means, means)
    size, axes = np.linalg.eigh(covariance)
    steps = (axes * np.sqrt(np.maximum(size, 0.0) * len(size))).T
    rows = [(Vectors.dense(x[:-1]), float(x[-1])) for step in steps for x in (means + step, means - step)]
    facts = {"rows": int(count), "mean": float(means[-1]), "spread": float(max(covariance[-1, -1], 0.0) ** 0.5)}
    return spark.createDataFrame(rows, StructType().add("inputs", VectorUDT()).add("label", "double")), facts


POISSON_STEPS = 100
POISSON_NEAR = 1e-10


def newton_poisson(sums: Callable[[np.ndarray], np.ndarray], inputs: int) -> np.ndarray:
    """Weights and intercept that minimise mean (mu - y log mu) + alpha / 2 |w|^2, the published objective.

    ``sums`` are those of ``Packed.poisson_sums`` at given weights. A step that raises the objective is halved. It starts from the
    mean label; where every label is 0 the intercept has no finite best value and the steps end at their limit.
    """
    others = [*range(inputs), inputs + 1]
    penalty = np.append(np.full(inputs, POISSON_ALPHA), 0.0)

    def at(weights):
        s = sums(weights)
        rows_mean = s[inputs + 1, inputs + 1]
        return s, rows_mean

    weights = np.zeros(inputs + 1)
    s, rows = at(weights)  # at zero every mean is 1, so the sum of means counts the rows
    label_mean = (s[inputs, inputs + 1] + rows) / rows
    weights[-1] = np.log(max(label_mean, 1e-12))

    def objective(s, weights):
        return s[inputs, inputs] / rows + 0.5 * penalty @ (weights * weights)

    s, _ = at(weights)
    for _ in range(POISSON_STEPS):
        slope = s[inputs, others] / rows - penalty * weights
        step = np.linalg.solve(s[np.ix_(others, others)] / rows + np.diag(penalty), slope)
        if np.abs(slope).max() <= POISSON_NEAR * max(1.0, label_mean):
            break
        before, share = objective(s, weights), 1.0
        while True:
            s, _ = at(weights + share * step)
            after = objective(s, weights + share * step)
            if after <= before + 1e-12 * abs(before) or share < 1e-6:
                break
            share /= 2.0
        weights = weights + share * step
    return weights


def poisson(spark: SparkSession, weights: np.ndarray) -> GeneralizedLinearRegressionModel:
    """Spark's log-link Poisson model with the given weights, the intercept last."""
    vector = _py2java(spark.sparkContext, Vectors.dense(weights[:-1]))
    made = spark._jvm.org.apache.spark.ml.regression.GeneralizedLinearRegressionModel(f"poisson_{uuid.uuid4().hex}", vector, float(weights[-1]))
    model = GeneralizedLinearRegressionModel(made)
    model._resetUid(made.uid())
    for name, value in (("featuresCol", "inputs"), ("labelCol", "label"), ("family", "poisson"), ("link", "log")):
        made.set(made.getParam(name), value)
        model.set(model.getParam(name), value)
    return model


def boosted_trees(label: str, rounds: int = TREE_ROUNDS):
    return GBTRegressor(
        featuresCol="inputs", labelCol=label, maxIter=rounds, stepSize=TREE_RATE, maxDepth=TREE_DEPTH, seed=SEED,
        checkpointInterval=10,
    )


def fit(
    train: DataFrame | Fold, columns: Sequence[str], target: str, model: str, rounds: int = TREE_ROUNDS,
    label: Column | None = None,
) -> PipelineModel:
    """Preparation and estimator fitted on one training fold, as one saveable pipeline.

    ``label`` is what is learned where ``target`` does not name a column of the fold.
    """
    if not isinstance(train, Fold):
        fold = Fold(train, columns)
        fitted = fit(fold, columns, target, model, rounds, label)
        fold.release()
        return fitted
    fold, asked = train, (target, model, rounds if model == "boosted_trees" else None)
    if asked in fold.fitted:
        return fold.fitted[asked]
    if model not in ("ridge", "poisson", "boosted_trees"):
        raise ValueError(f"unknown model: {model}")
    ensure_checkpoints(fold.train.sparkSession)
    spark = fold.train.sparkSession
    if model == "boosted_trees":
        with fold.shared:
            ready, stages = fold.ready(target, False, label)
        last = boosted_trees("label", rounds).fit(ready)
    else:
        with fold.shared:
            _, stages = fold.preparation(target, True, label)
        if model == "ridge":
            ready, size = condensed(spark, fold.equations(target, label))
            last = ridge("label", **size).fit(ready)
        else:
            last = poisson(spark, fold.poisson(target, label))
    fold.fitted[asked] = PipelineModel(stages=[*stages, last])
    return fold.fitted[asked]


def unsolved(model: PipelineModel, train: DataFrame, target: str, kind: str) -> float:
    """How far a ridge or Poisson fit is from its equations: the largest slope of the published objective, per row.

    Ridge: sum x (y - p) = alpha w. Poisson: mean x (y - p) = alpha w. The intercept has no penalty.
    """
    fitted = model.stages[-1]
    weights = fitted.coefficients.toArray()
    known = train.where(F.col(target).isNotNull())
    scored = model.transform(known).select(
        vector_to_array("inputs").alias("x"), (F.col(target).cast("double") - F.col("prediction")).alias("gap")
    )
    sums = scored.agg(
        F.count("*").alias("n"), F.sum("gap").alias("g"),
        F.array(*[F.sum(F.col("x")[j] * F.col("gap")) for j in range(len(weights))]).alias("s"),
    ).first()
    penalty = RIDGE_ALPHA if kind == "ridge" else POISSON_ALPHA * sums["n"]
    slopes = [abs(s - penalty * w) for s, w in zip(sums["s"], weights)]
    return max([abs(sums["g"]), *slopes]) / sums["n"]


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """The input columns plus the forecast."""
    return model.transform(df).select(*df.columns, F.col("prediction").alias(name))


def _rate(train: DataFrame, target: str) -> Column:
    """Target per batter faced; unknown rates take the mean rate of the fold."""
    rate = F.col(target) / F.nullif(F.col("batters_faced"), F.lit(0))
    mean = train.agg(F.avg(rate).alias("m")).first()["m"]
    return F.coalesce(rate, F.lit(mean))


# Upper bound of the rate per batter faced. Fixed values.
RATE_LIMIT = {"strikeouts": 1.0, "outs_recorded": 3.0}


def volume_rate_forecast(
    train: DataFrame | Fold, test: DataFrame, columns: Sequence[str], target: str, name: str
) -> DataFrame:
    """Forecast volume times forecast rate, each from a ridge model of its own."""
    fold = train if isinstance(train, Fold) else Fold(train, columns)
    volume = fit(fold, columns, "batters_faced", "ridge")
    rate = fit(fold, columns, f"{target}_rate", "ridge", label=_rate(fold.train, target))
    *made, last = volume.stages
    if rate.stages[:-1] == made:  # the same inputs, made once
        both = PipelineModel(stages=made).transform(test).select(*test.columns, "inputs")
        both = last.transform(both, {last.predictionCol: "_volume"})
        both = rate.stages[-1].transform(both).withColumnRenamed("prediction", "_rate").drop("inputs")
    else:
        both = predict(rate, predict(volume, test, "_volume"), "_rate")
    bounded = F.least(F.greatest(F.col("_rate"), F.lit(0.0)), F.lit(RATE_LIMIT[target]))
    return both.withColumn(name, F.greatest(F.col("_volume"), F.lit(0.0)) * bounded).drop("_volume", "_rate")


# --- evaluation in time order ---------------------------------------------------------------------

MODELS = ("ridge", "poisson", "boosted_trees", "ensemble", "volume_rate")


LINEAR = ("ridge", "poisson", "volume_rate")


def linear_forecasts(
    train: DataFrame | Fold, test: DataFrame | Packed, columns: Sequence[str], targets: Sequence[str], split: str, models: Sequence[str],
) -> DataFrame:
    """Long predictions of the linear models of a fold for several targets, all in one pass over the rows to forecast."""
    fold = train if isinstance(train, Fold) else Fold(train, columns)
    if not isinstance(test, Packed):
        others = [c for c in test.columns if c not in fold.columns or c in targets or c in PREDICTION_KEYS]
        test = Packed(test, fold.columns, others, table=Packed.lines_of(test, fold.columns, others))
    places: dict[tuple, int] = {}
    groups: dict[int, tuple[list, list]] = {}

    def place(target: str, kind: str, label: Column | None = None) -> tuple:
        """Where the weighted sum of a model stands: the inputs it reads and its number among their models."""
        last = fit(fold, columns, target, kind, label=label).stages[-1]
        made = fold.inputs(target, label)[2]
        plan, weights = groups.setdefault(id(made), (made.kept(), []))
        if (target, kind) not in places:
            places[target, kind] = (id(made), len(weights))
            weights.append(np.append(last.coefficients.toArray(), last.intercept))
        return places[target, kind]

    wanted = []
    for target in targets:
        for model in LINEAR:
            if model not in models or (model == "volume_rate" and target not in RATE_LIMIT):
                continue
            if model == "volume_rate":
                wanted.append((target, model, [place("batters_faced", "ridge"), place(f"{target}_rate", "ridge", _rate(fold.light, target))]))
            else:
                wanted.append((target, model, [place(target, model)]))
    starts, at = {}, 0
    for key, (_, weights) in groups.items():
        starts[key], at = at, at + len(weights)

    def forecast(target: str, model: str, sums: Sequence[tuple]) -> Column:
        first, *rest = [F.col("sums")[starts[key] + k] for key, k in sums]
        if model == "volume_rate":
            bounded = F.least(F.greatest(rest[0], F.lit(0.0)), F.lit(RATE_LIMIT[target]))
            return F.greatest(first, F.lit(0.0)) * bounded
        return F.exp(first) if model == "poisson" else first

    cells = [
        F.struct(
            F.lit(target).alias("target"), F.col(target).cast("double").alias("actual"), F.lit(model).alias("model"),
            forecast(target, model, sums).alias("prediction"),
        )
        for target, model, sums in wanted
    ]
    rows = test.scored(list(groups.values())).withColumn("_c", F.explode(F.array(*cells)))
    return rows.select(*PREDICTION_KEYS, "_c.target", F.lit(split).alias("split"), "_c.actual", "_c.model", "_c.prediction")


def fold_predictions(
    train: DataFrame | Fold, test: DataFrame | Packed, columns: Sequence[str], target: str, split: str,
    models: Sequence[str] = MODELS, rounds: int = TREE_ROUNDS,
) -> DataFrame:
    """Long predictions of several models for one fold and target, as one projection."""
    if set(models) <= set(LINEAR):
        return linear_forecasts(train, test, columns, [target], split, models)
    scored, names = test.source if isinstance(test, Packed) else test, []
    train = train if isinstance(train, Fold) else Fold(train, columns)
    for model in ("ridge", "poisson", "boosted_trees"):
        if model in models or ("ensemble" in models and model != "poisson"):
            scored = predict(fit(train, columns, target, model, rounds), scored, f"p_{model}")
            names.append(model)
    if "ensemble" in models:
        scored = scored.withColumn("p_ensemble", (F.col("p_ridge") + F.col("p_boosted_trees")) / 2.0)
        names.append("ensemble")
    if "volume_rate" in models and target in RATE_LIMIT:
        scored = volume_rate_forecast(train, scored, columns, target, "p_volume_rate")
        names.append("volume_rate")
    wanted = [n for n in names if n in models]
    cells = F.array(
        *[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("prediction")) for n in wanted]
    )
    return scored.select(
        *PREDICTION_KEYS,
        F.lit(target).alias("target"),
        F.lit(split).alias("split"),
        F.col(target).cast("double").alias("actual"),
        F.inline(cells),
    )


def split_list(splits: DataFrame) -> list[tuple[str, list[int], int]]:
    """The splits as plain values; one entry per season."""
    rows = splits.groupBy("split", "validation_season").agg(
        F.sort_array(F.collect_list("train_season")).alias("train")
    )
    return sorted(
        ((r["split"], list(r["train"]), r["validation_season"]) for r in rows.collect()),
        key=lambda item: item[2],
    )


def season_views(
    features: DataFrame, columns: Sequence[str], splits: Sequence[tuple[str, Sequence[int], int]]
) -> dict[str, tuple[Packed, Packed]]:
    """Training and validation rows of every split, as views of a table that is packed once."""
    packed = Packed.of(features, columns, ["season"])
    return {s: (packed.where(F.col("season").isin(*seasons)), packed.where(F.col("season") == season)) for s, seasons, season in splits}


def walk_forward(
    features: DataFrame, splits: Sequence[tuple[str, Sequence[int], int]], targets: Sequence[str] = K.TARGETS,
    family: str = "full", models: Sequence[str] = MODELS, rounds: int = TREE_ROUNDS,
    rolling: Sequence[str] | None = None, parallelism: int = 8, views: Mapping[str, tuple[Packed, Packed]] | None = None,
) -> DataFrame:
    """Every split, target and model: fitted on the past, predicting the next season.

    Fits are independent, so up to ``parallelism`` of them run at a time, those of the longest folds first. ``views`` are those of
    ``season_views`` with at least the columns of the family; without them the table is packed here.
    """
    columns = feature_columns(features, family, rolling) if rolling else feature_columns(features, family)
    views = views or season_views(features, columns, splits)
    linear = set(models) <= set(LINEAR)
    folds = {split: Fold(views[split][0], columns) for split, _, _ in splits}
    left = {split: 1 if linear else len(targets) for split in folds}

    def fitted(item: tuple[str, Sequence[str]]) -> DataFrame:
        split, own = item
        fold, test = folds[split], views[split][1]
        try:
            if linear:
                return linear_forecasts(fold, test, columns, own, split, models)
            return fold_predictions(fold, test, columns, own[0], split, models, rounds)
        finally:
            with fold.shared:
                left[split] -= 1
                if not left[split]:
                    fold.release()

    by_size = sorted(splits, key=lambda s: -len(s[1]))
    asked = [(split, own) for split, _, _ in by_size for own in ([tuple(targets)] if linear else [(target,) for target in targets])]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(asked)))) as pool:
        parts = dict(zip(asked, pool.map(inheritable_thread_target(features.sparkSession)(fitted), asked)))
    return reduce(DataFrame.unionByName, [parts[item] for split, _, _ in splits for item in asked if item[0] == split])


def ablation(
    features: DataFrame, splits, targets=K.TARGETS, families=K.FAMILIES, rounds: int = TREE_ROUNDS, rolling=None
) -> DataFrame:
    """Scores of the tree model on each cumulative feature family. The families share the packed folds of the widest one."""
    named = {f: feature_columns(features, f, rolling) if rolling else feature_columns(features, f) for f in families}
    out, views = None, season_views(features, max(named.values(), key=len), splits)
    for family in families:
        rows = walk_forward(features, splits, targets, family, ("boosted_trees",), rounds, rolling, views=views)
        part = stage(point_scores(rows), "scores").withColumn("feature_family", F.lit(family))  # one row per split and target
        out = part if out is None else out.unionByName(part)
    return out


def final_fit(
    features: DataFrame | Fold, last_season: int, columns: Sequence[str], target: str, model: str, path: str,
    rounds: int = TREE_ROUNDS,
) -> PipelineModel:
    """Fits on all seasons up to the last one, saves the pipeline and returns the saved one.

    A fold of exactly those seasons may be given, which several targets then share.
    """
    train = features if isinstance(features, Fold) else features.where(F.col("season") <= last_season)
    fitted = fit(train, columns, target, model, rounds)
    fitted.write().overwrite().save(path)
    return PipelineModel.load(path)


# --- permutation importance --------------------------------------------------------------------------

def _contributions(model: PipelineModel, rows: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """``rows`` with the forecast and ``own``, what each column adds to it, where the model is a weighted sum; else None."""
    *made, fitted = model.stages
    if not isinstance(fitted, LinearRegressionModel) or not made or not isinstance(made[-1], VectorAssembler):
        return None
    weights, parts = [float(w) for w in fitted.coefficients], {c: [] for c in columns}
    for k, name in enumerate(made[-1].getInputCols()):
        name = name.removeprefix("x_")
        name = name if name in parts else name.removeprefix("missing_")
        if name in parts:
            parts[name].append(k)
    x = F.col("x")
    cells = [sum((x[k] * F.lit(weights[k]) for k in parts[c]), F.lit(0.0)) for c in columns]
    return model.transform(rows).withColumn("x", vector_to_array("inputs")).select(
        "row_hash", "actual", "prediction", F.array(*cells).alias("own")
    )


def permutation_importance(
    model: PipelineModel, rows: DataFrame, columns: Sequence[str], target: str,
    repeats: int = IMPORTANCE_REPEATS, top: int = IMPORTANCE_TOP, group: int = IMPORTANCE_GROUP,
) -> DataFrame:
    """Mean rise of the absolute error when one column is re-paired, over every row with a known target.

    Per repeat the rows are dealt at random into groups of about ``group`` rows, so the number of groups grows with
    the rows; inside a group, in random order, every row takes the values of the row after it and the last one those of the
    first. In a linear model a replaced column changes the forecast by the difference of what both values add, so every row
    is forecast once. Otherwise the variants with one column replaced go through the model and are never shuffled.
    """
    known = rows.where(F.col(target).isNotNull()).select(
        F.xxhash64(*PREDICTION_KEYS, F.lit(SEED)).alias("row_hash"), F.col(target).cast("double").alias("actual"), *columns
    )
    groups = max(1, -(-known.count() // group))
    order = F.xxhash64("row_hash", "repeat")
    added = _contributions(model, known, columns)
    if added is not None:
        known = stage(added, "contributions")
    dealt = known.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "dealt", F.pmod(F.xxhash64("repeat", "row_hash", F.lit(SEED)), F.lit(groups))
    )
    ring = Window.partitionBy("repeat", "dealt").orderBy(order, "row_hash")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    error = F.abs(F.col("prediction") - F.col("actual"))
    if added is not None:
        paired = dealt.withColumn("other", F.coalesce(F.lead("own").over(ring), F.first("own").over(whole)))
        variants = paired.select("actual", "prediction", F.posexplode(F.arrays_zip("own", "other"))).select(
            F.col("pos"), "actual", (F.col("prediction") + (F.col("col.other") - F.col("col.own"))).alias("prediction"))
        shuffled = variants.groupBy("pos").agg(F.avg(error).alias("shuffled_mae"), F.count("*").alias("variants")).withColumn(
            "feature", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1)).drop("pos")
        return _ranked_importance(shuffled, known.agg(F.avg(error).alias("mae"), F.count("*").alias("rows")), top)
    own = F.struct(*columns)
    paired = stage(
        dealt.withColumn("d", F.coalesce(F.lead(own).over(ring), F.first(own).over(whole))).select("actual", *columns, "d"),
        "importance",
    )
    variants = paired.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns]))).select(
        "feature", "actual", *[F.expr(f"case when feature = '{c}' then d.`{c}` else `{c}` end").alias(c) for c in columns]
    )
    shuffled = predict(model, variants).groupBy("feature").agg(F.avg(error).alias("shuffled_mae"), F.count("*").alias("variants"))
    base = predict(model, known).agg(F.avg(error).alias("mae"), F.count("*").alias("rows"))
    return _ranked_importance(shuffled, base, top)


def _ranked_importance(shuffled: DataFrame, base: DataFrame, top: int) -> DataFrame:
    """One row per feature, most important first."""
    ranked = Window.orderBy(F.desc("importance_mae_increase"), "feature")
    return (
        shuffled.crossJoin(base)
        .select("feature", (F.col("shuffled_mae") - F.col("mae")).alias("importance_mae_increase"), "rows", "variants")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )
