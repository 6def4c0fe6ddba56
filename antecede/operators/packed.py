"""Passes over hundreds of numeric columns.

Spark reads rows of more than a hundred fields one value at a time, and aggregates of many columns outgrow compiled code. Here
the columns of a fold are written once as one array per row; every pass then works on Arrow batches as numpy matrices inside
tasks, a task gives one small partial result for each column, and Spark merges these. The functions travel to the workers
by value, so these need not have the repository on their path.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from antecede.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of a batch of arrays, one line per row; unknown values are 0."""
    flat = column.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    return flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width), known


class Packed:
    """``columns`` of a table as ``values``, an array of doubles per row, next to the columns to ``keep``, as a written table.

    With ``parts`` the table is written in folders of these columns, so that a fold reads its own seasons only.
    """

    def __init__(
        self, df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), parts: Sequence[str] = (), table: DataFrame | None = None
    ):
        self.columns, self.source, self.kept = list(columns), df, [c for c in df.columns if c in keep]
        self.table = stage(self.lines(*self.kept), "values", parts) if table is None else table
        self._facts: dict[str, dict] | None = None
        self.medians: dict[str, float] | None = None  # set by who finds them

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str], parts: Sequence[str] = ()) -> Packed:
        """A table with all its other columns kept."""
        return Packed(df, columns, [c for c in df.columns if c not in columns], parts)

    def where(self, condition: Column) -> Packed:
        """Some rows of the same written table; the condition reads columns that are kept."""
        return Packed(self.source.where(condition), self.columns, self.kept, table=self.table.where(condition))

    def lines(self, *others: Column | str) -> DataFrame:
        """The arrays and ``others`` straight from the table."""
        return self.lines_of(self.source, self.columns, others)

    @staticmethod
    def lines_of(df: DataFrame, columns: Sequence[str], others: Sequence[Column | str]) -> DataFrame:
        return df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("values"), *others)

    @property
    def facts(self) -> dict[str, dict]:
        """Per column the rows, the known values and their mean, variance, least and largest."""
        if self._facts is None:
            width, rows = len(self.columns), self.table.count()
            parts = self.table.select("values").mapInArrow(
                lambda batches: _moments(batches, width), "pos int, n bigint, mean double, apart double, low double, high double"
            )
            # Deviations are moved from the mean of their task to that of all rows before they are added.
            all_ = Window.partitionBy("pos")
            moved = parts.where("n > 0").withColumn("middle", F.sum(F.col("n") * F.col("mean")).over(all_) / F.sum("n").over(all_))
            gap = F.col("mean") - F.col("middle")
            found = {r.pos: r for r in moved.groupBy("pos").agg(
                F.sum("n").alias("n"), F.first("middle").alias("mean"), (F.sum(F.col("apart") + F.col("n") * gap * gap) / F.sum("n")).alias("var"),
                F.min("low").alias("low"), F.max("high").alias("high"),
            ).collect()}  # one row per column
            none = {"n": 0, "mean": None, "var": None, "low": None, "high": None}
            self._facts = {
                c: {"rows": rows} | ({k: found[p][k] for k in none} if p in found else none) for p, c in enumerate(self.columns)
            }
        return self._facts

    def around(self, low: Mapping[str, float], high: Mapping[str, float]) -> DataFrame:
        """(pos, kind, value, n), written: per column the values ``below`` low, at ``low``, at ``high`` and ``under`` high, and
        how often each value strictly ``inside`` occurs."""
        width, at = len(self.columns), [k for k, c in enumerate(self.columns) if c in low]
        ends = [np.array([b[self.columns[k]] for k in at]) for b in (low, high)]
        parts = self.table.select("values").mapInArrow(
            lambda batches: _around(batches, width, at, *ends), "pos int, kind string, value double, n bigint"
        )
        return stage(parts.groupBy("pos", "kind", "value").agg(F.sum("n").alias("n")), "around")

    def products(self, plan: Sequence[tuple], label: Column, table: DataFrame | None = None) -> np.ndarray:
        """Sums of products of the model inputs, the label and 1, over rows with a known label.

        ``plan`` has (column, indicator of a gap?, filling, mean, spread) for every input. The matrix is bounded by the columns;
        tasks' parts are added line by line by Spark.
        """
        width, shape = len(self.columns), self.shape(plan)
        rows = (self.table if table is None else table).select("values", label.cast("double").alias("label")).where(F.col("label").isNotNull())
        lines = rows.mapInArrow(lambda batches: _products(batches, width, *shape), "line int, sums array<double>")
        merged = lines.groupBy("line").applyInArrow(_added, "line int, sums array<double>").collect()
        size = len(plan) + 2
        out = np.zeros((size, size))
        for r in merged:
            out[r.line] = r.sums
        return out

    def poisson_sums(self, plan: Sequence[tuple], label: Column, weights: np.ndarray, table: DataFrame | None = None) -> np.ndarray:
        """Sums of a step of Newton's method for a log link: products of the inputs, the gap to the label and 1, each row by its mean.

        Like ``products``, with the last but one line for sums of the gaps instead of the label; the mean of a row follows from
        ``weights``, which are those of the inputs and the intercept.
        """
        shape = self.shape(plan)
        rows = (self.table if table is None else table).select("values", label.cast("double").alias("label")).where(F.col("label").isNotNull())
        width = len(self.columns)
        lines = rows.mapInArrow(lambda batches: _poisson_sums(batches, width, weights, *shape), "line int, sums array<double>")
        merged = lines.groupBy("line").applyInArrow(_added, "line int, sums array<double>").collect()
        out = np.zeros((len(plan) + 2, len(plan) + 2))
        for r in merged:
            out[r.line] = r.sums
        return out

    def shape(self, plan: Sequence[tuple]) -> list[np.ndarray]:
        """``plan`` as arrays: place, indicator of a gap?, filling, mean and spread of every input."""
        where = {c: k for k, c in enumerate(self.columns)}
        return [
            np.array([where[p[0]] for p in plan], dtype=int), np.array([p[1] for p in plan], dtype=bool),
            *[np.array([p[k] for p in plan], dtype=float) for k in (2, 3, 4)],
        ]

    def scored(self, models: Sequence[tuple[Sequence[tuple], Sequence[np.ndarray]]]) -> DataFrame:
        """The kept columns and ``sums``, an array with the weighted sum of each of the ``models``' weights, in one pass.

        Every item has the plan of its inputs and the weights of the models that read them, the intercept last.
        """
        width, kept = len(self.columns), self.table.select(*self.kept)
        steps = [(self.shape(plan), np.array(weights).T) for plan, weights in models]
        types = StructType([*kept.schema.fields, StructField("sums", ArrayType(DoubleType()))])
        return self.table.select("values", *self.kept).mapInArrow(lambda batches: _scored(batches, width, steps), types)


def _moments(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n, mean, apart = np.zeros(width, dtype=np.int64), np.zeros(width), np.zeros(width)
    low, high = np.full(width, np.inf), np.full(width, -np.inf)
    for b in batches:
        x, known = matrix(b.column(0), width)
        if not len(x):
            continue
        m = known.sum(0)
        own = x.sum(0) / np.maximum(m, 1)
        gap = np.where(known, x - own, 0.0)
        both, shift = np.maximum(n + m, 1), own - mean
        apart += (gap * gap).sum(0) + shift * shift * n * m / both
        mean, n = mean + shift * m / both, n + m
        low = np.minimum(low, np.where(known, x, np.inf).min(0))
        high = np.maximum(high, np.where(known, x, -np.inf).max(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(width, dtype=np.int32)), *[pa.array(v) for v in (n, mean, apart, low, high)]],
        names=["pos", "n", "mean", "apart", "low", "high"],
    )


def _around(batches: Iterable[pa.RecordBatch], width: int, at: Sequence[int], low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, known = matrix(b.column(0), width)
        if not len(x):
            continue
        x, known = x[:, at], known[:, at]
        tests = {"below": x < low, "low": x == low, "high": x == high, "under": x < high}
        pos, kind, value, n = [], [], [], []
        for name, test in tests.items():
            pos.append(np.array(at)), kind.extend([name] * len(at))
            value.append(np.zeros(len(at))), n.append((test & known).sum(0))
        inside = known & (x > low) & (x < high)
        for k in np.flatnonzero(inside.any(0)):
            values, often = np.unique(x[inside[:, k], k], return_counts=True)
            pos.append(np.full(len(values), at[k])), kind.extend(["inside"] * len(values))
            value.append(values), n.append(often)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(pos).astype(np.int32)), pa.array(kind), pa.array(np.concatenate(value)), pa.array(np.concatenate(n).astype(np.int64))],
            names=["pos", "kind", "value", "n"],
        )


def _products(batches: Iterable[pa.RecordBatch], width: int, where, gap, fill, mean, spread) -> Iterator[pa.RecordBatch]:
    size = len(where) + 2
    total = np.zeros((size, size))
    for b in batches:
        if not len(b):
            continue
        inputs = _inputs(b.column(0), width, where, gap, fill, mean, spread)
        whole = np.column_stack([inputs, b.column(1).to_numpy(zero_copy_only=False), np.ones(len(b))])
        total += whole.T @ whole
    yield _lines(total)


def _inputs(column: pa.Array, width: int, where, gap, fill, mean, spread) -> np.ndarray:
    """The filled and scaled inputs of a batch."""
    x, known = matrix(column, width)
    x, known = x[:, where], known[:, where]
    return (np.where(gap, ~known, np.where(known, x, fill)) - mean) / spread


def _lines(total: np.ndarray) -> pa.RecordBatch:
    size = len(total)
    sums = pa.ListArray.from_arrays(pa.array(np.arange(0, size * size + 1, size, dtype=np.int32)), pa.array(total.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), sums], names=["line", "sums"])


def _poisson_sums(batches: Iterable[pa.RecordBatch], width: int, weights: np.ndarray, *shape) -> Iterator[pa.RecordBatch]:
    size = len(weights) + 1
    total = np.zeros((size, size))
    for b in batches:
        if not len(b):
            continue
        inputs = np.column_stack([_inputs(b.column(0), width, *shape), np.ones(len(b))])
        label, mean = b.column(1).to_numpy(zero_copy_only=False), np.exp(inputs @ weights)
        others = [*range(size - 2), size - 1]  # the line between inputs and 1 is for the gaps
        total[np.ix_(others, others)] += inputs.T @ (inputs * mean[:, None])
        total[size - 2, others] += (label - mean) @ inputs
        total[size - 2, size - 2] += np.sum(mean - label * np.log(np.maximum(mean, 1e-300)))
    yield _lines(total)


def _scored(batches: Iterable[pa.RecordBatch], width: int, steps: Sequence[tuple]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = [np.column_stack([_inputs(b.column(0), width, *shape), np.ones(len(b))]) @ weights for shape, weights in steps]
        sums = np.concatenate(sums, axis=1)
        ends = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))], names=[*b.schema.names[1:], "sums"]
        )


def _added(table: pa.Table) -> pa.Table:
    lines = table.column("sums").combine_chunks()
    total = lines.flatten().to_numpy().reshape(len(lines), -1).sum(0)
    return pa.table({"line": pa.array([table.column("line")[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})
