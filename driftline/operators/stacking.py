"""Forward stacking: a final estimator, a non-negative blend unless given, learned from past-only predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.columns import finite, q
from driftline.operators.celltable import CellTable, refolded
from driftline.operators.estimators import Estimator, Fitted, add_predictions, check_target, ridge
from driftline.operators.solve import least_squares_lines, nonnegative_lines
from driftline.operators.timesplit import fold_audit
from driftline.operators.trees import boosting, random_forest
from driftline.session import keep, keep_columnar, ship_package
from driftline.spec import RunConfig, check_folds

# Settings of the stock stack, never taken from a search.
STACK_RIDGE_ALPHA = 1.0
STACK_BOOSTING = {
    "learning_rate": 0.1,
    "max_iter": 100,
    "max_leaf_nodes": 31,
    "min_samples_leaf": 20,
    "l2_regularization": 0.0,
}


class FinalFitted:
    """A fitted final estimator: predictions from those of the bases, which are the columns ``inputs``."""

    weights: DataFrame | None = None

    def at(self, rows: DataFrame, inputs: Sequence[str], out: str) -> DataFrame:
        raise NotImplementedError


class FinalEstimator:
    """Learns from the out-of-fold table: device, time, cell, ``y`` and a column per base."""

    def fit(self, oof: DataFrame, names: Sequence[str], table: CellTable) -> FinalFitted:
        raise NotImplementedError


@dataclass
class LineFitted(FinalFitted):
    """``weights``: (device, intercept, weights)."""

    table: CellTable
    weights: DataFrame

    def at(self, rows: DataFrame, inputs: Sequence[str], out: str) -> DataFrame:
        joined = self.table.join_devices(rows, self.weights.withColumnRenamed("intercept", "_intercept"))
        value = F.col("_intercept")
        for i, column in enumerate(inputs):
            value = value + F.col("weights")[i] * q(column)
        return joined.withColumn(out, value).drop("_intercept", "weights")


@dataclass(frozen=True)
class LinearBlend(FinalEstimator):
    """A line per device by least squares, with weights of at least 0 unless ``positive`` is off."""

    positive: bool = True

    def fit(self, oof: DataFrame, names: Sequence[str], table: CellTable) -> LineFitted:
        return LineFitted(table, keep(blend_weights(oof, names, table, self.positive)))


@dataclass
class CustomFinalFitted(FinalFitted):
    transform: Callable[[DataFrame, Sequence[str], str], DataFrame]

    def at(self, rows: DataFrame, inputs: Sequence[str], out: str) -> DataFrame:
        return self.transform(rows, inputs, out)


@dataclass(frozen=True)
class CustomFinal(FinalEstimator):
    """A user's own: ``fit_rows(out-of-fold table, base names)`` returns ``transform(rows, input columns, out)``."""

    fit_rows: Callable[[DataFrame, Sequence[str]], Callable[[DataFrame, Sequence[str], str], DataFrame]] = field(repr=False)

    def fit(self, oof: DataFrame, names: Sequence[str], table: CellTable) -> CustomFinalFitted:
        return CustomFinalFitted(self.fit_rows(oof, names))


@dataclass
class StackFitted(Fitted):
    """``oof``: the table the final estimator learned from. ``table`` has the stack's own folds, ``cells`` the caller's."""

    table: CellTable
    names: tuple[str, ...]
    bases: tuple[Fitted, ...]
    final: FinalFitted
    oof: DataFrame
    folds: DataFrame
    cells: tuple[int, ...]

    @property
    def weights(self) -> DataFrame | None:
        """(device, intercept, weights) of a linear blend."""
        return self.final.weights

    def at(self, rows: DataFrame, cell: int, out: str) -> DataFrame:
        inputs = [f"_base_{i}" for i in range(len(self.bases))]
        for base, column in zip(self.bases, inputs):
            rows = base.at(rows, self.table.last, column)
        return self.final.at(rows, inputs, out).drop(*inputs)


@dataclass
class ForwardStack(Estimator):
    """Bases in order; each predicts every fold from earlier rows, the warm-up is left out.

    ``folds``: the stack's own number of folds, that of the run unless given.
    ``final`` learns from the out-of-fold predictions.
    """

    estimators: Sequence[Estimator]
    name: str = "stacking"
    folds: int | None = None
    final: FinalEstimator = LinearBlend()

    def __post_init__(self) -> None:
        names = [e.name for e in self.estimators]
        if not names or len(set(names)) != len(names) or not all(names):
            raise ValueError("a stack needs base models with distinct names")
        if self.folds is not None:
            check_folds(self.folds)

    def fit_cells(self, table: CellTable, scheme: str, cells: Sequence[int]) -> StackFitted:
        """Only the full fit (cell ``k + 1``) is defined: the folds are those of the whole block."""
        if list(cells) != [table.last]:
            raise ValueError("a stack predicts the block after its folds only")
        own = refolded(table, check_folds(self.folds or table.folds))
        check_target(own)
        names = tuple(e.name for e in self.estimators)
        every = range(1, own.last + 1)
        with ThreadPoolExecutor(min(len(names), table.config.search_parallelism)) as pool:
            bases = tuple(pool.map(lambda e: e.fit_cells(own, scheme, every), self.estimators))
        oof = out_of_fold(own, scheme, bases, names)
        final = self.final.fit(oof, names, own)
        audit = fold_audit(own.rows, own.spec, own.folds, scheme)
        return StackFitted(own, names, bases, final, oof, audit, tuple(cells))


def out_of_fold(table: CellTable, scheme: str, bases: Sequence[Fitted], names: Sequence[str]) -> DataFrame:
    """``(device, ts, cell, y, <one column per base>)`` for all rows after the warm-up."""
    spec = table.spec
    rows = add_predictions(
        table.cells(scheme, 1, table.folds), dict(zip(names, bases)), range(1, table.folds + 1)
    )
    oof = keep_columnar(rows.select(spec.device, spec.time, "cell", q(spec.target).alias("y"), *[q(n) for n in names]))
    bad = oof.agg(*[F.count_if(~finite(q(n))).alias(n) for n in names]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"base predictions that are not finite: {bad}")
    return oof


def blend_weights(oof: DataFrame, names: Sequence[str], table: CellTable, positive: bool = True) -> DataFrame:
    """Least squares per device, with weights of at least 0 if ``positive``, from one aggregate over its out-of-fold rows."""
    device = table.spec.device
    ship_package(oof.sparkSession)
    columns = [*names, "y"]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    facts = oof.groupBy(device).agg(
        F.array(*[F.avg(q(c)) for c in columns]).alias("mean"),
        F.array(*[F.covar_pop(q(columns[i]), q(columns[j])) for i, j in pairs]).alias("spread"),
    )
    schema = T.StructType([
        oof.schema[device], T.StructField("intercept", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
    ])
    width, first, second = len(columns), [i for i, _ in pairs], [j for _, j in pairs]
    solve = nonnegative_lines if positive else least_squares_lines

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, packed = (
                batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1) for name in ("mean", "spread")
            )
            spreads = np.zeros((batch.num_rows, width, width))
            spreads[:, first, second] = spreads[:, second, first] = packed
            intercepts, weights = solve(means, spreads)
            yield pa.RecordBatch.from_arrays(
                [batch.column(device), pa.array(intercepts), pa.array(list(weights), pa.list_(pa.float64()))], schema.names
            )

    return facts.mapInArrow(blend, schema)


def stock_stack(config: RunConfig) -> ForwardStack:
    """Ridge, forest and boosting with the fixed settings."""
    return ForwardStack([
        ridge(STACK_RIDGE_ALPHA),
        random_forest(config.forest_trees, config.seed),
        boosting(config.seed, **STACK_BOOSTING),
    ])
