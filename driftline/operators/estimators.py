"""Models behind one protocol: fit on the past of some cells, predict those cells.

``fit_cells(table, scheme, cells)`` returns a ``Fitted``; its ``at`` puts a
prediction column on rows of one cell. The model used for a row of cell ``f``
has seen cells before ``f`` only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import finite, q
from driftline.operators.celltable import CellTable
from driftline.operators.linear import PLAIN_MODELS, add_linear, fit_linear, fit_plain
from driftline.session import keep

Transform = Callable[[DataFrame, str], DataFrame]


class Fitted:
    """Models for some cells."""

    cells: tuple[int, ...]

    def at(self, rows: DataFrame, cell: int, out: str) -> DataFrame:
        """Add the prediction for rows that all lie in ``cell``."""
        raise NotImplementedError


class Estimator:
    name: str

    def fit_cells(self, table: CellTable, scheme: str, cells: Sequence[int]) -> Fitted:
        raise NotImplementedError


@dataclass
class LinearFitted(Fitted):
    table: CellTable
    models: DataFrame
    scheme: str
    cells: tuple[int, ...]
    name: str

    def at(self, rows: DataFrame, cell: int, out: str) -> DataFrame:
        one = self.models.filter(F.col("cell") == cell)
        return add_linear(rows, self.table, one, self.scheme, [cell], {self.name: out})


@dataclass
class Linear(Estimator):
    """``mean_baseline``, ``single_sensor_linear`` or ``ridge``; all cells from one set of sums."""

    name: str
    alpha: float | DataFrame = 1.0

    def fit_cells(self, table: CellTable, scheme: str, cells: Sequence[int]) -> LinearFitted:
        return fit_linear_models(table, scheme, cells, [self])[self.name]


def fit_linear_models(
    table: CellTable, scheme: str, cells: Sequence[int], estimators: Sequence[Linear]
) -> dict[str, LinearFitted]:
    """Several linear models in one table; only ridge needs the sums of products."""
    alpha = next((e.alpha for e in estimators if e.name == "ridge"), None)
    plain = [e.name for e in estimators if e.name in PLAIN_MODELS]
    parts = [fit_plain(table, {scheme: cells}, plain)] if plain else []
    if alpha is not None:
        parts.append(fit_linear(table.gram, scheme, cells, ["ridge"], alpha))
    models = keep(reduce(DataFrame.unionByName, parts))
    return {e.name: LinearFitted(table, models, scheme, tuple(cells), e.name) for e in estimators}


def mean_baseline() -> Linear:
    return Linear("mean_baseline")


def single_sensor_linear() -> Linear:
    return Linear("single_sensor_linear")


def ridge(alpha: float | DataFrame = 1.0) -> Linear:
    return Linear("ridge", alpha)


@dataclass
class PerCellFitted(Fitted):
    transforms: dict[int, Transform]

    @property
    def cells(self) -> tuple[int, ...]:
        return tuple(sorted(self.transforms))

    def at(self, rows: DataFrame, cell: int, out: str) -> DataFrame:
        return self.transforms[cell](rows, out)


class PerCell(Estimator):
    """Any model that is fitted on a DataFrame: one fit per cell, several at a time."""

    def fit(self, table: CellTable, scheme: str, cell: int) -> Transform:
        raise NotImplementedError

    def fit_cells(self, table: CellTable, scheme: str, cells: Sequence[int]) -> PerCellFitted:
        with ThreadPoolExecutor(table.config.search_parallelism) as pool:
            fitted = list(pool.map(lambda f: self.fit(table, scheme, f), cells))
        return PerCellFitted(dict(zip(cells, fitted)))


@dataclass
class Custom(PerCell):
    """A user's own model: ``fit_rows(past rows)`` returns ``transform(rows, out)``."""

    name: str
    fit_rows: Callable[[DataFrame], Transform] = field(repr=False)

    def fit(self, table: CellTable, scheme: str, cell: int) -> Transform:
        return self.fit_rows(table.fit_rows.filter(table.in_prefix(scheme, cell)))


def _add_linear_groups(rows: DataFrame, fitted: Mapping[str, LinearFitted], cells: Sequence[int]) -> DataFrame:
    """Linear models that share a coefficient table are added with one join."""
    groups: dict[int, list[tuple[str, LinearFitted]]] = {}
    for out, f in fitted.items():
        groups.setdefault(id(f.models), []).append((out, f))
    for group in groups.values():
        first = group[0][1]
        models = first.models.filter(F.col("cell").isin(list(cells)))
        rows = add_linear(rows, first.table, models, first.scheme, cells, {f.name: out for out, f in group})
    return rows


def add_predictions(rows: DataFrame, fitted: Mapping[str, Fitted], cells: Sequence[int]) -> DataFrame:
    """Add one column per fitted model to rows labelled with their ``cell``."""
    from driftline.operators.trees import TreesFitted, add_tree_predictions

    linear = {out: f for out, f in fitted.items() if isinstance(f, LinearFitted)}
    others = {out: f for out, f in fitted.items() if out not in linear}
    rows = _add_linear_groups(rows, linear, list(cells))
    trees = {out: f for out, f in others.items() if isinstance(f, TreesFitted) and f.models is not None}
    if trees:
        rows = add_tree_predictions(rows, trees, list(cells))
        others = {out: f for out, f in others.items() if out not in trees}
    if not others:
        return rows
    parts = []
    for cell in cells:
        part = rows if len(cells) == 1 else rows.filter(F.col("cell") == cell)
        parts.append(reduce(lambda df, item: item[1].at(df, cell, item[0]), others.items(), part))
    return reduce(DataFrame.unionByName, parts)


def check_target(table: CellTable) -> None:
    """Targets that are not finite cannot be learned from."""
    bad = table.fit_rows.agg(F.count_if(~finite(q(table.spec.target))).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} target value(s) are not finite")


def check_columns(rows: DataFrame, table: CellTable) -> None:
    """Rows to predict must carry the fitted features, in the fitted order."""
    features = table.spec.features
    found = [c for c in rows.columns if c in features]
    if found != list(features):
        raise ValueError(f"prediction needs the features {list(features)} in this order, found {found}")


NO_MODEL = "no model for the device"


def predict_later(fitted: Fitted, readings: DataFrame, table: CellTable, out: str = "prediction") -> DataFrame:
    """Predict new feature rows with the full fit; also for streaming rows.

    Readings of a device without a model stay, with a NULL prediction and a ``reason``.
    """
    check_columns(readings, table)
    device = table.spec.device
    predicted = fitted.at(readings, table.last, out).withColumn("reason", F.lit(None).cast("string"))
    unknown = readings.join(table.cuts.table.select(device), device, "left_anti")
    return predicted.unionByName(
        unknown.withColumn(out, F.lit(None).cast("double")).withColumn("reason", F.lit(NO_MODEL))
    )
