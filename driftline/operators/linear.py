"""Mean, one-sensor and ridge models for every device and prefix, from the sums of products.

A model is a row of a coefficient table; predicting is one join and one expression.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.columns import q, total
from driftline.operators.celltable import CellTable
from driftline.operators.gram import GramTable
from driftline.operators.preprocess import HOURS, WEEKDAYS
from driftline.operators.solve import FLAT, DeviceSums, RidgePath, single_lines, squared_errors
from driftline.operators.timesplit import CELL
from driftline.session import shuffle_partitions, ship_package
from driftline.spec import HOUR, WEEKDAY, CalibrationSpec

# The ridge penalties searched, 10^-3 to 10^3 in 13 equal log steps.
RIDGE_ALPHAS = tuple(10.0 ** (-3 + i / 2) for i in range(13))

CELLS_AT_ONCE, GROUPS_OF_TASK = 1_000, 20

LINEAR_MODELS = ("mean_baseline", "single_sensor_linear", "ridge")


def _device_type(table: CellTable) -> T.DataType:
    return table.rows.schema[table.spec.device].dataType


def _fields(device: str, device_type: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(device, device_type), *[T.StructField(n, t) for n, t in fields]])


def model_schema(spec: CalibrationSpec, device_type: T.DataType) -> T.StructType:
    vector = T.ArrayType(T.DoubleType())
    return _fields(
        spec.device, device_type,
        ("scheme", T.StringType()), ("cell", T.IntegerType()), ("model", T.StringType()),
        ("alpha", T.DoubleType()), ("fit_rows", T.LongType()), ("intercept", T.DoubleType()),
        ("slopes", vector), ("fills", vector), ("hour_weights", vector), ("weekday_weights", vector),
    )


def _per_device(gram: GramTable, extra: DataFrame | None, solve, schema: T.StructType) -> DataFrame:
    """Run ``solve(devices, sums)`` on the sums of some devices at a time, dealt into groups of about ``CELLS_AT_ONCE`` cell pairs.

    A device has at most one row per cell pair, and per cell pair, hour and weekday. ``sums.heads`` has its extra columns.
    """
    table = gram.table
    spark = table.rows.sparkSession
    ship_package(spark)
    device, width = table.spec.device, gram.width
    heads = gram.fills if extra is None else gram.fills.join(extra, device)
    groups = max(1, math.ceil(table.cuts.devices * 2 * (table.folds + 2) / CELLS_AT_ONCE))
    parts = max(2, min(groups, max(shuffle_partitions(spark), math.ceil(groups / GROUPS_OF_TASK))))

    def dealt(sums: DataFrame) -> DataFrame:
        return sums.withColumn("_group", F.pmod(F.xxhash64(device), F.lit(groups))).repartition(parts, "_group")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        devices = pc.unique(left[device])
        left, right = (x.append_column("_nth", pc.index_in(x[device], devices)) for x in (left, right))
        left = left.sort_by([(c, "ascending") for c in ("_nth", "cell_train", "cell_final")])
        return solve(devices, DeviceSums(left, right.filter(pc.is_valid(right["_nth"])), width))

    products = dealt(gram.products.join(heads, device)).groupBy("_group")
    return products.cogroup(dealt(gram.levels).groupBy("_group")).applyInArrow(run, schema)


def _stacked(parts: list[tuple], schema: T.StructType) -> pa.Table:
    return pa.concat_tables([pa.table(dict(zip(schema.names, columns, strict=True))) for columns in parts])


def _lists(numbers: np.ndarray) -> pa.Array:
    """A row of numbers for each device as an array column."""
    return pa.ListArray.from_arrays(np.arange(len(numbers) + 1, dtype=np.int32) * numbers.shape[1], np.ascontiguousarray(numbers).ravel())


def design_columns(spec: CalibrationSpec, features: Sequence[str] | None) -> list[int] | None:
    """Positions of the chosen features' columns among ridge's 8 scaled and 31 one-hot ones; None for all."""
    if features is None:
        return None
    spec.check_features(features)
    p = len(spec.continuous)
    spans = {c: [i] for i, c in enumerate(spec.continuous)}
    spans[HOUR] = list(range(p, p + HOURS))
    spans[WEEKDAY] = list(range(p + HOURS, p + HOURS + WEEKDAYS))
    return [i for c in features for i in spans[c]]


def ridge_cv(
    gram: GramTable, alphas: Sequence[float] = RIDGE_ALPHAS, features: Sequence[str] | None = None
) -> DataFrame:
    """``(device, candidate, alpha, fold, rmse)`` on the training block.

    A fold's error follows from the sums of its own cell, so the grid reads no rows.
    """
    table = gram.table
    columns = design_columns(table.spec, features)
    folds, numbers = table.folds, [table.prefix_number("train", f) for f in range(1, table.folds + 1)]
    schema = _fields(
        table.spec.device, _device_type(table),
        ("candidate", T.IntegerType()), ("alpha", T.DoubleType()), ("fold", T.IntegerType()), ("rmse", T.DoubleType()),
    )

    def solve(devices: pa.Array, sums: DeviceSums) -> pa.Table:
        found = []
        for f, number in zip(range(1, folds + 1), numbers, strict=True):
            path = RidgePath(sums.design(sums.prefix("train", f), number), sums.p, columns)
            held_out = sums.design(sums.held_out("train", f), number)
            for i, alpha in enumerate(alphas):
                errors = np.sqrt(squared_errors(held_out, *path.weights(alpha)) / held_out[:, 0, 0])
                found.append((devices, np.full(len(errors), i, np.int32), np.full(len(errors), alpha), np.full(len(errors), f, np.int32), errors))
        return _stacked(found, schema)

    return _per_device(gram, None, solve, schema)


def best_candidate(cv: DataFrame, device: str, keep: Sequence[str]) -> DataFrame:
    """Lowest mean fold RMSE per device; the first candidate wins a tie."""
    scored = cv.groupBy(device, "candidate", *keep).agg(F.avg("rmse").alias("cv_rmse"))
    order = F.struct("cv_rmse", "candidate")
    return scored.groupBy(device).agg(
        *[F.min_by(c, order).alias(c) for c in ("candidate", *keep)],
        F.min("cv_rmse").alias("cv_rmse"), F.count("*").alias("candidates"),
    )


def tune_ridge(
    gram: GramTable, alphas: Sequence[float] = RIDGE_ALPHAS, features: Sequence[str] | None = None
) -> DataFrame:
    """``(device, candidate, alpha, cv_rmse, candidates)``."""
    return best_candidate(ridge_cv(gram, alphas, features), gram.table.spec.device, ["alpha"])


def fit_linear(
    gram: GramTable,
    scheme: str,
    cells: Sequence[int],
    models: Sequence[str] = LINEAR_MODELS,
    alpha: float | DataFrame = 1.0,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Coefficient rows, per device and model, that may predict the given cells.

    ``alpha`` is one penalty for all devices or a ``(device, alpha)`` table.
    ``features`` limits ridge to some of the features.
    """
    table = gram.table
    spec = table.spec
    numbers = {f: table.prefix_number(scheme, f) for f in cells}
    sensor = spec.continuous.index(spec.single_sensor)
    columns = design_columns(spec, features)
    own_alpha = isinstance(alpha, DataFrame)
    penalties = alpha.select(spec.device, "alpha") if own_alpha else None
    common = None if own_alpha else float(alpha)

    def solve(devices: pa.Array, sums: DeviceSums) -> pa.Table:
        found, n, p = [], len(devices), sums.p
        penalty = np.full(n, common) if common is not None else sums.heads["alpha"].to_numpy()
        for f, number in numbers.items():
            design = sums.design(sums.prefix(scheme, f), number)
            for name in models:
                slopes, calendar, used = np.zeros((n, p)), np.zeros((n, HOURS + WEEKDAYS)), pa.nulls(n, pa.float64())
                if name == "mean_baseline":
                    intercept = design[:, 0, -1] / design[:, 0, 0]
                elif name == "single_sensor_linear":
                    intercept, slopes[:, sensor] = single_lines(design, sensor)
                else:
                    used = pa.array(penalty)
                    intercept, w = RidgePath(design, p, columns).weights(penalty)
                    slopes, calendar = w[:, :p], w[:, p:]
                intercept = intercept + sums.centre_y - (slopes * sums.centres).sum(axis=1)
                found.append((
                    devices, pa.repeat(scheme, n), np.full(n, f, np.int32), pa.repeat(name, n), used, design[:, 0, 0].astype(np.int64), intercept,
                    *[_lists(x) for x in (slopes, sums.fills[:, :, number], calendar[:, :HOURS], calendar[:, HOURS:])],
                ))
        return _stacked(found, schema)

    schema = model_schema(spec, _device_type(table))
    return _per_device(gram, penalties, solve, schema)


PLAIN_MODELS = LINEAR_MODELS[:2]


def fit_plain(table: CellTable, cells: Mapping[str, Sequence[int]], models: Sequence[str]) -> DataFrame:
    """Coefficient rows of the mean and the one-sensor line, for any schemes at once, without Python.

    Seven sums per cell give those of any past; absent sensor values count as
    the past's median. Sums are of values less the device's centres, which
    cancel out and keep digits.
    """
    spec, device = table.spec, table.spec.device
    sensor = spec.continuous.index(spec.single_sensor)
    head = table.fills.select(device, "fills", F.col("centres")[sensor].alias("centre"), "centre_y")
    rows = table.join_devices(table.fit_rows, head.drop("fills")).select(
        *table.keys, *CELL.values(), (q(spec.single_sensor) - F.col("centre")).alias("_x"),
        (q(spec.target) - F.col("centre_y")).alias("_y"),
    )
    x, y = F.col("_x"), F.col("_y")
    parts = {
        "n": F.count("*").cast("double"), "y": F.sum(y), "k": F.count(x).cast("double"), "x": F.sum(x), "xx": F.sum(x * x),
        "xy": F.sum(x * y), "yk": F.sum(F.when(x.isNotNull(), y)),
    }
    by_cell = rows.groupBy(*table.keys, *CELL.values()).agg(
        *[F.coalesce(value, F.lit(0.0)).alias(f"_s{name}") for name, value in parts.items()]
    )
    pasts = [
        F.struct(F.lit(scheme).alias("scheme"), F.lit(f).alias("cell"), F.lit(table.prefix_number(scheme, f)).alias("number"), *[
            F.sum(F.when(F.col(CELL[scheme]) < f, F.col(f"_s{name}"))).alias(name) for name in parts
        ]) for scheme, chosen in cells.items() for f in chosen
    ]
    past = by_cell.groupBy(device).agg(F.array(*pasts).alias("_pasts")).select(device, F.explode("_pasts").alias("p"))
    joined = past.select(device, "p.*").join(head, device)
    c = F.col
    shift = c("fills")[sensor][c("number")] - c("centre")
    absent = c("n") - c("k")
    filled = joined.withColumns({
        "sx": c("x") + absent * shift, "sxx": c("xx") + absent * shift * shift, "sxy": c("xy") + shift * (c("y") - c("yk")),
        "own_fills": F.transform("fills", lambda m: m[c("number")]),
    })
    spread = c("sxx") - c("sx") * c("sx") / c("n")
    slope = F.when(spread > FLAT * c("sxx"), (c("sxy") - c("sx") * c("y") / c("n")) / spread).otherwise(0.0)
    solved = filled.withColumn("slope", slope)
    line = F.struct(
        F.lit(PLAIN_MODELS[1]).alias("model"), ((c("y") - c("slope") * c("sx")) / c("n") + c("centre_y") - c("slope") * c("centre")).alias("intercept"),
        F.array(*[c("slope") if i == sensor else F.lit(0.0) for i in range(len(spec.continuous))]).alias("slopes"),
    )
    mean = F.struct(
        F.lit(PLAIN_MODELS[0]).alias("model"), (c("y") / c("n") + c("centre_y")).alias("intercept"),
        F.array(*[F.lit(0.0)] * len(spec.continuous)).alias("slopes"),
    )
    wanted = [m for name, m in zip(PLAIN_MODELS, (mean, line)) if name in models]
    return solved.withColumn("m", F.explode(F.array(*wanted))).select(
        device, "scheme", "cell", "m.model", F.lit(None).cast("double").alias("alpha"), c("n").cast("long").alias("fit_rows"),
        "m.intercept", "m.slopes", c("own_fills").alias("fills"),
        F.array(*[F.lit(0.0)] * HOURS).alias("hour_weights"), F.array(*[F.lit(0.0)] * WEEKDAYS).alias("weekday_weights"),
    )


def wide_models(models: DataFrame, table: CellTable, scheme: str, cells: Sequence[int], names: Sequence[str]) -> DataFrame:
    """One row per device: for each model an array of its coefficient rows, ordered by cell."""
    parts = ("intercept", "slopes", "fills", "hour_weights", "weekday_weights")

    def one(name: str, cell: int) -> Column:
        return F.max(F.when((F.col("model") == name) & (F.col("cell") == cell), F.struct(*parts)))

    return models.filter(F.col("scheme") == scheme).groupBy(table.spec.device).agg(
        *[F.array(*[one(name, cell) for cell in cells]).alias(f"_{name}") for name in names]
    )


def contributions(model: Column, spec: CalibrationSpec, value=q) -> list[Column]:
    """What each feature adds to a prediction; ``value(name)`` gives the feature's column."""
    parts = [
        model["slopes"][i] * F.coalesce(value(c), model["fills"][i]) for i, c in enumerate(spec.continuous)
    ]
    return [*parts, model["hour_weights"][value(HOUR)], model["weekday_weights"][value(WEEKDAY)]]


def add_linear(
    rows: DataFrame, table: CellTable, models: DataFrame, scheme: str, cells: Sequence[int], outputs: dict[str, str]
) -> DataFrame:
    """Add predictions of linear models; ``outputs`` maps model name to new column.

    With several cells, ``rows`` carry theirs as ``cell``. Point estimates, not clipped.
    """
    wide = wide_models(models, table, scheme, cells, list(outputs))
    joined = table.join_devices(rows, wide, weight=4 * len(cells) * len(outputs))
    which = F.lit(0) if len(cells) == 1 else F.col("cell") - min(cells)
    added = {}
    for name, out in outputs.items():
        model = F.col(f"_{name}")[which]
        added[out] = total([model["intercept"], *contributions(model, table.spec)])
    return joined.withColumns(added).drop(*[f"_{name}" for name in outputs])
