"""Sums of products: all that the linear models need to know about the rows.

With ``z = [1, x_1.., m_1.., y]`` (``x`` a feature less a centre, 0 where
absent; ``m`` 1 where absent) the sums of ``z z'`` per cell give the sums for
any imputed and scaled version of the features, and add up over cells, so the
past of every fold is a prefix sum. One-hot levels need the sums of ``z`` per
hour and per weekday (31 rows per cell), and counts per hour and weekday. Centres are each device's warm-up medians and its first
target: past values that cancel out of every result and only keep digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.operators.celltable import CellTable
from driftline.operators.preprocess import WEEKDAYS, device_fills
from driftline.session import keep, keep_columnar
from driftline.spec import HOUR, WEEKDAY

CELL_KEYS = ("cell_train", "cell_final")


@dataclass(frozen=True)
class GramTable:
    """``products``: one row per device and cell pair. ``levels``: one more per hour (``kind`` 0) and weekday (1).

    An hour's row also has its rows per weekday, ``c0`` to ``c6``. ``fills``
    (one row per device): ``fills`` and the centres.
    """

    table: CellTable
    products: DataFrame
    levels: DataFrame
    fills: DataFrame
    width: int


def _z(table: CellTable) -> list:
    spec = table.spec
    centred = [q(c) - F.col("centres")[i] for i, c in enumerate(spec.continuous)]
    present = [F.coalesce(x, F.lit(0.0)) for x in centred]
    absent = [q(c).isNull().cast("double") for c in spec.continuous]
    return [F.lit(1.0), *present, *absent, q(spec.target) - F.col("centre_y")]


def build_fills(table: CellTable) -> DataFrame:
    """``(device, fills, centres, centre_y)``: one pass over the rows for the medians."""
    device = table.spec.device
    fills = device_fills(table).join(table.cuts.table.select(device, "first_target"), device)
    return keep(fills.select(
        device, "fills", F.transform("fills", lambda m: m[0]).alias("centres"), F.col("first_target").alias("centre_y")
    ))


def build_gram(table: CellTable) -> GramTable:
    """One more pass over the rows for the sums."""
    spec, device, fills = table.spec, table.spec.device, table.fills
    joined = table.join_devices(table.fit_rows, fills.select(device, "centres", "centre_y"))
    width = 2 * len(spec.continuous) + 2
    names = [f"z{i}" for i in range(width)]
    rows = joined.select(*table.keys, *CELL_KEYS, HOUR, WEEKDAY, *[z.alias(n) for z, n in zip(_z(table), names)])

    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.expr(f"sum({names[i]} * {names[j]}) AS p{i}_{j}") for i, j in pairs]
    products = rows.groupBy(*table.keys, *CELL_KEYS).agg(*sums)
    pairs_of_levels = rows.groupBy(*table.keys, *CELL_KEYS, HOUR, WEEKDAY).agg(*[F.sum(n).alias(n) for n in names])
    counts = [f"c{d}" for d in range(WEEKDAYS)]
    sides = [
        F.struct(
            F.lit(kind).alias("kind"), F.col(level).cast("int").alias("level"), *names,
            *[(F.when(F.col(WEEKDAY) == d, F.col("z0")).otherwise(0.0) if kind == 0 else F.lit(0.0)).alias(c) for d, c in enumerate(counts)],
        ) for kind, level in enumerate((HOUR, WEEKDAY))
    ]
    levels = pairs_of_levels.select(device, *CELL_KEYS, F.explode(F.array(*sides)).alias("_l")).select(
        device, *CELL_KEYS, "_l.*"
    ).groupBy(device, *CELL_KEYS, "kind", "level").agg(*[F.sum(n).alias(n) for n in (*names, *counts)])
    if table.salted:
        products = products.groupBy(device, *CELL_KEYS).agg(*[F.expr(f"sum(p{i}_{j}) AS p{i}_{j}") for i, j in pairs])
    products = products.select(device, *CELL_KEYS, F.array(*[f"p{i}_{j}" for i, j in pairs]).alias("products"))
    return GramTable(table, keep_columnar(products), keep_columnar(levels), fills, width)
