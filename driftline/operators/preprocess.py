"""Fitted preprocessing: exact medians, scaling, one-hot levels, imputation.

Medians of every prefix come from one pass: values are counted per prefix, and
running totals over the distinct values give the middle ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.operators.celltable import CellTable
from driftline.operators.running import running_totals, split_running_totals
from driftline.session import keep_columnar
from driftline.spec import HOUR, WEEKDAY

HOURS, WEEKDAYS = 24, 7


def long_values(rows: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per present value: the kept columns, ``feature`` (position in ``names``) and ``v``."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), q(c).alias("v")) for i, c in enumerate(names)])
    return rows.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*").filter("v IS NOT NULL")


def _middle(counted: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Median of ``v`` per group for each weight column, as an array; NULL without any value."""

    def at(s: str, rank: Column) -> Column:
        start = F.col(f"{s}_upto") - F.col(s)
        return F.max(F.when((start <= rank) & (rank < F.col(f"{s}_upto")), F.col("v")))

    def median(s: str) -> Column:
        n = F.col(f"{s}_all")
        return (at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2

    return counted.groupBy(*keys).agg(F.array(*[median(s) for s in counts]).alias("medians"))


def prefix_medians(table: CellTable, names: Sequence[str] | None = None) -> DataFrame:
    """``(device, feature, medians)``: exact medians of the present values, one per prefix."""
    names = names or table.spec.continuous
    device = table.spec.device
    counts = [f"n{i}" for i in range(len(table.prefixes))]
    weights = [table.in_prefix(*p).cast("long").alias(c) for p, c in zip(table.prefixes, counts)]
    rows = table.fit_rows.select(*table.keys, *weights, *[q(c) for c in names])
    values = long_values(rows, names, [*table.keys, *counts])
    counted = values.groupBy(device, "feature", "v").agg(*[F.sum(c).alias(c) for c in counts])
    if not table.salted:
        return _middle(running_totals(counted, [device, "feature"], "v", counts), [device, "feature"], counts)
    counted = keep_columnar(counted)
    hot = table.hot_devices()
    if table.cuts.rows // table.layout.hot_rows <= table.layout.broadcast_rows:
        hot = F.broadcast(hot)
    keys = [device, "feature"]
    large = split_running_totals(counted.join(hot, device, "left_semi"), keys, "v", counts, table.slices(len(names)))
    small = running_totals(counted.join(hot, device, "left_anti"), keys, "v", counts)
    return _middle(large, keys, counts).unionByName(_middle(small, keys, counts))


def device_fills(table: CellTable, names: Sequence[str] | None = None) -> DataFrame:
    """``(device, fills)`` with ``fills[feature][prefix]``; 0 where a prefix has no value."""
    names = names or table.spec.continuous
    empty = F.array(*[F.lit(0.0)] * len(table.prefixes))
    found = [
        F.coalesce(F.max(F.when(F.col("feature") == i, F.col("medians"))), empty) for i in range(len(names))
    ]
    fills = F.transform(F.array(*found), lambda m: F.transform(m, lambda x: F.coalesce(x, F.lit(0.0))))
    per_device = prefix_medians(table, names).groupBy(table.spec.device).agg(fills.alias("fills"))
    return per_device


def fill_at(table: CellTable, scheme: str, f: int, feature: int) -> Column:
    return F.col("fills")[feature][table.prefix_number(scheme, f)]


def fills_weight(table: CellTable) -> int:
    """How many plain rows of about eight numbers a row of ``fills`` is worth."""
    return max(1, len(table.spec.continuous) * len(table.prefixes) // 8)


def impute(rows: DataFrame, table: CellTable, fills: DataFrame, scheme: str, f: int) -> DataFrame:
    """Continuous features filled with the medians of one prefix."""
    joined = table.join_devices(rows, fills, fills_weight(table))
    filled = {
        c: F.coalesce(q(c), fill_at(table, scheme, f, i)) for i, c in enumerate(table.spec.continuous)
    }
    return joined.withColumns(filled).drop("fills")


def scale_statistics(imputed: DataFrame, table: CellTable) -> DataFrame:
    """Mean and population deviation per device; a deviation of 0 counts as 1."""
    aggs = []
    for i, c in enumerate(table.spec.continuous):
        aggs += [F.avg(q(c)).alias(f"mean_{i}"), F.stddev_pop(q(c)).alias(f"sd_{i}")]
    stats = imputed.groupBy(table.spec.device).agg(*aggs)
    return stats.withColumns({
        f"sd_{i}": F.when(F.col(f"sd_{i}") == 0, 1.0).otherwise(F.col(f"sd_{i}"))
        for i in range(len(table.spec.continuous))
    })


def standard_scale(rows: DataFrame, table: CellTable, stats: DataFrame) -> DataFrame:
    scaled = {
        c: (q(c) - F.col(f"mean_{i}")) / F.col(f"sd_{i}") for i, c in enumerate(table.spec.continuous)
    }
    return table.join_devices(rows, stats).withColumns(scaled).drop(
        *[f"{s}_{i}" for s in ("mean", "sd") for i in range(len(table.spec.continuous))]
    )


def one_hot(rows: DataFrame) -> DataFrame:
    """0/1 columns for every hour and weekday; a level that never occurs stays all zero."""
    flags = {f"hour_{h}": (F.col(HOUR) == h).cast("int") for h in range(HOURS)}
    flags.update({f"weekday_{d}": (F.col(WEEKDAY) == d).cast("int") for d in range(WEEKDAYS)})
    return rows.withColumns(flags)
