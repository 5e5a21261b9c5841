"""Inputs of the tree models, and bin edges from exact counts of all values for prefixes beyond one task.

Values are counted per feature and prefix, running totals give the ranks, and
the driver gets the edges alone: at most 254 a feature and prefix.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.operators.celltable import CellTable
from driftline.operators.preprocess import fills_weight, long_values
from driftline.operators.running import split_running_totals
from driftline.operators.splits import MOST_BINS, edges_of
from driftline.operators.timesplit import CELL

Edges = dict[tuple[str, int], list[np.ndarray]]


def inputs(table: CellTable, prefix: Column) -> list[Column]:
    """All features in order, gaps filled with the device's medians of a prefix; needs ``fills``."""
    spec = table.spec
    filled = [F.coalesce(q(c), F.col("fills")[i][prefix]) for i, c in enumerate(spec.continuous)]
    return filled + [q(c).cast("double") for c in spec.features[len(filled):]]


def with_fills(table: CellTable, rows: DataFrame) -> DataFrame:
    return table.join_devices(rows, table.fills.select(table.spec.device, "fills"), fills_weight(table))


def prefix_rows(table: CellTable) -> dict[tuple[str, int], int]:
    """Rows of every prefix, all devices together."""
    counts = [F.count_if(table.in_prefix(*p)).alias(f"n{i}") for i, p in enumerate(table.prefixes)]
    return table.once(("prefix_rows",), lambda: dict(zip(table.prefixes, table.fit_rows.agg(*counts).first())))


def _counted(table: CellTable) -> tuple[DataFrame, list[str]]:
    """``(feature, v, n0, n1, ...)``: how often a value stands in each prefix, filled gaps included."""
    spec, counts = table.spec, [f"n{i}" for i in range(len(table.prefixes))]
    cells = [CELL[s] for s in CELL]
    per_prefix = [F.count_if(table.in_prefix(*p)).alias(c) for p, c in zip(table.prefixes, counts)]
    rows = table.fit_rows
    present = long_values(rows.select(*cells, *[q(c).cast("double").alias(c) for c in spec.features]), spec.features, cells)
    present = present.groupBy("feature", "v").agg(*per_prefix)
    gaps = F.filter(F.array(*[F.when(q(c).isNull(), F.lit(i)) for i, c in enumerate(spec.continuous)]), lambda x: x.isNotNull())
    absent = rows.select(spec.device, *cells, F.explode(gaps).alias("feature")).groupBy(spec.device, "feature").agg(*per_prefix)
    filled = with_fills(table, absent).select(
        "feature", F.explode(F.array(*[
            F.struct(F.col("fills")[F.col("feature")][i].alias("v"), *[(F.col(c) if i == j else F.lit(0).cast("long")).alias(c) for j, c in enumerate(counts)])
            for i in range(len(counts))
        ])).alias("_p"),
    ).select("feature", "_p.*")
    return present.unionByName(filled).groupBy("feature", "v").agg(*[F.sum(c).alias(c) for c in counts]), counts


def _cuts(table: CellTable) -> DataFrame:
    """``(prefix, feature, side, j, v)``: all values (side 0) where they are few, or the values below (1) and above (2) the j-th cut."""
    counted, counts = _counted(table)
    there = [c.replace("n", "d") for c in counts]
    flagged = counted.withColumns({d: (F.col(c) > 0).cast("long") for c, d in zip(counts, there)})
    ranked = split_running_totals(flagged, ["feature"], "v", [*counts, *there], table.slices(len(table.spec.features)))
    prefixes = F.array(*[
        F.struct(
            F.lit(i).alias("prefix"), (F.col(f"{c}_upto") - F.col(c)).alias("start"), F.col(f"{c}_upto").alias("upto"),
            F.col(f"{c}_all").alias("n"), F.col(f"{d}_all").alias("kinds"), F.col(c).alias("own"),
        ) for i, (c, d) in enumerate(zip(counts, there))
    ])
    one = ranked.select("feature", "v", F.explode(prefixes).alias("_p")).select("feature", "v", "_p.*").filter("own > 0")
    few = one.filter(f"kinds <= {MOST_BINS}").select("prefix", "feature", F.lit(0).alias("side"), F.lit(0).cast("long").alias("j"), "v")
    last = MOST_BINS - 1
    reach = {  # the j whose rank j (n - 1) / MOST_BINS, rounded down (1) or up (2), falls on this value
        1: (f"(start * {MOST_BINS} + n - 2) div (n - 1)", f"(upto * {MOST_BINS} + n - 2) div (n - 1) - 1"),
        2: (f"IF(start = 0, 1, ((start - 1) * {MOST_BINS}) div (n - 1) + 1)", f"((upto - 1) * {MOST_BINS}) div (n - 1)"),
    }
    many = one.filter(f"kinds > {MOST_BINS}")
    for side, (low, high) in reach.items():
        bounded = many.withColumn("a", F.expr(f"greatest(1L, {low})")).withColumn("b", F.expr(f"least({last}L, {high})")).filter("a <= b")
        few = few.unionByName(bounded.select("prefix", "feature", F.lit(side).alias("side"), F.explode(F.sequence("a", "b")).alias("j"), "v"))
    return few


def bin_edges(table: CellTable) -> Edges:
    """Edges per prefix and feature; a value's bin is the number of edges below it."""

    def make() -> Edges:
        found = _cuts(table).toPandas().sort_values(["prefix", "feature", "side", "j", "v"])
        groups = {key: own["v"].to_numpy() for key, own in found.groupby(["prefix", "feature", "side"])}
        none = np.zeros(0)
        return {
            prefix: [edges_of(*[groups.get((i, f, side), none) for side in (0, 1, 2)]) for f in range(len(table.spec.features))]
            for i, prefix in enumerate(table.prefixes)
        }

    return table.once(("edges",), make)
