"""Permutation importance on the test block.

Every feature is shuffled on its own in every repeat. A device's rows get ranks
in the order of a hash of their keys. A shuffle is a bijection on the ranks,
``ROUNDS`` rounds of swap-or-not whose numbers follow from (seed, repeat, feature):
each row gives its value to the row at the rank it is sent to. For a linear model
a device's values meet in the arrays of its group, without a shuffle as long as rows
are clustered by device. Otherwise they meet by one aggregate over (device, repeat,
feature, rank), which needs no sort per feature. With devices above ``Layout.hot_rows``
ranks are counted in slices of the hash order, and the values of devices with more rows
than that in the block meet by the aggregate, so no such device is handled by one task.
The bijection is plain arithmetic, the same in every engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.columns import q
from driftline.functions.metrics import rmse
from driftline.operators.celltable import CellTable
from driftline.operators.estimators import Fitted, LinearFitted
from driftline.operators.linear import GROUPS_OF_TASK, contributions, wide_models
from driftline.session import keep, keep_columnar, ship_package, shuffle_partitions
from driftline.spec import CalibrationSpec

ROUNDS = 16
PRIME = (1 << 31) - 1
RANKS_AT_ONCE = 1 << 16  # ranks of shuffles that are held at a time, so few that they stay in the processor's cache
GROUP_ROWS = 20_000  # of split devices whose values meet in one group
PLAIN = -1  # the key of the error without a shuffle


def row_hash(spec: CalibrationSpec, seed: int) -> Column:
    stamp = F.date_format(q(spec.time), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.md5(F.concat_ws(":", q(spec.device).cast("string"), stamp, F.lit(str(seed))))


def scrambled(number: str, seed: int) -> str:
    """SQL text: a number below PRIME that follows from ``number`` and the seed."""
    a = f"((({number}) % {PRIME} * 48271 + {(seed * 16807 + 11) % PRIME}) % {PRIME})"
    return f"(({a} * {a} + 69621 * {a} + 12345) % {PRIME})"


def swapped(x: str, turn: str, key: str, n: str, seed: int) -> str:
    """SQL text: where rank ``x`` of ``n`` is after one round; a round undoes itself, so it is a bijection."""
    number = f"(({key}) * {ROUNDS} + {turn}) * 3"
    partner = f"(({scrambled(number, seed)} % {n} + {n} - {x}) % {n})"
    z = f"((greatest({x}, {partner}) % {PRIME} * {scrambled(f'{number} + 1', seed)} + {scrambled(f'{number} + 2', seed)}) % {PRIME})"
    return f"CASE WHEN ({z} * {z} % {PRIME}) % 2 = 1 THEN {partner} ELSE {x} END"


def sent_to(seed: int) -> Column:
    """The rank that a row's value is sent to, from ``_rank``, ``_size`` and ``_key``."""
    return F.expr(f"aggregate(sequence(0L, {ROUNDS - 1}L), _rank, (x, i) -> {swapped('x', 'i', '_key', '_size', seed)})")


def scrambled_array(number: np.ndarray, seed: int) -> np.ndarray:
    """``scrambled`` of whole numbers from 0 on."""
    a = (number % PRIME * 48271 + (seed * 16807 + 11) % PRIME) % PRIME
    return (a * a + 69621 * a + 12345) % PRIME


def below_prime(number: np.ndarray) -> np.ndarray:
    """The remainder by PRIME, which is one less than a power of two, of whole numbers from 0 to 2**62."""
    number = (number & PRIME) + (number >> 31)
    number = (number & PRIME) + (number >> 31)
    number -= (number >= PRIME) * PRIME
    return number


def places(rank: np.ndarray, size: np.ndarray | int, keys: np.ndarray, seed: int) -> np.ndarray:
    """``sent_to`` of each rank (columns) under each key (rows)."""
    x = np.repeat(rank[None].astype(np.int64), len(keys), axis=0)
    if not x.size:
        return x
    sizes, of = np.unique(np.atleast_1d(size), return_inverse=True)
    for turn in range(ROUNDS):
        number = (keys[:, None] * ROUNDS + turn) * 3
        partner = (scrambled_array(number, seed) % sizes)[:, of] - x
        partner += (partner >> 63) & size  # the size where it is negative
        larger = np.maximum(x, partner)
        if sizes[-1] > PRIME:
            larger %= PRIME
        z = below_prime(larger * scrambled_array(number + 1, seed) + scrambled_array(number + 2, seed))
        x = np.where(below_prime(z * z) & 1, partner, x)
    return x


def with_ranks(rows: DataFrame, table: CellTable, seed: int) -> DataFrame:
    """``_rank`` (from 0) and ``_size`` of each row in its device, in hash order."""
    spec = table.spec
    device, order = spec.device, ["_hash", spec.time]
    hashed = rows.withColumn("_hash", row_hash(spec, seed))
    if not table.salted:
        whole = Window.partitionBy(device)
        return hashed.withColumns({
            "_rank": (F.row_number().over(whole.orderBy(*order)) - 1).cast("long"), "_size": F.count("*").over(whole)
        }).drop("_hash")
    sliced = keep_columnar(
        hashed.repartitionByRange(max(2, table.slices()), device, *order).withColumn("_slice", F.spark_partition_id())
    )
    slices = Window.partitionBy(device)  # at most one row per slice and device
    before = slices.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(sliced.groupBy(device, "_slice").agg(F.count("*").alias("_n")).select(
        device, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(slices).alias("_size"),
    ))
    inside = Window.partitionBy(device, "_slice").orderBy(*order)
    return sliced.withColumn("_in", F.row_number().over(inside)).join(offsets, [device, "_slice"]).withColumn(
        "_rank", F.col("_before") + F.col("_in") - 1
    ).drop("_hash", "_slice", "_in", "_before")


def exchanged(ranked: DataFrame, spec: CalibrationSpec, repeats: int, seed: int, stays: Sequence[str], goes: str) -> DataFrame:
    """``(device, _key, _place, <stays>, given)``: each row of each shuffle with the value that was sent to its rank.

    ``_key`` is repeat * features + position; ``goes`` is an array with a value per feature.
    """
    width = len(spec.features)
    return _met(ranked, spec, repeats, seed, {c: q(c) for c in stays}, F.col(goes)[(F.col("_key") % width).cast("int")])


def _met(ranked: DataFrame, spec: CalibrationSpec, repeats: int, seed: int, stays: dict[str, Column], given: Column) -> DataFrame:
    """The same for expressions that may depend on ``_key``."""
    ship_package(ranked.sparkSession)
    keys = np.arange(repeats * len(spec.features), dtype=np.int64)

    @F.pandas_udf("array<long>")
    def sent(rank: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(list(np.ascontiguousarray(places(rank.to_numpy(), size.to_numpy(), keys, seed).T)))

    keyed = ranked.withColumn("_sent", sent("_rank", "_size")).select("*", F.posexplode("_sent").alias("_key", "_to")).withColumn(
        "_key", F.col("_key").cast("long")
    )
    none = [F.lit(None).cast(kind.dataType).alias(kind.name) for kind in keyed.select(*[c.alias(n) for n, c in stays.items()]).schema]
    both = F.array(
        F.struct(F.col("_rank").alias("_place"), *[c.alias(n) for n, c in stays.items()], F.lit(None).cast("double").alias("given")),
        F.struct(F.col("_to").alias("_place"), *none, given.alias("given")),
    )
    records = keyed.select(spec.device, "_key", F.explode(both).alias("_r")).select(spec.device, "_key", "_r.*")
    return records.groupBy(spec.device, "_key", "_place").agg(*[F.max(q(c)).alias(c) for c in stays], F.max("given").alias("given"))


def errors_of_devices(error: np.ndarray, shares: np.ndarray, sizes: np.ndarray, repeats: int, seed: int) -> np.ndarray:
    """RMSE of each device (columns) under every key and, in the last row, without a shuffle.

    The rows of a device stand together, in the order of their ranks.
    """
    n, width = shares.shape
    found, step = np.empty((repeats * width + 1, len(sizes))), max(1, RANKS_AT_ONCE // n)
    starts = np.cumsum(sizes) - sizes
    first_row, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)

    def root_mean(errors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.add.reduceat(errors * errors, starts, axis=-1) / sizes)

    found[-1] = root_mean(error)
    for first in range(0, repeats * width, step):
        keys = np.arange(first, min(repeats * width, first + step), dtype=np.int64)
        own = np.ascontiguousarray(shares.T[keys % width])
        given = np.empty_like(own)
        np.put_along_axis(given, places(np.arange(n) - first_row, size, keys, seed) + first_row, own, axis=1)
        found[keys] = root_mean(error + own - given)
    return found


def _errors_in_groups(staged: DataFrame, spec: CalibrationSpec, repeats: int, seed: int, groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Errors of devices that one task can hold: a group each where rows are clustered by device, else dealt into ``groups``."""
    spark = staged.sparkSession
    ship_package(spark)
    device, width = spec.device, len(spec.features)
    keys = np.append(np.arange(repeats * width, dtype=np.int64), PLAIN)

    def of_devices(part: pa.Table) -> pa.Table:
        names = pc.unique(part[device])
        nth = pc.index_in(part[device], names).to_numpy()
        order = np.lexsort((part["_rank"].to_numpy(), nth))
        shares = part["_shares"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        found = errors_of_devices(part["_error"].to_numpy()[order], shares[order], np.bincount(nth), repeats, seed)
        whose = names.take(np.repeat(np.arange(len(names)), len(keys)))
        return pa.table({device: whose, "_key": np.tile(keys, len(names)), "rmse": found.T.ravel()})

    kinds = T.StructType([staged.schema[device], T.StructField("_key", T.LongType()), T.StructField("rmse", T.DoubleType())])
    slim, by = staged.select(device, "_rank", "_error", "_shares"), device
    if groups:
        slim, by = slim.withColumn("_group", F.pmod(F.xxhash64(device), F.lit(groups))), "_group"
        slim = slim.repartition(min(groups, max(shuffle_partitions(spark), math.ceil(groups / GROUPS_OF_TASK))), by)
    found = keep_columnar(slim.groupBy(by).applyInArrow(of_devices, kinds))
    plain = found.filter(F.col("_key") == PLAIN).select(device, F.col("rmse").alias("plain"))
    return found.filter(F.col("_key") != PLAIN), plain


def _linear_errors(rows: DataFrame, table: CellTable, fitted: LinearFitted, cell: int, repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(device, _key, rmse)`` with one feature shuffled, and ``(device, plain)``.

    Only the shuffled feature's share of a prediction changes, so shares are exchanged instead of values.
    """
    spec, name = table.spec, fitted.name
    wide = wide_models(fitted.models, table, fitted.scheme, [cell], [name])
    joined = table.join_devices(rows, wide, weight=4)  # while the rows are clustered
    model = F.col(f"_{name}")[0]
    shares = contributions(model, spec)
    predicted = model["intercept"]
    for share in shares:
        predicted = predicted + share
    staged = with_ranks(joined.select(
        spec.device, spec.time, (q(spec.target) - predicted).alias("_error"), F.array(*shares).alias("_shares")
    ), table, seed)
    if not table.salted:
        return _errors_in_groups(staged, spec, repeats, seed)
    staged, most = keep_columnar(staged.drop(spec.time)), table.layout.hot_rows
    size = staged.agg(F.count("*").alias("n"), F.max("_size").alias("most")).first()
    groups = max(4 * shuffle_partitions(rows.sparkSession), math.ceil(size["n"] / GROUP_ROWS))
    shuffled, plain = _errors_in_groups(staged.filter(F.col("_size") <= most), spec, repeats, seed, groups)
    if (size["most"] or 0) <= most:
        return shuffled, plain
    large = staged.filter(F.col("_size") > most)
    own = F.col("_shares")[(F.col("_key") % len(spec.features)).cast("int")]
    met = _met(large, spec, repeats, seed, {"_kept": F.col("_error") + own}, own)
    error = F.col("_kept") - F.col("given")
    return (
        shuffled.unionByName(met.groupBy(spec.device, "_key").agg(F.sqrt(F.avg(error * error)).alias("rmse"))),
        plain.unionByName(large.groupBy(spec.device).agg(F.sqrt(F.avg(F.col("_error") * F.col("_error"))).alias("plain"))),
    )


def _general_errors(rows: DataFrame, table: CellTable, fitted: Fitted, cell: int, repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same for any model: it predicts every row once per feature and repeat."""
    spec, width = table.spec, len(table.spec.features)
    stays = [spec.time, spec.target, *spec.features]
    ranked = with_ranks(rows, table, seed).select(
        spec.device, "_rank", "_size", *[q(c) for c in stays], F.array(*[q(c).cast("double") for c in spec.features]).alias("_values")
    )
    # Predicting is most of the work here, so the rows of a device are dealt out.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    met = exchanged(ranked.repartition(parts, spec.device, "_rank"), spec, repeats, seed, stays, "_values")
    position = F.col("_key") % width
    swapped_in = met.withColumns({
        c: F.when(position == i, F.col("given").cast(ranked.schema[c].dataType)).otherwise(q(c)) for i, c in enumerate(spec.features)
    }).drop("given")
    swapped_in = swapped_in.repartition(parts, spec.device, "_key", "_place")
    shuffled = fitted.at(swapped_in, cell, "_prediction").groupBy(spec.device, "_key").agg(
        rmse(q(spec.target), F.col("_prediction")).alias("rmse")
    )
    plain = fitted.at(rows, cell, "_prediction").groupBy(spec.device).agg(
        rmse(q(spec.target), F.col("_prediction")).alias("plain")
    )
    return shuffled, plain


def permutation_importance(
    table: CellTable,
    fitted: Fitted,
    scheme: str = "final",
    repeats: int = 10,
    seed: int = 42,
    devices: DataFrame | None = None,
) -> DataFrame:
    """``(device, feature, position, rmse_increase_mean, rmse_increase_std)`` on the last block.

    ``devices`` (one row per device) limits the work to devices that chose this model.
    """
    spec, cell, width = table.spec, table.last, len(table.spec.features)
    rows = table.cells(scheme, cell, cell)
    if devices is not None:
        rows = table.join_devices(rows, devices.select(spec.device))
    errors = _linear_errors if isinstance(fitted, LinearFitted) else _general_errors
    shuffled, plain = errors(rows, table, fitted, cell, repeats, seed)
    names = F.array(*[F.lit(c) for c in spec.features])
    increase = F.col("rmse") - F.col("plain")
    return (
        shuffled.join(plain, spec.device).withColumn("position", (F.col("_key") % width).cast("int"))
        .groupBy(spec.device, "position")
        .agg(F.avg(increase).alias("rmse_increase_mean"), F.stddev_pop(increase).alias("rmse_increase_std"))
        .select(
            spec.device, names[F.col("position")].alias("feature"), "position",
            "rmse_increase_mean", "rmse_increase_std",
        )
    )


def ranked(importance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest increase first; features keep their order when equal."""
    return importance.orderBy(*by, F.desc("rmse_increase_mean"), "position")
