"""Exact running totals inside groups, also for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import keep, keep_columnar


def running_totals(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Add ``<s>_upto`` (running total in ``order``) and ``<s>_all`` (group total) for each column.

    One window task per group; right when groups are known to be small enough.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({
        **{f"{s}_upto": F.sum(s).over(upto) for s in sums},
        **{f"{s}_all": F.sum(s).over(whole) for s in sums},
    })


def split_running_totals(
    df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], parts: int
) -> DataFrame:
    """The same for groups of any size.

    Rows are range-partitioned by group and order into ``parts`` slices of
    about equal size and kept. The slices' own totals are few (slices +
    groups); their running totals are added to those inside each slice.
    """
    sliced = keep_columnar(
        df.repartitionByRange(max(2, parts), *keys, order).withColumn("_slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(s) for s in sums])
    in_turn = Window.partitionBy(*keys).orderBy("_slice")
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = keep(per_slice.select(
        *keys, "_slice",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums],
    ))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumns({f"{s}_upto": F.sum(s).over(inside) for s in sums})
        .join(offsets, [*keys, "_slice"])
        .withColumns({f"{s}_upto": F.col(f"{s}_upto") + F.col(f"{s}_before") for s in sums})
        .drop("_slice", *[f"{s}_before" for s in sums])
    )
