"""Time-ordered blocks and expanding-window folds.

Rows are shuffled once, by device. A device that one task can hold is numbered
there. A larger one is never brought together: its blocks and folds start at
rows with known ranks, and only those ranks are looked up. Counts per day give
the day that holds a rank, counts per second inside that day give the second,
and only when that second has several rows are they numbered. Its rows then
get their block and fold by comparing timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.columns import epoch_day, epoch_second, iso, q
from driftline.session import keep
from driftline.spec import CalibrationSpec, Layout, RunConfig, check_folds

TRAIN, VALIDATION, TEST = "train", "validation", "test"
# Cell columns: ``cell_train`` numbers the folds of the training block,
# ``cell_final`` those of training + validation. 0 is the warm-up, k+1 the
# block that is scored with the full fit.
CELL = {"train": "cell_train", "final": "cell_final"}

TOO_FEW_FOR_BLOCKS = "too few rows for three blocks"
TOO_FEW_FOR_FOLDS = "too few training rows for the folds"
INFINITE = "infinite values"


def block_sizes(n: Column, config: RunConfig) -> tuple[Column, Column, Column]:
    """Sizes of the three blocks, rounded half to even."""
    n_train = F.rint(n * F.lit(config.train_frac)).cast("long")  # bround does the same by decimals, which is slow per row
    n_val = F.rint(n * F.lit(config.val_frac)).cast("long")
    return n_train, n_val, n - n_train - n_val


def split_sizes(n: int, train_frac: float, val_frac: float) -> tuple[int, int, int]:
    """The same sizes for one known row count; an error when a block would be empty."""
    config = RunConfig(train_frac=train_frac, val_frac=val_frac)
    n_train, n_val = round(n * config.train_frac), round(n * config.val_frac)
    if min(n_train, n_val, n - n_train - n_val) < 1:
        raise ValueError(f"{n} rows: {TOO_FEW_FOR_BLOCKS}")
    return n_train, n_val, n - n_train - n_val


def fold_size(n: Column, folds: int) -> Column:
    return F.floor(n / F.lit(check_folds(folds) + 1)).cast("long")


def fold_starts(n: Column, folds: int) -> list[Column]:
    """Rank of the first row of each predicted fold; the rows before the first are warm-up."""
    size = fold_size(n, folds)
    return [n - F.lit(folds - i) * size for i in range(folds)]


def day_counts(rows: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """Rows per device and day."""
    day = epoch_day(q(spec.time), rows.schema[spec.time].dataType)
    return rows.groupBy(spec.device, day.alias("day")).agg(F.count("*").alias("n_day"))


def rank_lookup(rows: DataFrame, spec: CalibrationSpec, days: DataFrame, wanted: list[Column]) -> DataFrame:
    """``(device, ts_at)``: the timestamps at given ranks (0-based, expressions over ``n``), exactly."""
    device, ts, kind = spec.device, q(spec.time), rows.schema[spec.time].dataType
    upto = Window.partitionBy(device).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Between the two windows the ranks are computed once a row: repeated in the filter, its code would be too long to be compiled.
    days = days.withColumn("n", F.sum("n_day").over(Window.partitionBy(device))).withColumn(
        "ranks", F.array(*[rank.cast("long") for rank in wanted])
    ).withColumn("upto", F.sum("n_day").over(upto))
    rank = [F.get("ranks", F.lit(i)) for i in range(len(wanted))]
    holds = reduce(or_, [(r >= F.col("upto") - F.col("n_day")) & (r < F.col("upto")) for r in rank])
    targets = F.transform("ranks", lambda r, i: F.struct(i.alias("slot"), r.alias("rank")))
    located = F.filter(targets, lambda t: (t["rank"] >= F.col("upto") - F.col("n_day")) & (t["rank"] < F.col("upto")))
    cut_days = keep(
        days.filter(holds)  # few days hold a rank
        .withColumn("hits", located)
        .select(device, "day", (F.col("upto") - F.col("n_day")).alias("before"), "hits")
    )

    # At most 86,400 seconds per device and day.
    seconds = (
        rows.select(device, ts.alias("ts"))
        .withColumn("day", epoch_day(F.col("ts"), kind))
        .join(cut_days.select(device, "day"), [device, "day"], "left_semi")
        .groupBy(device, "day", epoch_second(F.col("ts"), kind).alias("second"))
        .agg(F.count("*").alias("n_second"), F.min("ts").alias("ts_first"))
    )
    in_day = Window.partitionBy(device, "day").orderBy("second")
    start = F.col("before") + F.col("upto") - F.col("n_second")
    found = keep(
        seconds.withColumn("upto", F.sum("n_second").over(in_day))
        .join(cut_days.select(device, "day", "before", "hits"), [device, "day"])
        .withColumn("start", start)
        .withColumn("hit", F.explode(F.filter(
            "hits", lambda t: (t["rank"] >= F.col("start")) & (t["rank"] < F.col("start") + F.col("n_second"))
        )))
        .select(device, "second", "ts_first", F.col("hit.slot").alias("slot"),
                (F.col("hit.rank") - F.col("start")).alias("skip"))
    )
    exact = found.filter("skip = 0").select(device, "slot", F.col("ts_first").alias("ts"))
    within = found.filter("skip > 0")
    if not within.isEmpty():
        # Keys are unique to the microsecond, so one second holds at most a million rows.
        numbered = (
            rows.select(device, ts.alias("ts"))
            .withColumn("second", epoch_second(F.col("ts"), kind))
            .join(within.select(device, "second").distinct(), [device, "second"], "left_semi")
            .withColumn("skip", F.row_number().over(Window.partitionBy(device, "second").orderBy("ts")) - 1)
        )
        exact = exact.unionByName(
            numbered.join(within, [device, "second", "skip"]).select(device, "slot", "ts")
        )
    return exact.groupBy(device).agg(
        F.array(*[F.max(F.when(F.col("slot") == i, F.col("ts"))) for i in range(len(wanted))]).alias("ts_at")
    )


@dataclass(frozen=True)
class Cuts:
    """``table``: one row per device with the sizes of its blocks and folds. ``rejected``: (device, n, reason)."""

    table: DataFrame
    rejected: DataFrame
    devices: int
    rows: int
    largest: int


def find_cuts(rows: DataFrame, spec: CalibrationSpec, config: RunConfig) -> Cuts:
    """Sizes of every device's blocks and folds, and its first target; one light pass."""
    k = config.cv_splits
    n = F.col("n")
    n_train, n_val, n_test = block_sizes(n, config)
    fit_all = n_train + n_val
    reason = F.when(F.least(n_train, n_val, n_test) < 1, TOO_FEW_FOR_BLOCKS).when(
        fold_size(n_train, k) < 1, TOO_FEW_FOR_FOLDS
    ).when(F.col("infinite") > 0, INFINITE)
    measured = [F.coalesce(F.abs(q(c)), F.lit(0.0)) for c in (spec.target, *spec.continuous)]
    counted = rows.groupBy(spec.device).agg(
        F.count("*").alias("n"), F.min_by(q(spec.target), q(spec.time)).alias("first_target"),
        F.count_if(q(spec.time).isNull()).alias("no_time"),
        F.count_if(F.array_max(F.array(*measured)) == float("inf")).alias("infinite"),
    )
    found = keep(counted.select(
        spec.device, "n", "first_target", n_train.alias("n_train"), n_val.alias("n_val"), n_test.alias("n_test"),
        fold_size(n_train, k).alias("fold_rows_train"), fold_size(fit_all, k).alias("fold_rows_final"),
        "no_time", reason.alias("reason"),
    ))
    bad = found.agg(F.sum("no_time").alias("t"), F.sum(F.when(q(spec.device).isNull(), n)).alias("d")).first()
    if bad["t"] or bad["d"]:
        raise ValueError(f"{bad['t'] or 0} row(s) without a timestamp, {bad['d'] or 0} without a device")
    table = found.filter("reason IS NULL").drop("reason")
    size = table.agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.max("n").alias("m")).first()
    return Cuts(
        table=table.drop("no_time"), rejected=found.filter("reason IS NOT NULL").select(spec.device, "n", "reason"),
        devices=size["d"], rows=size["n"] or 0, largest=size["m"] or 0,
    )


def cut_times(rows: DataFrame, spec: CalibrationSpec, config: RunConfig) -> DataFrame:
    """``(device, validation_from, test_from, train_from, final_from)``: where blocks and folds begin in time."""
    k = config.cv_splits
    n_train, n_val, _ = block_sizes(F.col("n"), config)
    wanted = [n_train, n_train + n_val, *fold_starts(n_train, k), *fold_starts(n_train + n_val, k)]
    return keep(rank_lookup(rows, spec, day_counts(rows, spec), wanted).select(
        spec.device, F.element_at("ts_at", 1).alias("validation_from"), F.element_at("ts_at", 2).alias("test_from"),
        F.slice("ts_at", 3, k).alias("train_from"), F.slice("ts_at", 3 + k, k).alias("final_from"),
    ))


def salts(n: Column, layout: Layout) -> Column:
    """Number of pieces a device's rows are spread over."""
    return F.ceil(n / F.lit(layout.hot_rows)).cast("int")


def join_device_table(
    rows: DataFrame, table: DataFrame, spec: CalibrationSpec, cuts: Cuts, layout: Layout, weight: int = 1
) -> DataFrame:
    """Join a one-row-per-device table (keyed by the device column) to rows.

    A table of at most ``layout.broadcast_rows`` rows is broadcast (a row worth
    ``weight`` plain ones counts that often). A larger one is shuffled; rows that
    are clustered stay where they are, and large devices of others are spread
    over several tasks: those above ``hot_rows`` whose share of all rows is more
    than one in ``broadcast_rows``, so that their names can always be broadcast.
    """
    key = spec.device
    if cuts.devices * weight <= layout.broadcast_rows:
        return rows.join(F.broadcast(table), key)
    clustered = "_piece" in rows.columns
    most = layout.hot_rows if clustered else max(layout.hot_rows, cuts.rows // max(1, layout.broadcast_rows))
    if cuts.largest <= most:
        return rows.join(table.hint("merge"), key)
    piece = "_piece" if clustered else "_join_piece"
    hot = cuts.table.filter(F.col("n") > most).select(key, F.ceil(F.col("n") / F.lit(most)).cast("int").alias("_join_pieces"))
    if cuts.rows // most <= layout.broadcast_rows:
        hot = F.broadcast(hot)
    pieces = F.coalesce("_join_pieces", F.lit(1))
    copies = table.join(hot, key, "left").withColumn(piece, F.explode(F.sequence(F.lit(0), pieces - 1)))
    if not clustered:
        rows = rows.join(hot, key, "left").withColumn(
            piece, F.pmod(F.xxhash64(q(spec.time)), pieces).cast("int")
        ).drop("_join_pieces")
    joined = rows.join(copies.drop("_join_pieces").hint("merge"), [key, piece])
    return joined if clustered else joined.drop(piece)


def cells_by_time(rows: DataFrame, spec: CalibrationSpec, config: RunConfig) -> DataFrame:
    """Add ``block``, ``cell_train`` and ``cell_final`` from the joined columns of ``cut_times``."""
    k = config.cv_splits
    ts = q(spec.time)

    def passed(starts: str) -> Column:
        count = F.lit(0)
        for i in range(k):
            count = count + (ts >= F.col(starts)[i]).cast("int")
        return count

    in_test = ts >= F.col("test_from")
    in_validation = ts >= F.col("validation_from")
    return rows.withColumns({
        "block": F.when(in_test, TEST).when(in_validation, VALIDATION).otherwise(TRAIN),
        "cell_train": F.when(in_test, k + 2).when(in_validation, k + 1).otherwise(passed("train_from")),
        "cell_final": F.when(in_test, k + 1).otherwise(passed("final_from")),
    }).drop("validation_from", "test_from", "train_from", "final_from")


def cells_by_rank(rows: DataFrame, keys: Sequence[str], spec: CalibrationSpec, config: RunConfig) -> DataFrame:
    """The same from each row's number in its device; ``n`` is the device's row count."""
    k = config.cv_splits
    rank, n = F.col("_rank"), F.col("n")
    n_train, n_val, _ = block_sizes(n, config)
    fit_all = n_train + n_val

    def cell(size: Column) -> Column:
        first = fold_starts(size, k)[0]
        fold = F.floor((rank - first) / fold_size(size, k)) + 1
        return F.when(rank < first, 0).otherwise(fold).cast("int")

    in_test, in_validation = rank >= fit_all, rank >= n_train
    order = Window.partitionBy(*keys).orderBy(spec.time)
    return rows.withColumn("_rank", F.row_number().over(order) - 1).withColumns({
        "block": F.when(in_test, TEST).when(in_validation, VALIDATION).otherwise(TRAIN),
        "cell_train": F.when(in_test, k + 2).when(in_validation, k + 1).otherwise(cell(n_train)),
        "cell_final": F.when(in_test, k + 1).otherwise(cell(fit_all)),
    }).drop("_rank", "n")


def labelled_rows(
    rows: DataFrame, spec: CalibrationSpec, config: RunConfig, cuts: Cuts, layout: Layout, buckets: int
) -> tuple[DataFrame, list[str]]:
    """Rows with block and cells, hash-partitioned by the returned keys; rejected devices are left out.

    Devices above ``layout.hot_rows`` are spread over pieces, by a hash of the timestamp.
    """
    device = spec.device
    sized = join_device_table(rows, cuts.table.select(device, "n"), spec, cuts, layout)
    if cuts.largest <= layout.hot_rows:
        keys = [device]
        return cells_by_rank(sized.repartition(buckets, *keys), keys, spec, config), keys
    keys = [device, "_piece"]
    small = sized.filter(F.col("n") <= layout.hot_rows).withColumn("_piece", F.lit(0))
    large = sized.filter(F.col("n") > layout.hot_rows).withColumn(
        "_piece", F.pmod(F.xxhash64(q(spec.time)), salts(F.col("n"), layout)).cast("int")
    ).drop("n")
    starts = join_device_table(large, cut_times(large, spec, config), spec, cuts, layout)
    small = cells_by_rank(small.repartition(buckets, *keys), keys, spec, config)
    large = cells_by_time(starts, spec, config).repartition(buckets, *keys)
    return small.unionByName(large), keys


def relabelled_rows(
    rows: DataFrame, spec: CalibrationSpec, config: RunConfig, cuts: Cuts, layout: Layout, keys: Sequence[str]
) -> DataFrame:
    """Kept rows with the cells of another number of folds; they are already clustered by ``keys`` and stay where they are."""
    bare = rows.drop("block", *CELL.values())
    sized = join_device_table(bare, cuts.table.select(spec.device, "n"), spec, cuts, layout)
    if "_piece" not in keys:
        return cells_by_rank(sized, keys, spec, config)
    small = cells_by_rank(sized.filter(F.col("n") <= layout.hot_rows), keys, spec, config)
    large = sized.filter(F.col("n") > layout.hot_rows).drop("n")
    starts = join_device_table(large, cut_times(large, spec, config), spec, cuts, layout)
    return small.unionByName(cells_by_time(starts, spec, config))


def refolded_cuts(cuts: Cuts, spec: CalibrationSpec, folds: int) -> Cuts:
    """The same blocks with another number of folds; every device must have the rows for it."""
    table = cuts.table.withColumns({
        "fold_rows_train": fold_size(F.col("n_train"), folds), "fold_rows_final": fold_size(F.col("n_train") + F.col("n_val"), folds),
    })
    few = table.filter("fold_rows_train < 1").count()
    if few:
        raise ValueError(f"{few} device(s): {TOO_FEW_FOR_FOLDS}")
    return Cuts(table, cuts.rejected, cuts.devices, cuts.rows, cuts.largest)


def block_periods(rows: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """Rows, first and last timestamp of each block."""
    return rows.groupBy(q(spec.device), "block").agg(
        F.count("*").alias("n_rows"),
        iso(F.min(q(spec.time))).alias("first_ts"),
        iso(F.max(q(spec.time))).alias("last_ts"),
    )


def fold_audit(rows: DataFrame, spec: CalibrationSpec, folds: int, scheme: str = "train") -> DataFrame:
    """What each fold trained on and predicted; the running totals run over at most k+1 rows per device."""
    cell = CELL[scheme]
    per_cell = (
        rows.filter(F.col(cell) <= folds)
        .groupBy(q(spec.device), F.col(cell).alias("fold"))
        .agg(F.count("*").alias("n"), F.min(q(spec.time)).alias("lo"), F.max(q(spec.time)).alias("hi"))
    )
    earlier = Window.partitionBy(q(spec.device)).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(q(spec.device)).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_cell.withColumns({
            "train_rows": F.sum("n").over(earlier),
            "warmup_rows": F.first("n").over(first),
            "train_start": iso(F.min("lo").over(earlier)),
            "train_end": iso(F.max("hi").over(earlier)),
        })
        .filter("fold >= 1")
        .select(
            q(spec.device), "fold", "train_rows", F.col("n").alias("oof_rows"), "warmup_rows",
            "train_start", "train_end", iso(F.col("lo")).alias("oof_start"), iso(F.col("hi")).alias("oof_end"),
        )
    )


def train_and_validation(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("block").isin(TRAIN, VALIDATION))


def fold_sizes_of(n: int, folds: int) -> Sequence[tuple[int, int]]:
    """(training rows, predicted rows) of each fold for one known row count."""
    size = n // (check_folds(folds) + 1)
    if size < 1:
        raise ValueError(f"{n} rows: {TOO_FEW_FOR_FOLDS}")
    return [(n - (folds - i) * size, size) for i in range(folds)]
