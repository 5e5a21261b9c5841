"""The feature rows of a run, kept once in the layout all later passes use."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.timesplit import (
    CELL, TEST, Cuts, find_cuts, join_device_table, labelled_rows, refolded_cuts, relabelled_rows,
)
from driftline.session import keep_clustered, shuffle_partitions
from driftline.spec import CalibrationSpec, Layout, RunConfig

SCHEMES = ("train", "final")


@dataclass(eq=False)
class CellTable:
    """Rows with their block and cells, shuffled once by device.

    Devices above ``layout.hot_rows`` are spread over pieces (``_piece``);
    without such devices every per-device aggregate is local to its task.

    A *prefix* ``(scheme, f)`` is the rows in cells before ``f``; the model
    fitted on it may predict cell ``f``. ``f = 1..k`` are the folds,
    ``f = k + 1`` is the whole block, which predicts the next block.
    """

    rows: DataFrame
    spec: CalibrationSpec
    config: RunConfig
    cuts: Cuts
    layout: Layout

    def __post_init__(self) -> None:
        self._fits: dict = {}
        self._lock = Lock()

    def once(self, key: tuple, make: Callable):
        """Result of ``make()``, computed once per key even when several threads ask."""
        with self._lock:
            mine = key not in self._fits
            future = self._fits.setdefault(key, Future())
        if mine:
            try:
                future.set_result(make())
            except BaseException as error:
                future.set_exception(error)
        return future.result()

    @property
    def folds(self) -> int:
        return self.config.cv_splits

    @property
    def last(self) -> int:
        return self.folds + 1

    @property
    def salted(self) -> bool:
        return self.cuts.largest > self.layout.hot_rows

    @property
    def keys(self) -> list[str]:
        return [self.spec.device, "_piece"] if self.salted else [self.spec.device]

    @property
    def prefixes(self) -> list[tuple[str, int]]:
        return [(scheme, f) for scheme in SCHEMES for f in range(1, self.last + 1)]

    def prefix_number(self, scheme: str, f: int) -> int:
        return self.prefixes.index((scheme, f))

    @property
    def fit_rows(self) -> DataFrame:
        """Rows that any model may be fitted on: never the test block."""
        return self.rows.filter(F.col("block") != TEST)

    def in_prefix(self, scheme: str, f: int) -> Column:
        return F.col(CELL[scheme]) < f

    def cells(self, scheme: str, first: int, last: int) -> DataFrame:
        """Rows of cells ``first..last`` with the cell number as ``cell``."""
        return self.rows.filter(F.col(CELL[scheme]).between(first, last)).withColumn("cell", F.col(CELL[scheme]))

    def join_devices(self, rows: DataFrame, table: DataFrame, weight: int = 1) -> DataFrame:
        """Join a one-row-per-device table; ``weight`` says how many plain rows one of its rows is worth."""
        return join_device_table(rows, table, self.spec, self.cuts, self.layout, weight)

    @property
    def fills(self) -> DataFrame:
        """Medians of all prefixes and centres, a row per device, made on first use."""
        from driftline.operators.gram import build_fills

        return self.once(("fills",), lambda: build_fills(self))

    @property
    def gram(self):
        """Sums of products of all cells, made on first use."""
        from driftline.operators.gram import build_gram

        return self.once(("gram",), lambda: build_gram(self))

    def slices(self, values: int = 1) -> int:
        """Tasks for ``values`` numbers of every row, where groups are too large for one."""
        return self.layout.slices(self.cuts.rows * values, shuffle_partitions(self.rows.sparkSession))

    def hot_devices(self) -> DataFrame:
        return self.cuts.table.filter(F.col("n") > self.layout.hot_rows).select(self.spec.device)


def refolded(table: CellTable, folds: int) -> CellTable:
    """The same rows, where they are, with their blocks cut into another number of folds."""

    def make() -> CellTable:
        config = replace(table.config, cv_splits=folds)
        cuts = refolded_cuts(table.cuts, table.spec, folds)
        rows = relabelled_rows(table.rows, table.spec, config, cuts, table.layout, table.keys)
        return CellTable(rows, table.spec, config, cuts, table.layout)

    return table if folds == table.folds else table.once(("refolded", folds), make)


def bucket_count(df: DataFrame, rows: int, layout: Layout) -> int:
    least = shuffle_partitions(df.sparkSession)
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(1, min(most, max(least, layout.slices(rows, least))))


def build_cell_table(
    features: DataFrame, spec: CalibrationSpec, config: RunConfig, layout: Layout = Layout()
) -> CellTable:
    """Size the blocks and folds, label the rows and keep them clustered by device: one shuffle."""
    cuts = find_cuts(features, spec, config)
    buckets = bucket_count(features, cuts.rows, layout)
    rows, keys = labelled_rows(features, spec, config, cuts, layout, buckets)
    return CellTable(keep_clustered(rows, keys, buckets, [*keys, spec.time]), spec, config, cuts, layout)
