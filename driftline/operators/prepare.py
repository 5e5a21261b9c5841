"""From measurements to features: which rows are used, and the row accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import null_for_nan, q
from driftline.spec import HOUR, WEEKDAY, CalibrationSpec


def any_sensor(spec: CalibrationSpec) -> Column:
    """True when at least one sensor reported; weather does not count."""
    return F.coalesce(*[q(c) for c in spec.sensors]).isNotNull()


def measurements(rows: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """The columns a run needs, checked, as doubles with NaN as NULL."""
    spec.check_measurements(rows.schema)
    return rows.select(q(spec.device), q(spec.time), *[null_for_nan(c) for c in (spec.target, *spec.continuous)])


def row_accounting(rows: DataFrame, spec: CalibrationSpec, by_device: bool = False) -> DataFrame:
    """Parsed = without target + (with target but) without sensors + used. One pass."""
    rows = measurements(rows, spec)
    has_target = q(spec.target).isNotNull()
    groups = [q(spec.device)] if by_device else []
    return rows.groupBy(*groups).agg(
        F.count("*").alias("rows_parsed"),
        F.count_if(~has_target).alias("rows_missing_target"),
        F.count_if(has_target & ~any_sensor(spec)).alias("rows_without_sensor_data"),
        F.count_if(has_target & any_sensor(spec)).alias("rows_used"),
    )


def calendar(rows: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """Hour 0-23 and weekday with Monday = 0."""
    ts = q(spec.time)
    return rows.withColumns({HOUR: F.hour(ts), WEEKDAY: F.weekday(ts)})


def prepare(rows: DataFrame, spec: CalibrationSpec) -> DataFrame:
    """Rows with a target and at least one sensor; gaps in the features stay NULL."""
    spec.check_features(spec.features)
    rows = measurements(rows, spec)
    kept = rows.filter(q(spec.target).isNotNull()).filter(any_sensor(spec))
    return calendar(kept, spec)
