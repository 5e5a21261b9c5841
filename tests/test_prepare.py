import datetime as dt

import pytest
from fleet_tables import SPEC
from pyspark.sql import functions as F

from driftline.operators.prepare import prepare, row_accounting
from driftline.spec import GAS_EXPORT, CalibrationSpec, LeakageError, RunConfig

S = "`CO(GT)` double, `PT08.S1(CO)` double, `PT08.S2(NMHC)` double, `PT08.S3(NOx)` double, `PT08.S4(NO2)` double, " \
    "`PT08.S5(O3)` double, T double, RH double, AH double"
N = None
ROWS = [
    ("x", dt.datetime(2004, 5, 3, 7), 1.2, 1000., 800., 1100., 1500., 900., 15., 40., .7),
    ("x", dt.datetime(2004, 5, 3, 8), N, 1010., 810., 1090., 1510., 910., 16., 41., .7),
    ("x", dt.datetime(2004, 5, 3, 9), 2.0, N, N, N, N, N, N, N, N),
    ("x", dt.datetime(2004, 5, 4, 10), 2.4, 1100., N, 1000., 1600., 980., 18., 38., .8),
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, f"device_id string, ts timestamp_ntz, {S}")


def test_features(rows):
    got = prepare(rows, GAS_EXPORT).orderBy("ts").collect()
    assert [(r["hour"], r["day_of_week"]) for r in got] == [(7, 0), (10, 1)]
    assert got[1]["PT08.S2(NMHC)"] is None
    assert tuple(got[0].__fields__[3:]) == GAS_EXPORT.features


def test_accounting(rows):
    assert row_accounting(rows, GAS_EXPORT).first().asDict() == {
        "rows_parsed": 4, "rows_missing_target": 1, "rows_without_sensor_data": 1, "rows_used": 2}
    both = rows.filter("T IS NULL").withColumn("CO(GT)", F.lit(None).cast("double"))
    counts = row_accounting(both, GAS_EXPORT).first().asDict()
    assert counts["rows_missing_target"] == 1 and counts["rows_without_sensor_data"] == 0


def test_weather_is_not_a_sensor(rows):
    only_weather = rows.filter("T = 15")
    for c in GAS_EXPORT.sensors:
        only_weather = only_weather.withColumn(c, F.lit(None).cast("double"))
    assert prepare(only_weather, GAS_EXPORT).count() == 0


def test_nan_is_missing(rows):
    with_nan = rows.withColumn("CO(GT)", F.when(F.hour("ts") == 7, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    assert row_accounting(with_nan, GAS_EXPORT).first()["rows_missing_target"] == 1


def test_schema_checks(rows):
    with pytest.raises(ValueError, match="RH"):
        prepare(rows.drop("RH"), GAS_EXPORT)
    with pytest.raises(TypeError, match="timestamp"):
        prepare(rows.withColumn("ts", F.col("ts").cast("string")), GAS_EXPORT)


@pytest.mark.parametrize("name", ["CO(GT)", "NO2(GT)", " benzene(gt) ", "y"])
def test_reference_columns_cannot_be_features(name):
    with pytest.raises(LeakageError):
        CalibrationSpec(target="y", sensors=("a", name), weather=(), single_sensor="a",
                        forbidden=GAS_EXPORT.forbidden, forbidden_suffixes=GAS_EXPORT.forbidden_suffixes)
    assert issubclass(LeakageError, ValueError)
    SPEC.check_features(["a", "PT08.S1(CO)"])


@pytest.mark.parametrize("bad", [
    {"train_frac": 0.0}, {"train_frac": 1.0}, {"val_frac": 0.0}, {"train_frac": 0.8, "val_frac": 0.2},
    {"cv_splits": 1}, {"cv_splits": True}, {"search_iterations": 0}, {"forest_trees": 0}, {"importance_repeats": 0},
])
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        RunConfig(**bad)


def test_defaults_and_quick_preset():
    assert RunConfig().as_dict() | {"search_parallelism": 0} == {
        "train_frac": 0.7, "val_frac": 0.15, "cv_splits": 5, "search_iterations": 20, "forest_trees": 300,
        "importance_repeats": 10, "seed": 42, "search_parallelism": 0}
    quick = RunConfig.quick()
    assert (quick.cv_splits, quick.search_iterations, quick.forest_trees, quick.importance_repeats) == (3, 2, 30, 3)
