"""Sensor-role views over the test tables.

Every value is a quotient of exact sums (in units of 0.0001), so any engine
gets the same doubles. The target is a fixed mix of the sensors plus unrelated columns as
noise. The reference analyser is in its daily check, and the device in
maintenance, at fixed points of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.spec import GAS_EXPORT, CalibrationSpec

VIEW_SPEC = CalibrationSpec(
    target="reference",
    sensors=("s1", "s2", "s3", "s4", "s5"),
    weather=("w1", "w2", "w3"),
    single_sensor="s1",
    forbidden=("reference",),
)

# Weights of the target mix, and what stands in for an absent sensor.
SENSOR_WEIGHTS = (0.05, 0.03, -0.02, 0.04, 0.01)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
RETURN_FLAGS = ("A", "N", "R")
LINE_STATUS = ("F", "O")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(value: Column, where: Column | None = None) -> Column:
    units = F.round(value * 10000).cast("long")
    chosen = units if where is None else F.when(where, units)
    return F.sum(chosen) / F.lit(10000.0) / F.count(chosen)


def mix(stand_in: float, noise: Column) -> Column:
    out = F.lit(2.0)
    for i, weight in enumerate(SENSOR_WEIGHTS, start=1):
        out = out + F.lit(weight) * F.coalesce(F.col(f"s{i}"), F.lit(stand_in))
    return out + noise


def _with_outages(means: DataFrame, stand_in: float, noise: Column, in_check: Column, in_maintenance: Column) -> DataFrame:
    target = F.when(~in_check, mix(stand_in, noise)).alias("reference")
    sensors = [F.when(~in_maintenance, F.col(s)).alias(s) for s in VIEW_SPEC.sensors]
    return means.select("device_id", "ts", target, *sensors, *VIEW_SPEC.weather)


def _events(spark: SparkSession, sf_dir: str, device: Column, stamp: Column) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    means = table(spark, sf_dir, "events").groupBy(device.alias("device_id"), stamp.alias("ts")).agg(
        *[exact_mean(F.col("value"), F.col("event_type") == kind).alias(f"s{i}") for i, kind in enumerate(EVENT_TYPES, 1)],
        exact_mean(k).alias("w1"), F.count("*").cast("double").alias("w2"), F.max("value").alias("w3"),
    )
    in_check = F.hour("ts") == F.dayofmonth("ts") - 1
    in_maintenance = F.hour("ts") == F.pmod(F.dayofmonth("ts") + 11, F.lit(24))
    return _with_outages(means, 50.0, F.lit(0.02) * F.col("w1") + F.lit(0.1) * F.sqrt("w3"), in_check, in_maintenance)


def _hour(ts: str) -> Column:
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device, one row per hour."""
    return _events(spark, sf_dir, F.lit("station"), _hour("ts"))


def five_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device, one row per five minutes."""
    steps = F.floor(F.minute("ts") / 5) * 5
    return _events(spark, sf_dir, F.lit("station"), _hour("ts") + F.make_dt_interval(mins=steps.cast("int")))


def fleet_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device per user, one row per hour with events."""
    return _events(spark, sf_dir, F.col("user_id"), _hour("ts"))


def fleet_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device per supplier, one row per shipping day."""
    quantity = F.col("l_quantity")
    means = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("device_id"), F.col("l_shipdate").alias("ts"))
        .agg(
            *[exact_mean(quantity, F.col("l_returnflag") == f).alias(f"s{i}") for i, f in enumerate(RETURN_FLAGS, 1)],
            *[exact_mean(quantity, F.col("l_linestatus") == f).alias(f"s{i}") for i, f in enumerate(LINE_STATUS, 4)],
            exact_mean(F.col("l_discount")).alias("w1"),
            exact_mean(F.col("l_tax")).alias("w2"),
            exact_mean(F.col("l_extendedprice")).alias("w3"),
        )
    )
    in_check = F.dayofmonth("ts") == F.month("ts")
    in_maintenance = F.dayofmonth("ts") == F.month("ts") + 13
    return _with_outages(means, 25.0, F.lit(0.00002) * F.col("w3"), in_check, in_maintenance)


# The export's own header: the named columns and the two empty ones its lines end with.
EXPORT_HEADER = (
    "Date", "Time", "CO(GT)", "PT08.S1(CO)", "NMHC(GT)", "C6H6(GT)", "PT08.S2(NMHC)", "NOx(GT)",
    "PT08.S3(NOx)", "NO2(GT)", "PT08.S4(NO2)", "PT08.S5(O3)", "T", "RH", "AH", "", "",
)
EXPORT_SPEC = GAS_EXPORT
SURPLUS_AH = "19,0"  # lines with this last value get a field too many where files are written


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one line of an export ``(device_id, line)``, defects included.

    The number in ``props`` decides the defect: 5 blank and 3 ``NA`` target,
    7 no time, 11 text in a sensor, 13 separators only, 17 an impossible date.
    Error events carry the missing marker.
    """
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    value = comma(F.col("value"))
    marker = F.lit("-200")
    sensor = F.when(F.col("event_type") == "error", marker).when(F.col("k") == 11, "abc").otherwise(value)
    fields = [
        F.when(F.col("k") == 17, "31/02/2024").otherwise(F.date_format("ts", "dd/MM/yyyy")),
        F.when(F.col("k") == 7, "").otherwise(F.date_format("ts", "HH.mm.ss")),
        F.when(F.col("k") == 5, "").when(F.col("k") == 3, "NA").otherwise(value),
        sensor,
        marker,
        value,
        F.when(F.col("event_type") == "view", marker).otherwise(value),
        F.col("k").cast("string"),
        F.when(F.col("event_type") == "click", "").otherwise(value),
        F.col("k").cast("string"),
        value,
        value,
        F.concat(F.lit("-"), value),
        F.lit("-200,0"),
        comma(F.col("k").cast("double")),
        F.lit(""),
        F.lit(""),
    ]
    line = F.when(F.col("k") == 13, ";" * 16).otherwise(F.concat_ws(";", *fields))
    return table(spark, sf_dir, "events").withColumn("k", k).select(F.col("user_id").alias("device_id"), line.alias("line"))
