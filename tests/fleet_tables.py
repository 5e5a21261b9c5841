"""Exports, fleets and brute-force layouts that the tests share."""

from pathlib import Path

import numpy as np
import pandas as pd

from driftline.operators.celltable import build_cell_table
from driftline.operators.prepare import prepare
from driftline.spec import CalibrationSpec, Layout, RunConfig

SPEC = CalibrationSpec(target="y", sensors=("a", "b"), weather=("t",), single_sensor="a", forbidden=("y",))


# Column, level, change per unit of CO, change with the time of day, noise, decimals.
EXPORT_COLUMNS = (
    ("CO(GT)", 0, 1, 0, 0, 1), ("PT08.S1(CO)", 800, 200, 0, 20, 0), ("NMHC(GT)", -200, 0, 0, 0, 0),
    ("C6H6(GT)", 5, 3, 0, 0, 1), ("PT08.S2(NMHC)", 600, 150, 0, 25, 0), ("NOx(GT)", 150, 0, 0, 0, 0),
    ("PT08.S3(NOx)", 1200, -100, 0, 30, 0), ("NO2(GT)", 110, 0, 0, 0, 0), ("PT08.S4(NO2)", 1400, 50, 0, 30, 0),
    ("PT08.S5(O3)", 900, 180, 0, 40, 0), ("T", 20, 0, 5, 1, 1), ("RH", 50, 0, 0, 10, 1), ("AH", 1, 0, 0, 0.1, 4),
)


def export_table(hours: int, seed: int) -> pd.DataFrame:
    """Hourly measurements; in hours 50 to 54 the device is off, every 17th target is missing."""
    rng = np.random.default_rng(seed)
    table = pd.DataFrame({"stamp": pd.date_range("2004-06-01", periods=hours, freq="h")})
    hour = np.arange(hours)
    wave = np.sin(hour % 24 * (np.pi / 12))
    co = (2 + wave + rng.normal(scale=0.3, size=hours)).clip(min=0.1)
    for name, level, per_co, per_wave, noise, digits in EXPORT_COLUMNS:
        table[name] = np.round(level + per_co * co + per_wave * wave + rng.normal(scale=noise, size=hours), digits)
    off = table.index.isin(range(50, 55))
    table.loc[off, [name for name in table if not name.endswith(("stamp", "(GT)"))]] = -200
    table.loc[(table.index % 17 == 0) & ~off, "CO(GT)"] = -200
    return table


def synthetic_lines(hours: int = 400, seed: int = 7) -> list[str]:
    """The table as an export: day-first dates, decimal commas, two columns without name, separator-only lines."""
    table = export_table(hours, seed)
    stamp = table.pop("stamp").dt
    table.insert(0, "Date", stamp.strftime("%d/%m/%Y"))
    table.insert(1, "Time", stamp.strftime("%H.%M.%S"))
    lines = table.to_csv(sep=";", decimal=",", index=False).splitlines()
    return [f"{line};;" for line in lines] + [";" * 16] * 3


def write_lines(folder, lines, name="station.csv") -> str:
    path = Path(folder) / name
    path.write_bytes(("\r\n".join(lines) + "\r\n").encode("ascii"))
    return str(path)


def fleet_frame(devices: int = 3, hours: int = 150, seed: int = 1) -> pd.DataFrame:
    """Several devices with gaps, uneven lengths and a known linear answer plus noise."""
    rng = np.random.default_rng(seed)
    parts = []
    for d in range(devices):
        n = hours + 17 * d
        kept = np.sort(rng.choice(n + 20, size=n, replace=False))
        a, b, t = rng.normal(1000, 200, n), np.round(rng.normal(50, 9, n), 1), rng.normal(15, 5, n)
        y = 0.004 * a + 0.1 * b - 0.05 * t + rng.normal(0, 0.2, n) + d
        frame = pd.DataFrame({"device_id": d, "ts": pd.Timestamp("2020-03-01") + pd.to_timedelta(kept, unit="h"),
                              "y": y, "a": a, "b": b, "t": t})
        frame.loc[rng.random(n) < 0.1, "a"] = np.nan
        frame.loc[rng.random(n) < 0.2, "b"] = np.nan
        frame.loc[rng.random(n) < 0.1, "t"] = np.nan
        frame.loc[rng.random(n) < 0.05, "y"] = np.nan
        parts.append(frame)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame):
    rows = spark.createDataFrame(frame)
    return rows.withColumn("ts", rows["ts"].cast("timestamp_ntz"))


def cell_table(spark, frame, config=RunConfig.quick(), layout=Layout(), spec=SPEC, partitions=None):
    rows = to_spark(spark, frame)
    if partitions:
        rows = rows.repartition(partitions)
    return build_cell_table(prepare(rows, spec), spec, config, layout)


def brute_cells(frame: pd.DataFrame, config=RunConfig.quick(), spec=SPEC) -> pd.DataFrame:
    """Blocks and cells from sorted positions, the plain way."""
    k = config.cv_splits
    used = frame[frame[spec.target].notna() & frame[list(spec.sensors)].notna().any(axis=1)]
    out = []
    for _, group in used.sort_values("ts").groupby("device_id"):
        n = len(group)
        n_train, n_val = round(n * config.train_frac), round(n * config.val_frac)
        group = group.assign(block="test", cell_train=k + 2, cell_final=k + 1, rn=range(n))
        for cell, size, beyond in (("cell_train", n_train, k + 1), ("cell_final", n_train + n_val, None)):
            t = size // (k + 1)
            starts = [size - (k - i) * t for i in range(k)]
            inside = group.rn < size
            group.loc[inside, cell] = [sum(r >= s for s in starts) for r in group.rn[inside]]
        group.loc[(group.rn >= n_train) & (group.rn < n_train + n_val), "cell_train"] = k + 1
        group.loc[group.rn < n_train + n_val, "block"] = "validation"
        group.loc[group.rn < n_train, "block"] = "train"
        out.append(group)
    return pd.concat(out).drop(columns="rn")


HOT = Layout(hot_rows=40, broadcast_rows=100_000)
SHUFFLED = Layout(hot_rows=2_000_000, broadcast_rows=0)
HOT_SHUFFLED = Layout(hot_rows=40, broadcast_rows=0)
