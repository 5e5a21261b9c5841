import numpy as np
import pandas as pd
import pytest
from fleet_tables import HOT, HOT_SHUFFLED, SHUFFLED, SPEC, brute_cells, cell_table, fleet_frame

from driftline.operators.linear import LINEAR_MODELS, RIDGE_ALPHAS, add_linear, fit_linear, fit_plain, ridge_cv, tune_ridge
from driftline.operators.estimators import predict_later, ridge
from driftline.operators.prepare import prepare
from driftline.operators.solve import RidgePath, nonnegative_line, single_lines, squared_errors
from driftline.operators.timesplit import cut_times
from driftline.spec import Layout, RunConfig

LAYOUTS = pytest.mark.parametrize(
    "layout", [Layout(), HOT, SHUFFLED, HOT_SHUFFLED], ids=["plain", "hot", "shuffled", "hot_shuffled"])


def design(past: pd.DataFrame, rows: pd.DataFrame):
    """Imputed, scaled and one-hot columns of ``rows`` with the statistics of ``past``."""
    columns = []
    for c in SPEC.continuous:
        fill = past[c].median() if past[c].notna().any() else 0.0
        x = past[c].fillna(fill)
        columns.append((rows[c].fillna(fill) - x.mean()) / (x.std(ddof=0) or 1.0))
    columns += [(rows.ts.dt.hour == h) * 1.0 for h in range(24)] + [(rows.ts.dt.dayofweek == d) * 1.0 for d in range(7)]
    return np.column_stack(columns)


def plain_ridge(past, rows, alpha):
    x, y = design(past, past), past.y.to_numpy()
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return y.mean() + (design(past, rows) - x.mean(axis=0)) @ w


def predictions(table, alpha, scheme="train", cell=None):
    cell = cell or table.last
    models = fit_linear(table.gram, scheme, [cell], alpha=alpha)
    rows = add_linear(table.cells(scheme, cell, cell), table, models, scheme, [cell], {m: m for m in LINEAR_MODELS})
    return rows.toPandas().sort_values(["device_id", "ts"])


@LAYOUTS
def test_models_equal_the_closed_form(spark, layout):
    frame = fleet_frame()
    table, cells = cell_table(spark, frame, layout=layout), brute_cells(frame)
    for scheme, alpha in (("train", 0.7), ("final", 100.0)):
        got = predictions(table, alpha, scheme)
        for device, mine in cells.groupby("device_id"):
            past = mine[mine[f"cell_{scheme}"] < table.last]
            rows = mine[mine[f"cell_{scheme}"] == table.last]
            found = got[got.device_id == device]
            assert found["ridge"].to_numpy() == pytest.approx(plain_ridge(past, rows, alpha), abs=1e-8)
            assert found["mean_baseline"].to_numpy() == pytest.approx(past.y.mean())
            fill = past.a.median()
            slope, intercept = np.polyfit(past.a.fillna(fill), past.y, 1)
            assert found["single_sensor_linear"].to_numpy() == pytest.approx(intercept + slope * rows.a.fillna(fill))


@LAYOUTS
def test_plain_models_equal_the_solver(spark, layout):
    frame = fleet_frame()
    frame.loc[(frame.device_id == 1) & (frame.a.notna()), "a"] = 7.0  # a sensor that never varies
    table = cell_table(spark, frame, layout=layout)
    cells = {scheme: range(1, table.last + 1) for scheme in ("train", "final")}
    names = list(LINEAR_MODELS[:2])
    key = lambda r: (r["device_id"], r["scheme"], r["cell"], r["model"])
    got = {key(r): r for r in fit_plain(table, cells, names).collect()}
    want = [r for scheme, f in cells.items() for r in fit_linear(table.gram, scheme, f, names).collect()]
    assert len(got) == len(want) == 3 * 2 * 4 * 2
    for r in want:
        mine = got[key(r)]
        assert mine["fit_rows"] == r["fit_rows"] and mine["intercept"] == pytest.approx(r["intercept"])
        for part in ("slopes", "fills", "hour_weights", "weekday_weights"):
            assert mine[part] == pytest.approx(r[part])
    assert {r["slopes"][0] for k, r in got.items() if k[0] == 1} == {0.0}


def test_search_equals_the_plain_loop(spark):
    frame = fleet_frame(devices=2)
    table, cells = cell_table(spark, frame), brute_cells(frame)
    got = ridge_cv(table.gram).toPandas()
    best = {r["device_id"]: r for r in tune_ridge(table.gram).collect()}
    for device, mine in cells.groupby("device_id"):
        means = []
        for alpha in RIDGE_ALPHAS:
            errors = []
            for f in (1, 2, 3):
                past, rows = mine[mine.cell_train < f], mine[mine.cell_train == f]
                errors.append(np.sqrt(((rows.y - plain_ridge(past, rows, alpha)) ** 2).mean()))
            found = got[(got.device_id == device) & np.isclose(got.alpha, alpha)].sort_values("fold")
            assert found.rmse.to_numpy() == pytest.approx(errors)
            means.append(np.mean(errors))
        assert best[device]["alpha"] == RIDGE_ALPHAS[int(np.argmin(means))]
        assert best[device]["cv_rmse"] == pytest.approx(min(means)) and best[device]["candidates"] == 13
    assert RIDGE_ALPHAS == pytest.approx(np.logspace(-3, 3, 13))


def test_later_rows_do_not_change_earlier_models(spark):
    frame = fleet_frame()
    table = cell_table(spark, frame)
    starts = {r["device_id"]: r["train_from"][1] for r in cut_times(table.rows, SPEC, table.config).collect()}
    poisoned = frame.copy()
    late = poisoned.ts >= poisoned.device_id.map(starts)
    poisoned.loc[late & poisoned.y.notna(), "y"] = -1e6
    for c in SPEC.continuous:
        poisoned.loc[late & poisoned[c].notna(), c] = 1e6
    first = predictions(table, 1.0, cell=1)
    second = predictions(cell_table(spark, poisoned), 1.0, cell=1)
    for m in LINEAR_MODELS:
        assert first[m].to_numpy() == pytest.approx(second[m].to_numpy(), abs=1e-9)


def test_selector_ignores_other_columns(spark):
    frame = fleet_frame(devices=1)
    changed = frame.assign(b=frame.b * 3 + 1, t=0.0)
    both = [predictions(cell_table(spark, f), 1.0)["single_sensor_linear"].to_numpy() for f in (frame, changed)]
    assert both[0] == pytest.approx(both[1])


def test_sensor_absent_in_training_gives_the_mean(spark):
    frame = fleet_frame(devices=1)
    cut = cut_times(cell_table(spark, frame).rows, SPEC, RunConfig.quick()).first()["validation_from"]
    frame.loc[frame.ts < cut, "a"] = np.nan
    frame["b"] = frame["b"].fillna(50.0)
    table = cell_table(spark, frame)
    got = predictions(table, 1.0)
    assert got["single_sensor_linear"].to_numpy() == pytest.approx(got["mean_baseline"].to_numpy())
    assert got["a"].notna().any()


def test_constant_features_and_large_offsets(spark):
    frame = fleet_frame(devices=1)
    frame["t"] = 3.25e9
    frame["a"] = frame["a"] + 1e8
    table, cells = cell_table(spark, frame), brute_cells(frame)
    past, rows = cells[cells.cell_train < 4], cells[cells.cell_train == 4]
    got = predictions(table, 1.0)
    assert got["ridge"].to_numpy() == pytest.approx(plain_ridge(past, rows, 1.0), abs=1e-6)


def test_later_readings(spark):
    frame = fleet_frame(devices=2)
    table = cell_table(spark, frame)
    fitted = ridge(1.0).fit_cells(table, "final", [table.last])
    readings = table.rows.filter("block = 'test'").select("device_id", "ts", *SPEC.features)
    later = predict_later(fitted, readings, table).toPandas().sort_values(["device_id", "ts"])
    assert later.prediction.to_numpy() == pytest.approx(predictions(table, 1.0, "final")["ridge"].to_numpy())
    with pytest.raises(ValueError, match="order"):
        predict_later(fitted, readings.select("device_id", "ts", *reversed(SPEC.features)), table)
    with pytest.raises(ValueError, match="features"):
        predict_later(fitted, readings.drop("b"), table)


def test_nonnegative_line():
    rng = np.random.default_rng(4)
    for weights in ((1.0, 0.5, 0.2), (1.0, -0.5, 0.2), (-1.0, -1.0, -1.0)):
        x = rng.normal(size=(60, 3)) + rng.normal(size=(60, 1))
        y = x @ weights + 2 + 0.1 * rng.normal(size=60)
        z = np.column_stack([x, y])
        intercept, w = nonnegative_line(z.mean(axis=0), np.cov(z.T, ddof=0))
        centred, target = x - x.mean(axis=0), y - y.mean()
        guess, step = np.zeros(3), 1 / np.linalg.norm(centred.T @ centred, 2)
        for _ in range(20_000):  # projected gradient
            guess = np.maximum(0, guess - step * centred.T @ (centred @ guess - target))
        assert w == pytest.approx(guess, abs=1e-8) and (w >= 0).all()
        assert intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w)


def test_designs_of_many_devices_are_solved_at_once():
    rng = np.random.default_rng(3)
    designs, tables = [], []
    for _ in range(5):
        day = rng.integers(0, 24, 60)
        x = np.column_stack([rng.normal(size=(60, 2)) * [1, 50], np.eye(24)[day], np.eye(7)[day % 7]])
        rows = np.column_stack([np.ones(60), x, x[:, 0] + rng.normal(size=60)])
        tables.append(rows)
        designs.append(rows.T @ rows)
    designs, alphas = np.stack(designs), np.array([0.1, 1.0, 10.0, 100.0, 1000.0])
    intercepts, weights = RidgePath(designs, 2).weights(alphas)
    errors = squared_errors(designs, intercepts, weights)
    lines = single_lines(designs, 1)
    for i, rows in enumerate(tables):
        x, y = rows[:, 1:-1], rows[:, -1]
        scale = np.append(x[:, :2].std(axis=0), np.ones(31))
        z, centred = (x - x.mean(axis=0)) / scale, y - y.mean()
        want = np.linalg.solve(z.T @ z + alphas[i] * np.eye(33), z.T @ centred) / scale
        assert weights[i] == pytest.approx(want, rel=1e-7, abs=1e-9)
        assert errors[i] == pytest.approx(((y - intercepts[i] - x @ weights[i]) ** 2).sum(), rel=1e-7)
        assert [lines[1][i], lines[0][i]] == pytest.approx(np.polyfit(x[:, 1], y, 1), rel=1e-7)
