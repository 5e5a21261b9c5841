import datetime as dt
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from fleet_tables import HOT_SHUFFLED, SPEC, cell_table, fleet_frame
from pyspark.sql import functions as F

from driftline.operators.estimators import Custom, add_predictions, mean_baseline, ridge, single_sensor_linear
from driftline.operators.search import forward_cv
from driftline.operators.celltable import refolded
from driftline.operators.solve import nonnegative_line, nonnegative_lines
from driftline.operators.stacking import (
    STACK_BOOSTING, STACK_RIDGE_ALPHA, CustomFinal, ForwardStack, LinearBlend, out_of_fold, stock_stack,
)
from driftline.operators.timesplit import INFINITE
from driftline.spec import CalibrationSpec, LeakageError, Layout, RunConfig

ONE = CalibrationSpec(target="y", sensors=("sensor",), weather=(), single_sensor="sensor")


def day(hours=34) -> pd.DataFrame:
    """34 hours: the first 24 are the training block, in folds of 6 after a warm-up of 6."""
    i = np.arange(hours)
    return pd.DataFrame({"device_id": "d", "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(i, unit="h"),
                         "y": i * 1.0, "sensor": i * 1.0})


def table_of(spark, frame, **kw):
    return cell_table(spark, frame, spec=ONE, **kw)


def oof_of(spark, frame, estimator, **kw):
    table = table_of(spark, frame, **kw)
    fitted = estimator.fit_cells(table, "train", range(1, 4))
    return out_of_fold(table, "train", [fitted], ["p"]).orderBy("ts").toPandas()


def recording_mean(seen: list) -> Custom:
    def fit(past):
        facts = past.agg(F.count("*"), F.max("ts"), F.avg("y")).first()
        seen.append(facts[:2])
        return lambda rows, out: rows.withColumn(out, F.lit(facts[2]))

    return Custom("recorder", fit)


def test_only_the_past_is_seen(spark):
    seen = []
    oof = oof_of(spark, day(), recording_mean(seen))
    assert sorted(seen) == [(n, dt.datetime(2020, 1, 1, n - 1)) for n in (6, 12, 18)]
    assert oof.p.tolist() == [2.5] * 6 + [5.5] * 6 + [8.5] * 6
    assert oof.ts.min() == dt.datetime(2020, 1, 1, 6)


@pytest.mark.parametrize("layout", [Layout(), HOT_SHUFFLED])
def test_prefix_means_and_refit(spark, layout):
    assert oof_of(spark, day(), mean_baseline(), layout=layout).p.tolist() == [2.5] * 6 + [5.5] * 6 + [8.5] * 6
    table = table_of(spark, day(), layout=layout)
    stack = ForwardStack([mean_baseline()]).fit_cells(table, "train", [table.last])
    refit = stack.bases[0].at(table.cells("train", 4, 4), 4, "p")
    assert {r["p"] for r in refit.select("p").collect()} == {11.5}
    assert stack.folds.select("train_rows", "oof_rows", "warmup_rows").orderBy("train_rows").collect() == [
        (6, 6, 6), (12, 6, 6), (18, 6, 6)]


def test_poisoned_future_leaves_earlier_predictions(spark):
    poisoned = day()
    poisoned.loc[12:23, "sensor"], poisoned.loc[12:23, "y"] = 1e6, -1e6
    for estimator in (mean_baseline(), single_sensor_linear(), ridge(1.0)):
        clean, dirty = oof_of(spark, day(), estimator), oof_of(spark, poisoned, estimator)
        assert clean.p[:6].to_numpy() == pytest.approx(dirty.p[:6].to_numpy(), abs=1e-9)
        assert abs(clean.p[12:].to_numpy() - dirty.p[12:].to_numpy()).max() > 1


def test_feature_empty_in_the_warm_up(spark):
    frame = day()
    frame.loc[:5, "sensor"] = np.nan
    frame["other"] = 1.0
    spec = CalibrationSpec(target="y", sensors=("sensor", "other"), weather=(), single_sensor="sensor")
    table = cell_table(spark, frame, spec=spec)
    fitted = single_sensor_linear().fit_cells(table, "train", range(1, 4))
    oof = out_of_fold(table, "train", [fitted], ["p"]).orderBy("ts").toPandas()
    assert oof.p[:6].tolist() == pytest.approx([2.5] * 6)


def test_blend_is_the_least_squares_on_covered_rows(spark):
    frame = fleet_frame()
    table = cell_table(spark, frame)
    stack = ForwardStack([mean_baseline(), single_sensor_linear(), ridge(1.0)]).fit_cells(table, "train", [table.last])
    oof = stack.oof.toPandas()
    assert (oof.groupby("device_id").size() == 3 * (oof[oof.cell == 1].groupby("device_id").size())).all()
    for row in stack.weights.collect():
        z = oof[oof.device_id == row["device_id"]][["mean_baseline", "single_sensor_linear", "ridge", "y"]].to_numpy()
        intercept, weights = nonnegative_line(z.mean(axis=0), np.cov(z.T, ddof=0))
        assert row["weights"] == pytest.approx(weights, abs=1e-6) and row["intercept"] == pytest.approx(intercept, abs=1e-5)
    rows = table.cells("train", 4, 4)
    out = stack.at(rows, 4, "p")
    assert set(out.columns) == {*rows.columns, "p"} and out.filter("p IS NULL").count() == 0


class RecordingMeta:
    """A final estimator that keeps what it was given and averages the bases."""

    def __init__(self):
        self.rows, self.names = None, None

    def __call__(self, oof, names):
        self.rows, self.names = oof.orderBy("ts").toPandas(), list(names)
        return lambda rows, inputs, out: rows.withColumn(out, sum(F.col(c) for c in inputs) / len(inputs))


@pytest.mark.parametrize("layout", [Layout(), HOT_SHUFFLED])
def test_final_estimator_sees_the_out_of_fold_table_alone(spark, layout):
    meta, table = RecordingMeta(), table_of(spark, day(), layout=layout)
    stack = ForwardStack([mean_baseline()], final=CustomFinal(meta)).fit_cells(table, "train", [table.last])
    assert meta.names == ["mean_baseline"] and meta.rows.columns.tolist() == ["device_id", "ts", "cell", "y", "mean_baseline"]
    assert meta.rows.mean_baseline.tolist() == [2.5] * 6 + [5.5] * 6 + [8.5] * 6
    assert meta.rows.y.tolist() == list(range(6, 24)) and meta.rows.ts.min() == dt.datetime(2020, 1, 1, 6)
    assert stack.weights is None
    out = stack.at(table.cells("train", 4, 4), 4, "p")
    assert {r["p"] for r in out.collect()} == {11.5}


@pytest.mark.parametrize("layout", [Layout(), HOT_SHUFFLED])
def test_folds_of_the_stack_s_own(spark, layout):
    meta, table = RecordingMeta(), table_of(spark, day(), layout=layout)
    stack = ForwardStack([mean_baseline(), single_sensor_linear()], folds=2, final=CustomFinal(meta)).fit_cells(table, "train", [table.last])
    assert meta.rows.cell.tolist() == [1] * 8 + [2] * 8 and meta.rows.ts.min() == dt.datetime(2020, 1, 1, 8)
    assert meta.rows.mean_baseline.tolist() == [3.5] * 8 + [7.5] * 8
    assert stack.folds.select("train_rows", "oof_rows", "warmup_rows").orderBy("train_rows").collect() == [(8, 8, 8), (16, 8, 8)]
    out = add_predictions(table.cells("train", 4, 4), {"p": stack}, [4])
    assert sorted(r["p"] for r in out.collect()) == pytest.approx([(11.5 + i) / 2 for i in range(24, 29)])
    assert table.folds == 3 and {r["cell_train"] for r in table.rows.collect()} == {0, 1, 2, 3, 4, 5}


@pytest.mark.parametrize("layout", [Layout(), HOT_SHUFFLED])
def test_refolding_equals_cutting_anew(spark, layout):
    frame = fleet_frame(devices=3)
    again = refolded(cell_table(spark, frame, layout=layout), 5)
    anew = cell_table(spark, frame, config=RunConfig.quick(cv_splits=5), layout=layout)
    columns = ["device_id", "ts", "block", "cell_train", "cell_final"]
    assert sorted(map(tuple, again.rows.select(columns).collect())) == sorted(map(tuple, anew.rows.select(columns).collect()))
    assert sorted(map(tuple, again.cuts.table.collect())) == sorted(map(tuple, anew.cuts.table.collect()))
    if not again.salted:
        plan = again.rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    with pytest.raises(ValueError, match="too few"):
        refolded(cell_table(spark, frame, layout=layout), 400)


def test_plain_least_squares_as_final(spark):
    table = cell_table(spark, fleet_frame())
    bases = [mean_baseline(), single_sensor_linear(), ridge(1.0)]
    stack = ForwardStack(bases, final=LinearBlend(positive=False)).fit_cells(table, "train", [table.last])
    oof = stack.oof.toPandas()
    for row in stack.weights.collect():
        own = oof[oof.device_id == row["device_id"]]
        x = np.column_stack([np.ones(len(own)), own[["mean_baseline", "single_sensor_linear", "ridge"]]])
        want = np.linalg.lstsq(x, own.y, rcond=None)[0]
        assert [row["intercept"], *row["weights"]] == pytest.approx(want, abs=1e-4)


def every_support(mean, spread):
    """Least error over all supports whose weights are positive."""
    b = len(mean) - 1
    best, least = np.zeros(b), spread[-1, -1]
    for size in range(1, b + 1):
        for chosen in combinations(range(b), size):
            idx = list(chosen)
            w = np.linalg.lstsq(spread[np.ix_(idx, idx)], spread[idx, -1], rcond=None)[0]
            error = spread[-1, -1] - w @ spread[idx, -1]
            if (w >= 0).all() and error < least - 1e-12:
                best, least = np.zeros(b), error
                best[idx] = w
    return least


@pytest.mark.parametrize("b", [1, 2, 5, 12])
def test_blends_of_many_inputs_equal_all_supports(b):
    rng = np.random.default_rng(b)
    rows = [rng.normal(size=(40, b + 1)) @ rng.normal(size=(b + 1, b + 1)) + rng.normal(size=b + 1) for _ in range(4 if b == 12 else 40)]
    rows[0][:, 0] = 3.0  # an input that does not vary
    if b > 1:
        rows[1][:, 1] = rows[1][:, 0]  # two equal ones
    rows[2][:, -1] = 5.0  # a target that does not vary
    means, spreads = np.stack([z.mean(axis=0) for z in rows]), np.stack([np.cov(z.T, ddof=0) for z in rows])
    intercepts, weights = nonnegative_lines(means, spreads)
    assert (weights >= 0).all()
    for z, mean, spread, a, w in zip(rows, means, spreads, intercepts, weights):
        got = np.mean((z[:, -1] - a - z[:, :-1] @ w) ** 2)
        assert got == pytest.approx(every_support(mean, spread), rel=1e-8, abs=1e-9)
        alone = nonnegative_line(mean, spread)
        assert alone[0] == pytest.approx(a) and alone[1] == pytest.approx(w)


def test_names_folds_and_scheme_are_checked(spark):
    for bad in ([], [mean_baseline(), mean_baseline()], [Custom("", lambda rows: None)]):
        with pytest.raises(ValueError, match="names"):
            ForwardStack(bad)
    for folds in (1, True, 2.0):
        with pytest.raises(ValueError):
            RunConfig(cv_splits=folds)
    table = table_of(spark, day())
    with pytest.raises(ValueError, match="after its folds"):
        ForwardStack([mean_baseline()]).fit_cells(table, "train", [1, 2])


def test_leaking_feature_is_refused():
    with pytest.raises(LeakageError):
        CalibrationSpec(
            target="y", sensors=("sensor", "NO2(GT)"), weather=(), single_sensor="sensor", forbidden_suffixes=("(GT)",)
        )


def test_targets_and_base_predictions_must_be_finite(spark):
    frame = day()
    frame.loc[3, "y"] = np.inf
    assert [r["reason"] for r in table_of(spark, frame).cuts.rejected.collect()] == [INFINITE]
    table = table_of(spark, day())
    broken = Custom("broken", lambda past: lambda rows, out: rows.withColumn(out, F.lit(float("nan"))))
    with pytest.raises(ValueError, match="not finite"):
        ForwardStack([broken]).fit_cells(table, "train", [table.last])


def test_stock_stack_is_fixed():
    stack = stock_stack(RunConfig.quick())
    assert [e.name for e in stack.estimators] == ["ridge", "random_forest", "hist_gradient_boosting"]
    assert stack.estimators[0].alpha == STACK_RIDGE_ALPHA == 1.0
    assert stack.estimators[1].settings == {"n_estimators": 30}
    assert stack.estimators[2].settings == STACK_BOOSTING


def test_forward_cv_of_mixed_models(spark):
    frame = fleet_frame(devices=2)
    table = cell_table(spark, frame)
    pooled_mean = Custom("pooled", lambda past: (lambda m: lambda rows, out: rows.withColumn(out, F.lit(m)))(
        past.agg(F.avg("y")).first()[0]))
    cv = forward_cv(table, [mean_baseline(), pooled_mean], by_device=False).toPandas()
    assert len(cv) == 6 and (cv.unusable == 0).all()
    rows = add_predictions(
        table.cells("train", 1, 3), {"p": mean_baseline().fit_cells(table, "train", range(1, 4))}, range(1, 4)).toPandas()
    want = np.sqrt(((rows.y - rows.p) ** 2).groupby(rows.cell).mean())
    got = cv[cv.candidate == 0].sort_values("fold").rmse
    assert got.to_numpy() == pytest.approx(want.to_numpy())
