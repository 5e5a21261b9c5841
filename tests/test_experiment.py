import glob
import json

import pytest
from fleet_tables import SPEC, cell_table, fleet_frame, to_spark
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import driftline.operators.stacking as stacking
import driftline.plans.experiment as experiment
from driftline import GAS_EXPORT, RunConfig, run_calibration, run_export
from driftline.operators.estimators import ridge
from driftline.operators.search import BOOSTING_SPACE, draw_boosting, tune_boosting
from driftline.operators.select import scores_wide
from driftline.sinks.report import append_manifest, finite_columns, report, six_decimals, write_outputs
from driftline.sources.export import fingerprint
from driftline.spec import MODEL_ORDER
from driftline.streaming.scoring import score_readings, stream_scores

LINEAR = ("mean_baseline", "single_sensor_linear", "ridge")
SMALL = RunConfig.quick(forest_trees=5, search_iterations=1)


@pytest.fixture(scope="module")
def result(spark, export_path):
    """All six models on a synthetic export; boosting kept short."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setitem(BOOSTING_SPACE, "max_iter", ("whole", 4, 6))
        patch.setitem(stacking.STACK_BOOSTING, "max_iter", 5)
        return run_export(spark, export_path, GAS_EXPORT, SMALL)


def test_accounting_and_periods(result):
    counts = result.accounting.first().asDict()
    assert counts == {"device_id": "station", "rows_parsed": 400, "rows_missing_target": 23, "rows_without_sensor_data": 5,
                      "rows_used": 372}
    rows = {r["block"]: r["n_rows"] for r in result.periods.collect()}
    assert rows == {"train": 260, "validation": 56, "test": 56}


def test_all_models_are_scored_and_sensible(result):
    wide = {r["model"]: r for r in scores_wide(result.scores, ["device_id"]).orderBy("ord").collect()}
    assert tuple(wide) == MODEL_ORDER
    for model, r in wide.items():
        assert r["validation_rmse"] > 0 and r["test_r2"] is not None
    assert wide["ridge"]["test_rmse"] < wide["single_sensor_linear"]["test_rmse"] < wide["mean_baseline"]["test_rmse"]
    assert wide["random_forest"]["test_rmse"] < wide["mean_baseline"]["test_rmse"]
    assert wide["hist_gradient_boosting"]["test_rmse"] < wide["mean_baseline"]["test_rmse"]
    assert wide["stacking"]["test_rmse"] < wide["mean_baseline"]["test_rmse"]


def test_selection_and_search(result):
    validation = result.scores.filter("stage = 'validation'").orderBy("rmse").first()["model"]
    assert result.selection.models == (validation,)
    assert result.ridge_search.first()["candidates"] == 13 and result.boosting_search.candidates == 1
    assert result.stack_folds.count() == 6
    assert {r["feature"] for r in result.importance.collect()} == set(GAS_EXPORT.features)


def test_report_files(spark, result, export_path, tmp_path):
    source = fingerprint(spark, export_path)
    paths = write_outputs(result, str(tmp_path), source)
    text = open(glob.glob(paths["metrics_json"] + "/*.json")[0]).read()

    def refuse(token):
        raise AssertionError(token)

    parsed = json.loads(text, parse_constant=refuse)
    assert parsed["selected_model"] == result.selection.models[0]
    assert parsed["dataset"]["files"][0]["digest"] == source.first()["digest"]
    assert parsed["periods"]["train"]["first_ts"] == "2004-06-01T01:00:00"
    assert parsed["tuning"]["stacking"]["validation_fit"]["warmup_rows"] == 65
    assert parsed["tuning"]["stacking"]["validation_fit"]["meta_rows"] == 195
    assert [f["train_rows"] for f in parsed["tuning"]["stacking"]["test_fit"]["folds"]] == [79, 158, 237]
    assert set(parsed["scores"]) == set(MODEL_ORDER) and parsed["config"]["cv_splits"] == 3
    values = [v["rmse_increase_mean"] for v in parsed["permutation_importance"]["values"]]
    assert values == sorted(values, reverse=True) and len(values) == 10

    lines = open(glob.glob(paths["metrics_csv"] + "/*.csv")[0]).read().splitlines()
    assert lines[0] == "device_id,model,validation_rmse,validation_mae,validation_r2,test_rmse,test_mae,test_r2"
    assert [line.split(",")[1] for line in lines[1:]] == list(MODEL_ORDER)
    assert all(len(v.split(".")[1]) == 6 for v in lines[1].split(",")[2:])
    importance = open(glob.glob(paths["importance_csv"] + "/*.csv")[0]).read().splitlines()
    assert importance[0] == "device_id,feature,rmse_increase_mean,rmse_increase_std" and len(importance) == 11

    append_manifest(result, str(tmp_path / "runs"), "quick", source, paths)
    append_manifest(result, str(tmp_path / "runs"), "quick", source, paths)
    runs = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert len(runs) == 2 and runs[0]["inputs_digest"] == runs[1]["inputs_digest"] is not None
    assert spark.read.parquet(paths["inputs"]).first()["digest"] == source.first()["digest"]
    assert runs[0]["outputs"] == runs[1]["outputs"] and json.loads(runs[0]["config"])["seed"] == 42


def test_undefined_values_are_written_as_null(spark):
    rows = spark.createDataFrame([(1.0, float("nan"), [float("inf"), 2.0], (float("nan"), "x"))],
                                 "a double, r2 double, v array<double>, s struct<d double, e string>")
    clean = finite_columns(rows)
    text = clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    assert json.loads(text) == {"a": 1.0, "r2": None, "v": [None, 2.0], "s": {"d": None, "e": "x"}}
    assert tuple(six_decimals(rows.select("a", "r2")).first()) == ("1.000000", None)


def test_constant_target_is_null_in_the_report(spark):
    frame = fleet_frame(devices=1)
    frame["y"] = frame["y"].where(frame["y"].isna(), 4.0)
    run = run_calibration(to_spark(spark, frame), SPEC, SMALL, models=("mean_baseline",))
    found = report(run).first()["scores"]["mean_baseline"]["test"]
    assert found["r2"] is None and found["rmse"] == pytest.approx(0)


def test_choice_comes_before_any_test_score(spark, monkeypatch):
    calls = []
    watch = lambda name: (lambda real: lambda *a, **k: (calls.append((name, *[x for x in a if isinstance(x, str)])), real(*a, **k))[1])
    monkeypatch.setattr(experiment, "score_block", watch("score")(experiment.score_block))
    monkeypatch.setattr(experiment, "select_model", watch("select")(experiment.select_model))
    monkeypatch.setattr(experiment, "fit_all", watch("fit")(experiment.fit_all))
    run_calibration(to_spark(spark, fleet_frame(devices=2)), SPEC, SMALL, models=LINEAR)
    chosen = [c[0] for c in calls].index("select")
    assert all("final" not in c and "test" not in c for c in calls[:chosen])
    assert ("fit", "final") in calls[chosen:] and ("score", "final", "test") in calls[chosen:]
    with pytest.raises(TypeError):
        experiment.test_stage(None, {}, None)


def test_fleet_run_repeats_and_every_device_chooses(spark):
    rows = to_spark(spark, fleet_frame())
    runs = [run_calibration(r, SPEC, SMALL, models=LINEAR) for r in (rows, rows.repartition(7))]
    key = lambda r: sorted((x["device_id"], x["model"], x["stage"], round(x["rmse"], 9)) for x in r.scores.collect())
    assert key(runs[0]) == key(runs[1]) and len(key(runs[0])) == 18
    assert runs[0].selection.chosen.count() == 3 and runs[0].importance.count() == 15


def test_files_belong_to_their_devices(spark):
    run = run_calibration(to_spark(spark, fleet_frame(devices=2)), SPEC, SMALL, models=LINEAR)
    source = spark.createDataFrame([("file:/x/1.csv", "b"), ("file:/x/0.csv", "a")], "file string, digest string")
    found = {r["device_id"]: [f["digest"] for f in r["dataset"]["files"]] for r in report(run, source).collect()}
    assert found == {0: ["a"], 1: ["b"]}


def test_errors(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        run_export(spark, str(tmp_path / "none.csv"), GAS_EXPORT, SMALL)
    assert not list(tmp_path.iterdir())
    frame = fleet_frame(devices=1)
    with pytest.raises(ValueError, match="duplicated"):
        run_calibration(to_spark(spark, fleet_frame(devices=1)._append(frame.dropna().tail(1))), SPEC, SMALL, models=LINEAR)
    with pytest.raises(ValueError, match="no device"):
        run_calibration(to_spark(spark, frame.head(3)), SPEC, SMALL, models=LINEAR)
    with pytest.raises(ValueError, match="1 row.s. without a timestamp"):
        run_calibration(to_spark(spark, frame).withColumn(
            "ts", F.when(F.col("ts") != F.lit(frame.dropna().ts.iloc[5]), F.col("ts"))), SPEC, SMALL, models=LINEAR)
    with pytest.raises(ValueError, match="unknown"):
        run_calibration(to_spark(spark, frame), SPEC, SMALL, models=("lasso",))


def test_draws_are_seeded_and_inside_the_space():
    drawn = draw_boosting(200, 1)
    assert drawn == draw_boosting(200, 1) != draw_boosting(200, 2)
    for name, (kind, low, high) in BOOSTING_SPACE.items():
        values = [d[name] for d in drawn]
        assert low <= min(values) and max(values) <= high and len(set(values)) > 20
        assert kind == "log" or all(isinstance(v, int) for v in values)


def test_boosting_search_scores_every_fold(spark, monkeypatch):
    monkeypatch.setitem(BOOSTING_SPACE, "max_iter", ("whole", 2, 3))
    config = RunConfig.quick(search_iterations=2)
    found = tune_boosting(cell_table(spark, fleet_frame(devices=2), config), config)
    scores = found.scores.toPandas()
    assert len(scores) == 6 and found.cv_rmse == pytest.approx(scores.groupby("candidate").rmse.mean().min())


def test_streamed_readings(spark, tmp_path):
    frame = fleet_frame(devices=2)
    table = cell_table(spark, frame)
    fitted = ridge(1.0).fit_cells(table, "final", [table.last])
    rows = to_spark(spark, frame).drop("y")
    rows.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream_scores(arriving, fitted, table, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert streamed == sorted(map(tuple, score_readings(rows, fitted, table).collect()))
    assert len(streamed) == frame[["a", "b"]].notna().any(axis=1).sum()
