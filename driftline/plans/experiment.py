"""The whole calibration run: prepare, split, tune, validate, choose, test, explain."""

from __future__ import annotations

import platform
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.functions.metrics import check_scores, score
from driftline.operators.celltable import CellTable, build_cell_table
from driftline.operators.estimators import (
    Estimator, Fitted, Linear, add_predictions, fit_linear_models, mean_baseline, ridge, single_sensor_linear,
)
from driftline.operators.importance import permutation_importance
from driftline.operators.linear import RIDGE_ALPHAS, tune_ridge
from driftline.operators.prepare import prepare, row_accounting
from driftline.operators.search import BoostingSearch, long_predictions, tune_boosting
from driftline.operators.select import Selection, select_model
from driftline.operators.stacking import StackFitted, stock_stack
from driftline.operators.timesplit import block_periods
from driftline.operators.trees import boosting, random_forest
from driftline.session import keep, kept_so_far, release
from driftline.sources.export import check_fingerprint, check_unique, fingerprint, load_export
from driftline.spec import MODEL_ORDER, CalibrationSpec, Layout, RunConfig


@dataclass
class RunResult:
    """Small tables, all keyed by device, and the settings they came from."""

    spec: CalibrationSpec
    config: RunConfig
    accounting: DataFrame
    periods: DataFrame
    rejected: DataFrame
    ridge_search: DataFrame | None
    boosting_search: BoostingSearch | None
    scores: DataFrame
    selection: Selection
    importance: DataFrame
    stack_folds: DataFrame | None
    stack_weights: DataFrame | None
    environment: dict
    elapsed: float = 0.0
    fitted: dict[str, Fitted] = field(default_factory=dict, repr=False)
    table: CellTable | None = field(default=None, repr=False)


def build_estimators(
    config: RunConfig, ridge_alpha: float | DataFrame = 1.0, boosting_params: Mapping | None = None,
    models: Sequence[str] = MODEL_ORDER,
) -> dict[str, Estimator]:
    """Unfitted models by name, in the fixed order."""
    make = {
        "mean_baseline": mean_baseline,
        "single_sensor_linear": single_sensor_linear,
        "ridge": lambda: ridge(ridge_alpha),
        "random_forest": lambda: random_forest(config.forest_trees, config.seed),
        "hist_gradient_boosting": lambda: boosting(config.seed, **(boosting_params or {})),
        "stacking": lambda: stock_stack(config),
    }
    unknown = [m for m in models if m not in make]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    return {name: make[name]() for name in MODEL_ORDER if name in models}


def fit_all(table: CellTable, estimators: Mapping[str, Estimator], scheme: str) -> dict[str, Fitted]:
    """Full fits of all models on one block; the Spark jobs of different models overlap."""
    cells = [table.last]
    linear = [e for e in estimators.values() if isinstance(e, Linear)]
    others = [e for e in estimators.values() if not isinstance(e, Linear)]
    with ThreadPoolExecutor(1 + len(others)) as pool:
        jobs = {e.name: pool.submit(e.fit_cells, table, scheme, cells) for e in others}
        fitted = fit_linear_models(table, scheme, cells, linear) if linear else {}
        fitted |= {name: job.result() for name, job in jobs.items()}
    return {name: fitted[name] for name in estimators}


def score_block(table: CellTable, fitted: Mapping[str, Fitted], scheme: str, stage: str) -> DataFrame:
    """``(device, model, stage, rmse, mae, r2, ...)``; all models are scored in one job."""
    device, cell = table.spec.device, table.last
    columns = {name: f"_p{i}" for i, name in enumerate(fitted)}
    rows = add_predictions(
        table.cells(scheme, cell, cell), {columns[name]: f for name, f in fitted.items()}, [cell]
    )
    scores = keep(
        score(long_predictions(rows, table, columns, "model", [device]), [device, "model"])
        .withColumn("stage", F.lit(stage))
    )
    check_scores(scores)
    return scores


def validation_stage(table: CellTable, estimators: Mapping[str, Estimator]) -> tuple[dict[str, Fitted], DataFrame]:
    """Fit on the training block, score the validation block."""
    fitted = fit_all(table, estimators, "train")
    return fitted, score_block(table, fitted, "train", "validation")


def test_stage(
    table: CellTable, estimators: Mapping[str, Estimator], selection: Selection
) -> tuple[dict[str, Fitted], DataFrame]:
    """Refit on training + validation, score the test block once. Needs the choice to have been made."""
    if not isinstance(selection, Selection):
        raise TypeError("the test stage needs a Selection")
    fitted = fit_all(table, estimators, "final")
    return fitted, score_block(table, fitted, "final", "test")


def importance_stage(table: CellTable, fitted: Mapping[str, Fitted], selection: Selection) -> DataFrame:
    """Importance of each device's own selected model on its test block."""
    config, out = table.config, None
    for name in selection.models:
        devices = selection.chosen.filter(q("model") == name)
        one = permutation_importance(
            table, fitted[name], "final", config.importance_repeats, config.seed,
            devices if len(selection.models) > 1 else None,
        ).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return keep(out)


def environment(spark: SparkSession) -> dict:
    return {
        "python": platform.python_version(), "platform": platform.platform(), "spark": spark.version,
        "numpy": np.__version__, "pandas": pd.__version__, "master": spark.sparkContext.master,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "time_zone": spark.conf.get("spark.sql.session.timeZone"),
    }


def run_calibration(
    rows: DataFrame,
    spec: CalibrationSpec,
    config: RunConfig = RunConfig(),
    layout: Layout = Layout(),
    models: Sequence[str] = MODEL_ORDER,
) -> RunResult:
    """Calibrate every device in a table of measurements."""
    started = time.perf_counter()
    spec.check_measurements(rows.schema)
    accounting = keep(row_accounting(rows, spec, by_device=True))
    table = build_cell_table(prepare(rows, spec), spec, config, layout)
    check_unique(table.rows, [*table.keys, spec.time])
    if not table.cuts.devices:
        reasons = table.cuts.rejected.select("reason").distinct().collect()
        raise ValueError(f"no device can be calibrated: {[r['reason'] for r in reasons] or 'no usable rows'}")
    periods = keep(block_periods(table.rows, spec))

    table.fills
    searches = {}
    if "ridge" in models:
        searches["ridge"] = lambda: keep(tune_ridge(table.gram, RIDGE_ALPHAS))
    if "hist_gradient_boosting" in models:
        searches["boosting"] = lambda: tune_boosting(table, config)
    waits = ("mean_baseline", "single_sensor_linear", "ridge", "hist_gradient_boosting")
    fixed = build_estimators(config, models=[m for m in models if m not in waits])
    with ThreadPoolExecutor(len(searches) + 1) as pool:
        # The forest and the stack do not wait for the searches; linear models are fitted together.
        early = pool.submit(fit_all, table, fixed, "train")
        found = {name: pool.submit(search) for name, search in searches.items()}
        found = {name: future.result() for name, future in found.items()}
        fitted = early.result()
    ridge_search, boosting_search = found.get("ridge"), found.get("boosting")

    estimators = build_estimators(
        config, ridge_search if ridge_search is not None else 1.0,
        boosting_search.params if boosting_search else None, models,
    )
    tuned = {name: e for name, e in estimators.items() if name not in fixed}
    fitted |= fit_all(table, tuned, "train")
    fitted = {name: fitted[name] for name in estimators}
    validation = score_block(table, fitted, "train", "validation")
    selection = select_model(validation, [spec.device], list(estimators))
    folds, weights = _stack_tables(fitted, "train")

    final, test = test_stage(table, estimators, selection)
    final_folds, final_weights = _stack_tables(final, "final")
    importance = importance_stage(table, final, selection)
    return RunResult(
        spec=spec, config=config, accounting=accounting, periods=periods, rejected=table.cuts.rejected,
        ridge_search=ridge_search, boosting_search=boosting_search,
        scores=validation.unionByName(test), selection=selection, importance=importance,
        stack_folds=None if folds is None else keep(folds.unionByName(final_folds)),
        stack_weights=None if weights is None else weights.unionByName(final_weights),
        environment=environment(rows.sparkSession), elapsed=time.perf_counter() - started,
        fitted=final, table=table,
    )


def _stack_tables(fitted: Mapping[str, Fitted], scheme: str) -> tuple[DataFrame | None, DataFrame | None]:
    stack = fitted.get("stacking")
    if not isinstance(stack, StackFitted):
        return None, None
    return (
        stack.folds.withColumn("scheme", F.lit(scheme)),
        None if stack.weights is None else stack.weights.withColumn("scheme", F.lit(scheme)),
    )


def run_recipe(
    spark: SparkSession, paths: str | Sequence[str], expected: DataFrame, folder: str, runs_path: str, spec: CalibrationSpec,
    config: RunConfig = RunConfig(), recipe: str = "recipe", layout: Layout = Layout(), device: str | None = None,
) -> dict[str, str]:
    """The pinned recipe: check the files' digests, run, write the outputs, append to the manifest; returns the paths.

    A changed, absent or unexpected file raises before anything is written to
    ``folder``. Intermediate tables are dropped at the end, also after an error.
    """
    from driftline.sinks.report import append_manifest, write_outputs

    source = fingerprint(spark, paths)
    check_fingerprint(source, expected)
    before = kept_so_far(spark)
    try:
        result = run_export(spark, paths, spec, config, layout, device)
        written = write_outputs(result, folder, source)
        append_manifest(result, runs_path, recipe, source, written)
        return written
    finally:
        release(spark, before)


def run_export(
    spark: SparkSession, paths: str | Sequence[str], spec: CalibrationSpec, config: RunConfig = RunConfig(),
    layout: Layout = Layout(), device: str | None = None,
) -> RunResult:
    """The same, from export files. A missing file raises before anything is written."""
    return run_calibration(load_export(spark, paths, device), spec, config, layout)
