"""Writing a run's results: JSON report, CSV tables, Parquet tables, run manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.columns import finite_or_null, q
from driftline.operators.select import scores_wide
from driftline.operators.stacking import STACK_BOOSTING, STACK_RIDGE_ALPHA
from driftline.plans.experiment import RunResult

SELECTION_RULE = "the model with the least validation RMSE, chosen before any test row is scored"
IMPORTANCE_MEASURE = "RMSE with the feature taken from another row, less RMSE as is"
STACK_RULES = {
    "base_models": "settings are constants; no search result goes into them",
    "blend": "least squares over the bases' predictions, no weight below zero, with an intercept",
    "blend_rows": "rows of the folds, each predicted from earlier rows; the rows before the first fold are left out",
}


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column, inside structs, arrays and maps too."""
    return df.select(*[_clean(q(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _clean(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(value)
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_clean(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _clean(x, kind.valueType))
    return value


def _constant(spark: SparkSession, values: Mapping) -> Column:
    """A driver-side setting as a literal struct column."""
    return F.struct(*[
        (_constant(spark, v) if isinstance(v, Mapping) else F.lit(v)).alias(k) for k, v in values.items()
    ])


def report(result: RunResult, source: DataFrame | None = None) -> DataFrame:
    """One nested row per device. ``source``: optional ``(file, digest)`` of the input."""
    spec, config = result.spec, result.config
    spark = result.scores.sparkSession
    device = spec.device

    features = F.array(*[F.lit(c) for c in spec.features])
    counts = ["rows_parsed", "rows_missing_target", "rows_without_sensor_data", "rows_used"]
    accounting = result.accounting.withColumn("files", F.lit(None).cast("array<struct<file:string,digest:string>>"))
    if source is not None:
        accounting = accounting.drop("files").join(_device_files(result, source), device, "left")
    dataset = accounting.select(device, F.struct(
        "files", F.lit(spec.target).alias("target"), features.alias("features"), *counts
    ).alias("dataset"))

    block = F.struct("n_rows", "first_ts", "last_ts")
    periods = result.periods.groupBy(device).agg(F.struct(*[
        F.max(F.when(q("block") == name, block)).alias(name) for name in ("train", "validation", "test")
    ]).alias("periods"))

    measures = F.struct("rmse", "mae", "r2")
    stages = result.scores.groupBy(device, "model").agg(F.struct(*[
        F.max(F.when(q("stage") == stage, measures)).alias(stage) for stage in ("validation", "test")
    ]).alias("stages"))
    names = [r["model"] for r in result.scores.select("model").distinct().collect()]
    scores = stages.groupBy(device).agg(F.struct(*[
        F.max(F.when(q("model") == name, q("stages"))).alias(name) for name in sorted(names)
    ]).alias("scores"))

    entry = F.struct((-q("rmse_increase_mean")).alias("order"), "position", "feature", "rmse_increase_mean", "rmse_increase_std")
    values = result.importance.groupBy(device, "model").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    importance = values.select(device, F.struct(
        "model", F.lit("test").alias("block"), F.lit(IMPORTANCE_MEASURE).alias("measure"),
        F.transform("v", lambda e: F.struct(e["feature"], e["rmse_increase_mean"], e["rmse_increase_std"])).alias("values"),
    ).alias("permutation_importance"))

    out = dataset.join(periods, device).join(_tuning(result), device)
    out = out.withColumn("selection_rule", F.lit(SELECTION_RULE))
    out = out.join(result.selection.chosen.withColumnRenamed("model", "selected_model"), device)
    out = out.join(scores, device).join(importance, device)
    return finite_columns(out.withColumns({
        "config": _constant(spark, config.as_dict()), "environment": _constant(spark, result.environment),
    }))


def _device_files(result: RunResult, source: DataFrame) -> DataFrame:
    """``(device, files)``: a file belongs to the device of its name, or to the only device there is."""
    device = result.spec.device
    kind = result.accounting.schema[device].dataType
    if result.table is not None and result.table.cuts.devices == 1:
        only = result.accounting.select(device).first()[0]
        owner = F.lit(only).cast(kind)
    else:
        owner = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).try_cast(kind)
    files = F.array_sort(F.collect_list(F.struct("file", "digest")))
    return source.withColumn(device, owner).groupBy(device).agg(files.alias("files"))


def _tuning(result: RunResult) -> DataFrame:
    spec, config = result.spec, result.config
    spark, device = result.scores.sparkSession, spec.device
    base = result.selection.chosen.select(device)
    parts = [F.lit(f"{config.cv_splits} expanding-window folds of the training block").alias("cv")]
    if result.ridge_search is not None:
        ridge = F.struct("alpha", "cv_rmse", "candidates").alias("ridge")
        base = base.join(result.ridge_search.select(device, ridge), device)
        parts.append(q("ridge"))
    if result.boosting_search is not None:
        found = result.boosting_search
        parts.append(_constant(spark, {
            "params": found.params, "cv_rmse": found.cv_rmse, "candidates": found.candidates,
        }).alias("hist_gradient_boosting"))
    if result.stack_folds is not None:
        fold = F.struct("fold", "train_rows", "oof_rows", "train_start", "train_end", "oof_start", "oof_end")
        fits = result.stack_folds.groupBy(device, "scheme").agg(F.struct(
            F.max("warmup_rows").alias("warmup_rows"), F.sum("oof_rows").alias("meta_rows"),
            F.array_sort(F.collect_list(fold)).alias("folds"),
        ).alias("fit")).groupBy(device).agg(
            F.max(F.when(q("scheme") == "train", q("fit"))).alias("validation_fit"),
            F.max(F.when(q("scheme") == "final", q("fit"))).alias("test_fit"),
        )
        base = base.join(fits, device)
        settings = {
            **STACK_RULES, "ridge_alpha": STACK_RIDGE_ALPHA, "hist_gradient_boosting": STACK_BOOSTING,
        }
        parts.append(F.struct(
            *[(_constant(spark, v) if isinstance(v, Mapping) else F.lit(v)).alias(k) for k, v in settings.items()],
            "validation_fit", "test_fit",
        ).alias("stacking"))
    return base.select(device, F.struct(*parts).alias("tuning"))


def six_decimals(df: DataFrame) -> DataFrame:
    """Floating columns as text with six decimals; undefined values stay NULL (an empty cell)."""
    return df.select(*[
        F.when(finite_or_null(q(f.name)).isNotNull(), F.format_string("%.6f", q(f.name))).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else q(f.name)
        for f in df.schema.fields
    ])


def metrics_table(result: RunResult) -> DataFrame:
    """Wide scores per device and model, still with the model's position ``ord``."""
    return scores_wide(result.scores, [result.spec.device])


def _write_csv(df: DataFrame, path: str, order: list, drop: str, single: bool) -> None:
    # One file for one device; many devices are range-partitioned instead.
    ordered = (df.coalesce(1) if single else df.repartitionByRange(*order)).sortWithinPartitions(*order).drop(drop)
    six_decimals(ordered).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_outputs(result: RunResult, folder: str, source: DataFrame | None = None) -> dict[str, str]:
    """Write the report as JSON, scores and importance as CSV and Parquet; return the paths."""
    device, folder = result.spec.device, folder.rstrip("/")
    single = result.table is not None and result.table.cuts.devices == 1
    paths = {
        "metrics_json": f"{folder}/metrics.json", "metrics_csv": f"{folder}/metrics.csv",
        "importance_csv": f"{folder}/feature_importance.csv", "scores": f"{folder}/scores.parquet",
        "importance": f"{folder}/importance.parquet", "rejected": f"{folder}/rejected.parquet",
    }
    rows = report(result, source)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(paths["metrics_json"])
    _write_csv(metrics_table(result), paths["metrics_csv"], [device, "ord"], "ord", single)
    _write_csv(
        result.importance.drop("model"), paths["importance_csv"],
        [F.col(device), F.desc("rmse_increase_mean"), F.col("position")], "position", single,
    )
    result.scores.write.mode("overwrite").parquet(paths["scores"])
    result.importance.write.mode("overwrite").parquet(paths["importance"])
    result.rejected.write.mode("overwrite").parquet(paths["rejected"])
    if source is not None:
        paths["inputs"] = f"{folder}/inputs.parquet"
        source.write.mode("overwrite").parquet(paths["inputs"])
    return paths


def append_manifest(
    result: RunResult, runs_path: str, recipe: str, source: DataFrame | None = None, outputs: Mapping[str, str] | None = None
) -> None:
    """Append one row on this run: recipe, settings, environment, time, digests of inputs and outputs.

    Inputs are folded into one digest; their list is the ``inputs`` output.
    """
    spark = result.scores.sparkSession
    inputs = None if source is None else table_digest(source.select("file", "digest"))
    made = [(name, table_digest(spark.read.parquet(path))) for name, path in (outputs or {}).items() if path.endswith(".parquet")]
    row = spark.createDataFrame(
        [(recipe, json.dumps(result.config.as_dict()), json.dumps(result.environment), result.elapsed, inputs, made)],
        "recipe string, config string, environment string, elapsed_seconds double, inputs_digest string, "
        "outputs array<struct<name:string,digest:string>>",
    )
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(runs_path)


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows that does not depend on their order."""
    return str(df.agg(F.sum(F.xxhash64(*[q(c) for c in df.columns]).cast("decimal(38,0)")).alias("d")).first()["d"])
