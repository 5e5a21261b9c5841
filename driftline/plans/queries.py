"""Registered queries: every operator over the given tables, in full."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import metrics
from driftline.functions.columns import iso, q, rounded
from driftline.operators.celltable import CellTable, build_cell_table
from driftline.operators.estimators import LinearFitted, PerCellFitted, mean_baseline, predict_later, ridge, single_sensor_linear
from driftline.operators.importance import permutation_importance
from driftline.operators.linear import fit_linear, fit_plain, ridge_cv, tune_ridge
from driftline.operators.prepare import any_sensor, calendar, prepare, row_accounting
from driftline.operators.preprocess import device_fills, impute, one_hot, prefix_medians, scale_statistics, standard_scale
from driftline.operators.search import forward_cv, tune_boosting
from driftline.operators.select import lowest_rmse, scores_wide
from driftline.operators.stacking import CustomFinal, ForwardStack, out_of_fold, stock_stack
from driftline.operators.timesplit import block_periods, find_cuts, fold_audit
from driftline.operators.trees import boosting, random_forest
from driftline.plans.experiment import build_estimators, fit_all, run_calibration, score_block
from driftline.session import keep, keep_columnar, shared_folder
from driftline.sinks.report import append_manifest, finite_columns, report, six_decimals, write_outputs
from driftline.sources import export, views
from driftline.spec import GAS_EXPORT, Layout, RunConfig
from driftline.streaming.scoring import score_readings, stream_scores

SPEC = views.VIEW_SPEC
CONFIG = RunConfig.quick()
KEYS = ["device_id"]
LINEAR_TWO = ("mean_baseline", "single_sensor_linear")
RIDGE_TWO = ("s1", "w3")
RIDGE_TWO_ALPHA = 10.0
# What the daily profile of the importance queries rises by in an hour.
DAILY_STEP = 0.05
STUMPS = {"max_iter": 3, "max_leaf_nodes": 2, "learning_rate": 0.5, "min_samples_leaf": 20, "l2_regularization": 5.0}
# Folds that only long records can be cut into, to show the rejection of the others.
MANY_FOLDS = RunConfig(cv_splits=45)
# Devices above 100 rows are split, to show that splitting changes no result.
SMALL_PIECES = Layout(hot_rows=100)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def long(value: Column | str) -> Column:
    return (q(value) if isinstance(value, str) else value).cast("long")


def fleet(
    spark: SparkSession, sf_dir: str, view=views.fleet_supplier, config: RunConfig = CONFIG, layout: Layout = Layout()
) -> CellTable:
    """The view written once, prepared, cut and clustered."""
    rows = keep_columnar(view(spark, sf_dir))
    return build_cell_table(prepare(rows, SPEC), SPEC, config, layout)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/out-{uuid.uuid4().hex}"


# --- sources and ingest ---------------------------------------------------


def parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = keep_columnar(views.raw_text(spark, sf_dir))
    parsed = keep_columnar(export.parse_rows(export.split_lines(lines, views.EXPORT_HEADER)))
    return export.drop_empty_unnamed(parsed)


@query
def ingest_parse(spark, sf_dir):
    """Typed, accepted rows of an export."""
    rows = parsed_text(spark, sf_dir).filter("problem IS NULL")
    names = ["co", "s1", "nmhc", "c6h6", "s2", "nox", "s3", "no2", "s4", "s5", "t", "rh", "ah"]
    values = [c for c in rows.columns if c not in ("device_id", "ts", "problem")]
    return rows.select("device_id", iso(q("ts")).alias("ts"), *[q(c).alias(n) for c, n in zip(values, names)])


@query
def ingest_files(spark, sf_dir):
    """The export written as files with a header each, some lines with a field too many, and read back: rows by outcome."""
    lines = views.raw_text(spark, sf_dir)
    fields = export.split_lines(lines, views.EXPORT_HEADER).drop("device_id", export.SURPLUS_FIELDS)
    named = fields.select(*[q(c) for c in fields.columns if not export.UNNAMED.fullmatch(c)])
    last = named.columns[-1]
    doubled = F.when(q(last) == views.SURPLUS_AH, F.concat(q(last), F.lit(";8"))).otherwise(q(last))
    folder = new_folder(spark)
    named.withColumn(last, doubled).write.options(header="true", sep=";", quote="", emptyValue="").csv(folder)
    rows = export.parse_rows(export.read_text(spark, folder, "station"))
    return rows.groupBy(F.coalesce("problem", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n_rows"))


@query
def ingest_reject_counts(spark, sf_dir):
    return export.reject_counts(parsed_text(spark, sf_dir))


@query
def export_accounting(spark, sf_dir):
    """Row accounting of the parsed export, by device."""
    rows = parsed_text(spark, sf_dir).filter("problem IS NULL")
    return row_accounting(rows, GAS_EXPORT, by_device=True)


@query
def duplicate_keys(spark, sf_dir):
    return export.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query
def file_fingerprint(spark, sf_dir):
    """SHA-256 of the input tables' files."""
    found = export.fingerprint(spark, f"{sf_dir}/*.parquet")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "kind", "digest")


@query
def line_fingerprint(spark, sf_dir):
    """SHA-256 per line of the export text: lines and least and greatest digest by device."""
    digest = F.sha2("line", 256)
    return views.raw_text(spark, sf_dir).groupBy("device_id").agg(
        F.count("*").alias("lines"), F.min(digest).alias("least"), F.max(digest).alias("greatest")
    )


# --- preparation -----------------------------------------------------------


@query
def row_accounting_fleet(spark, sf_dir):
    return row_accounting(views.fleet_user(spark, sf_dir), SPEC, by_device=True)


@query
def dataset_counts(spark, sf_dir):
    return row_accounting(views.fleet_supplier(spark, sf_dir), SPEC)


@query
def prepared_features(spark, sf_dir):
    """Usable rows with calendar features; gaps stay NULL."""
    rows = prepare(views.fleet_supplier(spark, sf_dir), SPEC)
    return rows.select("device_id", iso(q("ts")).alias("ts"), "reference", *SPEC.continuous, long("hour").alias("hour"),
                       long("day_of_week").alias("day_of_week"))


@query
def calendar_features(spark, sf_dir):
    rows = calendar(views.hourly(spark, sf_dir), SPEC)
    return rows.select(iso(q("ts")).alias("ts"), long("hour").alias("hour"), long("day_of_week").alias("day_of_week"))


# --- time-ordered blocks and folds ------------------------------------------


@query
def chrono_split(spark, sf_dir):
    return fleet(spark, sf_dir).rows.select("device_id", iso(q("ts")).alias("ts"), "block")


@query
def block_sizes(spark, sf_dir):
    cuts = find_cuts(prepare(views.fleet_user(spark, sf_dir), SPEC), SPEC, CONFIG)
    return cuts.table.select("device_id", "n", "n_train", "n_val", "n_test", "fold_rows_train", "fold_rows_final")


@query
def block_periods_fleet(spark, sf_dir):
    return block_periods(fleet(spark, sf_dir, views.fleet_user).rows, SPEC)


@query
def fold_assignment(spark, sf_dir):
    return _cells(fleet(spark, sf_dir))


@query
def fold_assignment_split(spark, sf_dir):
    """The same with every device split over pieces."""
    return _cells(fleet(spark, sf_dir, layout=SMALL_PIECES))


def _cells(table: CellTable) -> DataFrame:
    return table.rows.select(
        "device_id", iso(q("ts")).alias("ts"), long("cell_train").alias("cell_train"),
        long("cell_final").alias("cell_final"),
    )


def _audit(spark, sf_dir, scheme: str) -> DataFrame:
    table = fleet(spark, sf_dir, views.fleet_user)
    audit = fold_audit(table.rows, SPEC, CONFIG.cv_splits, scheme)
    return audit.withColumn("fold", long("fold"))


@query
def fold_audit_train(spark, sf_dir):
    return _audit(spark, sf_dir, "train")


@query
def fold_audit_final(spark, sf_dir):
    return _audit(spark, sf_dir, "final")


@query
def rejected_devices(spark, sf_dir):
    """Devices whose record is too short, with the reason; the others go on."""
    cuts = find_cuts(prepare(views.fleet_user(spark, sf_dir), SPEC), SPEC, MANY_FOLDS)
    return cuts.rejected


# --- fitted preprocessing -----------------------------------------------------


@query
def fold_medians(spark, sf_dir):
    """Exact medians of every feature, fold and scheme; NULL where a fold's past has no value."""
    table = fleet(spark, sf_dir)
    names = F.array(*[F.lit(c) for c in SPEC.continuous])
    schemes = F.array(*[F.lit(scheme) for scheme, _ in table.prefixes])
    cells = F.array(*[F.lit(f) for _, f in table.prefixes])
    return prefix_medians(table).select(
        "device_id", names[F.col("feature")].alias("feature"), F.posexplode("medians").alias("i", "median")
    ).select("device_id", "feature", schemes[F.col("i")].alias("scheme"), long(cells[F.col("i")]).alias("cell"), "median")


@query
def median_impute(spark, sf_dir):
    """All rows, gaps filled with the training block's medians."""
    table = fleet(spark, sf_dir)
    filled = impute(table.rows, table, device_fills(table), "train", table.last)
    return filled.select("device_id", iso(q("ts")).alias("ts"), *SPEC.continuous)


@query
def standard_scaled(spark, sf_dir):
    """All rows, imputed and scaled with the training block's statistics."""
    table = fleet(spark, sf_dir)
    fills = device_fills(table)
    filled = impute(table.rows, table, fills, "train", table.last)
    stats = scale_statistics(filled.filter(table.in_prefix("train", table.last)), table)
    scaled = standard_scale(filled, table, stats)
    return scaled.select("device_id", iso(q("ts")).alias("ts"), *[rounded(q(c)).alias(c) for c in SPEC.continuous])


@query
def one_hot_calendar(spark, sf_dir):
    rows = one_hot(prepare(views.fleet_user(spark, sf_dir), SPEC))
    flags = [c for c in rows.columns if c.startswith(("hour_", "weekday_"))]
    return rows.select("device_id", iso(q("ts")).alias("ts"), *[long(c).alias(c) for c in flags])


@query
def tree_features(spark, sf_dir):
    """Input of the tree models: ten imputed numbers, hour and weekday not one-hot."""
    table = fleet(spark, sf_dir, views.fleet_user)
    filled = impute(table.rows, table, device_fills(table), "final", table.last)
    return filled.select("device_id", iso(q("ts")).alias("ts"), *SPEC.continuous,
                         q("hour").cast("double").alias("hour"), q("day_of_week").cast("double").alias("day_of_week"))


# --- linear models -------------------------------------------------------------


@query
def mean_models(spark, sf_dir):
    """Mean of the training block's target, per device."""
    table = fleet(spark, sf_dir)
    models = fit_plain(table, {"train": [table.last]}, ["mean_baseline"])
    return models.select("device_id", "fit_rows", rounded(q("intercept")).alias("mean"))


@query
def fleet_ols(spark, sf_dir):
    """One-sensor line per device, scheme and fold."""
    table = fleet(spark, sf_dir)
    cells = range(1, table.last + 1)
    models = fit_plain(table, {"train": cells, "final": cells}, ["single_sensor_linear"])
    return models.select(
        "device_id", "scheme", long("cell").alias("cell"), "fit_rows",
        rounded(q("intercept")).alias("intercept"), rounded(q("slopes")[0]).alias("slope"),
    )


@query
def single_sensor_ols(spark, sf_dir):
    """The minimum slice: one device, hourly, line on one sensor, scored on each later block."""
    table = fleet(spark, sf_dir, views.hourly)
    out = None
    for scheme, stage in (("train", "validation"), ("final", "test")):
        fitted = fit_all(table, {"single_sensor_linear": single_sensor_linear()}, scheme)
        scores = score_block(table, fitted, scheme, stage)
        out = scores if out is None else out.unionByName(scores)
    return out.select("stage", "n_rows", *[rounded(q(m)).alias(m) for m in ("rmse", "mae", "r2")])


@query
def ridge_two_feature(spark, sf_dir):
    """Ridge on two features, per device: weights on the original scale."""
    table = fleet(spark, sf_dir)
    models = fit_linear(table.gram, "train", [table.last], ["ridge"], RIDGE_TWO_ALPHA, RIDGE_TWO)
    at = [SPEC.continuous.index(c) for c in RIDGE_TWO]
    return models.select(
        "device_id", rounded(q("intercept")).alias("intercept"),
        *[rounded(q("slopes")[i], 9).alias(f"slope_{c}") for i, c in zip(at, RIDGE_TWO)],
    )


@query
def ridge_search_two_feature(spark, sf_dir):
    """The 13 penalties by forward-chaining folds, ridge on two features."""
    table = fleet(spark, sf_dir)
    cv = ridge_cv(table.gram, features=RIDGE_TWO)
    return cv.groupBy("device_id", "candidate").agg(F.avg("rmse").alias("m")).select(
        "device_id", long("candidate").alias("candidate"), rounded(q("m")).alias("cv_rmse")
    )


@query
def ridge_full(spark, sf_dir):
    """Ridge on all features, per device: scores on the validation block."""
    table = fleet(spark, sf_dir)
    fitted = fit_all(table, {"ridge": ridge(1.0)}, "train")
    return score_block(table, fitted, "train", "validation").select("device_id", "model", "rmse", "mae", "r2")


@query
def ridge_search(spark, sf_dir):
    table = fleet(spark, sf_dir)
    return tune_ridge(table.gram)


@query
def later_readings(spark, sf_dir):
    """Readings without a target, predicted with the line fitted on training + validation."""
    rows = keep_columnar(views.fleet_supplier(spark, sf_dir))
    table = build_cell_table(prepare(rows, SPEC), SPEC, CONFIG)
    fitted = single_sensor_linear().fit_cells(table, "final", [table.last])
    later = rows.filter(q("reference").isNull() & any_sensor(SPEC))
    features = calendar(later.select("device_id", "ts", *SPEC.continuous), SPEC)
    return predict_later(fitted, features, table).select(
        "device_id", iso(q("ts")).alias("ts"), rounded(q("prediction")).alias("prediction")
    )


@query
def unmatched_readings(spark, sf_dir):
    """Readings of all devices, also of those whose record is too short for a model: none is lost."""
    features = keep_columnar(prepare(views.fleet_user(spark, sf_dir), SPEC))
    table = build_cell_table(features, SPEC, MANY_FOLDS)
    fitted = mean_baseline().fit_cells(table, "final", [table.last])
    later = predict_later(fitted, features.select("device_id", "ts", *SPEC.features), table)
    return later.groupBy("device_id", "reason").agg(F.count("*").alias("n_rows"), F.count("prediction").alias("n_predicted"))


# --- evaluation, stacking, selection ----------------------------------------------


@query
def forward_cv_ols(spark, sf_dir):
    """Mean and one-sensor line, each fold predicted from its past."""
    table = fleet(spark, sf_dir)
    cv = forward_cv(table, [mean_baseline(), single_sensor_linear()])
    return cv.select("device_id", long("candidate").alias("candidate"), long("fold").alias("fold"), "n_rows",
                     rounded(q("rmse")).alias("rmse"))


@query
def oof_prefix_mean(spark, sf_dir):
    """Out-of-fold predictions of the mean: each row gets the mean of its fold's past."""
    table = fleet(spark, sf_dir)
    base = mean_baseline().fit_cells(table, "train", range(1, table.last + 1))
    oof = out_of_fold(table, "train", [base], ["prediction"])
    return oof.select("device_id", iso(q("ts")).alias("ts"), long("cell").alias("fold"),
                      rounded(q("prediction")).alias("prediction"))


@query
def stack_two_linear(spark, sf_dir):
    """Non-negative blend of mean and one-sensor line, learned from past-only predictions."""
    return _two_linear_weights(fleet(spark, sf_dir))


def _two_linear_weights(table: CellTable, **settings) -> DataFrame:
    stack = ForwardStack([mean_baseline(), single_sensor_linear()], **settings).fit_cells(table, "train", [table.last])
    return stack.weights.select(
        "device_id", rounded(q("intercept"), 5).alias("intercept"),
        rounded(q("weights")[0], 5).alias("weight_mean"), rounded(q("weights")[1], 5).alias("weight_line"),
    )


@query
def stack_two_folds(spark, sf_dir):
    """The same stack with two folds of its own, where the run has three."""
    return _two_linear_weights(fleet(spark, sf_dir), folds=2)


@query
def stack_two_folds_split(spark, sf_dir):
    """The same with every device spread over several pieces."""
    return _two_linear_weights(fleet(spark, sf_dir, layout=SMALL_PIECES), folds=2)


@query
def stack_own_final(spark, sf_dir):
    """A final estimator of one's own in place of the blend: the median error of the line, per device, added to it; validation scores."""

    def median_error(oof, names):
        shifts = keep(oof.groupBy("device_id").agg(F.median(q("y") - q(names[1])).alias("_shift")))
        return lambda rows, inputs, out: rows.join(F.broadcast(shifts), "device_id").withColumn(out, q(inputs[1]) + q("_shift")).drop("_shift")

    table = fleet(spark, sf_dir)
    stack = ForwardStack([mean_baseline(), single_sensor_linear()], final=CustomFinal(median_error))
    scores = _scored(table, "stacking", stack)
    return scores.select("device_id", "model", *[rounded(q(m)).alias(m) for m in ("rmse", "mae")])


def two_model_scores(table: CellTable) -> DataFrame:
    estimators = build_estimators(CONFIG, models=LINEAR_TWO)
    parts = [
        score_block(table, fit_all(table, estimators, scheme), scheme, stage)
        for scheme, stage in (("train", "validation"), ("final", "test"))
    ]
    return parts[0].unionByName(parts[1])


@query
def score_metrics(spark, sf_dir):
    scores = two_model_scores(fleet(spark, sf_dir))
    return scores.select("device_id", "model", "stage", "n_rows",
                         *[rounded(q(m)).alias(m) for m in ("rmse", "mae", "r2")])


@query
def scores_table(spark, sf_dir):
    wide = scores_wide(two_model_scores(fleet(spark, sf_dir, views.fleet_user)), KEYS)
    values = [c for c in wide.columns if c.startswith(("validation_", "test_"))]
    return wide.select("device_id", long("ord").alias("ord"), "model", *[rounded(q(c)).alias(c) for c in values])


@query
def metrics_csv(spark, sf_dir):
    """The score table as it is written: six decimals, empty where undefined."""
    wide = scores_wide(two_model_scores(fleet(spark, sf_dir, views.hourly)), KEYS)
    return six_decimals(wide.drop("ord"))


@query
def r2_constant_target(spark, sf_dir):
    """R2 is undefined for a constant target: line number against quantity, by line number and for all."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.explode(F.array(q("l_linenumber"), F.lit(0))).alias("line_group"),
        q("l_linenumber").cast("double").alias("y"), q("l_quantity").alias("prediction"),
    )
    scores = metrics.score(rows, ["line_group"])
    return scores.select(long("line_group").alias("line_group"), "n_rows", "unusable",
                         *[rounded(q(m)).alias(m) for m in ("rmse", "mae", "r2")])


@query
def unusable_predictions(spark, sf_dir):
    """Pairs that cannot be scored: NULL, NaN and infinite quotients, by device."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        q("l_suppkey").alias("device_id"), q("l_quantity").alias("y"),
        F.when(q("l_tax") > 0, q("l_discount") / q("l_tax"))
        .when(q("l_discount") > 0, F.lit(float("inf")))
        .when(q("l_returnflag") != "N", F.lit(float("nan"))).alias("prediction"),
    )
    return metrics.score(rows, KEYS).select("device_id", "n_rows", "unusable")


@query
def finite_report_values(spark, sf_dir):
    """NaN and infinities become NULL on the way out."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(q("l_tax") > 0, q("l_discount") / q("l_tax"))
        .when(q("l_discount") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))).alias("ratio"),
    )
    return finite_columns(rows).groupBy(long("l_linenumber").alias("line")).agg(
        F.count("*").alias("n_rows"), F.count("ratio").alias("finite_rows"), rounded(F.max("ratio")).alias("largest")
    )


@query
def select_model(spark, sf_dir):
    """Lowest validation RMSE per device."""
    table = fleet(spark, sf_dir, views.fleet_user)
    estimators = build_estimators(CONFIG, models=LINEAR_TWO)
    scores = score_block(table, fit_all(table, estimators, "train"), "train", "validation")
    return lowest_rmse(scores, KEYS).select("device_id", "model", rounded(q("rmse")).alias("rmse"))


@query
def permutation_importance_ols(spark, sf_dir):
    """Importance of the one-sensor line on the test block."""
    return _importance_values(fleet(spark, sf_dir))


@query
def importance_split(spark, sf_dir):
    """The same with every device's ranks counted in slices."""
    return _importance_values(fleet(spark, sf_dir, layout=SMALL_PIECES))


def _importance_values(table: CellTable) -> DataFrame:
    fitted = single_sensor_linear().fit_cells(table, "final", [table.last])
    return _importance_table(permutation_importance(table, fitted, "final", CONFIG.importance_repeats, CONFIG.seed))


def _three_features(spark, sf_dir, layout: Layout = Layout()) -> tuple[CellTable, LinearFitted]:
    """A ridge of s1 and w3 plus a fixed daily profile, which predicts the validation block."""
    table = fleet(spark, sf_dir, views.hourly, layout=layout)
    models = fit_linear(table.gram, "train", [table.last], ["ridge"], RIDGE_TWO_ALPHA, RIDGE_TWO)
    profile = F.array(*[F.lit((h - 11.5) * DAILY_STEP) for h in range(24)])
    return table, LinearFitted(table, keep(models.withColumn("hour_weights", profile)), "train", (table.last,), "ridge")


def _importance_table(values: DataFrame) -> DataFrame:
    return values.select("device_id", "feature", long("position").alias("position"),
                         rounded(q("rmse_increase_mean")).alias("rmse_increase_mean"),
                         rounded(q("rmse_increase_std")).alias("rmse_increase_std"))


@query
def importance_three_features(spark, sf_dir):
    """Three features that matter, each shuffled on its own."""
    table, fitted = _three_features(spark, sf_dir)
    return _importance_table(permutation_importance(table, fitted, "train", CONFIG.importance_repeats, CONFIG.seed))


@query
def importance_three_split(spark, sf_dir):
    """The same with ranks counted in slices."""
    table, fitted = _three_features(spark, sf_dir, SMALL_PIECES)
    return _importance_table(permutation_importance(table, fitted, "train", CONFIG.importance_repeats, CONFIG.seed))


@query
def importance_three_general(spark, sf_dir):
    """The same by predicting every shuffled row, as for a model of any kind."""
    table, fitted = _three_features(spark, sf_dir)
    of_any_kind = PerCellFitted({table.last: lambda rows, out: fitted.at(rows, table.last, out)})
    return _importance_table(permutation_importance(table, of_any_kind, "train", CONFIG.importance_repeats, CONFIG.seed))


@query
def importance_ranking(spark, sf_dir):
    """Importance table in report order: largest increase first, feature order when equal."""
    table = fleet(spark, sf_dir, views.hourly)
    fitted = single_sensor_linear().fit_cells(table, "final", [table.last])
    values = permutation_importance(table, fitted, "final", CONFIG.importance_repeats, CONFIG.seed)
    mean = rounded(q("rmse_increase_mean"))
    order = Window.partitionBy("device_id").orderBy(F.desc("mean"), "position")
    return values.withColumn("mean", mean).select(
        "device_id", "feature", "mean", F.row_number().over(order).cast("long").alias("place")
    )


# --- trees, stock stack, whole run ---------------------------------------------------


def _scored(table: CellTable, name: str, estimator) -> DataFrame:
    fitted = fit_all(table, {name: estimator}, "train")
    return score_block(table, fitted, "train", "validation").select("device_id", "model", "rmse", "mae", "r2")


@query
def random_forest_scores(spark, sf_dir):
    return _scored(fleet(spark, sf_dir, views.fleet_user), "random_forest", random_forest(CONFIG.forest_trees))


@query
def boosting_scores(spark, sf_dir):
    return _scored(fleet(spark, sf_dir, views.fleet_user), "hist_gradient_boosting", boosting())


@query
def boosting_stumps(spark, sf_dir):
    """A few boosted trees of one split each, with a penalty on their leaves: validation scores."""
    scores = _scored(fleet(spark, sf_dir, views.hourly), "hist_gradient_boosting", boosting(**STUMPS))
    return scores.select("device_id", "model", *[rounded(q(m)).alias(m) for m in ("rmse", "mae")])


@query
def boosting_search(spark, sf_dir):
    table = fleet(spark, sf_dir, views.hourly)
    found = tune_boosting(table, RunConfig.quick(search_parallelism=8))
    return found.scores.withColumns({name: F.lit(value) for name, value in found.params.items()})


@query
def stack_full(spark, sf_dir):
    """The stock stack of ridge, forest and boosting: blend weights."""
    table = fleet(spark, sf_dir, views.hourly)
    stack = stock_stack(CONFIG).fit_cells(table, "train", [table.last])
    return stack.weights.select("device_id", "intercept", F.posexplode("weights").alias("base", "weight"))


@query
def run_experiment(spark, sf_dir):
    """The quick recipe on one device's hourly record: wide scores with the selected model marked."""
    rows = keep_columnar(views.hourly(spark, sf_dir))
    result = run_calibration(rows, SPEC, RunConfig.quick(search_parallelism=8))
    chosen = result.selection.chosen.withColumnRenamed("model", "selected")
    return scores_wide(result.scores, KEYS).join(chosen, KEYS).withColumn("selected", q("selected") == q("model"))


def linear_run(spark, sf_dir, view):
    rows = keep_columnar(view(spark, sf_dir))
    return run_calibration(rows, SPEC, CONFIG, models=("mean_baseline", "single_sensor_linear", "ridge"))


@query
def fleet_run(spark, sf_dir):
    """The recipe with the linear models, for every device."""
    result = linear_run(spark, sf_dir, views.fleet_supplier)
    return scores_wide(result.scores, KEYS).join(result.selection.chosen.withColumnRenamed("model", "selected"), KEYS)


@query
def report_json(spark, sf_dir):
    """The nested report of each device as JSON text, undefined values kept as null."""
    result = linear_run(spark, sf_dir, views.fleet_user)
    rows = report(result)
    return rows.select("device_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("report"))


@query
def run_manifest(spark, sf_dir):
    """Outputs of a run written and read back through its manifest."""
    result = linear_run(spark, sf_dir, views.hourly)
    folder = new_folder(spark)
    source = export.fingerprint(spark, f"{sf_dir}/events.parquet")
    paths = write_outputs(result, folder, source)
    append_manifest(result, f"{folder}/runs", "quick", source, paths)
    return spark.read.parquet(f"{folder}/runs").select("recipe", "config", "inputs_digest", "outputs")


@query
def stream_scoring(spark, sf_dir):
    """Readings scored as a stream equal those scored at once; both counts and the greatest difference."""
    rows = keep_columnar(views.fleet_user(spark, sf_dir))
    table = build_cell_table(prepare(rows, SPEC), SPEC, CONFIG)
    fitted = ridge(1.0).fit_cells(table, "final", [table.last])
    folder = new_folder(spark)
    rows.write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    stream_scores(arriving, fitted, table, f"{folder}/out", f"{folder}/state").awaitTermination()
    streamed = spark.read.parquet(f"{folder}/out").withColumnRenamed("prediction", "streamed")
    at_once = score_readings(rows, fitted, table)
    return at_once.join(streamed, ["device_id", "ts"], "full").agg(
        F.count("prediction").alias("at_once"), F.count("streamed").alias("streamed"),
        F.max(F.abs(q("prediction") - q("streamed"))).alias("difference"),
    )
