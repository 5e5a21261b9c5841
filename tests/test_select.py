import numpy as np
import pytest
from fleet_tables import cell_table, fleet_frame
from pyspark.sql import functions as F

from driftline.operators import importance
from driftline.operators.estimators import LinearFitted, mean_baseline, ridge
from driftline.operators.importance import (
    _general_errors, _linear_errors, exchanged, permutation_importance, places, ranked, sent_to, with_ranks,
)
from driftline.operators.select import scores_wide, select_model
from driftline.session import keep_columnar
from driftline.spec import MODEL_ORDER, Layout

TABLE = [("mean_baseline", 1.5, 1.3), ("single_sensor_linear", .85, .73), ("ridge", .6, .5), ("random_forest", .7, .48),
         ("hist_gradient_boosting", .75, .47), ("stacking", .72, .4)]


def scores(spark, rows):
    return spark.createDataFrame([("d", m, float(v)) for m, v, *_ in rows], "device_id string, model string, rmse double")


def chosen(spark, rows, order=MODEL_ORDER):
    return select_model(scores(spark, rows), ["device_id"], order).models


def test_lowest_validation_error_wins(spark):
    assert chosen(spark, TABLE) == ("ridge",)


def test_test_scores_are_not_read(spark):
    both = scores(spark, TABLE).withColumn("stage", F.lit("validation")).unionByName(
        scores(spark, [("stacking", 0.0)]).withColumn("stage", F.lit("test")))
    assert select_model(both, ["device_id"]).models == ("ridge",)


def test_ties_unknown_and_missing_models(spark):
    assert chosen(spark, [(m, 1.0) for m in reversed(MODEL_ORDER)]) == ("mean_baseline",)
    assert chosen(spark, [("stacking", 1.0), ("other", 0.1)]) == ("stacking",)
    assert chosen(spark, [("stacking", 1.0), ("ridge", 1.0)], ("stacking", "ridge")) == ("stacking",)


@pytest.mark.parametrize("rows", [[], [("other", 1.0)], [("ridge", float("nan"))], [("ridge", float("inf")), ("stacking", 1.0)]])
def test_bad_scores(spark, rows):
    with pytest.raises(ValueError):
        chosen(spark, rows)


def test_each_device_chooses(spark):
    rows = scores(spark, TABLE).unionByName(scores(spark, [("mean_baseline", .1), ("ridge", .2)]).withColumn("device_id", F.lit("e")))
    selection = select_model(rows, ["device_id"])
    assert {tuple(r) for r in selection.chosen.collect()} == {("d", "ridge"), ("e", "mean_baseline")}
    assert selection.models == ("mean_baseline", "ridge")


def test_wide_scores(spark):
    long = spark.createDataFrame(
        [("d", "ridge", "validation", 1.0, 2.0, None), ("d", "ridge", "test", 4.0, 5.0, 6.0)],
        "device_id string, model string, stage string, rmse double, mae double, r2 double")
    wide = scores_wide(long, ["device_id"])
    assert wide.columns == ["device_id", "ord", "model", "validation_rmse", "validation_mae", "validation_r2",
                            "test_rmse", "test_mae", "test_r2"]
    assert tuple(wide.first()) == ("d", 2, "ridge", 1.0, 2.0, None, 4.0, 5.0, 6.0)


def sent(spark, table, repeats, seed):
    """``{(device, key): [rank sent to, by rank]}``."""
    ranked = with_ranks(table.cells("final", 4, 4), table, seed)
    keyed = ranked.withColumn("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats * 5 - 1).cast("long"))))
    found = {}
    for r in keyed.select("device_id", "_key", "_rank", "_size", sent_to(seed).alias("to")).collect():
        found.setdefault((r["device_id"], r["_key"]), [None] * r["_size"])[r["_rank"]] = r["to"]
    return found


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_every_feature_has_a_permutation_of_its_own(spark, hot_rows):
    table = cell_table(spark, fleet_frame(), layout=Layout(hot_rows=hot_rows))
    assert table.salted == (hot_rows == 20)
    found = sent(spark, table, 3, 42)
    assert len(found) == 3 * 15
    for places in found.values():
        assert sorted(places) == list(range(len(places))) and sum(i == p for i, p in enumerate(places)) < len(places) / 3
    for device in range(3):
        own = [tuple(places) for (d, _), places in found.items() if d == device]
        assert len(set(own)) == 15
        same = [sum(x == y for x, y in zip(a, b)) for i, a in enumerate(own) for b in own[:i]]
        assert max(same) < len(own[0]) / 3


def test_shuffles_are_even(spark):
    """Over many keys every rank is sent everywhere equally often."""
    n, keys = 7, 7000
    rows = spark.range(n * keys).select((F.col("id") % n).alias("_rank"), F.expr(f"id div {n}").alias("_key"), F.lit(n).cast("long").alias("_size"))
    counts = rows.groupBy("_rank", sent_to(5).alias("to")).count().toPandas()
    assert len(counts) == n * n and counts["count"].between(850, 1150).all()


def test_shuffles_do_not_depend_on_the_layout(spark):
    frame, found = fleet_frame(), []
    for hot_rows in (1_000_000, 20):
        table = cell_table(spark, frame, layout=Layout(hot_rows=hot_rows))
        fitted = ridge(1.0).fit_cells(table, "final", [4])
        rows = permutation_importance(table, fitted, repeats=2).collect()
        found.append({(r["device_id"], r["position"]): (r["rmse_increase_mean"], r["rmse_increase_std"]) for r in rows})
    assert found[0].keys() == found[1].keys()
    for key, values in found[0].items():
        assert values == pytest.approx(found[1][key])


def test_values_are_exchanged_as_sent(spark):
    """A feature's shuffled column holds the same values, gaps too; all others stay."""
    table = cell_table(spark, fleet_frame(devices=1))
    ranked = with_ranks(table.cells("final", 4, 4), table, 7).select(
        "device_id", "_rank", "_size", "y", F.array("a", "b", "t", F.col("hour").cast("double"), F.col("day_of_week").cast("double")).alias("v"))
    rows = sorted(ranked.collect(), key=lambda r: r["_rank"])
    places = sent(spark, table, 2, 7)
    for r in exchanged(ranked, table.spec, 2, 7, ["y", "v"], "v").collect():
        own, key = rows[r["_place"]], r["_key"]
        giver = rows[places[r["device_id"], key].index(r["_place"])]
        assert r["y"] == own["y"] and r["v"] == own["v"] and r["given"] == giver["v"][key % 5]


def test_linear_shortcut_equals_predicting_again(spark):
    table = cell_table(spark, fleet_frame())
    fitted = ridge(1.0).fit_cells(table, "final", [4])
    rows = table.cells("final", 4, 4)
    fast, slow = (
        {tuple(r[:-1]): r[-1] for part in errors(rows, table, fitted, 4, 2, 1) for r in part.collect()} for errors in (_linear_errors, _general_errors)
    )
    assert isinstance(fitted, LinearFitted) and len(slow) == 3 * 2 * 5 + 3
    assert fast == pytest.approx(slow)


def test_importance_finds_the_driver_and_repeats(spark):
    frame = fleet_frame()
    table = cell_table(spark, frame)
    fitted = ridge(1.0).fit_cells(table, "final", [4])
    first = [tuple(r) for r in ranked(permutation_importance(table, fitted, repeats=3), ["device_id"]).collect()]
    again = [tuple(r) for r in ranked(permutation_importance(table, fitted, repeats=3), ["device_id"]).collect()]
    assert first == again and len(first) == 15
    assert {r[1] for r in first[::5]} <= {"a", "b"} and all(r[4] >= 0 for r in first)
    flat = permutation_importance(table, mean_baseline().fit_cells(table, "final", [4]), repeats=2).collect()
    assert max(abs(r["rmse_increase_mean"]) for r in flat) < 1e-12


def test_ranks_in_arrays_go_where_the_expression_sends_them(spark):
    for n, seed in ((1, 3), (2, 42), (97, 42), (1000, 7)):
        rows = spark.range(n).select(F.col("id").alias("_rank"), F.lit(n).cast("long").alias("_size"))
        keyed = rows.withColumn("_key", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1, 29, 299)])))
        want = keyed.select("_key", "_rank", sent_to(seed).alias("to")).orderBy("_key", "_rank").toPandas()["to"].to_numpy().reshape(4, n)
        got = places(np.arange(n), n, np.array([0, 1, 29, 299]), seed)
        assert (got == want).all() and (places(np.arange(n), np.full(n, n), np.array([0, 1, 29, 299]), seed) == want).all()


def test_linear_importance_has_slim_records(spark, monkeypatch):
    """Devices that one task holds are shuffled in arrays; for others a row of a shuffle carries two numbers."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep_columnar(df)

    monkeypatch.setattr(importance, "keep_columnar", kept)
    table = cell_table(spark, fleet_frame())
    permutation_importance(table, ridge(1.0).fit_cells(table, "final", [4]), repeats=2)
    assert "FlatMapGroupsInArrow" in plans[-1] and "Generate" not in plans[-1]  # no row per shuffle
    table = cell_table(spark, fleet_frame(), layout=Layout(hot_rows=20))
    shuffled, _ = _linear_errors(table.cells("final", 4, 4), table, ridge(1.0).fit_cells(table, "final", [4]), 4, 2, 1)
    text = shuffled._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in text.splitlines() if "max(given" in line]
    assert sums and all(" HashAggregate" in line for line in sums)


def test_split_devices_with_few_rows_in_the_block_meet_in_arrays(spark, monkeypatch):
    """Devices whose rows of the block one task holds need no row per shuffle, also where devices are split; the others do."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep_columnar(df)

    monkeypatch.setattr(importance, "keep_columnar", kept)
    frame, found = fleet_frame(devices=6), []
    for hot_rows in (1_000_000, 60, 25):
        table = cell_table(spark, frame, layout=Layout(hot_rows=hot_rows))
        fitted = ridge(1.0).fit_cells(table, "final", [4])
        shuffled, plain = _linear_errors(table.cells("final", 4, 4), table, fitted, 4, 2, 1)
        sizes = [r["count"] for r in table.cells("final", 4, 4).groupBy("device_id").count().collect()]
        text = shuffled._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plans[-1] and ("Generate" in text) == (max(sizes) > hot_rows)
        found.append({tuple(r[:-1]): r[-1] for part in (shuffled, plain) for r in part.collect()})
    assert min(sizes) <= 25 < max(sizes) <= 60 < len(frame) / 6  # some in arrays, some by the aggregate
    assert len(found[0]) == 6 * 11 and found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])


def test_shuffles_of_several_devices_at_once_are_those_of_each():
    sizes, keys = np.array([1, 5, 40, 5]), np.array([0, 7, 29])
    rank = np.concatenate([np.arange(n) for n in sizes])
    each = [places(np.arange(n), int(n), keys, 3) for n in sizes]
    assert (places(rank, np.repeat(sizes, sizes), keys, 3) == np.concatenate(each, axis=1)).all()
    far = np.array([0, 5, importance.PRIME - 1, importance.PRIME, importance.PRIME + 1, 2**62 - 1, 2**62])
    assert (importance.below_prime(far) == far % importance.PRIME).all()
