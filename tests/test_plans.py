"""Plans stay as designed: no shuffle on clustered rows, no single-task exchange, pruned scans."""

import pytest
from fleet_tables import SPEC, cell_table, fleet_frame
from pyspark.sql import functions as F

from driftline.operators.linear import add_linear, fit_linear, fit_plain, ridge_cv
from driftline.operators.preprocess import prefix_medians
from driftline.functions.metrics import score
from driftline.spec import Layout


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    return cell_table(spark, fleet_frame())


def test_medians_need_no_shuffle(table):
    text = plan(prefix_medians(table))
    assert "Exchange" not in text and "Bucketed: true" in text


def test_per_device_aggregates_need_no_shuffle(table):
    joined = table.join_devices(table.fit_rows, table.fills.select("device_id", "centres"))
    text = plan(joined.groupBy("device_id", "cell_train").agg(F.sum(F.col("a") - F.col("centres")[0])))
    assert text.count("Exchange") == text.count("BroadcastExchange") > 0
    scan = [line for line in text.splitlines() if "FileScan" in line][0]
    assert "PushedFilters: [IsNotNull(block), Not(EqualTo(block,test))" in scan and "cell_final" not in scan.split("ReadSchema")[1]


def test_large_device_tables_are_not_broadcast(spark):
    table = cell_table(spark, fleet_frame(), layout=Layout(broadcast_rows=0))
    text = plan(table.join_devices(table.fit_rows, table.cuts.table.select("device_id", "n")))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    # The device table is shuffled; the clustered rows stay where they are.
    assert text.count("Exchange hashpartitioning") == 1


def test_no_single_task_exchange_on_rows(table):
    models = fit_linear(table.gram, "train", [table.last])
    rows = add_linear(table.cells("train", 4, 4), table, models, "train", [4], {"ridge": "p"})
    text = plan(score(rows.withColumn("target", F.col("y")), ["device_id"], "target", "p"))
    assert "SinglePartition" not in text


def test_one_python_call_solves_many_devices(table):
    for solved in (fit_linear(table.gram, "train", [table.last]), ridge_cv(table.gram)):
        text = plan(solved)
        assert "FlatMapCoGroupsInArrow [_group" in text and "CoGroupsInPandas" not in text


def test_mean_and_one_sensor_line_run_without_python(table):
    text = plan(fit_plain(table, {"train": [1, 4], "final": [4]}, ["mean_baseline", "single_sensor_linear"]))
    assert "InPandas" not in text and "Python" not in text
    assert text.count("Exchange hashpartitioning") == 1  # the device table goes to the rows, which stay


def test_level_sums_have_a_row_per_hour_and_weekday(table):
    most = table.gram.levels.groupBy("device_id", "cell_train", "cell_final").count().agg(F.max("count")).first()[0]
    assert most <= 31
