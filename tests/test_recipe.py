"""The pinned recipe's digest check, and the release of intermediate tables."""

import pytest
from fleet_tables import SPEC, fleet_frame, synthetic_lines, to_spark, write_lines
from pyspark.sql import functions as F

from driftline.operators.celltable import build_cell_table
from driftline.operators.prepare import prepare
from driftline.plans.experiment import run_recipe
from driftline.session import kept_so_far, release
from driftline.sources.export import fingerprint
from driftline.spec import GAS_EXPORT, RunConfig


def test_changed_and_absent_files_are_refused_before_any_write(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        write_lines(tmp_path, synthetic_lines(48), name)
    pattern, out = str(tmp_path / "*.csv"), tmp_path / "out"
    good = fingerprint(spark, pattern).select("file", "digest")
    changed = good.withColumn("digest", F.when(F.col("file").endswith("a.csv"), "0").otherwise(F.col("digest")))
    absent = good.union(spark.createDataFrame([("file:/c.csv", "0")], good.schema))
    before = kept_so_far(spark)
    for expected in (changed, absent, good.limit(1)):
        with pytest.raises(ValueError, match="differs from the expected digest"):
            run_recipe(spark, pattern, expected, str(out), str(out / "runs"), GAS_EXPORT, RunConfig.quick())
    assert not out.exists() and kept_so_far(spark) == before


def test_an_error_in_the_run_leaves_no_tables(spark, tmp_path):
    path = write_lines(tmp_path, synthetic_lines(6))
    tables = len(spark.catalog.listTables())
    before = kept_so_far(spark)
    with pytest.raises(ValueError, match="no device can be calibrated"):
        run_recipe(spark, path, fingerprint(spark, path), str(tmp_path / "out"), str(tmp_path / "runs"), GAS_EXPORT)
    assert kept_so_far(spark) == before and len(spark.catalog.listTables()) == tables


def test_release_drops_tables_and_folders(spark):
    before, tables = kept_so_far(spark), len(spark.catalog.listTables())
    table = build_cell_table(prepare(to_spark(spark, fleet_frame()), SPEC), SPEC, RunConfig.quick())
    assert table.rows.count() and len(spark.catalog.listTables()) == tables + 1
    assert release(spark, before) == 1 and kept_so_far(spark) == before
    assert len(spark.catalog.listTables()) == tables
