"""Predicting later readings as they arrive.

The fitted models are static tables or pipelines, so scoring a stream is the
batch expression on streaming rows: map-only, without state. The models are
those of a finished run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftline.functions.columns import null_for_nan
from driftline.operators.celltable import CellTable
from driftline.operators.estimators import Fitted, predict_later
from driftline.operators.prepare import any_sensor, calendar


def score_readings(readings: DataFrame, fitted: Fitted, table: CellTable, out: str = "prediction") -> DataFrame:
    """Predictions for batch or streaming readings with at least one sensor; no target is needed.

    A device without a model gets NULL and a reason.
    """
    spec = table.spec
    rows = readings.select(spec.device, spec.time, *[null_for_nan(c) for c in spec.continuous])
    features = calendar(rows.filter(any_sensor(spec)), spec)
    return predict_later(fitted, features, table, out).select(spec.device, spec.time, out, "reason")


def stream_scores(
    readings: DataFrame, fitted: Fitted, table: CellTable, path: str, checkpoint: str
) -> StreamingQuery:
    """Score a stream and append to Parquet; exactly once through the checkpoint folder."""
    return (
        score_readings(readings, fitted, table)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
