"""Choosing a model on the validation block, before the test block is looked at."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import finite, q
from driftline.session import keep
from driftline.spec import MODEL_ORDER


def ordered_models(spark, order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    return spark.createDataFrame([(i, name) for i, name in enumerate(order)], "ord int, model string")


def lowest_rmse(scores: DataFrame, by: Sequence[str], order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Model with the lowest RMSE per group; the earlier in ``order`` wins a tie. Other models are ignored."""
    ranked = scores.join(F.broadcast(ordered_models(scores.sparkSession, order)), "model")
    best = F.struct("rmse", "ord")
    return ranked.groupBy(*by).agg(F.min_by("model", best).alias("model"), F.min("rmse").alias("rmse"))


@dataclass(frozen=True)
class Selection:
    """A choice that has been made: ``chosen`` (device, model) is written out, not a plan.

    The test stage takes it as an argument, so no test score can exist before it.
    """

    chosen: DataFrame
    models: tuple[str, ...]


def select_model(validation: DataFrame, by: Sequence[str], order: Sequence[str] = MODEL_ORDER) -> Selection:
    """Choose from validation scores ``(<by>, model, rmse)``; they hold no other stage."""
    if "stage" in validation.columns:
        validation = validation.filter(q("stage") == "validation")
    known = validation.filter(q("model").isin(list(order)))
    facts = known.agg(F.count("*").alias("n"), F.count_if(~finite(q("rmse"))).alias("bad")).first()
    if not facts["n"]:
        raise ValueError("no scored models to choose from")
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} validation score(s) are not finite, so no model can be chosen")
    chosen = keep(lowest_rmse(known, by, order).select(*by, "model"))
    found = {r["model"] for r in chosen.select("model").distinct().collect()}
    return Selection(chosen, tuple(name for name in order if name in found))


def scores_wide(scores: DataFrame, by: Sequence[str], order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """One row per group and model: ``validation_*`` then ``test_*``, with the model's position ``ord``."""
    measures = ("rmse", "mae", "r2")
    wide = scores.groupBy(*by, "model").agg(*[
        F.max(F.when(q("stage") == stage, q(m))).alias(f"{stage}_{m}")
        for stage in ("validation", "test") for m in measures
    ])
    return wide.join(F.broadcast(ordered_models(scores.sparkSession, order)), "model").select(
        *by, "ord", "model", *[f"{stage}_{m}" for stage in ("validation", "test") for m in measures]
    )
