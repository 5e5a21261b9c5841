"""Forward-chaining evaluation and the boosting search."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.functions.metrics import check_scores, score
from driftline.operators.celltable import CellTable
from driftline.operators.estimators import Estimator, PerCell, PerCellFitted, add_predictions
from driftline.operators.trees import TreeModel, boosting, fit_trees
from driftline.session import keep
from driftline.spec import RunConfig

# The search space. Ranges of whole numbers include both ends.
BOOSTING_SPACE = {
    "learning_rate": ("log", 0.02, 0.3),
    "max_iter": ("whole", 100, 400),
    "max_leaf_nodes": ("whole", 8, 63),
    "min_samples_leaf": ("whole", 10, 100),
    "l2_regularization": ("log", 1e-4, 10.0),
}


def draw_boosting(candidates: int, seed: int) -> list[dict]:
    """Seeded random settings. The draws are this package's own."""
    rng = random.Random(seed)

    def draw(kind: str, low: float, high: float):
        if kind == "whole":
            return rng.randint(low, high)
        return math.exp(rng.uniform(math.log(low), math.log(high)))

    return [{name: draw(*rule) for name, rule in BOOSTING_SPACE.items()} for _ in range(candidates)]


def long_predictions(rows: DataFrame, table: CellTable, columns: dict[str, str], label: str, by: Sequence[str]) -> DataFrame:
    """One row per prediction: the ``by`` columns, ``label``, ``y`` and ``prediction``."""
    pairs = [F.struct(F.lit(name).alias(label), q(c).alias("prediction")) for name, c in columns.items()]
    return rows.select(*by, q(table.spec.target).alias("y"), F.explode(F.array(*pairs)).alias("_p")).select(
        *by, "y", "_p.*"
    )


def forward_cv(
    table: CellTable, candidates: Sequence[Estimator], scheme: str = "train", by_device: bool = True
) -> DataFrame:
    """``([device,] candidate, fold, rmse, ...)``: each fold predicted from earlier rows only.

    All candidates and folds are scored in one job; ``by_device=False`` pools the devices.
    """
    folds = range(1, table.folds + 1)
    fitted = dict(enumerate(fit_many(table, candidates, scheme, folds)))
    rows = add_predictions(table.cells(scheme, 1, table.folds), {f"_p{i}": f for i, f in fitted.items()}, folds)
    by = ([table.spec.device] if by_device else []) + ["cell"]
    scores = score(
        long_predictions(rows, table, {i: f"_p{i}" for i in fitted}, "candidate", by), [*by, "candidate"]
    )
    return scores.withColumnRenamed("cell", "fold")


def fit_many(table: CellTable, candidates: Sequence[Estimator], scheme: str, cells: Sequence[int]) -> list:
    """Fit all candidates; tree models are grown together, those fitted cell by cell share one pool."""
    if all(isinstance(c, TreeModel) for c in candidates):
        return fit_trees(table, candidates, scheme, cells)
    if not all(isinstance(c, PerCell) for c in candidates):
        return [c.fit_cells(table, scheme, cells) for c in candidates]
    jobs = [(c, f) for c in candidates for f in cells]
    with ThreadPoolExecutor(table.config.search_parallelism) as pool:
        done = list(pool.map(lambda job: job[0].fit(table, scheme, job[1]), jobs))
    size = len(cells)
    return [PerCellFitted(dict(zip(cells, done[i * size:(i + 1) * size]))) for i in range(len(candidates))]


@dataclass(frozen=True)
class BoostingSearch:
    """The winner's settings, its mean fold RMSE, and all candidates' scores."""

    params: dict
    cv_rmse: float
    candidates: int
    scores: DataFrame


def tune_boosting(table: CellTable, config: RunConfig) -> BoostingSearch:
    """Random search on the training block: mean fold RMSE, the first of equal candidates wins.

    The model is common to all devices, so a fold's RMSE is taken over all of them.
    """
    drawn = draw_boosting(config.search_iterations, config.seed)
    candidates = [boosting(config.seed, **p) for p in drawn]
    cv = keep(forward_cv(table, candidates, by_device=False))
    check_scores(cv)
    means = cv.groupBy("candidate").agg(F.avg("rmse").alias("cv_rmse"))
    best = means.orderBy("cv_rmse", "candidate").first()
    return BoostingSearch(dict(sorted(drawn[best["candidate"]].items())), best["cv_rmse"], len(drawn), cv)
