"""Error measures as aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import finite


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r_squared(y: Column, p: Column) -> Column:
    """1 - residual / total sum of squares; NULL when the target is constant."""
    ratio = F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))
    return F.when(F.min(y) != F.max(y), 1.0 - ratio)


def unusable(y: Column, p: Column) -> Column:
    """Rows whose target or prediction is not a finite number."""
    return F.count_if(~(finite(y) & finite(p)))


def score(rows: DataFrame, by: Sequence[str], y: str = "y", p: str = "prediction") -> DataFrame:
    """All measures in one aggregate, with the row count and the number of unusable rows."""
    target, predicted = F.col(y), F.col(p)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), unusable(target, predicted).alias("unusable"),
        rmse(target, predicted).alias("rmse"), mae(target, predicted).alias("mae"),
        r_squared(target, predicted).alias("r2"),
    )


def check_scores(scores: DataFrame) -> None:
    """An empty score table or any unusable row is an error."""
    facts = scores.agg(F.count("*").alias("groups"), F.sum("unusable").alias("unusable")).first()
    if not facts["groups"]:
        raise ValueError("nothing to score")
    if facts["unusable"]:
        raise ValueError(f"{facts['unusable']} row(s) with a target or prediction that is not finite")


def score_all(rows: DataFrame, y: str = "y", p: str = "prediction") -> dict[str, float | None]:
    """RMSE, MAE and R2 of one table of predictions; R2 is None for a constant target."""
    scores = score(rows, [], y, p).filter("n_rows > 0")
    check_scores(scores)
    found = scores.first()
    return {name: found[name] for name in ("rmse", "mae", "r2")}
