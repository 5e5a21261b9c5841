import math

import pytest

from driftline.functions.metrics import score, score_all


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, prediction double")


@pytest.mark.parametrize("y, p, want", [
    ((1, 2, 3, 4), (1, 2, 4, 2), (math.sqrt(1.25), 0.75, 0.0)),
    ((2, 4, 6), (3, 4, 5), (math.sqrt(2 / 3), 2 / 3, 0.75)),
    ((1, 2, 3, 4), (1, 2, 3, 4), (0.0, 0.0, 1.0)),
    ((1, 2, 3, 4), (2.5,) * 4, (math.sqrt(1.25), 1.0, 0.0)),
])
def test_values(spark, y, p, want):
    got = score_all(pairs(spark, y, p))
    assert [got[m] for m in ("rmse", "mae", "r2")] == pytest.approx(want)


def test_worse_than_the_mean_and_constant_target(spark):
    assert score_all(pairs(spark, (1, 2, 3, 4), (4, 3, 2, 1)))["r2"] < 0
    constant = score_all(pairs(spark, (3, 3), (3, 2)))
    assert constant["r2"] is None and constant["rmse"] == pytest.approx(math.sqrt(0.5))


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_values_that_are_not_finite_are_refused(spark, bad):
    for y, p in (((1, bad), (1, 2)), ((1, 2), (1, bad))):
        with pytest.raises(ValueError, match="finite"):
            score_all(pairs(spark, y, p))


def test_nothing_to_score(spark):
    with pytest.raises(ValueError, match="nothing"):
        score_all(spark.createDataFrame([], "y double, prediction double"))


def test_groups(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 5.0, None)], "g string, y double, prediction double")
    got = {r["g"]: r for r in score(rows, ["g"]).collect()}
    assert got["a"]["mae"] == 0.5 and got["a"]["unusable"] == 0 and got["b"]["unusable"] == 1
