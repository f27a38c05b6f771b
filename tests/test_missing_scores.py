"""Scores that are NULL or NaN belong to no class and count in no report."""

import pytest

from churnlake.operators import evaluate


def test_missing_scores_count_nowhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, nan), (1, None), (None, 0.8)], "y int, p double")
    yes = {r["class"]: r for r in evaluate.report(df, "y", "p", 0.5).collect()}["yes"]
    assert (yes["precision"], yes["recall"], yes["support"], yes["accuracy"]) == (1, 1, 1, 1)
    assert [r[0] for r in df.select(evaluate.classify(df.p, 0.5)).collect()] == ["yes", "no", None, None, "yes"]
    out = evaluate.calibration(df, "y", "p").first()
    assert (out["predicted"], out["observed"]) == (pytest.approx(0.5), 0.5)
