"""Kernel machines on landmarks: the kernel, the solutions, and planted rings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import board, landmarks


@pytest.fixture(scope="module")
def rings():
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 2)) * [1.0, 3.0] + [5.0, 0.0]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    return x, ((z ** 2).sum(axis=1) < 1.2).astype(int)


@pytest.fixture(scope="module")
def frame(spark, rings):
    rows = [(i, p.tolist(), int(t), i % 2) for i, (p, t) in enumerate(zip(*rings))]
    return spark.createDataFrame([*rows, (-1, [0.0, 0.0], None, 0)], "key long, x array<double>, y int, fold int").repartition(3).checkpoint()


@pytest.fixture(scope="module")
def marks(frame):
    mean, sd = landmarks.scales(frame, "x")
    return landmarks.Landmarks(landmarks.chosen_landmarks(frame, "x", 25, mean, sd), mean, sd, [0.05, 1.0])


@pytest.fixture(scope="module")
def machines(frame, marks):
    return landmarks.fit_grid(frame, "y", "x", marks, [0.01, 1.0, 100.0])


def test_rows_that_are_landmarks_lose_nothing(spark):
    x = np.array([[0.0, 1.0], [2.0, 0.5], [-1.0, 3.0]])
    marks = landmarks.Landmarks(x, np.zeros(2), np.ones(2), [0.3])
    phi = marks.features(x, 0)[:, :-1]
    assert np.allclose(phi @ phi.T, landmarks._kernel(x, x, 0.3))
    df = spark.createDataFrame([(p.tolist(),) for p in x], "x array<double>")
    assert marks.errors(df, "x").first()["kernel_error"] == pytest.approx(0, abs=1e-9)


def test_error_equals_numpy(frame, marks, rings):
    got = {r["gamma"]: r["kernel_error"] for r in marks.errors(frame.filter("key >= 0"), "x").collect()}
    z = (rings[0] - marks.mean) / marks.sd
    for g in marks.gammas:
        k = landmarks._kernel(z, marks.points, g)
        left = 1 - np.einsum("ij,jk,ik->i", k, np.linalg.pinv(landmarks._kernel(marks.points, marks.points, g), rcond=1e-10), k)
        assert got[g] == pytest.approx(left.mean(), abs=1e-6) and got[g] < 0.2


def test_solutions_are_stationary(machines, rings):
    """The slope of the objective, from the rows themselves."""
    x, y = rings
    side = np.where(y == 1, 1.0, -1.0)
    for (i, j, f), w in machines.weights.items():
        used = np.arange(len(x)) % 2 != f
        phi = machines.marks.features(x, i)
        short = np.maximum(0, 1 - side * (phi @ w)) * used
        slope = w * np.append(np.ones(len(w) - 1), 0) - 2 * machines.costs[j] * phi.T @ (side * short)
        assert np.abs(slope).max() <= 1e-5 * max(1, machines.costs[j] * used.sum())
    assert machines.passes < 40 and max(machines.slopes.values()) <= 1e-6


def test_planted_ring_is_found(frame, machines):
    scores = machines.out_of_fold(frame, "y", "key", "fold", "x").checkpoint()
    assert scores.count() == 6 * 901
    best = {r["model"]: r["f1"] for r in board.best_f1(scores, ["model"], "y").collect()}
    assert best["kernel_1_2"] > 0.95
    straight = frame.filter("y is not null").agg(F.avg("y")).first()[0]
    assert best["kernel_1_2"] > 2 * straight / (1 + straight) + 0.1  # all said to be inside


def test_out_of_fold_scores_equal_the_margin(frame, machines):
    for f in (0, 1):
        part = frame.filter(f"fold = {f}")
        want = {r["key"]: r["m"] for r in part.select("key", machines.margin(1, 2, f, "x").alias("m")).collect()}
        got = machines.out_of_fold(part, "y", "key", "fold", "x").filter("model = 'kernel_1_2'").collect()
        assert all(r["pred"] == pytest.approx(1 / (1 + np.exp(-want[r["key"]])), abs=1e-9) for r in got)


def test_fewer_rows_than_landmarks(spark):
    df = spark.createDataFrame([([1.0], 1), ([3.0], 0)] * 4, "x array<double>, y int").withColumn("fold", F.lit(0))
    mean, sd = landmarks.scales(df, "x")
    points = landmarks.chosen_landmarks(df, "x", 30, mean, sd)
    assert points.shape == (2, 1)
    got = landmarks.fit_grid(df, "y", "x", landmarks.Landmarks(points, mean, sd, [0.5]), [10.0], folds=1)
    margins = {r["x"][0]: r["m"] for r in df.select("x", got.margin(0, 0, 1, "x").alias("m")).collect()}
    assert margins[1.0] > 0 > margins[3.0]
