"""Kernel machines: rows cross to numpy without a Python object each, and machines with the same rows inside share their products."""

import numpy as np

from churnlake.operators import landmarks, side_by_side


def test_machines_with_the_same_rows_inside_share_products(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(p.tolist(), float(i % 2), i % 3) for i, p in enumerate(r.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "x array<double>, y double, fold int").coalesce(1)
    marks = landmarks.Landmarks(r.normal(size=(5, 2)), np.zeros(2), np.ones(2), [0.3])
    cells = {(0, j, f): np.zeros(6) for j in range(4) for f in range(3)}
    called = []

    def summed(frame, of, size):
        batch = frame.toArrow().to_batches()[0]
        concatenate = np.concatenate
        monkeypatch.setattr(np, "concatenate", lambda *a, **k: called.append(1) or concatenate(*a, **k))
        out = of(batch)
        monkeypatch.setattr(np, "concatenate", concatenate)
        return out

    monkeypatch.setattr(landmarks, "array_sum", summed)
    got = landmarks._sums(df, "x", marks, cells)
    assert len(called) == 3  # a product for each fold, not for each of 12 machines
    x, y, fold = (np.array(c) for c in zip(*rows))
    phi, side = marks.features(x, 0), np.where(y > 0.5, 1.0, -1.0)
    for (_, _, f), (loss, n, inside, pull) in got.items():
        own = fold != f
        assert loss == n == own.sum() and np.allclose(inside, phi[own].T @ phi[own]) and np.allclose(pull, phi[own].T @ side[own])


def test_first_points_are_the_least_hashes(spark):
    points = spark.createDataFrame([([float(i % 40), float(i % 7)],) for i in range(600)], "point array<double>").repartition(5)
    one = side_by_side.first_points(points, 4, 3, 1)
    assert one.shape == (3, 4, 2) and np.array_equal(side_by_side.first_points(points, 30, 3, 1)[:, :4], one)
