"""Kernel machines of a search, fitted side by side, are those that Spark ML fits one by one."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnlake.operators import margins, models
from churnlake.operators.sums import array_sum
from churnlake.sources import models as stored


def points(spark, n=600):
    r = np.random.default_rng(8)
    x = np.column_stack([r.normal(size=(n, 2)), r.integers(0, 2, n)])
    y = (x[:, 0] * x[:, 1] + 0.4 * r.normal(size=n) > 0).astype(int)
    rows = [(i, p.tolist(), int(v), i % 2) for i, (p, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, x array<double>, y int, fold int").select("key", "y", "fold", array_to_vector(F.col("x")).alias("features")).cache()


def test_machines_equal_those_of_spark(spark):
    df = points(spark)
    candidates = [{"gamma": 0.3, "dim": 20, "reg": 0.1, "max_iter": 8}, {"gamma": 2.0, "dim": 10, "max_iter": 5}]
    found = margins.side_by_side(df, "y", candidates, 2, 3)
    assert sorted(found) == [(i, s) for i in range(2) for s in range(3)]
    for i, s in [(0, 1), (0, 2), (1, 2)]:
        machine = found[i, s]
        one = models.fit("svm", df.filter(F.col("fold") != s), "y", candidates[i])
        assert np.allclose(machine.weights, one.model.coefficients.toArray(), atol=1e-7) and abs(machine.threshold - one.model.intercept) < 1e-7
        scored = zip(*(m.score(df).orderBy("key").select("pred").collect() for m in (machine, one)))
        assert max(abs(a.pred - b.pred) for a, b in scored) < 1e-7


def test_a_search_makes_features_in_shared_passes(spark, monkeypatch, tmp_path):
    df = points(spark).drop("fold")
    passes = []
    monkeypatch.setattr(margins, "array_sum", lambda *a: passes.append(a[2]) or array_sum(*a))
    monkeypatch.setattr(models, "fit", None)  # no machine is fitted by itself
    found = models.search("svm", df, "y", "key", models.grid(gamma=[0.3, 2.0], dim=[20], max_iter=[6]))
    assert len(found.results) == 2 and 6 < len(passes) < 30
    stored.save(spark, found.best, f"{tmp_path}/best")
    again, _ = stored.load(spark, f"{tmp_path}/best")
    scores = [[r.pred for r in m.score(df).orderBy("key").select("pred").collect()] for m in (found.best, again)]
    assert scores[0] == scores[1] and np.mean([(p > 0.5) == bool(r.y) for p, r in zip(scores[0], df.orderBy("key").collect())]) > 0.6
