"""Histogram boosting: first splits by hand, planted signals, sampling, early stop, equal reruns."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake.operators import boosting, evaluate, models, penalty, prep
from churnlake.session import checkpoint
from churnlake.sources import models as files


def hashed(seed):
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(100_000)) / 100_000.0


@pytest.fixture(scope="module")
def ready(spark):
    df = spark.range(1500).withColumnRenamed("id", "key").withColumns({"x1": F.floor(hashed(1) * 7).cast("double"), "x2": hashed(2) - 0.5, "x3": hashed(3) - 0.5})
    df = df.withColumn("y", ((F.col("x2") * F.col("x3") > 0) | (F.col("x1") > 5)).cast("int"))
    return checkpoint(models.add_folds(prep.feature_pipeline([], ["x1", "x2", "x3"]).fit(df).transform(df).select("key", "y", "features"), "y", "key", 2))


def test_first_split_by_hand(ready):
    got = boosting.boosted(ready, "y", "key", [{"trees": 1, "depth": 1, "rate": 1.0, "min_rows": 30, "bins": 16}], fold=None, held=0.0)[0][0]
    rows = ready.select(vector_to_array("features"), "y").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (-1.0, None)
    for f in range(3):
        for c in boosting.quantile_cuts(ready, 16)[f]:
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) >= 30:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
                if gain > best[0] + 1e-9:
                    best = (gain, (f, c, *(-g[s].sum() / (h[s].sum() + 1) for s in (left, ~left))))
    root, a, b = got.trees[0]
    assert (root[0], root[1]) == best[1][:2] and np.allclose([a[4], b[4]], best[1][2:])


def test_signal_sampling_and_equal_reruns(ready):
    candidates = [{"trees": 25, "depth": 3, "rate": 0.3, "sample": 0.7, "columns": 0.7, "columns_tree": 0.9, "columns_change": 1.05, "bins": 16},
                  {"trees": 12, "depth": 2, "rate": 0.3, "bins": 32}]
    out = boosting.boosted(ready, "y", "key", candidates)
    assert [len(m) for m in out] == [3, 3]
    for f in range(2):  # rows of the fold that the model has not seen
        assert evaluate.auc(out[0][f].score(ready.filter(F.col("fold") == f)), "y", "pred").first()[0] > 0.9
    again = boosting.boosted(ready, "y", "key", candidates)
    assert [len(t.trees) for c in again for t in c] == [len(t.trees) for c in out for t in c]
    a, b = (m[0][2].score(ready).select("key", "pred") for m in (out, again))
    assert a.join(b.withColumnRenamed("pred", "p"), "key").select(F.max(F.abs(F.col("pred") - F.col("p")))).first()[0] < 1e-6
    assert out[0][2].losses[0] > out[0][2].losses[-1]


def test_noise_stops_early_and_gain_bounds_splits(ready):
    noise = checkpoint(ready.withColumn("y", (F.pmod(F.xxhash64("key", F.lit(50)), F.lit(2))).cast("int")))
    out = boosting.boosted(noise, "y", "key", [{"trees": 60, "depth": 3, "rate": 0.3, "bins": 8}, {"trees": 3, "min_gain": 1.0, "bins": 8}], fold=None, held=0.2)
    assert len(out[0][0].trees) < 60
    assert all(len(t) == 1 for t in out[1][0].trees)


def test_stored_and_loaded(spark, ready, tmp_path):
    grown = boosting.boosted(ready, "y", "key", [{"trees": 2, "depth": 2, "bins": 8}], fold=None, held=0.0)[0][0]
    linear = penalty.penalty_path(ready, "y", [0.5], n_lambdas=3, folds=0).model(0, 2)
    stacked = models.Stacked([grown, linear], penalty.Linear(np.array([0.1, 2.0, 1.0]), {}))
    for name, model in (("boosted", grown), ("linear", linear), ("stacked", stacked)):
        files.save(spark, model, f"{tmp_path}/{name}", 0.4)
        again, threshold = files.load(spark, f"{tmp_path}/{name}")
        both = model.score(ready).select("key", "pred").join(again.score(ready).select("key", F.col("pred").alias("p")), "key")
        assert threshold == 0.4 and both.filter("pred <> p").count() == 0 and both.count() == ready.count()
