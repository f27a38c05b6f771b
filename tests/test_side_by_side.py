"""Runs of k-means moved side by side, against numpy and against Spark's own evaluator."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnlake.operators import side_by_side
from churnlake.operators.levels import LevelGrouper


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.2, (20, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    x[5] = x[4]  # equal points
    return x, r.integers(1, 9, len(x)).astype(float)


@pytest.fixture(scope="module")
def points(spark, cloud):
    rows = [(p.tolist(), w) for p, w in zip(cloud[0], cloud[1].tolist())]
    return spark.createDataFrame(rows, "point array<double>, weight double").repartition(3).checkpoint()


def lloyd(x, w, centres, rounds=100):
    for _ in range(rounds):
        at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([np.average(x[at == i], axis=0, weights=w[at == i]) if (at == i).any() else c for i, c in enumerate(centres)])
    far = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
    return centres, (w * far).sum()


def test_all_runs_equal_lloyd_from_the_same_points(points, cloud):
    x, w = cloud
    sizes, starts = [2, 3, 4, 6], 5
    first = side_by_side.first_points(points, max(sizes), starts, 9)
    assert first.shape == (5, 6, 2) and all(len(np.unique(f, axis=0)) == 6 for f in first)
    got = side_by_side.best_centres(points, sizes, starts, 9)
    for k in sizes:
        runs = [lloyd(x, w, first[s, :k]) for s in range(starts)]
        best = min(runs, key=lambda r: round(r[1], 9))[0]
        assert np.allclose(got[k], best[np.lexsort(best.T[::-1])])


def test_waves_change_nothing(points, monkeypatch):
    whole = side_by_side.best_centres(points, [2, 3, 4, 5], 4, 1)
    scores = side_by_side.silhouettes(points, whole)
    monkeypatch.setattr(side_by_side, "waves", lambda sizes, starts: ([k] for k in sorted(sizes)))
    single = side_by_side.best_centres(points, [2, 3, 4, 5], 4, 1)
    assert all(np.allclose(whole[k], single[k]) for k in whole)
    assert np.allclose(scores, side_by_side.silhouettes(points, whole))


def test_waves_hold_the_bound():
    assert list(side_by_side.waves([2, 3, 4, 50, 5], 10, 100)) == [[2, 3, 4], [5], [50]]


def test_silhouettes_equal_the_evaluator(points):
    centres = side_by_side.best_centres(points, [2, 3, 4, 7], 4, 1)
    judge = ClusteringEvaluator(featuresCol="v", predictionCol="cluster", weightCol="weight")
    for k, s in side_by_side.silhouettes(points, centres):
        dealt = side_by_side.assigned(points, centres[k]).withColumn("v", array_to_vector("point"))
        assert s == pytest.approx(judge.evaluate(dealt), abs=1e-9)


def test_planted_clouds_are_found(points):
    centres = side_by_side.best_centres(points, range(2, 10), 25, 2022)
    scores = side_by_side.silhouettes(points, centres)
    assert max(scores, key=lambda r: r[1])[0] == 4


def test_one_cluster_has_no_silhouette(spark):
    same = spark.createDataFrame([([1.0, 1.0], 1.0)] * 4, "point array<double>, weight double")
    assert side_by_side.silhouettes(same, {2: np.array([[1.0, 1.0], [9.0, 9.0]])}) == []


def test_grouper_on_few_levels(spark):
    def fit(rows):
        df = spark.createDataFrame(rows, "g string, y int")
        return {r.level: r.group for r in LevelGrouper("g", "y").fit(df).collect()}

    assert fit([]) == {}
    assert fit([("a", 1)]) == {"a": "a"}
    assert fit([("a", 1), (None, None)] * 9) == {"a": "NA|a", "NA": "NA|a"}
    # Equal points form one group, however many clusters are asked for.
    df = spark.createDataFrame([(g, 1) for g in "abc"] * 5, "g string, y int")
    assert len({r.group for r in LevelGrouper("g", "y", k=2).fit(df).collect()}) == 1


def test_reruns_agree(spark):
    df = spark.range(4000).select(F.concat(F.lit("l"), F.col("id") % 17).alias("g"), (F.xxhash64("id") % 3 == 0).cast("int").alias("y"))
    assert LevelGrouper("g", "y").fit(df).sort("level").collect() == LevelGrouper("g", "y").fit(df.repartition(5)).sort("level").collect()
