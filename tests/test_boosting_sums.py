"""Boosting adds up histograms of the features that a tree may use, and walks trees as node by node."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnlake.operators import boosting


def test_only_features_of_the_tree_are_added_up(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, int(x[0] + x[3] > 0), x.tolist()) for i, x in enumerate(r.normal(size=(400, 4)))]
    df = spark.createDataFrame(rows, "key long, y int, x array<double>").select("key", "y", array_to_vector(F.col("x")).alias("features"))
    sizes = []
    array_sum = boosting.array_sum
    monkeypatch.setattr(boosting, "array_sum", lambda frame, of, size: sizes.append(size) or array_sum(frame, of, size))
    first = {}
    for share in (0.5, 1.0):
        sizes.clear()
        grown = boosting.boosted(df, "y", "key", [{"trees": 2, "depth": 1, "bins": 8, "columns_tree": share, "min_rows": 5}], fold=None)[0][0]
        first[share] = sizes[1] - 2  # held-out loss and rows come first
    assert first[1.0] == 2 * first[0.5]
    assert len(grown.trees) == 2 and all(len(t) == 3 for t in grown.trees)


def test_rows_come_to_the_leaf_of_the_rules():
    tree = [boosting.Node(0.0, 1, 0.0, 2, 1, 2), boosting.Node(1.5), boosting.Node(0.0, 0, 0.0, 4, 3, 4), boosting.Node(2.5), boosting.Node(3.5)]
    bins = np.array([[0, 2], [4, 3], [5, 3], [9, 0]], np.uint16)
    assert boosting._leaf_of(tree, bins.T).tolist() == [1, 3, 4, 1]
    assert boosting._grown(tree, bins.T).tolist() == [1.5, 2.5, 3.5, 1.5]
    assert boosting._grown([boosting.Node(7.0)], bins.T).tolist() == [7.0] * 4
