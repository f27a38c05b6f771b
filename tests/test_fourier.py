"""Random Fourier features: the formula, and rows that cross to numpy as Arrow buffers."""

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from churnlake.operators import models


def test_features_equal_the_formula(spark):
    x = np.random.default_rng(6).normal(size=(50, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "key long, x array<double>").select("key", array_to_vector(F.col("x")).alias("features"))
    out = models.fourier_features(0.5, 7, 2, 3)(df.repartition(60, "key"))  # some partitions are empty
    rng = np.random.default_rng(2)
    weights, phase = rng.normal(0.0, 1.0, (3, 7)), rng.uniform(0, 2 * math.pi, 7)
    got = np.array([r[1] for r in sorted(out.select("key", vector_to_array("_fourier")).collect())])
    assert np.allclose(got, math.sqrt(2 / 7) * np.cos(x @ weights + phase), atol=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and ", 250" in plan  # an Arrow function, not one of pandas Series
