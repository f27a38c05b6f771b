"""The imputer on rows whose gaps hardly ever repeat, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import prep

COLS = [f"c{i}" for i in range(12)]


def by_pattern(z, loadings, ridge):
    """Each row on its own: least squares on its seen columns."""
    out = np.where(np.isnan(z), 0.0, z)
    for row, full in zip(z, out):
        gap = np.isnan(row)
        seen = loadings[~gap]
        score = np.linalg.solve(seen.T @ seen + ridge * np.eye(loadings.shape[1]), seen.T @ row[~gap])
        full[gap] = loadings[gap] @ score
    return out


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 2)) @ r.normal(size=(2, 12)) + 0.05 * r.normal(size=(1500, 12))
    return x, r.random(x.shape) < 0.2


@pytest.fixture(scope="module")
def frame(spark, table):
    x, gap = table
    rows = [(i, *[None if g else float(v) for v, g in zip(a, b)]) for i, (a, b) in enumerate(zip(x, gap))]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{c} double" for c in COLS)).repartition(4)


def test_rows_are_filled_one_by_one(table):
    x, gap = table
    z = np.where(gap, np.nan, x)
    z[3] = np.nan  # nothing seen
    loadings = np.linalg.qr(np.random.default_rng(1).normal(size=(12, 3)))[0]
    assert np.allclose(prep._impute(z, loadings, 1e-3), by_pattern(z, loadings, 1e-3))


@pytest.mark.parametrize("cells", [0, prep.PATTERN_CELLS])
def test_fit_equals_numpy(frame, table, monkeypatch, cells):
    """Rows read in each round, or sums by pattern: 12 rounds lead to the same loadings."""
    monkeypatch.setattr(prep, "PATTERN_CELLS", cells)
    x, gap = table
    z = np.where(gap, np.nan, x)
    mean, sd = np.nanmean(z, axis=0), np.nanstd(z, axis=0)
    z = (z - mean) / sd
    loadings = np.zeros((12, 0))
    for _ in range(12):
        filled = by_pattern(z, loadings, 1e-3) if loadings.shape[1] else np.where(gap, 0.0, z)
        new = np.linalg.eigh(filled.T @ filled)[1][:, ::-1][:, :2]
        loadings = new
    got = prep.PcaImputer(COLS, rank=2, max_iter=11, tol=0).fit(frame, "key").loadings
    assert np.allclose(got @ got.T, loadings @ loadings.T, atol=1e-6)


def test_planted_rank_is_chosen_and_restored(frame, table):
    x, gap = table
    model = prep.PcaImputer(COLS, max_rank=3, max_iter=25).fit(frame, "key")
    assert model.loadings.shape[1] == 2
    filled = np.array(model.transform(frame).sort("key").select(*COLS).collect())
    assert np.abs(filled - x)[gap].mean() < 0.1 and np.array_equal(filled[~gap], x[~gap])


def test_ranks_tried_together_equal_ranks_tried_alone(frame, monkeypatch):
    monkeypatch.setattr(prep, "PATTERN_CELLS", 0)
    fit = prep.PcaImputer(COLS, max_iter=5)
    cells = frame.select(F.xxhash64("key").alias("_h"), *COLS)
    zero, one = np.zeros(12), np.ones(12)
    together = fit._fitted(cells, zero, one, [1, 3], True)
    for r in (1, 3):
        alone = fit._fitted(cells, zero, one, [r], True)[r]
        assert np.allclose(together[r] @ together[r].T, alone @ alone.T, atol=1e-6)


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "key long, a double, b double")
    got = prep.PcaImputer(["a", "b"]).fit(df, "key").transform(df).sort("key").select("a", "b").collect()
    assert [tuple(r) for r in got] == [(0.0, 2.0), (0.0, 2.0)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "key long, a double, b double")
    assert prep.PcaImputer(["a", "b"]).fit(df, "key").transform(df).count() == 0
