"""Topics of large vocabularies: blocks of documents that get the rows of their terms."""

import numpy as np
import pytest

from churnlake.operators import topics


def test_a_round_moves_a_term_once_for_a_block(spark, monkeypatch):
    r = np.random.default_rng(3)
    dense = (r.random((400, 30)) < 0.5) * r.random((400, 30))
    long = spark.createDataFrame([(int(d), f"w{t:02d}", float(dense[d, t])) for d, t in zip(*dense.nonzero())], "doc int, term string, weight double")
    kept = []
    checkpoint = topics.checkpoint
    monkeypatch.setattr(topics, "checkpoint", lambda df: kept.append(checkpoint(df)) or kept[-1])
    model = topics.lsa(long, "doc", k=4, oversample=26, max_broadcast=0, factor_bytes=0, entries=500)
    blocks = -(-long.count() // 500)
    needs = [df for df in kept if df.columns == ["block", "id"]]
    assert len(needs) == 1 and needs[0].count() <= 30 * blocks < long.count() / 5
    assert needs[0].select("block").distinct().count() == blocks
    left, exact, right = np.linalg.svd(dense)
    assert model.singular_values == pytest.approx(exact[:4], rel=1e-9) and max(model.residuals) < 1e-6
    loadings = np.array([row[1:] for row in sorted(model.terms.collect())])
    assert np.allclose(np.abs(loadings.T), np.abs(right[:4]), atol=1e-6)
    assert np.allclose(np.array([row[1:] for row in sorted(model.projection.collect())]), dense @ loadings, atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, "a", 2.0)]])
def test_hardly_any_entries(spark, rows):
    long = spark.createDataFrame(rows, "doc int, term string, weight double")
    model = topics.lsa(long, "doc", k=2, factor_bytes=0)
    assert model.singular_values == pytest.approx([2.0] * len(rows))
    assert model.terms.count() == model.projection.count() == len(rows)
