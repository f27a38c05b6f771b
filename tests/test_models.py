"""Models on data with a planted signal."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from churnlake.operators import evaluate, explain, models, prep, topics
from churnlake.session import checkpoint
from churnlake.sources import models as stored


def hashed(seed):
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(100_000)) / 100_000.0


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(2000).withColumnRenamed("id", "key").withColumns({
        "x1": hashed(1), "x2": hashed(2), "g": F.element_at(F.array(*map(F.lit, "abc")), (F.pmod(F.xxhash64("key", F.lit(3)), F.lit(3)) + 1).cast("int"))})
    signal = F.col("x1") + 0.5 * (F.col("g") == "a").cast("double") + (hashed(4) - 0.5) * 0.4
    df = df.withColumn("y", (signal > 0.8).cast("int"))
    pipeline = prep.feature_pipeline(["g"], ["x1", "x2"]).fit(df)
    return checkpoint(df), pipeline


@pytest.fixture(scope="module")
def ready(planted):
    df, pipeline = planted
    return checkpoint(pipeline.transform(df).select("key", "y", "features"))


@pytest.fixture(scope="module")
def xor(spark):
    df = spark.range(1200).withColumnRenamed("id", "key").withColumns({"x1": hashed(1) - 0.5, "x2": hashed(2) - 0.5})
    df = df.withColumn("y", (F.col("x1") * F.col("x2") > 0).cast("int"))
    pipeline = prep.feature_pipeline([], ["x1", "x2"]).fit(df)
    return checkpoint(pipeline.transform(df).select("key", "y", "features"))


def auc_on_rest(df, family, params=None):
    train, test = df.filter("key % 4 <> 0"), df.filter("key % 4 = 0")
    model = models.fit(family, train, "y", params)
    return evaluate.auc(model.score(test), "y", "pred").first()[0]


@pytest.mark.parametrize("family, params", [
    ("glm", {"lambda": 0.001}), ("nb", {}), ("gbm", {"trees": 10}), ("rf", {"trees": 10}), ("dt", {}),
    ("ada", {"trees": 4, "depth": 4})])
def test_families_find_the_signal(ready, family, params):
    assert auc_on_rest(ready, family, params) >= 0.8


def test_curved_models_beat_the_linear_one(xor):
    assert auc_on_rest(xor, "glm") < 0.6
    assert auc_on_rest(xor, "svm", {"gamma": 1.0}) > 0.85
    assert auc_on_rest(xor, "nn", {"hidden": (8,), "max_iter": 200}) > 0.85


def test_early_stopping_and_regression(ready):
    marked = ready.withColumn("check", F.col("key") % 5 == 0)
    model = models.fit("gbm", marked, "y", {"trees": 30, "validation_col": "check"})
    assert 1 <= len(model.model.trees) <= 30
    assert evaluate.auc(models.fit_regressor(ready, "y", {"trees": 5}).score(ready), "y", "pred").first()[0] > 0.8


def test_rules_and_importance(ready):
    assert "If (feature" in models.rules(models.fit("dt", ready, "y", {"depth": 2}))
    shares = models.importances(models.fit("rf", ready, "y", {"trees": 5}), ready)
    assert sum(s for _, s in shares) == pytest.approx(1.0)


def test_folds_are_stratified(ready):
    folds = models.add_folds(ready, "y", "key", 3)
    sizes = folds.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r.y == y]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_search_reports_and_stops(ready):
    found = models.search("dt", ready, "y", "key", models.grid(depth=[1, 4]), metric="auc")
    assert found.best.params["depth"] == 4
    assert found.report(ready.sparkSession).count() == 2
    draws = models.random_params(6, 1, alpha=lambda r: r.random())
    assert len({str(d) for d in draws}) == 6
    stopped = models.search("glm", ready, "y", "key", draws, stop_rounds=2, stop_tol=10.0)
    assert len(stopped.results) < 6


def test_stack_and_automl(ready):
    stacked = models.stack([("glm", {}), ("dt", {})], ready, "y", "key")
    scored = stacked.score(ready)
    assert {"key", "y", "features", "pred"} == set(scored.columns)
    assert evaluate.auc(scored, "y", "pred").first()[0] > 0.8
    best, board = models.automl(ready, "y", "key", [("glm", [{}]), ("dt", [{"depth": 1}])], max_secs=60)
    assert best.family == "glm" and len(board) == 2


def test_count_naive_bayes(planted):
    df, _ = planted
    model = models.CountNaiveBayes(["g"], ["x1", "x2"], "y").fit(df)
    scored = model.score(df, "key").join(df.select("key", "y"), "key")
    assert evaluate.auc(scored, "y", "pred").first()[0] > 0.8


def test_save_load_score(spark, planted, tmp_path):
    df, pipeline = planted
    model = models.fit("glm", pipeline.transform(df), "y")
    stored.save_model(spark, PipelineModel([*pipeline.stages, model.model]), 0.4, str(tmp_path))
    loaded, cut = stored.load_model(spark, str(tmp_path))
    a = {r.key: r.pred for r in model.score(pipeline.transform(df)).select("key", "pred").collect()}
    b = {r.key: r.pred for r in models.with_score(loaded.transform(df)).select("key", "pred").collect()}
    assert cut == 0.4 and a == pytest.approx(b)


def linear(df):
    return df.withColumn("pred", 0.2 + 0.5 * F.col("x1") - 0.1 * F.col("x2"))


def test_shapley_adds_up_and_equals_linear(planted):
    df, _ = planted
    rows = df.filter("key < 3")
    got = explain.shapley_sample(rows, df, linear, "key", ["x1", "x2"], n_background=30, n_orders=2)
    background = explain.seeded_sample(df, "key", 30, 1)
    exact = explain.linear_contributions(rows, background, "key", {"x1": 0.5, "x2": -0.1})
    a = {(r.key, r.feature): r.contribution for r in got.collect()}
    b = {(r.key, r.feature): r.contribution for r in exact.collect()}
    assert a == pytest.approx(b)


def test_permutation_importance_ranks_features(planted):
    df, _ = planted

    def scorer(d):
        return d.withColumn("pred", 1 / (1 + F.exp(-8 * (F.col("x1") - 0.6))))

    got = {r.feature: r.importance for r in explain.permutation_importance(df, scorer, "key", "y", ["x1", "x2"]).collect()}
    assert got["x1"] > 0.1 and got["x2"] == pytest.approx(0)


def test_partial_dependence_of_a_line(planted):
    df, _ = planted
    grid = explain.quantile_grid(df, "x1", 5)
    got = {r.x1: r.mean_pred for r in explain.partial_dependence(df, linear, "x1", grid).collect()}
    base = 0.2 - 0.1 * df.agg(F.avg("x2")).first()[0]
    assert got == pytest.approx({g: base + 0.5 * g for g in grid})


def test_pca_imputer_restores_rank_one(spark):
    rng = np.random.default_rng(5)
    full = np.outer(rng.normal(10, 3, 400), [1.0, 2.0, -1.0, 0.5])
    holes = rng.random(full.shape) < 0.05
    rows = [(i, *[None if h else float(v) for v, h in zip(r, hs)]) for i, (r, hs) in enumerate(zip(full, holes))]
    df = spark.createDataFrame(rows, "key int, a double, b double, c double, d double")
    model = prep.PcaImputer(list("abcd")).fit(df, "key")
    assert model.loadings.shape[1] >= 1
    filled = model.transform(df)
    assert filled.agg(F.max(prep.gaps(filled, list("abcd")))).first()[0] == 0
    got = np.array([r[1:] for r in sorted(filled.collect())])
    error = np.abs(got - full)[holes] / np.abs(full[holes])
    assert error.max() < 0.05
    assert np.allclose(got[~holes], full[~holes])


def test_imputer_falls_back_to_means(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i == 3 else float(i % 5)) for i in range(70)], "key int, a double, b double")
    filled = prep.PcaImputer(["a", "b"], rank=0).fit(df, "key").transform(df)
    mean = df.agg(F.avg("b")).first()[0]
    assert filled.filter("key = 3").first().b == pytest.approx(mean)


def two_vocabularies(spark):
    rng = random.Random(3)
    rows = [(d, f"{'xy'[d % 2]}{rng.randrange(12)}", 1.0) for d in range(100) for _ in range(14)]
    return spark.createDataFrame(rows, "doc int, term string, weight double").groupBy("doc", "term").agg(F.sum("weight").alias("weight"))


def test_lsa_equals_dense_svd(spark):
    long = two_vocabularies(spark)
    rows = long.collect()
    terms = sorted({r.term for r in rows})
    dense = np.zeros((100, len(terms)))
    for r in rows:
        dense[r.doc, terms.index(r.term)] = r.weight
    model = topics.lsa(long, "doc", k=2, n_iter=6)
    shuffled = topics.lsa(long, "doc", k=2, n_iter=6, max_broadcast=0, factor_bytes=0)
    assert max(model.residuals) <= 1e-3 and max(shuffled.residuals) <= 1e-2
    assert model.singular_values == pytest.approx(shuffled.singular_values)
    assert model.singular_values == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:2], rel=1e-4)
    projection = np.array([r[1:] for r in sorted(model.projection.collect())])
    loadings = {r.term: r[1:] for r in model.terms.collect()}
    v = np.array([loadings[t] for t in terms])
    assert np.allclose(dense @ v, projection, atol=1e-6)
    first_two = topics.topic_terms(model, 5).filter("topic in ('t0', 't1')").collect()
    assert all(len({r.term[0] for r in first_two if r.topic == t}) == 1 for t in ("t0", "t1"))
    flags = topics.flags(model, "doc", n=2)
    assert flags.columns == ["doc", "topic_0", "topic_1"]


def test_lsa_of_flat_spectra_and_of_all_components(spark):
    """Components of like strength, more components asked for than there are, and an empty table."""
    r = np.random.default_rng(5)
    dense = (r.random((300, 90)) < 0.1) * r.random((300, 90))
    long = spark.createDataFrame([(int(d), f"w{t:02d}", float(dense[d, t])) for d, t in zip(*dense.nonzero())], "doc int, term string, weight double")
    exact = np.linalg.svd(dense, compute_uv=False)
    model = topics.lsa(long, "doc", k=8, oversample=4, n_iter=20, tolerance=1e-6)
    assert max(model.residuals) <= 1e-6
    assert model.singular_values == pytest.approx(exact[:8], rel=1e-9)
    whole = topics.lsa(long, "doc", k=200, oversample=0)
    assert whole.singular_values == pytest.approx(exact, rel=1e-9)
    few = topics.lsa(long.filter("doc < 3"), "doc", k=5)
    assert few.singular_values == pytest.approx([*np.linalg.svd(dense[:3], compute_uv=False), 0, 0], abs=1e-6)
    assert few.residuals == pytest.approx([0] * 5, abs=1e-3)
    again = topics.lsa(long, "doc", k=8, oversample=4, n_iter=20, tolerance=1e-6)
    assert again.singular_values == pytest.approx(model.singular_values, rel=1e-9)


def test_lda_separates_vocabularies(spark):
    counts = two_vocabularies(spark).select("doc", "term", F.col("weight").cast("long").alias("tf"))
    got = topics.lda(counts, "doc", k=2, max_iter=30, n_terms=5).collect()
    by_topic = {t: {r.term[0] for r in got if r.topic == t} for t in (0, 1)}
    assert sorted(map(sorted, by_topic.values())) == [["x"], ["y"]]


def _same_scores(spark, model, df, path, key=None):
    from churnlake.sources import models as stored

    stored.save(spark, model, path, 0.6)
    loaded, threshold = stored.load(spark, path)
    assert threshold == 0.6

    def scores(m):
        out = m.score(df, key) if key else m.score(df)
        return sorted((r["k"], r["pred"]) for r in out.select("k", "pred").collect())

    assert scores(model) == scores(loaded)


def test_every_fitted_thing_survives_storage(spark, tmp_path):
    import numpy as np

    from churnlake.operators import models, prep
    from churnlake.sources import models as stored

    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), "xyz"[i % 3], int(a + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, t string, y int")
    ready = prep.feature_pipeline(["t"], ["a", "b"]).fit(df).transform(df).cache()
    for family, params in (("glm", {}), ("svm", {"dim": 20, "max_iter": 5}), ("ada", {"trees": 2, "depth": 3}), ("dt", {"depth": 2})):
        _same_scores(spark, models.fit(family, ready, "y", params), ready, f"{tmp_path}/{family}")
    stack = models.stack([("glm", {}), ("dt", {"depth": 2})], ready, "y", "k")
    _same_scores(spark, stack, ready, f"{tmp_path}/stack")
    for text, numbers in ((["t"], ["a"]), (["t"], []), ([], ["a"])):
        _same_scores(spark, models.CountNaiveBayes(text, numbers, "y").fit(df), df, f"{tmp_path}/nb{len(text)}{len(numbers)}", "k")
    holes = df.withColumn("a", F.when(F.col("k") % 5 > 0, F.col("a")))
    imputer = prep.PcaImputer(["a", "b"], rank=1).fit(holes, "k")
    stored.save(spark, imputer, f"{tmp_path}/imputer")
    again, _ = stored.load(spark, f"{tmp_path}/imputer")
    assert sorted(imputer.transform(holes).collect()) == sorted(again.transform(holes).collect())


def test_random_params_are_as_many_as_asked_for():
    import pytest

    from churnlake.operators import models

    assert len({repr(p) for p in models.random_params(6, 1, a=[1, 2], b=[1, 2, 3])}) == 6
    with pytest.raises(ValueError):
        models.random_params(7, 1, a=[1, 2], b=[1, 2, 3])
