"""Penalty paths, stored scores, stacks and tree contributions on data with a planted signal."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake.operators import board, evaluate, models, penalty, prep, sums, tree_contributions
from churnlake.session import checkpoint


def hashed(seed):
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(100_000)) / 100_000.0


@pytest.fixture(scope="module")
def ready(spark):
    df = spark.range(1500).withColumnRenamed("id", "key").withColumns({
        **{f"x{i}": hashed(i) for i in range(1, 5)}, "g": F.element_at(F.array(*map(F.lit, "abc")), (F.pmod(F.xxhash64("key", F.lit(9)), F.lit(3)) + 1).cast("int"))})
    signal = F.col("x1") + 0.7 * F.col("x2") * F.col("x3") + 0.4 * (F.col("g") == "a").cast("double") + (hashed(7) - 0.5) * 0.5
    df = df.withColumn("y", (signal > 0.9).cast("int"))
    pipeline = prep.feature_pipeline(["g"], ["x1", "x2", "x3", "x4"]).fit(df)
    return checkpoint(models.add_folds(pipeline.transform(df).select("key", "y", "features"), "y", "key", 2))


ALPHAS = [0.0, 0.3, 0.9, 1.0]


@pytest.fixture(scope="module")
def path(ready):
    return penalty.penalty_path(ready, "y", ALPHAS, n_lambdas=8)


def test_solutions_are_stationary_and_paths_begin_empty(ready, path):
    chosen = list(itertools.product(range(4), range(8)))
    assert penalty.violations(path, ready, "y", chosen).agg(F.max("violation")).first()[0] < 1e-8
    assert (np.abs(path.coefficients[1:, 0, -1, 1:]) < 1e-9).all() and (path.coefficients[1:, -1, -1, 1:] != 0).any(axis=1).all()
    assert path.passes < 15  # for 96 solutions together


@pytest.mark.parametrize("alpha, step", [(0, 2), (1, 3), (2, 4), (3, 5)])
def test_same_solution_as_spark(ready, path, alpha, step):
    own = LogisticRegression(featuresCol="features", labelCol="y", regParam=float(path.lambdas[alpha, step]), elasticNetParam=ALPHAS[alpha], maxIter=500, tol=1e-12).fit(ready)
    both = path.model(alpha, step).score(ready).withColumnRenamed("pred", "p")
    both = own.transform(both).select(F.max(F.abs(F.col("p") - vector_to_array("probability")[1])))
    assert both.first()[0] < 2e-3  # Spark divides by the sample deviation


def test_folds_are_left_out(ready, path):
    for f in range(2):
        alone = penalty.penalty_path(ready.filter(F.col("fold") != f), "y", [0.3], n_lambdas=1, folds=0)
        assert alone.coefficients.shape == (1, 1, 1, path.coefficients.shape[3])
    store = penalty.out_of_fold(path, ready, "y", "key", [(1, 5), (2, 7)])
    want = {}
    rows = ready.select("key", "fold", vector_to_array("features").alias("x")).collect()
    for i, j in [(1, 5), (2, 7)]:
        for r in rows:
            raw = path.raw(i, j, r["fold"])
            want[f"glm_grid_model_{i}", r["key"]] = 1 / (1 + math.exp(-(raw[0] + np.dot(raw[1:], r["x"]))))
    got = {(r["model"], r["key"]): r["pred"] for r in store.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    loss = penalty.deviances(path, ready, "y")
    y = {r["key"]: r["y"] for r in ready.select("key", "y").collect()}
    mean = np.mean([-math.log(p if y[k] else 1 - p) for (m, k), p in want.items() if m.endswith("_1")])
    assert abs(loss[1, 5] - mean) < 1e-9


def test_sums_over_many_batches(spark):
    df = spark.range(10_000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x")).repartition(13)
    assert sums.array_sum(df, lambda b: sums.matrix(b.column(0)).sum(axis=0), 2).tolist() == [sum(range(10_000)), 10_000]
    assert sums.array_sum(df.filter("x[0] < 0"), lambda b: sums.matrix(b.column(0)).sum(axis=0), 2).tolist() == [0, 0]


def test_store_board_and_stack(spark, ready):
    candidates = [{"depth": 2}, {"depth": 4}]
    store = board.out_of_fold("dt", ready, "y", "key", candidates, 2)
    assert store.count() == 2 * ready.count() and store.select("model", "key").distinct().count() == store.count()
    again = models.fit("dt", ready.filter("fold <> 1"), "y", candidates[1]).score(ready.filter("fold = 1")).select("key", F.col("pred").alias("p"))
    assert store.filter("model = 'dt_grid_model_1' and fold = 1").join(again, "key").filter("pred <> p").count() == 0
    names = board.top(store, "y", 2)
    fitted = {n: models.fit("dt", ready, "y", candidates[int(n[-1])]) for n in names}
    stacked = board.stack(store, fitted, "y", "key")
    assert evaluate.auc(stacked.score(ready), "y", "pred").first()[0] > 0.85
    table = board.on_sets(fitted | {"stacked": stacked, "dt_cv_1": fitted[names[0]]}, {"train": ready.filter("key % 4 <> 0"), "test": ready.filter("key % 4 = 0")}, "y", "key")
    out = {r["modID"]: r for r in board.board(table, "y", max_gap=1, wide_gap=1).collect()}
    assert set(out) == {*names, "stacked"}
    rows = table.filter(F.col("model") == names[0]).collect()

    def f1(cut, s):
        mine = [(r["y"], round(r["pred"] * 1000 + 1e-9) >= cut) for r in rows if r["set"] == s]
        tp = sum(y and h for y, h in mine)
        return 2 * tp / (2 * tp + sum(bool(y) != h for y, h in mine))

    best = max(range(1001), key=lambda c: (f1(c, "train"), c))
    assert out[names[0]]["trainF1"] == pytest.approx(f1(best, "train")) and out[names[0]]["testF1"] == pytest.approx(f1(best, "test"))
    spoiled = table.withColumn("pred", F.when(F.col("key") == 3, F.lit(float("nan"))).otherwise(F.col("pred")))
    assert board.best_f1(spoiled, ["model", "set"], "y").count() == board.best_f1(table, ["model", "set"], "y").count()


def enumerated(trees, cover, values, x):
    """Shapley values by all subsets of features."""
    k = x.shape[1]

    def known(row, s):
        total, at = 0.0, 0
        for tree in trees:
            n = len(tree.leaves)
            for leaf, share, value in zip(tree.leaves, tree_contributions.shares(tree, cover[at:at + n]), values[at:at + n]):
                p = 1.0
                for f, z in share.items():
                    p *= float(leaf.takes(row[None], f)[0]) if f in s else z
                total += tree.weight * p * value
            at += n
        return total

    out = np.zeros_like(x)
    for i, row in enumerate(x):
        for j in range(k):
            rest = [f for f in range(k) if f != j]
            for size in range(k):
                w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                for s in itertools.combinations(rest, size):
                    out[i, j] += w * (known(row, {*s, j}) - known(row, set(s)))
    return out


@pytest.mark.parametrize("family, params", [("gbm", {"trees": 3, "depth": 3}), ("dt", {"depth": 3}), ("rf", {"trees": 3, "depth": 3})])
def test_contributions_equal_all_subsets(ready, family, params):
    model = models.fit(family, ready, "y", params)
    told = tree_contributions.explain_trees(model, ready, "y")
    x = np.array([r[0] for r in ready.select(vector_to_array("features")).limit(12).collect()])
    got = tree_contributions.contributions_of(told.trees, told.cover, told.values, x)
    assert np.allclose(got, enumerated(told.trees, told.cover, told.values, x), atol=1e-12)
    assert all(n > 0 for n in told.cover) and told.cover[:len(told.trees[0].leaves)].sum() == ready.count()
    names = tree_contributions.column_names(ready)
    out = tree_contributions.tree_contributions(ready, told, "key", names)
    assert {r[0] for r in out.select("feature").distinct().collect()} == set(names.values()) and "g" in names.values()
    total = out.groupBy("key").agg(F.sum("contribution").alias("t")).agg(F.avg("t")).first()[0]
    assert abs(total) < 1e-9  # contributions of the background itself add up to nothing
    if family == "dt":
        scored = model.score(ready).join(out.groupBy("key").agg(F.sum("contribution").alias("t")), "key")
        assert scored.select(F.max(F.abs(F.col("pred") - F.col("t") - told.base))).first()[0] < 1e-9


def test_start_on_a_part_of_the_rows_gives_the_same_solutions(ready, path, monkeypatch):
    """Also where the part is a poor guide, each solution is stationary on all rows."""
    monkeypatch.setattr(penalty, "START", 400)
    other = penalty.penalty_path(ready, "y", ALPHAS, n_lambdas=8)
    assert np.allclose(other.lambdas, path.lambdas) and np.allclose(other.coefficients, path.coefficients, atol=1e-6)
    monkeypatch.setattr(penalty, "ENOUGH", 10 ** 9)  # too few rows to start from
    third = penalty.penalty_path(ready, "y", ALPHAS, n_lambdas=8)
    assert np.array_equal(third.coefficients, path.coefficients)


def test_few_passes_over_many_rows(spark, monkeypatch):
    """A start on a part of the rows leaves a few passes of gradients over all of them."""
    df = spark.range(40_000).withColumnRenamed("id", "key").withColumns({f"x{i}": hashed(i) for i in range(1, 4)})
    df = df.withColumn("y", (F.col("x1") + hashed(8) > 1.0).cast("int"))
    many = checkpoint(models.add_folds(prep.feature_pipeline([], ["x1", "x2", "x3"]).fit(df).transform(df).select("key", "y", "features"), "y", "key", 2))
    monkeypatch.setattr(penalty, "START", 8_000)
    path = penalty.penalty_path(many, "y", ALPHAS, n_lambdas=8)
    assert path.passes <= 8
    assert penalty.violations(path, many, "y", list(itertools.product(range(4), range(8)))).agg(F.max("violation")).first()[0] < 1e-8
