"""Predictions of many models kept by model id, key and fold; leaderboard and stack read them instead of fitting again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.operators import models
from churnlake.operators.ranking import is_number
from churnlake.session import stored

CUTS = 1000     # thresholds of the F1 of a board: scores are rounded to so many parts


def out_of_fold(family: str, folded: DataFrame, label: str, key: str, candidates: Sequence[Mapping], folds: int, fold: str = "fold",
                parallelism: int = 8) -> DataFrame:
    """``(model, fold, key, label, pred)``: each candidate's score of each row, by the model that has not seen its fold.

    Candidate ``i`` is named ``<family>_grid_model_<i>``. Models train side by side; their scores are
    written out, so nothing is fitted again when they are read.
    """
    def one(task: tuple[int, Mapping, int]) -> DataFrame:
        i, params, f = task
        model = models.fit(family, folded.filter(F.col(fold) != f), label, params)
        scored = model.score(folded.filter(F.col(fold) == f))
        return stored(scored.select(F.lit(f"{family}_grid_model_{i}").alias("model"), fold, key, label, F.col("pred").cast("double").alias("pred")), "scores")

    tasks = [(i, p, f) for i, p in enumerate(candidates) for f in range(folds)]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return together(pool.map(inheritable_thread_target(folded.sparkSession)(one), tasks))


def on_sets(fitted: Mapping[str, object], sets: Mapping[str, DataFrame], label: str, key: str) -> DataFrame:
    """``(model, set, key, label, pred)`` of fitted models on whole sets."""
    return stored(together([
        m.score(df).select(F.lit(name).alias("model"), F.lit(s).alias("set"), key, label, F.col("pred").cast("double").alias("pred"))
        for name, m in fitted.items() for s, df in sets.items()]), "scores")


def together(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cut_counts(scores: DataFrame, by: Sequence[str], label: str, pred: str = "pred") -> DataFrame:
    """``(by, cut, n, pos, tp, fp, fn)``: per threshold of a grid, the counts of scores at or above it.

    Rows without label or score (NULL or NaN) count nowhere. One row per model and cut, so the running
    sums see ``CUTS`` rows a model at most.
    """
    known = scores.filter(F.col(label).isNotNull() & is_number(pred))
    counted = known.groupBy(*by, F.round(F.col(pred) * CUTS).cast("int").alias("cut")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    down = Window.partitionBy(*by).orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"tp": F.sum("pos").over(down), "all_": F.sum("n").over(down), "positives": F.sum("pos").over(Window.partitionBy(*by))})
    return run.select(*by, "cut", "n", "pos", "tp", (F.col("all_") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"))


def best_f1(scores: DataFrame, by: Sequence[str], label: str, pred: str = "pred") -> DataFrame:
    """``(by, cut, f1)``: the highest threshold with the best F1 of each model."""
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    best = cut_counts(scores, by, label, pred).groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), F.col("cut"))).alias("b"))
    return best.select(*by, "b.cut", "b.f1")


def board(scores: DataFrame, label: str, train: str = "train", test: str = "test", max_gap: float = 0.025, wide_gap: float = 0.05) -> DataFrame:
    """Leaderboard of scored sets: each model's threshold is best for the training set and judged on both."""
    cut = best_f1(scores.filter(F.col("set") == train), ["model"], label).select("model", F.col("cut").alias("best"))
    known = scores.filter(F.col(label).isNotNull() & is_number("pred")).join(F.broadcast(cut), "model")  # one row per model
    hit, yes = F.round(F.col("pred") * CUTS) >= F.col("best"), F.col(label) == 1

    def f1(s: str):
        tp, wrong = F.count(F.when((F.col("set") == s) & yes & hit, 1)), F.count(F.when((F.col("set") == s) & (yes != hit), 1))
        return F.try_divide(2 * tp, 2 * tp + wrong)

    results = known.groupBy(F.col("model").alias("modID")).agg(f1(train).alias("trainF1"), f1(test).alias("testF1"))
    return models.leaderboard(results, max_gap, wide_gap)


def top(scores: DataFrame, label: str, n: int) -> list[str]:
    """Names of the best models of a store of out-of-fold scores by F1; ties by name."""
    return [r["model"] for r in best_f1(scores, ["model"], label).orderBy(F.desc("f1"), "model").limit(n).collect()]  # n names


def stacked_features(scores: DataFrame, names: Sequence[str], label: str, key: str) -> DataFrame:
    """``(key, label, features)``: the out-of-fold scores of the named models side by side, one row per key."""
    wide = scores.filter(F.col("model").isin(list(names))).groupBy(key, label).pivot("model", list(names)).agg(F.first("pred"))
    return wide.select(key, label, array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.5)) for c in names])).alias(models.FEATURES))


def stack(scores: DataFrame, fitted: Mapping[str, object], label: str, key: str, meta: str = "glm", params: Mapping | None = None) -> models.Stacked:
    """Fitted models (by name) combined by a model of their stored out-of-fold scores; no base model is fitted again."""
    names = list(fitted)
    chief = models.fit(meta, stored(stacked_features(scores, names, label, key), "stack"), label, params or {"lambda": 0.0, "alpha": 0.0})
    return models.Stacked([fitted[n] for n in names], chief)
