"""Classifiers, their search and their comparison, all trained by Spark ML.

Training rows carry a ``features`` vector and a 0/1 label. A fitted model is an
object with ``score(df)``, which adds ``pred``, the score of the positive class.

Spark ML has no kernel machine, drop-out or per-level column sampling: the
radial kernel is approximated by random Fourier features and the network has
layers only.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    NaiveBayes, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import evaluate, margins
from churnlake.operators.ranking import shuffled_position
from churnlake.operators.sums import matrix
from churnlake.session import broadcast_if_small, checkpoint

FEATURES = "features"
OWN_COLUMNS = ("rawPrediction", "probability", "prediction")


# --- fitted models -----------------------------------------------------------------

def with_score(df: DataFrame, name: str = "pred") -> DataFrame:
    """Turn the columns of a Spark ML classifier into one score column."""
    if "probability" in df.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in df.columns:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    else:
        score = F.col("prediction")
    return df.withColumn(name, score).drop(*OWN_COLUMNS)


@dataclass
class Fitted:
    family: str
    params: dict
    model: Model
    before: Callable[[DataFrame], DataFrame] | None = None

    def score(self, df: DataFrame) -> DataFrame:
        ready = self.before(df) if self.before else df
        return with_score(self.model.transform(ready)).drop("_fourier")


def fourier_features(gamma: float, dim: int, seed: int, n_inputs: int) -> Callable[[DataFrame], DataFrame]:
    """Random cosine features whose inner products approximate a radial kernel."""
    of = margins.draws(gamma, dim, seed, n_inputs)

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        made = margins.cosines(matrix(x).reshape(len(x), n_inputs), of)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(made.ravel()))

    return lambda df: df.withColumn("_fourier", array_to_vector(project(vector_to_array(FEATURES))))


def before_model(family: str, params: Mapping) -> Callable[[DataFrame], DataFrame] | None:
    """What a family does to the rows before its model; it depends on the parameters only."""
    if family != "svm":
        return None
    return fourier_features(params["gamma"], params["dim"], params["seed"], params["n_inputs"])


def n_features(df: DataFrame) -> int:
    meta = df.schema[FEATURES].metadata.get("ml_attr", {})
    return meta.get("num_attrs") or df.select(FEATURES).first()[0].size


def fit(family: str, train: DataFrame, label: str, params: Mapping | None = None) -> Fitted | "AdaBoost":
    """Train one model of a family: glm, nb, svm, gbm, rf, dt, ada or nn."""
    p = dict(params or {})
    io = {"featuresCol": FEATURES, "labelCol": label}
    before = None
    if family == "ada":
        return AdaBoost(label, **p).fit(train)
    if family == "glm":
        estimator = LogisticRegression(**io, maxIter=p.get("max_iter", 50), regParam=p.get("lambda", 0.01),
                                       elasticNetParam=p.get("alpha", 0.5))
    elif family == "nb":
        estimator = NaiveBayes(**io, modelType=p.get("kind", "gaussian"), smoothing=p.get("laplace", 1.0))
    elif family == "svm":
        size = n_features(train)
        p |= {"gamma": p.get("gamma", 1.0 / size), "dim": p.get("dim", 100), "seed": p.get("seed", 1), "n_inputs": size}
        before = before_model(family, p)
        estimator = LinearSVC(featuresCol="_fourier", labelCol=label, maxIter=p.get("max_iter", 50),
                              regParam=p.get("reg", 1e-3), standardization=False)
    elif family == "gbm":
        estimator = GBTClassifier(
            **io, maxIter=p.get("trees", 20), maxDepth=p.get("depth", 4), stepSize=p.get("rate", 0.1),
            subsamplingRate=p.get("sample", 1.0), minInstancesPerNode=p.get("min_rows", 1), maxBins=p.get("bins", 32),
            featureSubsetStrategy=str(p.get("columns", "all")), seed=p.get("seed", 1))
        if "validation_col" in p:
            estimator = estimator.setValidationIndicatorCol(p["validation_col"])
            estimator = estimator.setParams(validationTol=p.get("stop_tol", 0.01))
    elif family == "rf":
        estimator = RandomForestClassifier(
            **io, numTrees=p.get("trees", 50), maxDepth=p.get("depth", 6), seed=p.get("seed", 1),
            minInstancesPerNode=p.get("min_rows", 1), impurity=p.get("impurity", "gini"))
    elif family == "dt":
        estimator = DecisionTreeClassifier(
            **io, maxDepth=p.get("depth", 5), minInstancesPerNode=p.get("min_rows", 1),
            impurity=p.get("impurity", "gini"), seed=p.get("seed", 1))
    elif family == "nn":
        layers = [n_features(train), *p.get("hidden", (8,)), 2]
        estimator = MultilayerPerceptronClassifier(
            **io, layers=layers, maxIter=p.get("max_iter", 100), seed=p.get("seed", 1), blockSize=128)
    else:
        raise ValueError(f"unknown family {family}")
    return Fitted(family, p, estimator.fit(before(train) if before else train), before)


def fit_regressor(train: DataFrame, target: str, params: Mapping | None = None) -> Fitted:
    """Boosted regression trees; ``pred`` is the predicted value."""
    p = dict(params or {})
    estimator = GBTRegressor(featuresCol=FEATURES, labelCol=target, maxIter=p.get("trees", 20),
                             maxDepth=p.get("depth", 4), stepSize=p.get("rate", 0.1), seed=p.get("seed", 1))
    return Fitted("gbm_regressor", p, estimator.fit(train))


def rules(model: Fitted) -> str:
    """A decision tree as indented if-else text."""
    return model.model.toDebugString


def importances(model: Fitted, df: DataFrame) -> list[tuple[str, float]]:
    """Feature names with their share in a tree model's splits."""
    attrs = df.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    shares = model.model.featureImportances
    return sorted(((names.get(i, str(i)), float(shares[i])) for i in range(shares.size)), key=lambda x: -x[1])


class AdaBoost:
    """Weighted decision trees: rows the last tree missed count more for the next.

    Row weights live in a column; every few rounds they are written out so that
    the plan stays short.
    """

    family = "ada"

    def __init__(self, label: str, trees: int = 10, depth: int = 10, rate: float = 1.0, seed: int = 1):
        self.label, self.trees, self.depth, self.rate, self.seed = label, trees, depth, rate, seed
        self.params = {"trees": trees, "depth": depth, "rate": rate}
        self.stages: list[tuple[Model, float]] = []

    def fit(self, train: DataFrame) -> "AdaBoost":
        data = checkpoint(train.select(FEATURES, F.col(self.label).alias("_y")).withColumn("_w", F.lit(1.0)))
        for i in range(self.trees):
            tree = DecisionTreeClassifier(
                featuresCol=FEATURES, labelCol="_y", weightCol="_w", maxDepth=self.depth, seed=self.seed + i).fit(data)
            scored = tree.transform(data)
            missed = F.when(F.col("prediction") != F.col("_y"), F.col("_w")).otherwise(0.0)
            error = scored.agg(F.sum(missed) / F.sum("_w")).first()[0]
            if error >= 0.5:
                break
            say = self.rate * math.log((1 - error) / max(error, 1e-10))
            self.stages.append((tree, say))
            if error <= 1e-10:
                break
            grown = F.when(F.col("prediction") != F.col("_y"), F.col("_w") * math.exp(say)).otherwise(F.col("_w"))
            data = scored.select(FEATURES, "_y", grown.alias("_w"))
            if i % 3 == 2:
                data = checkpoint(data)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """``pred`` is the weighted share of trees that vote for the positive class."""
        total = sum(s for _, s in self.stages) or 1.0
        out = df.withColumn("_votes", F.lit(0.0))
        for tree, say in self.stages:
            out = tree.transform(out).withColumn("_votes", F.col("_votes") + F.col("prediction") * say).drop(*OWN_COLUMNS)
        return out.withColumn("pred", F.col("_votes") / total).drop("_votes")


class CountNaiveBayes:
    """Naive Bayes from group counts, for text and number columns side by side.

    The model is a table of log probabilities per column, level and class; rows
    are scored by joining their unpivoted columns to it.
    """

    def __init__(self, text_cols: Sequence[str], number_cols: Sequence[str], label: str, laplace: float = 1.0):
        self.text_cols, self.number_cols, self.label, self.laplace = list(text_cols), list(number_cols), label, laplace

    def fit(self, train: DataFrame) -> "CountNaiveBayes":
        y = self.label
        self.prior = train.agg(F.log(F.sum(y) / F.sum(1 - F.col(y))).alias("prior")).scalar()
        if self.text_cols:
            long = train.select(y, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in self.text_cols]).unpivot(
                [y], self.text_cols, "column", "level")
            counts = long.groupBy("column", "level").agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
            sizes = counts.groupBy("column").agg(
                F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count(F.lit(1)).alias("n_levels"))
            a = self.laplace
            odds = (F.log((F.col("pos") + a) / (F.col("all_pos") + a * F.col("n_levels")))
                    - F.log((F.col("neg") + a) / (F.col("all_neg") + a * F.col("n_levels"))))
            self.levels = counts.join(F.broadcast(sizes), "column").select("column", "level", odds.alias("odds"))
        if self.number_cols:
            cls = F.when(F.col(y) == 1, "pos").otherwise("neg")
            stats = [
                x for c in self.number_cols for k in ("pos", "neg")
                for x in (F.avg(F.when(cls == k, F.col(c))).alias(f"{c}_{k}_mean"),
                          F.stddev(F.when(cls == k, F.col(c))).alias(f"{c}_{k}_sd"))]
            self.moments = train.agg(F.struct(*stats)).scalar()
        return self

    def score(self, df: DataFrame, key: str) -> DataFrame:
        """``(key, pred)``; unknown levels and missing numbers say nothing."""
        parts = []
        if self.text_cols:
            long = df.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in self.text_cols]).unpivot(
                [key], self.text_cols, "column", "level")
            parts.append(long.join(broadcast_if_small(self.levels), ["column", "level"], "left").select(key, "odds"))
        if self.number_cols:
            def density(c: str, k: str):
                mean, sd = self.moments[f"{c}_{k}_mean"], self.moments[f"{c}_{k}_sd"]
                z = (F.col(c) - mean) / sd
                return -F.log(sd) - z * z / 2
            odds = sum((F.coalesce(density(c, "pos") - density(c, "neg"), F.lit(0.0)) for c in self.number_cols), F.lit(0.0))
            parts.append(df.select(key, odds.alias("odds")))
        terms = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        total = F.coalesce(F.sum("odds"), F.lit(0.0)) + self.prior
        return terms.groupBy(key).agg((1 / (1 + F.exp(-total))).alias("pred"))


def search_counts(train: DataFrame, text_cols: Sequence[str], number_cols: Sequence[str], label: str, key: str,
                  laplaces: Sequence[float], folds: int = 2, seed: int = 1, cut: float = 0.5) -> tuple["CountNaiveBayes", DataFrame]:
    """The group-count model with the smoothing of the best cross-validated accuracy, and all scores.

    Ties go to the first smoothing listed.
    """
    folded = checkpoint(add_folds(train, label, key, folds, seed))
    parts = None
    for i, laplace in enumerate(laplaces):
        for f in range(folds):
            model = CountNaiveBayes(text_cols, number_cols, label, laplace).fit(folded.filter(F.col("fold") != f))
            held = folded.filter(F.col("fold") == f)
            right = ((F.col("pred") >= cut).cast("int") == F.col(label)).cast("double")
            one = model.score(held, key).join(held.select(key, label), key).agg(F.avg(right).alias("accuracy")).select(
                F.lit(i).alias("candidate"), F.lit(float(laplace)).alias("laplace"), F.lit(f).alias("fold"), "accuracy")
            parts = one if parts is None else parts.unionByName(one)
    scores = checkpoint(parts)
    best = scores.groupBy("candidate").agg(F.round(F.avg("accuracy"), 12).alias("m")).orderBy(F.desc("m"), "candidate").first()
    return CountNaiveBayes(text_cols, number_cols, label, laplaces[best["candidate"]]).fit(train), scores


# --- folds and search -----------------------------------------------------------------

def add_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 1, name: str = "fold") -> DataFrame:
    """Fold number 0..k-1; every fold has each class's share to within one row."""
    return shuffled_position(df, key, seed, name, [label]).withColumn(name, (F.col(name) % k).cast("int"))


def quality(scored: DataFrame, label: str, metric: str) -> float:
    """One number for a scored set: auc, f1 at the best threshold, or accuracy at a half."""
    if metric == "accuracy":
        return evaluate.report(scored, label, "pred", 0.5).first()["accuracy"]
    counts = evaluate.score_counts(scored, label, "pred")
    return evaluate.max_f1(counts)[1] if metric == "f1" else evaluate.auc_of(counts).first()["auc"] or 0.0


def cross_validate(family: str, folded: DataFrame, label: str, candidates: Sequence[Mapping], folds: int,
                   metric: str, parallelism: int = 8, fitted: Mapping[tuple[int, int], object] | None = None) -> list[list[float]]:
    """Scores per candidate and fold; several models train at the same time, or are given by candidate and fold."""

    def one(task: tuple[int, int]) -> float:
        i, f = task
        model = fitted[task] if fitted else fit(family, folded.filter(F.col("fold") != f), label, candidates[i])
        return quality(model.score(folded.filter(F.col("fold") == f)), label, metric)

    tasks = [(i, f) for i in range(len(candidates)) for f in range(folds)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        flat = pool.map(inheritable_thread_target(folded.sparkSession)(one), tasks)
    return [flat[i:i + folds] for i in range(0, len(flat), folds)]


def grid(**choices: Iterable) -> list[dict]:
    """All combinations of the listed values."""
    names = list(choices)
    return [dict(zip(names, combo)) for combo in itertools.product(*choices.values())]


def random_params(n: int, seed: int, **choices) -> list[dict]:
    """``n`` distinct draws; a choice is a list, or a function of the random generator."""
    rng, out, seen = random.Random(seed), [], set()
    if not any(callable(v) for v in choices.values()):
        every = grid(**choices)
        if n > len(every):
            raise ValueError(f"{n} draws asked for, but there are only {len(every)}")
        return rng.sample(every, n)
    misses = 0
    while len(out) < n:
        draw = {k: v(rng) if callable(v) else rng.choice(list(v)) for k, v in choices.items()}
        misses = 0 if repr(draw) not in seen else misses + 1
        if misses > 10_000:
            raise ValueError(f"{n} draws asked for, but only {len(out)} differ")
        if not misses:
            seen.add(repr(draw))
            out.append(draw)
    return out


@dataclass
class Search:
    family: str
    metric: str
    results: list[dict]
    best: "Fitted | AdaBoost | margins.Machine"

    def report(self, spark) -> DataFrame:
        """Mean and deviation of the metric over the folds, one row per parameter set."""
        rows = [(f"{self.family}_grid_model_{i}", repr(r["params"]), float(np.mean(r["scores"])), float(np.std(r["scores"])))
                for i, r in enumerate(self.results)]
        return spark.createDataFrame(rows, "model string, params string, mean double, sd double")


def search(family: str, train: DataFrame, label: str, key: str, candidates: Sequence[Mapping], folds: int = 2,
           metric: str = "f1", seed: int = 1, max_secs: float | None = None, stop_rounds: int | None = None,
           stop_tol: float = 1e-3, parallelism: int = 8) -> Search:
    """Cross-validate each candidate, refit the best on all rows. Kernel machines of a batch are fitted side by side, on all rows too.

    Candidates run in batches. The search stops after a batch that ends past the
    time limit, if one is given, or when the best score has not grown by ``stop_tol`` over
    ``stop_rounds`` candidates.
    """
    folded = checkpoint(add_folds(train, label, key, folds, seed))
    started, results, best, stale = time.monotonic(), [], -math.inf, 0
    batch = max(1, parallelism // folds)
    if stop_rounds:
        batch = min(batch, stop_rounds)
    for start in range(0, len(candidates), batch):
        some = candidates[start:start + batch]
        fitted = margins.side_by_side(folded, label, some, folds, n_features(folded)) if family == "svm" else None
        for i, (params, scores) in enumerate(zip(some, cross_validate(family, folded, label, some, folds, metric, parallelism, fitted))):
            results.append({"params": dict(params), "scores": scores, "whole": fitted[i, folds] if fitted else None})
            mean = float(np.mean(scores))
            stale = 0 if mean > best + stop_tol else stale + 1
            best = max(best, mean)
        if (max_secs and time.monotonic() - started > max_secs) or (stop_rounds and stale >= stop_rounds):
            break
    top = max(results, key=lambda r: np.mean(r["scores"]))
    return Search(family, metric, results, top["whole"] or fit(family, folded, label, top["params"]))


# --- ensembles and comparison ------------------------------------------------------------

@dataclass
class Stacked:
    base: list
    meta: Fitted
    params: dict = field(default_factory=dict)
    family: str = "stacked"

    def score(self, df: DataFrame) -> DataFrame:
        return _drop_base(self.meta.score(_meta_features(_score_all(df, self.base), len(self.base))), len(self.base))


def _score_all(df: DataFrame, models: Sequence) -> DataFrame:
    for i, m in enumerate(models):
        df = m.score(df).withColumnRenamed("pred", f"_base{i}")
    return df


def _meta_features(df: DataFrame, n: int) -> DataFrame:
    base = array_to_vector(F.array(*[F.col(f"_base{i}").cast("double") for i in range(n)]))
    return df.withColumnRenamed(FEATURES, "_features").withColumn(FEATURES, base)


def _drop_base(df: DataFrame, n: int) -> DataFrame:
    return df.drop(FEATURES, *[f"_base{i}" for i in range(n)]).withColumnRenamed("_features", FEATURES)


def stack(base: Sequence[tuple[str, Mapping]], train: DataFrame, label: str, key: str, folds: int = 2, seed: int = 1) -> Stacked:
    """Base models combined by a logistic model trained on their out-of-fold scores."""
    folded = checkpoint(add_folds(train, label, key, folds, seed))
    parts = None
    for f in range(folds):
        models = [fit(family, folded.filter(F.col("fold") != f), label, p) for family, p in base]
        part = _score_all(folded.filter(F.col("fold") == f), models)
        parts = part if parts is None else parts.unionByName(part)
    meta = fit("glm", checkpoint(_meta_features(parts, len(base)).select(FEATURES, label)), label,
               {"lambda": 0.0, "alpha": 0.0})
    return Stacked([fit(family, folded, label, p) for family, p in base], meta)


def automl(train: DataFrame, label: str, key: str, plans: Sequence[tuple[str, Sequence[Mapping]]], max_secs: float | None = None,
           folds: int = 2, metric: str = "auc", too_good: float = 0.999, seed: int = 1) -> tuple[object, list[dict]]:
    """Try families and parameters, all of them or, if a time limit is given, until it is up.

    Returns the best model by cross-validation whose training AUC is below
    ``too_good``, and the leaderboard.
    """
    folded = checkpoint(add_folds(train, label, key, folds, seed))
    started, board = time.monotonic(), []
    for family, params in [(family, p) for family, candidates in plans for p in candidates]:
        if board and max_secs and time.monotonic() - started > max_secs:
            break
        scores = cross_validate(family, folded, label, [params], folds, metric)[0]
        board.append({"family": family, "params": dict(params), "score": float(np.mean(scores))})
    for entry in sorted(board, key=lambda b: -b["score"]):
        model = fit(entry["family"], folded, label, entry["params"])
        if quality(model.score(folded), label, "auc") < too_good:
            return model, board
    raise ValueError("every model fits the training rows too well")


def leaderboard(results: DataFrame, max_gap: float = 0.025, wide_gap: float = 0.05, skip: str = "_cv_") -> DataFrame:
    """Models ordered by test F1: none that fit the training set fully, no fold
    models, and a gap between training and test F1 below ``max_gap``."""
    gap = F.abs(F.col("trainF1") - F.col("testF1"))
    return (
        results.withColumn("diff", gap)
        .filter((F.col("trainF1") < 1) & (F.col("diff") < wide_gap))
        .filter(~F.col("modID").contains(skip) & (F.col("diff") < max_gap))
        .orderBy(F.desc("testF1"), "modID"))
