"""Why a scorer says what it says. A scorer is a function that adds ``pred`` to a DataFrame."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators.ranking import (
    group_quantiles, largest, nearest_to, seeded_sample, shuffled_position)

Scorer = Callable[[DataFrame], DataFrame]


def quantile_grid(df: DataFrame, feature: str, n: int = 20) -> list[float]:
    """``n`` distinct quantiles of a numeric feature."""
    probs = {f"q{i}": i / (n - 1) for i in range(n)}
    row = group_quantiles(df, [], feature, probs).first()  # one row of n numbers
    return sorted(set(row))


def _on_grid(df: DataFrame, feature: str, grid: Sequence) -> DataFrame:
    kind = df.schema[feature].dataType
    values = F.array(*[F.lit(v).cast(kind) for v in grid])
    return df.drop(feature).withColumn(feature, F.explode(values))


def partial_dependence(df: DataFrame, scorer: Scorer, feature: str, grid: Sequence) -> DataFrame:
    """Mean score of all rows with the feature set to each grid value."""
    return scorer(_on_grid(df, feature, grid)).groupBy(feature).agg(F.avg("pred").alias("mean_pred"))


def ice(rows: DataFrame, scorer: Scorer, key: str, feature: str, grid: Sequence) -> DataFrame:
    """Score of each given row with the feature set to each grid value."""
    return scorer(_on_grid(rows, feature, grid)).select(key, feature, "pred")


def pick_rows(scored: DataFrame, key: str, threshold: float, score: str = "pred") -> DataFrame:
    """Rows worth explaining: all lowest, the first near the threshold, all highest."""
    parts = {
        "lowest": largest(scored, score, smallest=True),
        "nearest": nearest_to(scored, score, threshold, key),
        "highest": largest(scored, score),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumn("pick", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(df: DataFrame, scorer: Scorer, key: str, label: str,
                           features: Sequence[str], seed: int = 1) -> DataFrame:
    """How much the log loss grows when one feature is taken from another row."""
    base = df.select(key, label, *features)
    rows = shuffled_position(base, key, seed, "_pos")
    donors = shuffled_position(base, key, seed + 1, "_pos").select(
        "_pos", *[F.col(f).alias(f"_d_{f}") for f in features])
    pairs = rows.join(donors, "_pos")
    variants = F.array(F.lit(""), *[F.lit(f) for f in features])
    wide = pairs.withColumn("feature", F.explode(variants))
    wide = wide.withColumns({
        f: F.when(F.col("feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f)) for f in features})
    p = F.least(F.greatest(F.col("pred"), F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    losses = scorer(wide).groupBy("feature").agg(F.avg(loss).alias("loss"))
    unchanged = losses.filter("feature = ''").select("loss").scalar()
    return losses.filter("feature <> ''").select("feature", (F.col("loss") - unchanged).alias("importance"))


def shapley_sample(rows: DataFrame, background: DataFrame, scorer: Scorer, key: str,
                   features: Sequence[str], n_background: int = 20, n_orders: int = 8,
                   seed: int = 1) -> DataFrame:
    """``(key, feature, contribution)`` by sampling background rows and orders of entry.

    Few features have all their orders tried.

    For each row, order and background row the features change one after the
    other from the background's value to the row's own; a feature's mean change
    of the score is its contribution. Contributions of a row add up to its score
    minus the mean background score.
    """
    if math.factorial(len(features)) <= n_orders:
        orders = list(itertools.permutations(features))
    else:
        rng = random.Random(seed)
        orders = [rng.sample(list(features), len(features)) for _ in range(n_orders)]
    other = seeded_sample(background, key, n_background, seed).select(
        *[F.col(f).alias(f"_b_{f}") for f in features])
    # n_background rows travel with each row as one array.
    others = other.agg(F.collect_list(F.struct(*other.columns))).scalar()
    steps = [
        F.struct(
            F.lit(order[i - 1] if i else None).cast("string").alias("entered"),
            F.lit(order[i] if i < len(order) else None).cast("string").alias("next"),
            *[F.lit(f in order[:i]).alias(f"_own_{f}") for f in features])
        for order in orders for i in range(len(order) + 1)
    ]
    grid = rows.select(key, *features).withColumn("_bg", F.explode(others)).select(
        key, *features, "_bg.*", F.inline(F.array(*steps)))
    mixed = grid.withColumns({
        f: F.when(F.col(f"_own_{f}"), F.col(f)).otherwise(F.col(f"_b_{f}")) for f in features})
    scored = scorer(mixed).select(key, F.inline(F.array(
        F.struct(F.col("entered").alias("feature"), F.col("pred").alias("change")),
        F.struct(F.col("next").alias("feature"), (-F.col("pred")).alias("change")))))
    # Every walk enters each feature once: one score with a plus, one with a minus.
    mean_change = 2 * F.sum("change") / F.count(F.lit(1))
    return scored.filter("feature is not null").groupBy(key, "feature").agg(mean_change.alias("contribution"))


def linear_contributions(rows: DataFrame, background: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """Exact contributions of a linear score: coefficient times distance from the mean."""
    means = background.select(F.struct(*[F.avg(f).alias(f) for f in coefficients])).scalar()
    parts = [
        F.struct(F.lit(f).alias("feature"), (F.lit(c) * (F.col(f) - means[f])).alias("contribution"))
        for f, c in coefficients.items()]
    return rows.select(key, F.inline(F.array(*parts)))


def confident_errors(scored: DataFrame, texts: DataFrame, key: str, label: str, score: str = "pred",
                     low: float = 0.4, high: float = 0.6, sentiment: str | None = None) -> DataFrame:
    """Texts of customers scored low who stayed, or scored high (and friendly) who left."""
    left = (F.col(score) > high) & (F.col(label) == 0)
    if sentiment:
        left = left & (F.col(sentiment) > 0)
    wrong = scored.filter(((F.col(score) < low) & (F.col(label) == 1)) | left)
    return texts.join(wrong.select(key), key, "left_semi")
