"""Exact Shapley values of fitted trees, along the paths to their leaves.

What a tree says when only some features are known follows the splits of known features and, at a split
of an unknown one, takes both sides by the shares of background rows that go there. For one leaf this is
a product: a known feature gives 1 or 0 (the row takes this path or not), an unknown one the share of
its splits on the path. The Shapley value of a product game needs no subsets: the coefficients of the
polynomial ``prod(share_i + takes_i * t)`` over the other features of the path hold the sums over all
subsets of each size. So a leaf costs the square of the number of features on its path.

Values of a row add up to its score minus the mean over the background, where a boosted model's score is
the sum of its trees before the logistic function, and that of one tree or a forest the share of positive
background rows in the leaf (a forest's own leaves hold resampled rows, so its score differs a little). Rows come in Arrow batches; trees are small and travel with the task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import models
from churnlake.operators.sums import array_sum, matrix

_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (.*)\)")
_LEAF = re.compile(r"Predict: (.*)")
_TREE = re.compile(r"Tree \d+ \(weight (.*)\):")


@dataclass
class Leaf:
    """``path`` has ``(feature, threshold or categories, whether left)`` from the root down."""

    value: float
    path: list[tuple[int, float | frozenset, bool]]

    def takes(self, x: np.ndarray, feature: int | None = None) -> np.ndarray:
        """Rows that go along the path, by the splits of one feature or of all."""
        out = np.ones(len(x), bool)
        for f, at, left in self.path:
            if feature is None or f == feature:
                goes = np.isin(x[:, f], list(at)) if isinstance(at, frozenset) else x[:, f] <= at
                out &= goes if left else ~goes
        return out


@dataclass
class Tree:
    weight: float
    leaves: list[Leaf]


def read_trees(model) -> list[Tree]:
    """The trees of a Spark ML tree model, from its description."""
    trees: list[Tree] = []
    above: list[tuple[int, float | frozenset, bool]] = []
    for line in model.toDebugString.splitlines()[1:]:
        text = line.strip()
        if m := _TREE.match(text):
            trees.append(Tree(float(m[1]), []))
            above = []
        elif m := _SPLIT.match(text):
            at = float(m[4]) if m[3] in ("<=", ">") else frozenset(float(v) for v in m[4].strip("{}").split(","))
            if m[1] == "Else":
                # The other side of the last split that was still open on its left.
                while not above[-1][2]:
                    above.pop()
                above.pop()
            above.append((int(m[2]), at, m[1] == "If"))
        elif m := _LEAF.match(text):
            if not trees:
                trees.append(Tree(1.0, []))
            trees[-1].leaves.append(Leaf(float(m[1]), list(above)))
    return trees


def covered(trees: list[Tree], background: DataFrame, label: str | None = None, features: str = "features") -> np.ndarray:
    """Background rows, and positives among them, by leaf over all trees: one pass."""
    leaves = [leaf for t in trees for leaf in t.leaves]

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(batch.column(0)), batch.column(1).to_numpy()
        takes = [leaf.takes(x) for leaf in leaves]
        return np.array([[t.sum() for t in takes], [y[t].sum() for t in takes]])

    rows = background.select(vector_to_array(features).alias("x"), (F.col(label) if label else F.lit(0)).cast("double").alias("y"))
    return array_sum(rows, counts, 2 * len(leaves)).reshape(2, -1)


def shares(tree: Tree, cover: np.ndarray) -> list[dict[int, float]]:
    """By leaf and feature of its path: the share of background rows that stay on it at the feature's splits."""
    under: dict[tuple, float] = {}
    for leaf, n in zip(tree.leaves, cover):
        for k in range(len(leaf.path) + 1):
            under[tuple(leaf.path[:k])] = under.get(tuple(leaf.path[:k]), 0.0) + n
    out = []
    for leaf in tree.leaves:
        own: dict[int, float] = {}
        for k, (f, _, _) in enumerate(leaf.path):
            whole = under[tuple(leaf.path[:k])]
            own[f] = own.get(f, 1.0) * (under[tuple(leaf.path[:k + 1])] / whole if whole else 0.0)
        out.append(own)
    return out


def leaf_values(takes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the product game of one leaf: ``takes`` by row and feature, ``share`` by feature."""
    n, m = takes.shape
    out = np.zeros((n, m))
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    for j in range(m):
        # Coefficients by number of known features among the others.
        poly = np.zeros((n, m))
        poly[:, 0] = 1
        for i in range(m):
            if i != j:
                moved = np.zeros_like(poly)
                moved[:, 1:] = poly[:, :-1] * takes[:, i:i + 1]
                poly = poly * share[i] + moved
        out[:, j] = (takes[:, j] - share[j]) * (poly @ weight)
    return out


def contributions_of(trees: list[Tree], cover: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Contributions by row and feature; ``cover`` and ``values`` are by leaf over all trees."""
    out = np.zeros_like(x)
    at = 0
    for tree in trees:
        k = len(tree.leaves)
        for leaf, share, value in zip(tree.leaves, shares(tree, cover[at:at + k]), values[at:at + k]):
            if share and value:
                names = list(share)
                takes = np.stack([leaf.takes(x, f) for f in names], axis=1).astype(float)
                out[:, names] += tree.weight * value * leaf_values(takes, np.array([share[f] for f in names]))
        at += k
    return out


@dataclass
class Explained:
    """Trees with the cover and values of their leaves; ``base`` is the mean over the background."""

    trees: list[Tree]
    cover: np.ndarray
    values: np.ndarray
    base: float


def explain_trees(model: models.Fitted, background: DataFrame, label: str, features: str = "features") -> Explained:
    trees = read_trees(model.model)
    counts = covered(trees, background, label, features)
    boosted = model.family in ("gbm", "gbm_regressor")
    if boosted:
        values = np.array([leaf.value for t in trees for leaf in t.leaves])
    else:
        values = counts[1] / np.maximum(counts[0], 1)
        trees = [Tree(1 / len(trees), t.leaves) for t in trees]
    weight = np.concatenate([np.full(len(t.leaves), t.weight) for t in trees])
    n = max(1.0, counts[0][:len(trees[0].leaves)].sum())
    return Explained(trees, counts[0], values, float((weight * values * counts[0]).sum() / n))


def tree_contributions(rows: DataFrame, explained: Explained, key: str, names: dict[int, str], features: str = "features") -> DataFrame:
    """``(key, feature, contribution)`` of every feature for every row; repeated rows have rows of their own.

    ``names`` gives the features' names by place; features of one name (the levels of a column) are added.
    """
    k = max(names) + 1
    wanted = sorted(set(names.values()))
    fold = np.zeros((k, len(wanted)))
    for i, name in names.items():
        fold[i, wanted.index(name)] = 1

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            out = contributions_of(explained.trees, explained.cover, explained.values, x) @ fold if len(x) else np.zeros((0, len(wanted)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(wanted), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "v"])

    kind = rows.schema[key].dataType.simpleString()
    values = rows.select(key, vector_to_array(features).alias("x")).mapInArrow(told, f"`{key}` {kind}, v array<double>")
    return values.select(key, F.posexplode("v").alias("_i", "contribution")).select(
        key, F.element_at(F.array(*map(F.lit, wanted)), F.col("_i") + 1).alias("feature"), "contribution")


def summary(contributions: DataFrame) -> DataFrame:
    """Mean size and mean of the contributions by feature."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_size"), F.avg("contribution").alias("mean"))


def column_names(df: DataFrame, numbers: Sequence[str] = (), features: str = "features") -> dict[int, str]:
    """Names of the vector's places; levels of an encoded column bear the column's name, scaled numbers those given."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    named = {f"_scaled_{i}": c for i, c in enumerate(numbers)}
    return {a["idx"]: named.get(a["name"], re.sub(r"_vec_.*$", "", a["name"])) for group in attrs.values() for a in group}
