"""Kernel machines on landmarks: a whole grid of widths and costs, in all folds, fitted side by side.

Landmarks are centres of the rows (k-means). The radial kernel of a row with the landmarks, turned by the inverse
root of the landmarks' own kernel, gives features whose products approximate the kernel; what they leave out of
each row's own kernel value of 1 is the kernel error. On these features a machine with squared hinge loss is
fitted by Newton steps: a pass over the rows sums the products of the features of the rows inside the margin, for
all machines at once, and the driver solves one system of landmarks x landmarks numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from churnlake.operators.side_by_side import best_centres
from churnlake.operators.sums import array_sum, matrix
from churnlake.session import checkpoint

ROWS = 1024   # rows whose features a task holds at a time


def scales(df: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each place of the array ``x``; 1 where nothing varies."""
    found = df.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_samp("v")).orderBy("i").collect()  # a row per place
    return np.array([r[1] for r in found]), np.array([r[2] or 1.0 for r in found])


def chosen_landmarks(df: DataFrame, x: str, n: int, mean: np.ndarray, sd: np.ndarray, seed: int = 1, max_iter: int = 20) -> np.ndarray:
    """Centres of the standardised rows: ``n`` of them, or one per distinct row where these are fewer."""
    scaled = F.zip_with(x, F.arrays_zip(F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, sd.tolist())).alias("s")),
                        lambda v, t: F.round((v - t["m"]) / t["s"], 9))
    points = checkpoint(df.groupBy(scaled.alias("point")).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    n = min(n, points.count())
    return best_centres(points, [n], 1, seed, max_iter)[n]


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0.0))


@dataclass
class Landmarks:
    """Features of rows for each width of the kernel."""

    points: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    gammas: list[float]

    def __post_init__(self):
        self.turns = []
        for g in self.gammas:
            values, vectors = np.linalg.eigh(_kernel(self.points, self.points, g))
            keep = values > values[-1] * 1e-10
            self.turns.append(vectors[:, keep] / np.sqrt(values[keep]))

    def features(self, x: np.ndarray, i: int) -> np.ndarray:
        """Features of the rows of ``x`` at width ``i``, and a last column of ones."""
        turned = _kernel((x - self.mean) / self.sd, self.points, self.gammas[i]) @ self.turns[i]
        return np.column_stack([turned, np.ones(len(x))])

    def errors(self, df: DataFrame, x: str) -> DataFrame:
        """``(gamma, kernel_error)``: mean of what the features leave out of a row's kernel with itself."""
        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(self.gammas)), 0
            for batch in batches:
                data = matrix(batch.column(0))
                n += len(data)
                for at in range(0, len(data), ROWS):
                    rows = data[at:at + ROWS]
                    for i in range(len(self.gammas)):
                        total[i] += len(rows) - (self.features(rows, i)[:, :-1] ** 2).sum()
            yield pa.RecordBatch.from_pydict({"gamma": pa.array(self.gammas, pa.float64()), "total": total, "n": pa.array([n] * len(total), pa.int64())})

        sums = df.select(x).mapInArrow(left_out, "gamma double, total double, n long")
        return sums.groupBy("gamma").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("kernel_error"))


@dataclass
class Machines:
    """Weights of all machines of a grid: by width, cost, and fold left out (the last: none)."""

    marks: Landmarks
    costs: list[float]
    folds: int
    weights: dict[tuple[int, int, int], np.ndarray]
    passes: int
    slopes: dict[tuple[int, int, int], float]  # largest slope of each objective, relative to the cost times the rows

    def margin(self, i: int, j: int, f: int, x: str) -> Column:
        marks, w = self.marks, self.weights[i, j, f]

        @pandas_udf("double")
        def value(rows: pd.Series) -> pd.Series:
            return pd.Series(marks.features(np.array(rows.tolist(), dtype=float).reshape(len(rows), -1), i) @ w if len(rows) else np.zeros(0))

        return value(x)

    def name(self, i: int, j: int) -> str:
        return f"kernel_{i}_{j}"

    def out_of_fold(self, df: DataFrame, label: str, key: str, fold: str, x: str) -> DataFrame:
        """``(model, fold, key, label, pred)``: each machine's score (a logistic curve of its margin) of the rows it hasn't seen."""
        cells = [(i, j) for i in range(len(self.marks.gammas)) for j in range(len(self.costs))]
        marks, weights, folds = self.marks, self.weights, self.folds

        @arrow_udf("array<double>")
        def scores(rows: pa.Array, unseen: pa.Array) -> pa.Array:
            out = np.zeros((len(rows), len(cells)))
            data, at = matrix(rows), unseen.to_numpy(zero_copy_only=False)
            w = {c: np.array([weights[*c, f] for f in range(folds)]).T for c in cells}
            for some in (slice(k, k + ROWS) for k in range(0, len(rows), ROWS)):
                own, place = at[some], np.arange(len(at[some]))
                for i in range(len(marks.gammas)):
                    phi = marks.features(data[some], i)
                    for c, cell in enumerate(cells):
                        if cell[0] == i:
                            out[some, c] = 1 / (1 + np.exp(-np.clip((phi @ w[cell])[place, own], -30, 30)))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(cells)), pa.array(out.ravel()))

        names = F.array(*[F.lit(self.name(i, j)) for i, j in cells])
        scored = df.withColumn("_s", F.arrays_zip(names.alias("model"), scores(x, fold).alias("pred")))
        return scored.select(fold, key, label, F.inline("_s")).select("model", fold, key, label, "pred")


def fit_grid(df: DataFrame, label: str, x: str, marks: Landmarks, costs: Sequence[float], folds: int = 2, fold: str = "fold",
             max_iter: int = 40, tol: float = 1e-6) -> Machines:
    """Machines for every width, cost and fold, and on all rows.

    Minimises half the squared weights plus ``cost`` times the sum of squared hinge losses. Rows without a label
    are left out. A step that raises its objective is halved; a machine whose slope is at most ``tol`` times its cost
    and rows leaves the passes.
    """
    rows = df.filter(F.col(label).isNotNull()).select(x, F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    width = [t.shape[1] + 1 for t in marks.turns]
    cells = [(i, j, f) for i in range(len(marks.gammas)) for j in range(len(costs)) for f in range(folds + 1)]
    weights = {c: np.zeros(width[c[0]]) for c in cells}
    last = {c: (weights[c], np.inf) for c in cells}
    moving, slopes, passes = list(cells), dict.fromkeys(cells, np.inf), 0
    while moving and passes < max_iter:
        passes += 1
        for c, (loss, n, inside, pull) in _sums(rows, x, marks, {c: weights[c] for c in moving}).items():
            w, cost = weights[c], costs[c[1]]
            free = np.ones(len(w))
            free[-1] = 0.0  # the last weight is the threshold
            value = 0.5 * (free * w * w).sum() + cost * loss
            before, lowest = last[c]
            if value > lowest * (1 + 1e-12):
                weights[c] = (w + before) / 2
                continue
            last[c] = (w, value)
            slope = free * w + 2 * cost * (inside @ w - pull)
            slopes[c] = float(np.abs(slope).max() / max(1.0, cost * n))
            if slopes[c] <= tol:
                moving.remove(c)
                continue
            bend = np.diag(np.where(free > 0, 1.0, 1e-9)) + 2 * cost * inside
            weights[c] = w - np.linalg.solve(bend, slope)
    return Machines(marks, list(costs), folds, {c: last[c][0] for c in cells}, passes, slopes)


def _sums(rows: DataFrame, x: str, marks: Landmarks, weights: dict[tuple[int, int, int], np.ndarray]) -> dict:
    """Of each machine: squared hinge losses, number of rows, and over the rows inside the margin the products of features and their sum by side."""
    cells = list(weights)
    sizes = [len(weights[c]) for c in cells]
    offsets = np.cumsum([0, *(2 + m * m + m for m in sizes)])

    def of(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(offsets[-1])
        data_, y_, fold_ = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        for some in (slice(k, k + ROWS) for k in range(0, len(data_), ROWS)):
            data, side, fold = data_[some], np.where(y_[some] > 0.5, 1.0, -1.0), fold_[some]
            features = {i: marks.features(data, i) for i in {c[0] for c in cells}}
            products: dict = {}  # machines that have the same rows inside share them
            for c, m, o in zip(cells, sizes, offsets):
                phi = features[c[0]]
                short = 1 - side * (phi @ weights[c])
                used = fold != c[2]
                near = used & (short > 0)
                total[o] += (short[near] ** 2).sum()
                total[o + 1] += used.sum()
                name = c[0], near.tobytes()
                if name not in products:
                    own = phi[near]
                    products[name] = np.concatenate([(own.T @ own).ravel(), own.T @ side[near]])
                total[o + 2:o + 2 + m * m + m] += products[name]
        return total

    flat = array_sum(rows.select(x, "y", "fold"), of, int(offsets[-1]))  # landmarks x landmarks numbers of each machine
    return {c: (flat[o], flat[o + 1], flat[o + 2:o + 2 + m * m].reshape(m, m), flat[o + 2 + m * m:o + 2 + m * m + m])
            for c, m, o in zip(cells, sizes, offsets)}
