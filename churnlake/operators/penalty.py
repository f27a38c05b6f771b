"""Logistic regression along whole paths of elastic-net penalties, all mixing weights and folds at once.

The objective of mixing weight ``a`` and penalty ``l`` over standardised features is the mean log loss plus
``l * (a * sum|b| + (1 - a) / 2 * sum b^2)``; the intercept is free. A step replaces the loss of every
solution by its quadratic form at the present coefficients: one pass over the rows adds up, for all
solutions together, the weighted Gram matrices and gradients, and coordinate descent solves all forms
side by side on the driver. The first form is the same for all, so the path is first walked from the
largest penalty down with warm starts; later steps start from the step before. Driver and tasks hold a
``k x k`` matrix for each solution, whatever the number of rows.

Where there are more than ``START`` rows, about so many of them are solved first. They give the start and the Gram
matrices; the passes over all rows then need gradients only, until every solution is stationary on all rows. A
solution whose slope does not fall fast enough takes a Gram matrix of all rows.

Rows without a label are left out; features must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.operators.sums import array_sum, matrix
from churnlake.session import stored

CHUNK = 512     # rows,
SOLUTIONS = 256  # and solutions, whose weights are held at a time
START = 1 << 16  # rows that a start is looked for on,
ROUGH = 1e-6    # with slopes of at most this
ENOUGH = 50     # of these, of either label in each set of rows
SLOW = 0.3      # of its slope that a step must leave at most, or the Gram matrix is taken anew


def _columns(df: DataFrame, label: str, fold: str | None, features: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))


def _parts(batch: pa.RecordBatch, mean: np.ndarray, sd: np.ndarray):
    """Standardised rows with a leading 1, labels and folds, some at a time."""
    x, y, fold = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    x = np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], axis=1)
    for k in range(0, len(x), CHUNK):
        yield x[k:k + CHUNK], y[k:k + CHUNK], fold[k:k + CHUNK]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    out = np.clip(z, -35, 35)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _logistic(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def descend(gram: np.ndarray, target: np.ndarray, b: np.ndarray, lasso: np.ndarray, ridge: np.ndarray,
            rounds: int = 60, sweeps: int = 8) -> np.ndarray:
    """Minimise ``b'Gb/2 - t'b + lasso*|b| + ridge*b^2/2`` for many forms side by side; coordinate 0 is free.

    Some sweeps of coordinate descent, then the linear system of the coordinates that are not 0, with
    their signs; it is the minimum if it keeps these signs and the other slopes lie within the lasso
    part. Forms for which it does not take part in the next round.
    """
    b = b.copy()
    k = b.shape[1]
    open_ = np.arange(len(b))
    free = np.arange(k) == 0
    for _ in range(rounds):
        g = np.ascontiguousarray(gram[open_].transpose(2, 1, 0))  # by coordinate, then form
        t, own, l1, l2 = target[open_].T, b[open_].T.copy(), lasso[open_], ridge[open_]
        at = np.einsum("jic,jc->ic", g, own)
        for _ in range(sweeps):
            for j in range(k):
                left = t[j] - at[j] + g[j, j] * own[j]
                if j:
                    new = np.sign(left) * np.maximum(np.abs(left) - l1, 0) / np.maximum(g[j, j] + l2, 1e-12)
                else:
                    new = left / np.maximum(g[j, j], 1e-12)
                step = new - own[j]
                own[j] = new
                at += g[j] * step
        b[open_] = own.T
        used = (b[open_] != 0) | free
        sign = np.where(free, 0.0, np.sign(b[open_]))
        system = gram[open_] * used[:, :, None] * used[:, None, :]
        system[:, np.arange(k), np.arange(k)] += np.where(used, np.where(free, 0.0, l2[:, None]) + 1e-11, 1.0)
        exact = np.linalg.solve(system, (np.where(used, target[open_] - sign * l1[:, None], 0.0))[:, :, None])[:, :, 0]
        slope = target[open_] - np.einsum("cij,cj->ci", gram[open_], exact)
        good = (np.where(used & ~free, np.sign(exact) == sign, True) & (used | (np.abs(slope) <= l1[:, None] * (1 + 1e-9) + 1e-12))).all(axis=1)
        b[open_[good]] = exact[good]
        open_ = open_[~good]
        if not len(open_):
            break
    return b


def _off(slope: np.ndarray, b: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """How far coordinates are from stationary: the slope of the loss against that of the penalty."""
    held = np.abs(slope + lasso[:, None] * np.sign(b) + ridge[:, None] * b)
    out = np.where(b != 0, held, np.maximum(np.abs(slope) - lasso[:, None], 0))
    out[:, 0] = np.abs(slope[:, 0])
    return out


@dataclass
class Path:
    """Solutions by mixing weight, penalty and set of rows: without each fold in turn, and all rows last."""

    alphas: np.ndarray
    lambdas: np.ndarray     # by mixing weight, from the largest down
    coefficients: np.ndarray  # of standardised features, the intercept first
    mean: np.ndarray
    sd: np.ndarray
    folds: int
    passes: int             # over the rows, the one for means included

    def raw(self, alpha: int, step: int, rows: int = -1) -> np.ndarray:
        """Intercept and coefficients of the features as they are."""
        b = self.coefficients[alpha, step, rows]
        own = b[1:] / self.sd
        return np.concatenate([[b[0] - own @ self.mean], own])

    def model(self, alpha: int, step: int) -> Linear:
        return Linear(self.raw(alpha, step), {"alpha": float(self.alphas[alpha]), "lambda": float(self.lambdas[alpha, step])})


@dataclass
class Linear:
    """A linear model of the log odds; ``score`` stays in the JVM."""

    raw: np.ndarray
    params: dict
    family: str = "glm"
    features: str = "features"

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", linear_score(self.raw, self.features))


def linear_score(raw: Sequence[float], features: str = "features") -> Column:
    own = F.array(*[F.lit(float(c)) for c in raw[1:]])
    z = F.aggregate(F.zip_with(vector_to_array(features), own, lambda x, c: x * c), F.lit(float(raw[0])), lambda s, v: s + v)
    return 1 / (1 + F.exp(-z))


def penalty_path(train: DataFrame, label: str, alphas: Sequence[float], n_lambdas: int = 20, least: float = 1e-3, folds: int = 2,
                 fold: str | None = "fold", features: str = "features", steps: int = 30, tol: float = 1e-9) -> Path:
    """All solutions of ``len(alphas) * n_lambdas`` penalties, on all rows and without each fold.

    The largest penalty of a mixing weight leaves no coefficient but the intercept; the others fall
    evenly on a log scale to ``least`` of it.
    """
    rows = _columns(train, label, fold if folds else None, features)
    k = len(rows.select("x").first()["x"])
    sets = folds + 1

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y, f = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        out = np.zeros((sets, 2 + k))
        for s in range(sets):
            use = f != s
            out[s] = [use.sum(), y[use].sum(), *(x[use] * y[use, None]).sum(axis=0)]
        return np.concatenate([out.ravel(), x.sum(axis=0), (x * x).sum(axis=0)])

    found = array_sum(rows, moments, sets * (2 + k) + 2 * k)
    by_set, sums, squares = found[:sets * (2 + k)].reshape(sets, 2 + k), found[-2 * k:-k], found[-k:]
    n, positives = by_set[:, 0], by_set[:, 1]
    mean = sums / n[-1]
    variance = squares / n[-1] - mean ** 2
    sd = np.where(variance > 1e-12, np.sqrt(np.maximum(variance, 1e-12)), np.inf)  # a constant column has no say
    share = positives[-1] / n[-1]
    slope = np.abs((by_set[-1, 2:] - mean * positives[-1]) / n[-1] / sd)
    alphas = np.asarray(alphas, float)
    lambdas = slope.max() / np.maximum(alphas, 1e-3)[:, None] * np.geomspace(1, least, n_lambdas)[None, :]
    shape = (len(alphas), n_lambdas, sets, k + 1)
    lasso = np.broadcast_to((alphas[:, None] * lambdas)[:, :, None], shape[:3]).reshape(-1)
    ridge = np.broadcast_to(((1 - alphas[:, None]) * lambdas)[:, :, None], shape[:3]).reshape(-1)
    own = np.tile(np.arange(sets), len(alphas) * n_lambdas)
    upper = np.triu_indices(k + 1)

    def unpacked(flat: np.ndarray) -> np.ndarray:
        gram = np.zeros((len(flat), k + 1, k + 1))
        gram[:, upper[0], upper[1]] = flat
        gram[:, upper[1], upper[0]] = flat
        return gram

    def forms(data: DataFrame, weight: np.ndarray, b: np.ndarray, sets_of: np.ndarray, bend: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Gram matrices (if asked for) and gradients at ``b`` over some rows, one pass for all; ``weight`` has their number in each set."""
        square = len(upper[0]) if bend else 0
        width = square + k + 1

        def sums_of(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros((len(b), width))
            for x, y, f in _parts(batch, mean, sd):
                for v in np.unique(f):
                    mine = f == v
                    own, seen = x[mine], np.flatnonzero(sets_of != v)  # solutions that see these rows
                    both = own[:, upper[0]] * own[:, upper[1]] if bend else None
                    for at in range(0, len(seen), SOLUTIONS):
                        some = seen[at:at + SOLUTIONS]
                        p = _sigmoid(own @ b[some].T)
                        if bend:
                            total[some, :square] += np.maximum(p * (1 - p), 1e-6).T @ both
                        total[some, square:] += (y[mine, None] - p).T @ own
            return total

        total = array_sum(data, sums_of, len(b) * width).reshape(len(b), width) / weight[sets_of][:, None]
        return unpacked(total[:, :square]) if bend else None, total[:, square:]

    # A part of many rows, by hash, with enough of either label to start from.
    some, size, hits = rows, n, positives
    if n[-1] > START:
        part = stored(rows.filter(F.pmod(F.xxhash64("x", "y", "fold"), F.lit(1 << 20)) < int((1 << 20) * START / n[-1])), "start")
        own_n, own_hits = array_sum(part, lambda batch: np.array([[(u := batch.column(2).to_numpy() != s).sum(), batch.column(1).to_numpy()[u].sum()] for s in range(sets)]).T, 2 * sets).reshape(2, sets)
        if min(own_hits.min(), (own_n - own_hits).min()) >= ENOUGH:
            some, size, hits = part, own_n, own_hits

    # All solutions begin without features, so the first form of a set of rows serves them all.
    start = np.zeros((sets, k + 1))
    start[:, 0] = np.log(hits / np.maximum(size - hits, 1e-9))
    gram, gradient = forms(some, size, start, np.arange(sets))
    target = np.einsum("cij,cj->ci", gram, start) + gradient
    b = np.zeros(shape)
    warm = np.broadcast_to(start, (len(alphas), sets, k + 1)).reshape(-1, k + 1)
    for step in range(n_lambdas):
        spread = np.repeat(lambdas[:, step] * alphas, sets), np.repeat(lambdas[:, step] * (1 - alphas), sets)
        warm = descend(np.tile(gram, (len(alphas), 1, 1)), np.tile(target, (len(alphas), 1)), warm, *spread)
        b[:, step] = warm.reshape(len(alphas), sets, k + 1)
    b = b.reshape(-1, k + 1)
    bends = np.zeros((len(b), k + 1, k + 1))

    def moved(at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return descend(bends[at], np.einsum("cij,cj->ci", bends[at], b[at]) + gradient, b[at], lasso[at], ridge[at])

    rounds, open_ = 2, np.arange(len(b))
    while rounds < steps:
        bends[open_], gradient = forms(some, size, b[open_], own[open_])
        rounds += 1
        off = _off(-gradient, b[open_], lasso[open_], ridge[open_]).max(axis=1)
        far = off > (tol if some is rows else max(tol, ROUGH))
        gradient, open_ = gradient[far], open_[far]
        if not len(open_):
            break
        b[open_] = moved(open_, gradient)
    passes = rounds
    if some is not rows:
        passes, open_, last = 1, np.arange(len(b)), np.full(len(b), np.inf)
        while passes < steps:
            _, gradient = forms(rows, n, b[open_], own[open_], bend=False)
            passes += 1
            off = _off(-gradient, b[open_], lasso[open_], ridge[open_]).max(axis=1)
            gradient, open_, off = gradient[off > tol], open_[off > tol], off[off > tol]
            if not len(open_):
                break
            slow = open_[off > SLOW * last[open_]]
            if len(slow):
                bends[slow] = forms(rows, n, b[slow], own[slow])[0]
                passes += 1
            last[open_] = off
            b[open_] = moved(open_, gradient)
    return Path(alphas, lambdas, b.reshape(shape), mean, sd, folds, passes)


def deviances(path: Path, df: DataFrame, label: str, fold: str = "fold", features: str = "features") -> np.ndarray:
    """Mean log loss of every solution on the rows of the folds it has not seen, by mixing weight and penalty: one pass."""
    shape = path.coefficients.shape

    def losses(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(shape[0] * shape[1] + 1)
        for x, y, f in _parts(batch, path.mean, path.sd):
            for s in range(path.folds):
                mine = f == s
                for at in range(0, len(total) - 1, SOLUTIONS):
                    z = x[mine] @ path.coefficients[:, :, s].reshape(-1, shape[3])[at:at + SOLUTIONS].T
                    total[at:at + z.shape[1]] += (np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))).sum(axis=0) - y[mine] @ z
                total[-1] += mine.sum()
        return total

    total = array_sum(_columns(df, label, fold, features), losses, shape[0] * shape[1] + 1)
    return (total[:-1] / max(total[-1], 1)).reshape(shape[:2])


def violations(path: Path, df: DataFrame, label: str, chosen: Sequence[tuple[int, int]], features: str = "features") -> DataFrame:
    """``(alpha, step, violation)``: how far chosen solutions on all rows are from stationary, from the rows anew.

    At a solution the mean gradient of a feature equals its penalty's slope, and is at most the lasso
    part where the coefficient is 0. Computed by one aggregation over the rows for all solutions.
    """
    b = np.array([path.coefficients[i, j, -1] for i, j in chosen]).reshape(len(chosen), -1)

    def gradients(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(b) + 1, b.shape[1]))
        for x, y, _ in _parts(batch, path.mean, path.sd):
            total[:-1] += (_logistic(x @ b.T) - y[:, None]).T @ x
            total[-1] += len(x)
        return total

    total = array_sum(_columns(df, label, None, features), gradients, (len(b) + 1) * b.shape[1]).reshape(-1, b.shape[1])
    alpha, penalty = np.array([path.alphas[i] for i, _ in chosen]), np.array([path.lambdas[i, j] for i, j in chosen])
    off = _off(total[:-1] / np.maximum(total[-1], 1), b, penalty * alpha, penalty * (1 - alpha)).max(axis=1, initial=0.0)
    return df.sparkSession.createDataFrame(
        [(float(a), int(j), float(v)) for (_, j), a, v in zip(chosen, alpha, off)], "alpha double, step int, violation double")  # a row per solution asked for


def out_of_fold(path: Path, df: DataFrame, label: str, key: str, chosen: Sequence[tuple[int, int]], name: str = "glm",
                fold: str = "fold", features: str = "features") -> DataFrame:
    """``(model, fold, key, label, pred)``: scores of chosen solutions on the rows of the fold that they have not seen."""
    raw = np.array([[path.raw(i, j, s) for i, j in chosen] for s in range(path.folds)])

    def scored(x: pa.Array, of: pa.Array) -> pa.Array:
        rows, unseen = matrix(x), of.to_numpy(zero_copy_only=False)
        out = np.zeros((len(unseen), len(chosen)))
        for s in range(path.folds):
            mine = unseen == s
            out[mine] = _logistic(raw[s, :, 0] + rows[mine] @ raw[s, :, 1:].T) if mine.any() else 0.0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(unseen) + 1, dtype=np.int32) * len(chosen)), pa.array(out.ravel()))

    known = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull())
    each = known.select(fold, key, label, F.posexplode(F.arrow_udf(scored, "array<double>")(vector_to_array(features), F.col(fold).cast("int"))).alias("_no", "pred"))
    names = F.array(*[F.lit(f"{name}_grid_model_{i}") for i, _ in chosen])
    return each.select(F.element_at(names, F.col("_no") + 1).alias("model"), fold, key, label, "pred")
