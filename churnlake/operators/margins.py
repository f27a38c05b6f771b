"""Linear machines with hinge loss on random Fourier features: all candidates of a search, in all folds, side by side.

Each machine takes the same steps as Spark ML's ``LinearSVC`` (features scaled and centred while it is fitted, an
unscaled penalty, quasi-Newton steps with a line search), which ``models.fit`` uses for one machine. A pass over the rows makes the features of each
width once, for the machines of all sets of rows, and adds up their losses and gradients, so no features are kept. The driver holds the
last steps of every machine.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators.sums import array_sum, matrix
from churnlake.session import stored

ROWS = 128      # rows whose features a task holds at a time, so few that they stay in a cache
BLOCK = 32      # rows that are stored together
MEMORY = 10     # steps that tell the bend of a loss
SEARCHES = 20   # points of a line search
RECENT = 20     # losses that must be alike at the end

Draws = tuple[np.ndarray, np.ndarray]


def draws(gamma: float, dim: int, seed: int, n_inputs: int) -> Draws:
    """Directions and phases of random cosine features."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2 * gamma), (n_inputs, dim)), rng.uniform(0, 2 * math.pi, dim)


def cosines(x: np.ndarray, of: Draws) -> np.ndarray:
    """Features whose inner products approximate a radial kernel."""
    weights, phase = of
    out = x @ weights
    out += phase
    np.cos(out, out=out)
    out *= math.sqrt(2.0 / len(phase))
    return out


def steps(n: int, max_iter: int, tol: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Asks for the loss and slope at points, and returns the last point: quasi-Newton steps within an orthant.

    No penalty on the absolute values is meant here, but a coefficient still does not change its sign within a step, and
    a line search begins with half of the step, as in Spark ML.
    """
    x = np.zeros(n)
    value, slope = yield x
    first, recent, moves, turns = value, [math.inf], [], []
    iteration, failed = 0, False
    while not (iteration >= max_iter or len(recent) >= 2 and abs(value - max(recent)) <= tol * first
               or np.linalg.norm(slope) <= max(tol * value, 1e-8)):
        found = None
        down = _direction(slope, moves, turns)
        if down is not None:
            down = np.where(down * slope < 0, down, 0.0)
            side = np.where(x != 0, np.sign(x), np.sign(-slope))
            fall = float(down @ slope)
            alpha, shrink = (0.5 / np.linalg.norm(slope), 0.1) if iteration < 1 else (1.0, 0.5)

            def at(alpha: float) -> np.ndarray:
                point = x + down * alpha
                return np.where(np.sign(point) == np.sign(side), point, 0.0)

            if fall == 0:
                found = (x, value, slope)
            else:
                factor = shrink
                for k in range(SEARCHES):
                    alpha *= factor
                    if not 1e-10 <= alpha <= 1e10:
                        break
                    point = at(alpha)
                    own, bend = yield point
                    if k == SEARCHES - 1:
                        break
                    last, rise = (point, own, bend), float(bend @ down)
                    factor = shrink if own > value + alpha * fall * 1e-4 else 2.1 if rise < 0.9 * fall else shrink if rise > -0.9 * fall else 1.0
                    if factor == 1.0 or k == SEARCHES - 2:
                        found = last
                        break
        if found is None:  # once with the bend forgotten, then no more
            if failed:
                break
            failed, moves, turns = True, [], []
            continue
        point, own, bend = found
        moves, turns = [point - x, *moves][:MEMORY], [bend - slope, *turns][:MEMORY]
        x, value, slope = point, own, bend
        recent = [*recent, value][-RECENT:]
        iteration, failed = iteration + 1, False
    return x


def _direction(slope: np.ndarray, moves: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray | None:
    """Down the slope, by the bend that the last moves showed; none if they show no bend."""
    out, share = slope.copy(), []
    scale = 1.0
    if moves:
        along, own = moves[0] @ turns[0], turns[0] @ turns[0]
        if along < 0 or math.isnan(along):
            return None
        with np.errstate(all="ignore"):
            scale = along / own
    with np.errstate(all="ignore"):
        for m, t in zip(moves, turns):
            share.append((m @ out) / (m @ t))
            if math.isnan(share[-1]):
                return None
            out -= share[-1] * t
        out *= scale
        for m, t, s in zip(moves[::-1], turns[::-1], share[::-1]):
            out += (s - (t @ out) / (m @ t)) * m
    return -out


@dataclass
class Machine:
    """A fitted machine; ``score`` adds a logistic curve of its margin."""

    params: dict
    weights: np.ndarray
    threshold: float
    features: str = "features"
    family: str = "svm"

    def score(self, df: DataFrame) -> DataFrame:
        p, weights, threshold = self.params, self.weights, self.threshold
        of = draws(p["gamma"], p["dim"], p["seed"], p["n_inputs"])

        @F.arrow_udf("double")
        def value(x: pa.Array) -> pa.Array:
            rows = matrix(x).reshape(len(x), -1)
            out = np.zeros(len(x))
            for k in range(0, len(x), ROWS):
                out[k:k + ROWS] = cosines(rows[k:k + ROWS], of) @ weights + threshold
            with np.errstate(over="ignore"):
                return pa.array(1 / (1 + np.exp(-out)))

        return df.withColumn("pred", value(vector_to_array(self.features)))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``(x, y, fold)`` as numbers of ``BLOCK`` of them in a row, written once: passes read them as they are."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [matrix(batch.column(0)), *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (1, 2))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[k:k + BLOCK].tobytes() for k in range(0, batch.num_rows, BLOCK)], pa.binary()) for c in columns], names=["x", "y", "fold"])

    width = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < width:
        rows = rows.repartition(width)
    return stored(rows.mapInArrow(packed, "x binary, y binary, fold binary"), "machines")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, labels and folds, some at a time."""
    x, y, fold = (np.frombuffer(b"".join(batch.column(c).to_pylist())) for c in range(3))
    x = x.reshape(len(y), -1) if len(y) else np.zeros((0, 0))
    for k in range(0, len(y), ROWS):
        yield x[k:k + ROWS], y[k:k + ROWS], fold[k:k + ROWS]


def side_by_side(folded: DataFrame, label: str, candidates: Sequence[Mapping], folds: int, n_inputs: int, features: str = "features",
                 fold: str = "fold") -> dict[tuple[int, int], Machine]:
    """The machine of each candidate without each fold, and on all rows (as fold ``folds``).

    Labels must be 0 or 1. A candidate has ``gamma``, ``dim``, ``seed``, ``max_iter`` and ``reg``, as in ``models.fit``.
    """
    params = [{**p, "gamma": p.get("gamma", 1.0 / n_inputs), "dim": p.get("dim", 100), "seed": p.get("seed", 1), "n_inputs": n_inputs} for p in candidates]
    kinds = list(dict.fromkeys((p["gamma"], p["dim"], p["seed"]) for p in params))
    of = [draws(*k, n_inputs) for k in kinds]
    rows = _blocks(folded.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")))
    sets = folds + 1
    offsets = np.cumsum([0, *(2 * sets * k[1] for k in kinds)])

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(offsets[-1] + sets + 1)
        for x, y, f in _parts(batch):
            total[-1] += (~np.isin(y, (0.0, 1.0))).sum()
            used = (f[:, None] != np.arange(sets)).astype(float)
            total[-1 - sets:-1] += used.sum(axis=0)
            for d, o, e in zip(of, offsets, offsets[1:]):
                phi = cosines(x, d)
                total[o:e] += np.concatenate([used.T @ phi, used.T @ (phi * phi)]).ravel()
        return total

    found = array_sum(rows, moments, int(offsets[-1]) + sets + 1)
    if found[-1]:
        raise ValueError(f"labels must be 0 or 1; {int(found[-1])} rows have others")
    n = found[-1 - sets:-1]
    mean, scale = {}, {}  # by kind of features and set of rows
    for k, (o, e) in enumerate(zip(offsets, offsets[1:])):
        sums, squares = found[o:e].reshape(2, sets, -1)
        for s in range(sets):
            mean[k, s] = sums[s] / max(n[s], 1)
            sd = np.sqrt(np.maximum(squares[s] - n[s] * mean[k, s] ** 2, 0.0) / max(n[s] - 1, 1))
            scale[k, s] = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1.0), 0.0)

    kind = [kinds.index((p["gamma"], p["dim"], p["seed"])) for p in params]
    runs = {(i, s): steps(p["dim"] + 1, p.get("max_iter", 50)) for i, p in enumerate(params) for s in range(sets)}
    asked = {m: next(run) for m, run in runs.items()}
    ends: dict[tuple[int, int], np.ndarray] = {}

    def unscaled(m: tuple[int, int], point: np.ndarray) -> tuple[np.ndarray, float]:
        own = point[:-1] * scale[kind[m[0]], m[1]]
        return own, float(point[-1] - own @ mean[kind[m[0]], m[1]])

    while asked:
        at = {k: [m for m in asked if kind[m[0]] == k] for k in sorted({kind[m[0]] for m in asked})}
        points = {k: [unscaled(m, asked[m]) for m in ms] for k, ms in at.items()}
        stacked = [(of[k], np.array([p[0] for p in points[k]]).T, np.array([p[1] for p in points[k]]), np.array([m[1] for m in ms])) for k, ms in at.items()]
        sizes = np.cumsum([0, *((w.shape[0] + 2) * w.shape[1] for _, w, _, _ in stacked)])

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(sizes[-1])
            for x, y, f in _parts(batch):
                side = np.where(y > 0.5, 1.0, -1.0)
                for (d, w, b, without), o, e in zip(stacked, sizes, sizes[1:]):
                    phi = cosines(x, d)
                    short = 1 - side[:, None] * (phi @ w + b)
                    near = (short > 0) & (f[:, None] != without)
                    pull = np.where(near, -side[:, None], 0.0)
                    total[o:e] += np.concatenate([phi.T @ pull, pull.sum(axis=0)[None], np.where(near, short, 0.0).sum(axis=0)[None]]).ravel()
            return total

        flat = array_sum(rows, sums, int(sizes[-1]))
        for (k, ms), o, e in zip(at.items(), sizes, sizes[1:]):
            for m, column in zip(ms, flat[o:e].reshape(-1, len(ms)).T / np.maximum(n[[m[1] for m in ms]], 1)[:, None]):
                point, own = asked.pop(m), scale[k, m[1]]
                penalty = params[m[0]].get("reg", 1e-3) * own * own * point[:-1]
                slope = np.append((column[:-2] - column[-2] * mean[k, m[1]]) * own + penalty, column[-2])
                try:
                    asked[m] = runs[m].send((float(column[-1] + 0.5 * penalty @ point[:-1]), slope))
                except StopIteration as end:
                    ends[m] = end.value
    return {m: Machine(params[m[0]], *unscaled(m, x), features) for m, x in ends.items()}
