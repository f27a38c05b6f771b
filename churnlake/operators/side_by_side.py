"""k-means for many numbers of groups, from many starts each, moved side by side.

A pass over the points moves the centres of all runs at once: a task adds up the points nearest to each
centre, and one aggregation by run and centre gives the new ones. So the number of passes follows the slowest
run, not the number of runs, and runs that have come to rest leave the passes. The driver holds centres only,
at most about ``CENTRES`` at a time: more numbers of groups follow in further waves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from churnlake.operators.sums import matrix

CENTRES = 1 << 19   # centres moved in one pass, over all runs
CELLS = 1 << 15     # distances a task holds at a time, few enough for its cache
DIGITS = 9          # sums of doubles differ in their last bits; choices between runs are made on so many digits


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(batch["point"].tolist(), dtype=float).reshape(len(batch), -1), batch["weight"].to_numpy(dtype=float)


def _nearest(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of ``x``, with the number of and squared distance to the nearest centre of each run (``runs x k x d``)."""
    step = max(1, CELLS // (centres.shape[0] * centres.shape[1]))
    for at in range(0, len(x), step):
        rows = slice(at, at + step)
        far = sum((x[rows, j, None, None] - centres[None, :, :, j]) ** 2 for j in range(x.shape[1]))
        best = far.argmin(axis=2)
        yield rows, best, np.take_along_axis(far, best[:, :, None], 2)[:, :, 0]


def first_points(points: DataFrame, n: int, starts: int, seed: int) -> np.ndarray:
    """``starts x n x d``: the first distinct points in a hashed order of their own for each start; a smaller k takes fewer of them."""
    ordered = points.select("point").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"), "point").withColumn("h", F.xxhash64("point", "start", F.lit(seed)))

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        # More than the rows up to the n-th hash of a start cannot be among its first n.
        rows = rows[rows.groupby("start")["h"].rank(method="min") <= n]
        return rows.assign(_p=rows["point"].map(tuple)).sort_values(["h", "_p"]).groupby("start", sort=False).head(n).drop(columns="_p")

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = least(batch if held is None else pd.concat([held, batch]))
        if held is not None:
            yield held

    schema = "start int, point array<double>, h bigint"
    rows = ordered.mapInPandas(of_task, schema).groupBy("start").applyInPandas(least, schema).toPandas()  # starts x n
    rows = rows.assign(_p=rows["point"].map(tuple)).sort_values(["start", "h", "_p"])
    return np.array(rows["point"].tolist(), dtype=float).reshape(starts, -1, len(rows["point"].iloc[0]))


def moved(points: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """New centres of all runs (``k: runs x k x d``) and the weighted squared distances to the old ones (``k: runs``).

    A centre without points stays where it is.
    """
    d = next(iter(centres.values())).shape[2]
    sizes = sorted(centres)
    offsets = np.cumsum([0, *(centres[k].shape[0] * k for k in sizes)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((offsets[-1], d + 2))
        for batch in batches:
            x, w = matrix(batch.column(0)), batch.column(1).to_numpy()
            for k, offset in zip(sizes, offsets):
                runs = centres[k].shape[0]
                cells = runs * k
                for rows, best, far in _nearest(x, centres[k]):
                    place = (best + np.arange(runs) * k).ravel()
                    weight = np.repeat(w[rows], runs)
                    own = total[offset:offset + cells]
                    own[:, 0] += np.bincount(place, weight, cells)
                    own[:, 1] += np.bincount(place, weight * far.ravel(), cells)
                    for j in range(d):
                        own[:, 2 + j] += np.bincount(place, weight * np.repeat(x[rows, j], runs), cells)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_pydict({"cell": used, **{f"s{j}": np.ascontiguousarray(total[used, j]) for j in range(d + 2)}})

    names = [f"s{j}" for j in range(d + 2)]
    sums = points.select("point", "weight").mapInArrow(partial, "cell bigint, " + ", ".join(f"{c} double" for c in names))
    found = sums.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row per centre
    total = np.zeros((offsets[-1], d + 2))
    total[found["cell"].to_numpy()] = found[names].to_numpy()
    new, spread = {}, {}
    for k, offset in zip(sizes, offsets):
        own = total[offset:offset + centres[k].shape[0] * k].reshape(-1, k, d + 2)
        held = own[:, :, :1] > 0
        new[k] = np.where(held, own[:, :, 2:] / np.where(held, own[:, :, :1], 1.0), centres[k])
        spread[k] = own[:, :, 1].sum(axis=1)
    return new, spread


def waves(sizes: Sequence[int], starts: int, most: int = CENTRES) -> Iterator[list[int]]:
    """The numbers of groups in order, as many at a time as ``most`` centres allow."""
    now: list[int] = []
    for k in sorted(sizes):
        if now and starts * (sum(now) + k) > most:
            yield now
            now = []
        now.append(k)
    if now:
        yield now


def best_centres(points: DataFrame, sizes: Sequence[int], starts: int = 25, seed: int = 2022, max_iter: int = 100,
                 tol: float = 1e-9) -> dict[int, np.ndarray]:
    """``k: k x d`` centres of the tightest run of each number of groups, ordered by their coordinates.

    ``points`` holds ``point`` (array of doubles) and ``weight``; no size may be above the number of distinct points.
    A run rests when no centre moves by more than ``tol``, or after ``max_iter`` passes.
    """
    if not sizes:
        return {}
    first = first_points(points, max(sizes), starts, seed)
    out: dict[int, np.ndarray] = {}
    for wave in waves(sizes, starts):
        centres = {k: first[:, :k].copy() for k in wave}
        spread = {k: np.full(starts, np.inf) for k in wave}
        moving = {k: np.arange(starts) for k in wave}
        for _ in range(max_iter):
            new, now = moved(points, {k: centres[k][runs] for k, runs in moving.items()})
            for k, runs in list(moving.items()):
                far = np.abs(new[k] - centres[k][runs]).max(axis=(1, 2))
                centres[k][runs], spread[k][runs] = new[k], now[k]
                if (far > tol).any():
                    moving[k] = runs[far > tol]
                else:
                    del moving[k]
            if not moving:
                break
        for k in wave:
            tightest = centres[k][int(np.round(spread[k], DIGITS).argmin())]
            out[k] = tightest[np.lexsort(tightest.T[::-1])]
    return out


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with ``cluster``, the number of the nearest centre (the first of equally near ones)."""
    @pandas_udf("int")
    def cluster(point: pd.Series) -> pd.Series:
        x = np.array(point.tolist(), dtype=float).reshape(len(point), -1)
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *(best[:, 0] for _, best, _ in _nearest(x, centres[None]))]))

    return points.withColumn("cluster", cluster("point"))


def silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> list[tuple[int, float]]:
    """Weighted mean silhouette (squared Euclidean) of each number of groups whose points lie in two clusters at least.

    The mean squared distance of a point to a cluster follows from the cluster's weight, sum and sum of squares,
    so two passes over the points serve all numbers of groups. The only point of a cluster counts 0.
    """
    out: list[tuple[int, float]] = []
    for wave in waves(list(centres), 1):
        out += _silhouettes(points, {k: centres[k] for k in wave})
    return out


def _silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> list[tuple[int, float]]:
    sizes = sorted(centres)
    d = centres[sizes[0]].shape[1]
    offsets = dict(zip(sizes, np.cumsum([0, *sizes])))
    cells = sum(sizes)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((cells, d + 2))
        for batch in batches:
            x, w = _arrays(batch)
            values = np.column_stack([np.ones(len(x)), (x * x).sum(axis=1), x]) * w[:, None]
            for k in sizes:
                for rows, best, _ in _nearest(x, centres[k][None]):
                    np.add.at(total, offsets[k] + best[:, 0], values[rows])
        yield pd.DataFrame({"cell": np.arange(cells), **{f"s{j}": total[:, j] for j in range(d + 2)}})

    names = [f"s{j}" for j in range(d + 2)]
    found = points.mapInPandas(sums, "cell bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in names]).toPandas()  # a row per centre
    stats = np.zeros((cells, d + 2))
    stats[found["cell"].to_numpy()] = found[names].to_numpy()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(len(sizes)), 0.0
        for batch in batches:
            x, w = _arrays(batch)
            weight += w.sum()
            for i, k in enumerate(sizes):
                own = stats[offsets[k]:offsets[k] + k]
                held = own[:, 0] > 0
                mass = np.where(held, own[:, 0], 1.0)
                for rows, best, _ in _nearest(x, centres[k][None]):
                    at, y, v = best[:, 0], x[rows], w[rows]
                    far = (y * y).sum(axis=1)[:, None] + own[:, 1] / mass - 2 * y @ (own[:, 2:] / mass[:, None]).T
                    far = np.maximum(np.where(held, far, np.inf), 0.0)
                    rest = mass[at] - v
                    alone = rest <= 0
                    inside = far[np.arange(len(y)), at] * mass[at] / np.where(alone, 1.0, rest)
                    far[np.arange(len(y)), at] = np.inf
                    outside = far.min(axis=1)
                    most = np.maximum(inside, outside)
                    s = np.where(alone | (most == 0), 0.0, (outside - inside) / np.where(most == 0, 1.0, most))
                    total[i] += (s[np.isfinite(outside)] * v[np.isfinite(outside)]).sum()
        yield pd.DataFrame({"k": sizes, "total": total, "weight": weight})

    means = points.mapInPandas(scored, "k int, total double, weight double").groupBy("k").agg(
        F.try_divide(F.sum("total"), F.sum("weight")).alias("s"))
    clusters = {k: int((stats[offsets[k]:offsets[k] + k, 0] > 0).sum()) for k in sizes}
    return sorted((r["k"], r["s"]) for r in means.collect() if clusters[r["k"]] > 1)  # a row per number of groups
