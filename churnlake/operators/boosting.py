"""Second-order gradient boosting on histograms; all candidates of a search and their folds grow side by side.

Features are cut into bins at quantiles once and stored as small numbers. A pass over the rows adds up, for
every growing tree, node, feature and bin, the rows, gradients and Hessians of the log loss in each task; the
driver reads the histograms, picks the split of each node and goes one level down. So a level of all trees
costs one pass, and what is shuffled is histograms, whatever the number of rows. Every ten trees the margins
of the rows are written out.

A split must leave ``min_rows`` rows on both sides and gain more than ``min_gain`` per row of the tree; a tree
sees a share of the rows (by hash) and of the features, each level a share of these that changes with depth.
The learning rate shrinks with every tree. A model stops when its loss on held-out rows, averaged over three
scorings, has not fallen by ``stop_tol``. Rows without a label are left out; ties take the first feature and cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators.sums import array_sum, matrix
from churnlake.session import stored

DEFAULTS = {"trees": 50, "depth": 4, "rate": 0.1, "anneal": 0.99, "sample": 1.0, "columns": 1.0, "columns_tree": 1.0, "columns_change": 1.0,
            "min_rows": 10, "min_gain": 0.0, "bins": 32, "l2": 1.0}
EVERY = 5       # trees between scorings
MARGINS = 10    # trees between writings of the margins


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = math.inf       # rows of at most this go left
    place: int = 0              # the same as a bin
    left: int = -1
    right: int = -1


@dataclass
class Job:
    """One model while it grows; ``skip`` is the fold that it doesn't see (-1: none)."""

    params: dict
    skip: int
    seed: int
    start: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    open_: list[int] = field(default_factory=list)
    done: bool = False


def _spread(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in 0..1 from hashes of rows."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(float) / (1 << 53)


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers that the bytes of a binary column without nulls hold, one row after the other."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind)
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind)


def _down(tree: list[Node], columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row comes to; ``columns`` holds the bins feature by feature."""
    def of(i: int):
        n = tree[i]
        return values[i] if n.feature < 0 else np.where(columns[n.feature] <= n.place, of(n.left), of(n.right))

    return np.broadcast_to(of(0), columns.shape[1])


def _leaf_of(tree: list[Node], columns: np.ndarray) -> np.ndarray:
    return _down(tree, columns, np.arange(len(tree)))


def _grown(tree: list[Node], columns: np.ndarray) -> np.ndarray:
    return _down(tree, columns, np.array([n.value for n in tree]))


def quantile_cuts(train: DataFrame, bins: int, features: str = "features", error: float = 1e-3) -> list[np.ndarray]:
    """Cut points of each feature: at most ``bins - 1`` of its quantiles; the driver holds these only.

    Quantiles come from a sketch within ``error`` of their rank, so they can differ with the layout of the rows.
    """
    size = len(train.select(vector_to_array(features)).first()[0])
    wide = train.select(*[vector_to_array(features)[i].alias(f"x{i}") for i in range(size)])
    found = wide.approxQuantile(wide.columns, [i / bins for i in range(1, bins)], error)
    # A cut at the largest value would leave nothing on the right.
    tops = wide.agg(F.array(*[F.max(c) for c in wide.columns])).first()[0]
    lows = wide.agg(F.array(*[F.min(c) for c in wide.columns])).first()[0]
    return [np.array(sorted({lo, *q} - {top})) for q, top, lo in zip(found, tops, lows)]


def boosted(train: DataFrame, label: str, key: str, candidates: Sequence[Mapping], folds: int = 2, fold: str | None = "fold", held: float = 0.1,
            stop_tol: float = 1e-3, seed: int = 1, features: str = "features") -> list[list[Boosted]]:
    """For each candidate its models without each fold, and the one on all rows last.

    A share ``held`` of the rows, by hash of the key, grows no tree and tells when to stop; with 0 every tree is grown.
    """
    known = train.filter(F.col(label).isNotNull())
    by_bins = {b: quantile_cuts(known, b, features) for b in sorted({{**DEFAULTS, **c}["bins"] for c in candidates})}
    k = len(next(iter(by_bins.values())))
    most = max(len(c) + 1 for cuts in by_bins.values() for c in cuts)
    jobs = [Job({**DEFAULTS, **c}, s, 1000 * i + seed) for i, c in enumerate(candidates) for s in ([*range(folds), -1] if fold else [-1])]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            rows = [np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint16) for cuts in by_bins.values()] if len(x) else []
            held_ = [b"".join(r[i].tobytes() for r in rows) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(held_, pa.binary()), *batch.columns[1:]], names=["bins", "y", "fold", "h"])

    rows = stored(known.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"),
                               F.xxhash64(key).alias("h")).mapInArrow(binned, "bins binary, y double, fold int, h bigint").withColumn("m", F.lit(b"")), "binned")
    order = {b: i for i, b in enumerate(by_bins)}

    def opened(batch: pa.RecordBatch):
        flat = _bytes(batch.column(0), np.uint16).reshape(batch.num_rows, len(by_bins), k)
        y, f = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        return flat, y, f, batch.column(3).to_numpy().view(np.uint64), _bytes(batch.column(4), np.float64).reshape(batch.num_rows, -1)

    def margin(job: Job, no: int, columns: np.ndarray, kept: np.ndarray, since: int, upto: int) -> np.ndarray:
        z = kept[:, no] if kept.shape[1] else np.full(columns.shape[1], job.start)
        for tree in job.trees[since:upto]:
            z = z + _grown(tree, columns)
        return z

    def histograms(now: list[tuple[int, Job]], since: int, level: int) -> list[tuple[float, float, np.ndarray]]:
        """By job: held-out loss and rows (before the first split), then rows, gradients and Hessians by open node, feature of its tree and bin."""
        shapes = [(len(_in_tree(job, k)), len(job.open_), most) for _, job in now]
        sizes = [2 + 3 * math.prod(x) for x in shapes]

        def of(batch: pa.RecordBatch) -> np.ndarray:
            flat, y, f, h, kept = opened(batch)
            outside = _spread(h, 77) < held
            columns = np.ascontiguousarray(flat.transpose(1, 2, 0))
            out = []
            for (no, job), shape in zip(now, shapes):
                bins, p = columns[order[job.params["bins"]]], job.params
                t = len(job.trees) - 1
                scored = np.zeros(2)
                if level == 0:
                    test = np.flatnonzero(outside & (f != job.skip))
                    z = margin(job, no, bins[:, test], kept[test], since, t)
                    scored[:] = (np.logaddexp(0, z) - y[test] * z).sum(), len(test)
                # The sample comes first, so that only its rows go down the trees.
                use = np.flatnonzero(~outside & (f != job.skip) & (_spread(h, job.seed * 7919 + t) < p["sample"]))
                own = bins[:, use]
                if level:
                    slot = np.full(len(job.trees[t]), -1)
                    slot[job.open_] = np.arange(len(job.open_))
                    node = slot[_leaf_of(job.trees[t], own)]
                    at = np.flatnonzero(node >= 0)
                    use, own, node = use[at], own[:, at], node[at]
                else:
                    node = np.zeros(len(use), np.int64)
                q = 1 / (1 + np.exp(-np.clip(margin(job, no, own, kept[use], since, t), -35, 35)))
                sums = np.zeros((3, *shape))
                for i, feature in enumerate(_in_tree(job, k)):
                    cell = node * most + own[feature]
                    for j, w in enumerate((None, q - y[use], q * (1 - q))):
                        sums[j, i] = np.bincount(cell, w, shape[1] * most).reshape(shape[1:])
                out += [scored, sums.ravel()]
            return np.concatenate(out)

        total = np.split(array_sum(rows, of, sum(sizes)), np.cumsum(sizes)[:-1])
        found = []
        for (_, job), shape, part in zip(now, shapes, total):
            whole = np.zeros((3, shape[1], k, most))
            whole[:, :, _in_tree(job, k)] = part[2:].reshape(3, *shape).transpose(0, 2, 1, 3)
            found.append((part[0], part[1], whole))
        return found

    def first(batch: pa.RecordBatch) -> np.ndarray:
        _, y, f, h, _ = opened(batch)
        inside = _spread(h, 77) >= held
        return np.array([[(inside & (f != j.skip)).sum(), y[inside & (f != j.skip)].sum()] for j in jobs])

    counts = array_sum(rows, first, 2 * len(jobs)).reshape(-1, 2)
    for job, (n, pos) in zip(jobs, counts):
        job.start = math.log(max(pos, 1e-9) / max(n - pos, 1e-9))
    since = 0
    for t in range(max(j.params["trees"] for j in jobs) + 1):
        now = [(i, j) for i, j in enumerate(jobs) if not j.done]
        for _, job in now:
            job.trees.append([Node(0.0)])
            job.open_ = [0]
        for level in range(max((j.params["depth"] for _, j in now), default=0)):
            now = [(i, j) for i, j in now if j.open_ and not j.done and level < j.params["depth"]]
            if not now:
                break
            for (i, job), part in zip(now, histograms(now, since, level)):
                if level == 0:
                    job.losses.append(part[0] / max(part[1], 1))
                    if t >= job.params["trees"] or (held and t % EVERY == 0 and _flat(job.losses[::EVERY], stop_tol)):
                        job.done = True
                        job.trees.pop()
                        continue
                _split(job, part[2], level, by_bins[job.params["bins"]])
        if (t + 1) % MARGINS == 0 and any(not j.done for j in jobs):
            upto = since + MARGINS

            def moved(batches: Iterator[pa.RecordBatch], since: int = since, upto: int = upto) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    flat, _, _, _, kept = opened(batch)
                    z = np.stack([margin(j, i, flat[:, order[j.params["bins"]]].T, kept, since, upto) for i, j in enumerate(jobs)], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in z], pa.binary())], names=["bins", "y", "fold", "h", "m"])

            rows, since = stored(rows.mapInArrow(moved, "bins binary, y double, fold int, h bigint, m binary"), "binned"), upto
    each = len(jobs) // len(candidates)
    models = [Boosted(j.start, [[(n.feature, n.cut, n.left, n.right, n.value) for n in t] for t in j.trees], j.params, j.losses) for j in jobs]
    return [models[i:i + each] for i in range(0, len(models), each)]


def _flat(scored: list[float], tol: float, rounds: int = 3) -> bool:
    """Whether the moving average of the loss has stopped falling."""
    if len(scored) < 2 * rounds:
        return False
    means = [np.mean(scored[i:i + rounds]) for i in range(len(scored) - rounds + 1)]
    return min(means[-rounds:]) > min(means[:-rounds]) * (1 - tol)


def _in_tree(job: Job, k: int) -> np.ndarray:
    """The features that the last tree of a job may use."""
    return np.random.default_rng([job.seed, len(job.trees)]).permutation(k)[:max(1, math.ceil(job.params["columns_tree"] * k))]


def _split(job: Job, sums: np.ndarray, level: int, cuts: list[np.ndarray]) -> None:
    """Split the open nodes of a job's last tree by its histograms, and value their children."""
    p, tree, k = job.params, job.trees[-1], sums.shape[2]
    in_tree = _in_tree(job, k)
    share = min(1.0, max(0.0, p["columns"] * p["columns_change"] ** level))
    draw = np.random.default_rng([job.seed, len(job.trees), level])
    rate = p["rate"] * p["anneal"] ** (len(job.trees) - 1)
    opened = []
    for slot, name in enumerate(job.open_):
        allowed = np.zeros(k, bool)
        allowed[draw.permutation(in_tree)[:max(1, math.ceil(share * len(in_tree)))]] = True
        n, g, h = (np.cumsum(s[slot], axis=1) for s in sums)
        alln, allg, allh = (x[in_tree[0], -1] for x in (n, g, h))
        if level == 0:
            tree[name].value = -rate * allg / (allh + p["l2"])
        gain = g ** 2 / (h + p["l2"]) + (allg - g) ** 2 / (allh - h + p["l2"]) - allg ** 2 / (allh + p["l2"])
        real = np.array([[c < len(cuts[f]) for c in range(n.shape[1])] for f in range(k)])
        gain = np.where(allowed[:, None] & real & (n >= p["min_rows"]) & (alln - n >= p["min_rows"]), np.round(gain, 9), -np.inf)
        f, c = np.unravel_index(gain.argmax(), gain.shape)
        if not gain[f, c] > 2 * p["min_gain"] * max(alln, 1) or gain[f, c] <= 0:
            continue
        node = tree[name]
        node.feature, node.place, node.cut, node.left, node.right = int(f), int(c), float(cuts[f][c]), len(tree), len(tree) + 1
        for gg, hh in ((g[f, c], h[f, c]), (allg - g[f, c], allh - h[f, c])):
            opened.append(len(tree))
            tree.append(Node(-rate * gg / (hh + p["l2"])))
    job.open_ = opened


@dataclass
class Boosted:
    """Grown trees: nodes are ``(feature, cut, left, right, value)``, feature -1 in a leaf; ``losses`` are those on the held-out rows."""

    start: float
    trees: list[list[tuple[int, float, int, int, float]]]
    params: dict
    losses: list[float]
    family: str = "gbm"

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        trees = [tuple(np.array(c) for c in zip(*t)) for t in self.trees]
        start = self.start

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            x = matrix(column)
            z = np.full(len(x), start)
            for feature, cut, left, right, value in trees:
                at = np.zeros(len(x), np.int64)
                while len(inner := np.flatnonzero(feature[at] >= 0)):
                    n = at[inner]
                    at[inner] = np.where(x[inner, feature[n]] <= cut[n], left[n], right[n])
                z += value[at]
            return pa.array(1 / (1 + np.exp(-z)))

        return df.withColumn("pred", scored(vector_to_array(features)))
