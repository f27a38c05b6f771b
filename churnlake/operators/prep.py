"""Splitting, imputing, scaling and encoding before models are trained."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from churnlake.operators.profile import level_counts, melt, numeric_columns
from churnlake.operators.ranking import hash_order
from churnlake.session import broadcast_if_small, checkpoint, stored

BUCKET_ROWS = 100_000  # rows that one task ranks
PATTERN_CELLS = 1 << 18  # numbers of all sums by pattern of gaps, up to which the imputer keeps these


def stratified_split(df: DataFrame, label: str, key: str, p: float = 0.75, seed: int = 2020,
                     bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``is_train``: the ``ceil(p n)`` rows of each class with the smallest key hashes.

    Counts per class and leading hash digits tell in which bucket a class's last
    training row lies. Only that bucket is ranked; there are as many digits as keep
    it small. A missing label is a class of its own, apart from an empty one.
    """
    digits = 1
    rows = df.count()
    while 16 ** digits * bucket_rows < rows:
        digits += 1
    cls = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    place = hash_order(key, seed)
    keyed = df.select(cls.alias("_class"), place.alias("_h"), F.col(key).alias("_key"),
                      F.substring(place, 1, digits).alias("_b"))
    before = Window.partitionBy("_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("_class", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_class", "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.ceil(F.round(F.sum("_n").over(Window.partitionBy("_class")) * p, 6)).alias("_want"))
    edge = buckets.filter((F.col("_want") > F.col("_before")) & (F.col("_want") <= F.col("_before") + F.col("_n")))

    edge = edge.select("_class", "_b", "_before", "_want")
    rank = F.row_number().over(Window.partitionBy("_class", "_b").orderBy("_h", "_key")) + F.col("_before")
    # One row per class, stored, so that the rows can join it without a shuffle where it is small.
    last = stored(
        keyed.join(edge, ["_class", "_b"]).withColumn("_rank", rank).filter(F.col("_rank") == F.col("_want"))
        .select("_class", F.col("_h").alias("_last_h"), F.col("_key").alias("_last_key")), "split")
    inside = F.struct(place, F.col(key)) <= F.struct("_last_h", "_last_key")
    out = df.withColumn("_class", cls).join(broadcast_if_small(last), "_class", "left")
    return out.withColumn("is_train", F.coalesce(inside, F.lit(False))).drop("_class", "_last_h", "_last_key")


def scale(df: DataFrame, train: DataFrame, cols: Sequence[str], center: bool, ddof: int) -> DataFrame:
    """Divide by the training standard deviation, after subtracting the mean if ``center``."""
    deviation = F.stddev_samp if ddof else F.stddev_pop
    stats = train.select(F.struct(*[
        x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), deviation(c).alias(f"{c}_sd"))])).scalar()
    return df.withColumns({
        c: F.try_divide(F.col(c) - stats[f"{c}_mean"] if center else F.col(c).cast("double"), stats[f"{c}_sd"])
        for c in cols})


def one_hot(cols: Sequence[str]) -> Pipeline:
    """Fixed-width indicator vectors ``<col>_vec``; unseen levels get a slot of their own."""
    index = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep")
    encode = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                           dropLast=False)
    return Pipeline(stages=[index, encode])


def feature_pipeline(text_cols: Sequence[str], number_cols: Sequence[str]) -> Pipeline:
    """Encode text columns, scale numbers without centring, assemble ``features``."""
    stages = list(one_hot(text_cols).getStages()) if text_cols else []
    stages += [
        VectorAssembler(inputCols=list(number_cols), outputCol="_numbers", handleInvalid="error"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=False, withStd=True),
        VectorAssembler(inputCols=["_scaled", *[f"{c}_vec" for c in text_cols]], outputCol="features"),
    ]
    return Pipeline(stages=stages)


def feature_names(df: DataFrame, leave_out: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in leave_out]


def shared_features(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, usable)``: text columns without levels unknown to the test set,
    numbers with the same minimum and maximum in both."""
    numbers = [c for c in cols if c in numeric_columns(train)]
    others = [c for c in cols if c not in numbers]
    parts = []
    if others:
        ours, theirs = (level_counts(d, others).select("column", F.coalesce("value", F.lit("\0")).alias("value"))
                        for d in (train, test))
        unknown = ours.join(theirs.withColumn("known", F.lit(1)), ["column", "value"], "left").groupBy("column").agg(
            (F.count("known") == F.count(F.lit(1))).alias("usable"))
        parts.append(unknown)
    if numbers:
        edges = [melt(d, numbers, "double").groupBy("column").agg(
            F.min("value").alias(f"lo{i}"), F.max("value").alias(f"hi{i}")) for i, d in enumerate((train, test))]
        same = F.col("lo0").eqNullSafe(F.col("lo1")) & F.col("hi0").eqNullSafe(F.col("hi1"))
        parts.append(edges[0].join(edges[1], "column").select("column", same.alias("usable")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --- imputation by principal components ------------------------------------------------

def _impute(z: np.ndarray, loadings: np.ndarray, ridge: float) -> np.ndarray:
    """Fill NaN cells of standardised rows from the projection of what is seen of them on the loadings."""
    gaps = np.isnan(z)
    out = np.where(gaps, 0.0, z)
    rank = loadings.shape[1]
    rows = np.flatnonzero(gaps.any(axis=1))
    if rank == 0 or not len(rows):
        return out
    # Each row has its own system, of rank x rank numbers: the loadings' products over its seen columns.
    products = (loadings[:, :, None] * loadings[:, None, :]).reshape(len(loadings), rank * rank)
    systems = ((~gaps[rows]).astype(float) @ products).reshape(-1, rank, rank) + ridge * np.eye(rank)
    scores = np.linalg.solve(systems, (out[rows] @ loadings)[:, :, None])[:, :, 0]
    out[rows] = np.where(gaps[rows], scores @ loadings.T, out[rows])
    return out


class PcaImputer:
    """Fill numeric gaps from the leading principal components of all columns.

    Each round fills the rows from the loadings and adds up their outer products: a task gives one
    columns-by-columns matrix for each rank tried, whatever the gaps are, and the driver finds its eigenvectors.
    All ranks tried share the passes; those whose loadings no longer move leave them. Where rows with the same
    gaps are so many that the sums of products by pattern are few numbers, these are summed once and stand for
    the rows in all rounds: a filled row is linear in what is seen of it, so both ways give the same loadings.
    """

    def __init__(self, cols: Sequence[str], rank: int | None = None, max_rank: int = 5, max_iter: int = 300,
                 ridge: float = 1e-3, tol: float = 1e-4, seed: int = 1):
        self.cols, self.rank, self.max_rank = list(cols), rank, max_rank
        self.max_iter, self.ridge, self.tol, self.seed = max_iter, ridge, tol, seed

    def fit(self, df: DataFrame, key: str) -> "PcaImputerModel":
        cols, k = self.cols, len(self.cols)
        # Every round reads these numbers again, so they are written out once.
        cells = checkpoint(df.select(
            F.xxhash64(key, F.lit(self.seed)).alias("_h"), *[F.col(c).cast("double").alias(c) for c in cols]))
        row = cells.agg(*[x for c in cols for x in (F.avg(c), F.stddev_pop(c))]).first()  # 2 numbers per column
        mean = np.array([0.0 if v is None else float(v) for v in row[0::2]])
        sd = np.array([v or 1.0 for v in row[1::2]], dtype=float)
        rank = self._choose_rank(cells, mean, sd) if self.rank is None else self.rank
        loadings = self._fitted(cells, mean, sd, [rank])[rank] if rank else np.zeros((k, 0))
        return PcaImputerModel(cols, mean, sd, loadings, self.ridge)

    def _fitted(self, cells: DataFrame, mean, sd, ranks: Sequence[int], hide: bool = False) -> dict[int, np.ndarray]:
        """Loadings of each rank that no longer move when the gaps are filled from them."""
        rows = self._moments(cells, mean, sd, hide) if self._patterns(cells, hide) * len(self.cols) ** 2 <= PATTERN_CELLS else None
        done: dict[int, np.ndarray] = {}
        loadings = {r: np.zeros((len(self.cols), 0)) for r in ranks}
        for _ in range(self.max_iter + 1):
            filled = self._products(cells, mean, sd, loadings, hide) if rows is None else self._products_by_pattern(rows, loadings)
            for r, products in filled.items():
                old, new = loadings[r], self._leading(products, r)
                loadings[r] = new
                if old.shape[1] and np.linalg.norm(new @ new.T - old @ old.T) < self.tol:
                    done[r] = loadings.pop(r)
            if not loadings:
                break
        return {**done, **loadings}

    @staticmethod
    def _leading(products: np.ndarray, rank: int) -> np.ndarray:
        return np.linalg.eigh(products)[1][:, ::-1][:, :rank]

    @staticmethod
    def _held_out(h: np.ndarray, k: int) -> np.ndarray:
        """One observed cell in twenty, the same in every pass."""
        mixed = h.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(k, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(40)) % np.uint64(20) == 0

    def _patterns(self, cells: DataFrame, hide: bool) -> int:
        """Number of different patterns of gaps, near enough to choose by."""
        cols, k, held_out = self.cols, len(self.cols), self._held_out

        def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                gap = batch[cols].isna().to_numpy()
                if hide:
                    gap |= held_out(batch["_h"].to_numpy(), k)
                yield pd.DataFrame({"gaps": [g.tobytes() for g in np.unique(gap, axis=0)]})

        return cells.mapInPandas(seen, "gaps binary").agg(F.approx_count_distinct("gaps")).first()[0]

    def _moments(self, cells: DataFrame, mean, sd, hide: bool) -> DataFrame:
        """``(gaps, products)``: sums of outer products of the standardised rows, by pattern of gaps (counted as 0)."""
        cols, k, held_out = self.cols, len(self.cols), self._held_out

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                z = (batch[cols].to_numpy(dtype=float) - mean) / sd
                if hide:
                    z[held_out(batch["_h"].to_numpy(), k)] = np.nan
                patterns, where = np.unique(np.isnan(z), axis=0, return_inverse=True)
                z = np.where(np.isnan(z), 0.0, z)
                sums = [(z[rows].T @ z[rows]).ravel() for rows in (where.ravel() == i for i in range(len(patterns)))]
                yield pd.DataFrame({
                    "gaps": np.repeat(["".join("01"[int(g)] for g in p) for p in patterns], k * k),
                    "cell": np.tile(np.arange(k * k), len(patterns)), "value": np.concatenate(sums) if sums else np.zeros(0)})

        sums = cells.mapInPandas(partial, "gaps string, cell int, value double").groupBy("gaps", "cell").agg(F.sum("value").alias("value"))
        return checkpoint(sums.groupBy("gaps").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda x: x["value"]).alias("products")))

    def _products_by_pattern(self, moments: DataFrame, loadings: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """As ``_products``, from the sums of the patterns."""
        k, ridge = len(self.cols), self.ridge
        ranks = sorted(loadings)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(ranks), k, k))
            for batch in batches:
                for gaps, products in zip(batch["gaps"], batch["products"]):
                    unit = np.where(np.array([g == "1" for g in gaps])[None, :], np.nan, np.eye(k))
                    seen = np.asarray(products).reshape(k, k)
                    for i, r in enumerate(ranks):
                        fill = _impute(unit, loadings[r], ridge)
                        total[i] += fill.T @ seen @ fill
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

        return self._summed(moments.mapInPandas(partial, "cell int, value double"), ranks)

    def _summed(self, parts: DataFrame, ranks: Sequence[int]) -> dict[int, np.ndarray]:
        k = len(self.cols)
        flat = np.zeros(len(ranks) * k * k)
        for cell, value in parts.groupBy("cell").agg(F.sum("value")).collect():  # columns x columns numbers of each rank
            flat[cell] = value
        return dict(zip(ranks, flat.reshape(-1, k, k)))

    def _products(self, cells: DataFrame, mean, sd, loadings: dict[int, np.ndarray], hide: bool = False) -> dict[int, np.ndarray]:
        """By rank: the sum of outer products of the rows with their gaps filled from the loadings."""
        cols, k, ridge, held_out = self.cols, len(self.cols), self.ridge, self._held_out
        ranks = sorted(loadings)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(ranks), k, k))
            for batch in batches:
                z = (batch[cols].to_numpy(dtype=float) - mean) / sd
                if hide:
                    z[held_out(batch["_h"].to_numpy(), k)] = np.nan
                for i, r in enumerate(ranks):
                    filled = _impute(z, loadings[r], ridge)
                    total[i] += filled.T @ filled
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

        return self._summed(cells.mapInPandas(partial, "cell int, value double"), ranks)

    def _choose_rank(self, cells: DataFrame, mean, sd) -> int:
        """The rank with the smallest error on held-out cells; 0 means column means."""
        cols, k, ridge, held_out = self.cols, len(self.cols), self.ridge, self._held_out
        top = min(self.max_rank, k - 1)
        found = self._fitted(cells, mean, sd, range(1, top + 1), True) if top > 0 else {}
        fitted = [np.zeros((k, 0)), *(found[r] for r in range(1, top + 1))]

        def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(fitted))
            for batch in batches:
                z = (batch[cols].to_numpy(dtype=float) - mean) / sd
                hidden = held_out(batch["_h"].to_numpy(), k) & ~np.isnan(z)
                masked = np.where(hidden, np.nan, z)
                for r in range(len(fitted)):
                    total[r] += ((_impute(masked, fitted[r], ridge) - z)[hidden] ** 2).sum()
            yield pd.DataFrame({"rank": np.arange(len(fitted)), "error": total})

        sums = cells.mapInPandas(errors, "rank int, error double").groupBy("rank").agg(F.sum("error").alias("error"))
        return min(sums.collect(), key=lambda r: (r["error"], r["rank"]))["rank"]  # at most 6 rows


class PcaImputerModel:
    def __init__(self, cols, mean, sd, loadings, ridge):
        self.cols, self.mean, self.sd, self.loadings, self.ridge = cols, mean, sd, loadings, ridge

    def transform(self, df: DataFrame) -> DataFrame:
        mean, sd, loadings, ridge = self.mean, self.sd, self.loadings, self.ridge

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def fill(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values])
            full = _impute((x - mean) / sd, loadings, ridge) * sd + mean
            return pd.Series(list(np.where(np.isnan(x), full, x)))

        numbers = [F.col(c).cast("double") for c in self.cols]
        filled = df.withColumn("_filled", fill(*numbers))
        return filled.withColumns({c: F.col("_filled")[i] for i, c in enumerate(self.cols)}).drop("_filled")


def gaps(df: DataFrame, cols: Sequence[str]) -> Column:
    """Number of missing cells per row."""
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
