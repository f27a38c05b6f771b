"""Grouping the levels of a text column, and applying learned groups to new data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.operators.profile import joined_levels
from churnlake.operators.side_by_side import DIGITS, assigned, best_centres, silhouettes
from churnlake.session import broadcast_if_small, checkpoint, splittable

MISSING = "NA"


def _level(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(MISSING))


def lump_rare(counts: DataFrame, group: str, n: str, threshold: float = 0.05, other: str = "other") -> DataFrame:
    """Rename groups with fewer than ``round(rows * threshold)`` rows in a level table."""
    sizes = counts.groupBy(group).agg(F.sum(n).alias("_size"))
    smallest = F.round(counts.select(F.sum(n)).scalar() * threshold)
    rare = sizes.filter(F.col("_size") < smallest).select(group, F.lit(1).alias("_rare"))
    return counts.join(broadcast_if_small(rare), group, "left").withColumn(
        group, F.when(F.col("_rare") == 1, other).otherwise(F.col(group))).drop("_rare")


def lump_rare_levels(df: DataFrame, col: str, threshold: float = 0.05, other: str = "other") -> DataFrame:
    """Mapping ``(level, group)`` that keeps frequent levels and pools the rest."""
    counts = df.groupBy(_level(col).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return lump_rare(counts.withColumn("group", F.col("level")), "group", "n", threshold, other).select("level", "group")


def apply_groups(df: DataFrame, col: str, mapping: DataFrame, replace: bool = True, other: str = "other") -> DataFrame:
    """Known levels take their group, unknown ones become ``other``.

    The result replaces the column or goes to ``<col>_bis``.
    """
    named = splittable(mapping.select(F.col("level").alias("_level"), F.col("group").alias("_group")), "_level")
    out = df.withColumn("_level", _level(col)).join(broadcast_if_small(named), "_level", "left")
    target = col if replace else f"{col}_bis"
    return out.withColumn(target, F.coalesce("_group", F.lit(other))).drop("_level", "_group")


def group_letters(number: Column) -> Column:
    """A to Z, then AA, AB and so on, up to three letters."""
    n = number.cast("int")
    first, second = n - 702, n - 26

    def letter(i: Column) -> Column:
        return F.char(F.pmod(i, F.lit(26)) + 65)

    return F.concat(
        F.when(first >= 0, letter(F.floor(first / 676))).otherwise(""), F.when(second >= 0, letter(F.floor(second / 26))).otherwise(""), letter(n))


class LevelGrouper:
    """Cluster levels that behave alike and pool the groups that stay small.

    Levels are points (target rate, log of their size), weighted by size, so
    the clustering works on one row per level whatever the size of the data.
    All numbers of groups, each from ``starts`` starts, are fitted side by side.
    """

    def __init__(self, col: str, target: str, threshold: float = 0.05, k: int | None = None,
                 max_k: int | None = None, letters: bool = False, seed: int = 2022, starts: int = 25):
        self.col, self.target, self.threshold = col, target, threshold
        self.k, self.max_k, self.letters, self.seed, self.starts = k, max_k, letters, seed, starts

    def level_table(self, df: DataFrame) -> DataFrame:
        """``(level, n, weight, point)``, the points standardised; a coordinate that never varies is 0.

        The last bits of a mean depend on the order of the rows, so points are rounded: starts are drawn by their hashes.
        """
        table = checkpoint(df.groupBy(_level(self.col).alias("level")).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col(self.target).cast("double")), F.lit(0.0)).alias("rate")).withColumn(
            "log_n", F.log("n")))
        names = ("rate", "log_n")
        found = table.agg(*[x for c in names for x in (F.avg(c), F.stddev_samp(c))]).first()  # 4 numbers
        scaled = [F.round((F.col(c) - found[2 * i]) / found[2 * i + 1], DIGITS) if found[2 * i + 1] else F.lit(0.0) for i, c in enumerate(names)]
        return table.select("level", "n", F.col("n").cast("double").alias("weight"), F.array(*scaled).alias("point"))

    def centres(self, levels: DataFrame) -> dict[int, np.ndarray]:
        """The best centres for each number of clusters, from 2 to below the number of levels (or to ``max_k``)."""
        # Equal points can't be told apart, so there are no more clusters than distinct points.
        most = min(levels.count() - 1, levels.select("point").distinct().count(), self.max_k or (1 << 31))
        return best_centres(levels, range(2, most + 1), self.starts, self.seed)

    def scores(self, levels: DataFrame) -> list[tuple[int, float]]:
        """Silhouette of each number of clusters."""
        return silhouettes(levels, self.centres(levels))

    @staticmethod
    def choose_k(scores: list[tuple[int, float]]) -> int:
        """The first number of clusters whose silhouette reaches the 95th percentile."""
        if not scores:
            return 1
        scores = [(k, round(s, DIGITS)) for k, s in scores]
        cut = np.quantile([s for _, s in scores], 0.95)
        return next(k for k, s in scores if s >= cut)

    def fit(self, df: DataFrame) -> DataFrame:
        """Mapping ``(level, group)``, to be saved and applied with ``apply_groups``."""
        levels = checkpoint(self.level_table(df))
        if self.k:
            k = min(self.k, levels.select("point").distinct().count())
            found = best_centres(levels, [k] if k > 1 else [], self.starts, self.seed)
        else:
            found = self.centres(levels)
            k = self.choose_k(silhouettes(levels, found))
        clustered = assigned(levels, found[k]) if k > 1 else levels.withColumn("cluster", F.lit(0))
        if self.letters:
            clustered = clustered.withColumn("group", group_letters(F.col("cluster")))
        else:
            names = joined_levels(clustered, "cluster", "level").withColumnRenamed("levels", "group")
            clustered = clustered.join(names, "cluster")
        return lump_rare(clustered.select("level", "n", "group"), "group", "n", self.threshold).select("level", "group")
