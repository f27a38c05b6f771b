"""Joins in the forms the retention work needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.session import broadcast_if_small


def left_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
            null_safe: bool = False) -> DataFrame:
    """Left join on differently named keys; the right key is dropped.

    ``null_safe`` lets a missing key match a missing key.
    """
    a, b = F.col(left_key), F.col(f"_r.{right_key}")
    condition = a.eqNullSafe(b) if null_safe else a == b
    joined = left.alias("_l").join(right.alias("_r"), condition, "left")
    rest = [F.col(f"_r.{c}") for c in right.columns if c != right_key]
    return joined.select("_l.*", *rest)


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column both sides have."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, "left")


def lookup(df: DataFrame, dimension: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to a dimension, broadcast when counting shows it to be small."""
    return df.join(broadcast_if_small(dimension), on, "left")


def unmatched(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def matched(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def left_keep_cardinality(left: DataFrame, right: DataFrame, on: Sequence[str],
                          cols: Sequence[str]) -> DataFrame:
    """Left join to the distinct ``on + cols`` rows of the right side."""
    return left.join(right.select(*on, *cols).distinct(), list(on), "left")


def changed(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys present in both whose values differ, old and new side by side."""
    old = a.select(key, *[F.col(c).alias(f"{c}_old") for c in cols])
    new = b.select(key, *[F.col(c).alias(f"{c}_new") for c in cols])
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))
    return old.join(new, key).filter(differs)
