"""Stacking, differences of level sets, reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name, absent columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_same_columns(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def new_levels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct levels of ``a`` that ``b`` does not have; a missing level counts as a level."""
    return a.select(col).subtract(b.select(col))


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Exactly ``columns`` in that order: absent ones filled, surplus ones dropped."""
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def gather(df: DataFrame, key: str, cols: Sequence[str], name: str = "var2", value: str = "value") -> DataFrame:
    return df.unpivot([key], list(cols), name, value)
