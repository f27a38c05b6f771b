"""Column expressions for cleaning, recoding and deriving features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.operators.profile import numeric_columns, text_columns


# --- choosing columns -----------------------------------------------------------

def pick_columns(df: DataFrame, prefix: str | None = None, suffix: str | None = None,
                 contains: str | None = None, kind: str | None = None) -> list[str]:
    """Column names by start, end or part of the name (any case) and by type."""
    typed = {"numeric": numeric_columns, "string": text_columns}
    names = typed[kind](df) if kind else df.columns
    return [
        c for c in names
        if (prefix is None or c.lower().startswith(prefix.lower()))
        and (suffix is None or c.lower().endswith(suffix.lower()))
        and (contains is None or contains.lower() in c.lower())
    ]


def relabel(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


# --- membership, levels, missing values -------------------------------------------

def is_member(col: Column, members: Sequence, null_is_member: bool = False) -> Column:
    """Membership that is never NULL."""
    return F.when(col.isNull(), F.lit(null_is_member)).otherwise(col.isin(*members))


def collapse_levels(col: Column, keep: Sequence[str], other: str = "other") -> Column:
    return F.when(col.isin(*keep), col).otherwise(other)


def recode(col: Column, mapping: Mapping[str, str], null_to: str | None = None,
           default: str | None = None) -> Column:
    """Replace listed levels; others keep their name, or take ``default``."""
    out = F.when(col.isNull(), F.lit(null_to))
    for old, new in mapping.items():
        out = out.when(col == old, F.lit(new))
    return out.otherwise(F.lit(default) if default is not None else col)


def to_null(col: Column, sentinels: Sequence[str]) -> Column:
    return F.when(~col.isin(*sentinels), col)


def fill_text(df: DataFrame, value: str = "other") -> DataFrame:
    return df.fillna(value, subset=text_columns(df))


def missing_flag(col: Column, missing: str, present: str) -> Column:
    return F.when(col.isNull(), missing).otherwise(present)


def fill_from_ratio(col: Column, numerator: Column, denominator: Column) -> Column:
    """Fill a missing ratio from its parts where the denominator is positive."""
    return F.when(col.isNull() & (denominator > 0), numerator / denominator).otherwise(col)


def threshold_class(col: Column, cut: float, low: str, high: str) -> Column:
    return F.when(col.isNull(), None).when(col <= cut, low).otherwise(high)


# --- numbers and dates ---------------------------------------------------------------

def parse_number(col: Column, decimal: str = ",") -> Column:
    text = col if decimal == "." else F.replace(col, F.lit(decimal), F.lit("."))
    return text.try_cast("double")


def parse_date(col: Column, fmt: str = "M/d/yyyy") -> Column:
    return F.try_to_date(col, fmt)


def grade_number(col: Column) -> Column:
    """School grades: ``PK`` is -1, ``K`` is 0, others are their number."""
    return F.when(col == "PK", -1.0).when(col == "K", 0.0).otherwise(col.try_cast("double"))


def season(day: Column) -> Column:
    """Seasons that change on the 15th of December, March, June and September."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    return (
        F.when(day.isNull(), None)
        .when((md >= 1215) | (md < 315), "Winter")
        .when(md < 615, "Spring")
        .when(md < 915, "Summer")
        .otherwise("Fall")
    )


def row_max(*cols: Column) -> Column:
    return F.greatest(*cols)


def min_max_scale(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Scale to 0..1; a single missing value makes the whole result missing."""
    edge = df.select(F.struct(
        F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"),
        (F.count(F.lit(1)) > F.count(col)).alias("gaps"))).scalar()
    scaled = F.try_divide(F.col(col) - edge["lo"], edge["hi"] - edge["lo"])
    return df.withColumn(col, F.when(~edge["gaps"], F.round(scaled, digits)))
