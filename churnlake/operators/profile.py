"""Column profiles, target rates by level, correlations and other exploratory tables.

Wide tables are profiled in one job: columns are unpivoted to
``(column, value)`` and counted with map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.operators.ranking import first_per_group, group_quantiles
from churnlake.operators.sums import array_sum
from churnlake.session import broadcast_if_small, checkpoint

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def melt(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    typed = df.select(*[F.col(c).cast(kind).alias(c) for c in cols])
    return typed.unpivot([], list(cols), "column", "value")


def level_counts(df: DataFrame, cols: Sequence[str], na_substring: bool = False) -> DataFrame:
    """``(column, value, n)``; with ``na_substring`` any text containing "na" is missing."""
    long = melt(df, cols, "string")
    if na_substring:
        contains = F.lower("value").contains("na")
        long = long.withColumn("value", F.when(~contains, F.col("value")))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def levels(df: DataFrame, cols: Sequence[str], top_n: int, na_substring: bool = False) -> DataFrame:
    """``(column, position, level, share)``: missing share, top levels, then the rest.

    ``Rest`` is the share of level names left out, ``RestCount`` their number.
    """
    counts = level_counts(df, cols, na_substring)
    n_rows = F.sum("n")
    totals = counts.groupBy("column").agg(
        n_rows.alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("n_levels"))
    # Missing comes last and is dropped after ranking, so that both uses share one count.
    order = [F.col("value").isNull(), F.desc("n"), F.asc("value")]
    top = first_per_group(counts, ["column"], order, top_n - 1, "position").filter(F.col("value").isNotNull())
    top = top.join(F.broadcast(totals), "column").select(
        "column", "position", F.col("value").alias("level"), (F.col("n") / F.col("rows")).alias("share"))
    dropped = F.greatest(F.col("n_levels") - (top_n - 1), F.lit(0))
    summary = totals.select("column", F.inline(F.array(
        _profile_entry(0, "NA", F.col("missing") / F.col("rows")),
        _profile_entry(top_n, "Rest", F.coalesce(F.try_divide(dropped, F.col("n_levels")), F.lit(0.0))),
        _profile_entry(top_n + 1, "RestCount", dropped.cast("double")))))
    return top.unionByName(summary).withColumn("share", F.round("share", 4))


def _profile_entry(position: int, level: str, share: Column) -> Column:
    return F.struct(F.lit(position).alias("position"), F.lit(level).alias("level"), share.alias("share"))


def levels_wide(profile: DataFrame, top_n: int) -> DataFrame:
    """One row per column: ``Var_1`` .. ``Var_n`` as ``level : share``, then the rest."""
    text = F.concat_ws(" : ", "level", F.format_number("share", 4))
    entries = [F.max(F.when(F.col("position") == i, text)).alias(f"Var_{i + 1}") for i in range(top_n)]
    return profile.groupBy("column").agg(
        *entries,
        F.max(F.when(F.col("level").eqNullSafe("Rest") & (F.col("position") == top_n), F.col("share"))).alias("Rest"),
        F.max(F.when(F.col("position") == top_n + 1, F.col("share"))).alias("RestCount"))


# --- numeric bins -------------------------------------------------------------

def equal_width_bin(df: DataFrame, col: str, bins: int = 10) -> Column:
    """Bin number 1..bins of ``(a, b]`` intervals over the column's range; the minimum is in bin 1."""
    edge = df.select(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    width = (edge["hi"] - edge["lo"]) / bins
    number = F.ceil(F.try_divide(F.col(col) - edge["lo"], width))
    return F.when(F.col(col).isNull(), None).otherwise(
        F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.lit(bins))).cast("int")


def break_bin(col: Column, breaks: Sequence[float]) -> Column:
    """Number of the ``(b[i], b[i+1]]`` interval that holds the value, else NULL."""
    ordered = sorted(breaks)
    edges = F.array(*[F.lit(float(b)) for b in ordered])
    number = F.size(F.filter(edges, lambda b: b < col))
    return F.when((col > ordered[0]) & (col <= ordered[-1]), number).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    binned = df.select(equal_width_bin(df, col, bins).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# --- target by level -----------------------------------------------------------

def target_by_level(df: DataFrame, col: str, target: str, exposure: str | None = None,
                    count: str | None = None, pred: str | None = None,
                    breaks: Sequence[float] | None = None, n_bins: int | None = None) -> DataFrame:
    """Exposure, target total and target rate per level of ``col``.

    The rate divides by the summed exposure, or by ``count`` where one is given.
    With ``breaks`` or ``n_bins`` the column is binned first and the level is the
    bin number; missing values stay a level of their own.
    """
    level = F.col(col)
    if breaks is not None:
        level = break_bin(level, breaks)
    elif n_bins is not None:
        level = equal_width_bin(df, col, n_bins)
    weight = F.col(exposure) if exposure else F.lit(1)
    sums = [
        F.coalesce(F.sum(weight), F.lit(0)).alias("expo"),
        F.coalesce(F.sum(target), F.lit(0)).alias("tot"),
        F.coalesce(F.sum(count if count else weight), F.lit(0)).alias("_base"),
    ]
    if pred:
        sums.append(F.coalesce(F.sum(pred), F.lit(0.0)).alias("tot_pred"))
    table = df.groupBy(level.alias("level")).agg(*sums)
    table = table.withColumn("ave", F.try_divide(F.col("tot"), F.col("_base")))
    if pred:
        table = table.withColumn("predprop", F.try_divide(F.col("tot_pred"), F.col("_base")))
    return table.drop("_base")


def portfolio(df: DataFrame, target: str, exposure: str | None = None) -> DataFrame:
    """Mean and variance of the target, the mean taken over the exposure."""
    weight = F.col(exposure) if exposure else F.lit(1)
    t = F.col(target).cast("double")
    sums = df.agg(
        F.sum(weight).cast("double").alias("n"), F.sum(t).alias("s"),
        F.sum(t * t).alias("ss"), F.count(t).alias("c"))
    mean = F.col("s") / F.col("n")
    square = F.col("ss") - 2 * mean * F.col("s") + mean * mean * F.col("c")
    return sums.select("n", mean.alias("mean"), (square / (F.col("n") - 1)).alias("var"))


def auto_bin(level_table: DataFrame, whole: DataFrame, strength: float = 2.0,
             exposure_min: float = 0.02) -> DataFrame:
    """Keep levels that stand out from the portfolio and carry exposure; pool the others.

    ``whole`` is the one-row ``portfolio`` table.
    """
    stats = whole.select(F.struct("mean", "var")).scalar()
    total = level_table.select(F.sum("expo")).scalar()
    margin = stats["var"] / strength
    stands_out = (F.col("ave") >= stats["mean"] + margin) | (F.col("ave") <= stats["mean"] - margin)
    keep = stands_out & (F.col("expo") / total >= exposure_min)
    name = F.when(keep, F.coalesce(F.col("level").cast("string"), F.lit("NA"))).otherwise("other")
    pooled = level_table.groupBy(name.alias("level")).agg(F.sum("expo").alias("expo"), F.sum("tot").alias("tot"))
    return pooled.withColumn("ave", F.try_divide(F.col("tot"), F.col("expo")))


# --- column summaries ----------------------------------------------------------

def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, one row per column."""
    long = melt(df, cols, "double")
    basic = long.groupBy("column").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing"))
    return basic.join(group_quantiles(long, ["column"], "value", QUARTILES, few_groups=True), "column", "left")


def describe(df: DataFrame) -> DataFrame:
    """Count, distinct levels and top level of texts, dates and truth values; moments and quartiles of numbers."""
    numbers = numeric_columns(df)
    levels = [f.name for f in df.schema if f.name not in numbers and isinstance(f.dataType, T.AtomicType)]
    parts = []
    if numbers:
        long = melt(df, numbers, "double")
        moments = long.groupBy("column").agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"))
        parts.append(moments.join(group_quantiles(long, ["column"], "value", QUARTILES, few_groups=True), "column", "left"))
    if levels:
        counts = level_counts(df, levels).filter(F.col("value").isNotNull())
        totals = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
        top = first_per_group(counts, ["column"], [F.desc("n"), F.asc("value")]).select(
            "column", F.col("value").alias("top"), F.col("n").alias("freq"))
        parts.append(totals.join(top, "column"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def dictionary(df: DataFrame, max_levels: int = 50) -> DataFrame:
    """Data dictionary: type, missing count, and level counts or a numeric range.

    A first pass estimates the number of levels of each column; only columns
    that may have few are counted level by level, so identifiers are never
    shuffled.
    """
    numbers = numeric_columns(df)
    texts = [c for c in df.columns if c not in numbers]
    sketch = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts] or [F.lit(0)]).first()  # one row
    few = [c for c in texts if sketch[c] <= 4 * max_levels]

    facts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    out = facts.unpivot([], facts.columns, "column", "missing")
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    content = F.lit(f"more than {max_levels} levels")
    if few:
        counts = level_counts(df, few).filter(F.col("value").isNotNull())
        # At most max_levels + 1 entries per column reach the list.
        listed = first_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], max_levels + 1, "position").groupBy(
            "column").agg(F.count(F.lit(1)).alias("n_levels"), F.array_sort(F.collect_list(
                F.struct("position", F.concat_ws(": ", "value", F.col("n").cast("string")).alias("t")))).alias("l"))
        texts_of = F.array_join(F.transform("l", lambda x: x["t"]), ", ")
        listed = listed.select("column", "n_levels", texts_of.alias("level_list"))
        out = out.join(broadcast_if_small(listed), "column", "left")
        shown = F.when(F.col("n_levels") <= max_levels, F.col("level_list")).when(F.col("n_levels").isNull(), "")
        content = F.when(F.col("column").isin(*few), shown.otherwise(content)).otherwise(content)
    if numbers:
        ranges = summary(df, numbers).select(
            "column", *[F.format_number(c, 2).alias(c) for c in ("min", "max", "median", "mean")])
        out = out.join(broadcast_if_small(ranges), "column", "left")
        content = F.when(F.col("column").isin(numbers), F.concat(
            F.lit("min "), "min", F.lit(", max "), "max", F.lit(", med "), "median", F.lit(", mean "), "mean")).otherwise(content)
    return out.select("column", types[F.col("column")].alias("dtype"), "missing", content.alias("content"))


def missing(df: DataFrame) -> DataFrame:
    """Share of missing values per column, only columns that have any."""
    share = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return share.unpivot([], share.columns, "column", "share").filter("share > 0")


def consistency(df: DataFrame, supplied: str, formula: Column) -> DataFrame:
    """Five-number summary of the relative error of a supplied column against its formula."""
    error = df.select(F.try_divide(F.col(supplied) - formula, formula).alias("rel_error"))
    return summary(error, ["rel_error"])


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and the whiskers: the outermost values within 1.5 quartile ranges."""
    by = list(by)
    source = df if by else df.withColumn("_one", F.lit(1))
    keys = by or ["_one"]
    quart = broadcast_if_small(checkpoint(group_quantiles(source, keys, col, QUARTILES)))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    value = F.col(col)
    # One row per group, next to the rows; many groups join by key instead.
    joined = source.filter(value.isNotNull()).join(quart, keys)
    whiskers = joined.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(value >= F.col("q1") - reach, value)).alias("low_whisker"),
        F.max(F.when(value <= F.col("q3") + reach, value)).alias("high_whisker"),
        F.count(F.when((value < F.col("q1") - reach) | (value > F.col("q3") + reach), 1)).alias("n_outliers"))
    return whiskers if by else whiskers.drop("_one")


# --- correlation ---------------------------------------------------------------

def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(var1, var2, value)`` for each unordered pair, rows with gaps left out; NULL for a constant column.

    Tasks add up products of centred rows as small matrices; the driver gets one number per pair of columns.
    """
    cols = sorted(cols)
    k = len(cols)
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    means = complete.agg(*[F.avg(c).alias(c) for c in cols]).first()  # one number per column
    mean = np.array([m or 0.0 for m in means])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - mean
        return z.T @ z

    sums = array_sum(complete, products, k * k).reshape(k, k)
    size = np.sqrt(np.diag(sums))
    pairs = [(cols[i], cols[j], float(sums[i, j] / (size[i] * size[j])) if size[i] * size[j] > 0 else None)
             for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(pairs, "var1 string, var2 string, value double")


def correlated_pairs(df: DataFrame, cols: Sequence[str], low: float = 0.8) -> DataFrame:
    size = F.abs("value")
    return correlation(df, cols).filter((size > low) & (size < 1))


def drop_correlated(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop the second column of every correlated pair."""
    drop = [r["var2"] for r in pairs.select("var2").distinct().collect()]  # column names only
    return df.drop(*drop)


def near_zero_variance(df: DataFrame, cols: Sequence[str], freq_cut: float = 19.0,
                       unique_cut: float = 10.0) -> DataFrame:
    """Frequency ratio of the two commonest levels, percent of distinct values, verdict."""
    counts = level_counts(df, cols).filter(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    n_rows = df.select(F.count(F.lit(1))).scalar()
    two = first_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], 2, "_pos")
    top = two.groupBy("column").agg(
        F.max(F.when(F.col("_pos") == 1, F.col("n"))).alias("first"),
        F.max(F.when(F.col("_pos") == 2, F.col("n"))).alias("second"))
    ratio = F.coalesce(F.col("first") / F.col("second"), F.lit(0.0))
    out = top.join(totals, "column").select(
        "column", ratio.alias("freq_ratio"),
        (100.0 * F.col("n_levels") / n_rows).alias("percent_unique"),
        (F.col("n_levels") == 1).alias("zero_var"))
    return out.withColumn("nzv", F.col("zero_var") | (
        (F.col("freq_ratio") > freq_cut) & (F.col("percent_unique") <= unique_cut)))


def drop_near_zero_variance(df: DataFrame, report: DataFrame) -> DataFrame:
    """Drop the columns a training report marked, from the same or from new data."""
    drop = [r["column"] for r in report.filter("nzv").select("column").collect()]  # column names only
    return df.drop(*drop)


# --- shapes, proportions, duplicates ---------------------------------------------

def proportion_table(df: DataFrame, col: str) -> DataFrame:
    """Share of each level, the missing level included."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.col("n") / total)


def shape(frames: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
               F.lit(len(df.columns)).cast("long").alias("n_columns"))
        for name, df in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; exact counting spreads over ``(column, value)``."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return row.unpivot([], row.columns, "column", "n_distinct")
    return level_counts(df, cols).groupBy("column").agg(F.count("value").alias("n_distinct"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    keys = list(cols or df.columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def joined_levels(df: DataFrame, by: str, col: str, sep: str = "|") -> DataFrame:
    """Distinct level names per group as one text; meant for level tables, not base rows."""
    pairs = df.filter(F.col(col).isNotNull()).select(by, col).distinct()
    return pairs.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias("levels"))
