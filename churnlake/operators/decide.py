"""Decisions from a scorer: what-if scenarios, discount sweeps, segments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.operators.explain import Scorer
from churnlake.operators.profile import target_by_level
from churnlake.operators.ranking import largest


def scenario(df: DataFrame, scorer: Scorer, segment: Column, changes: Mapping[str, Column], weight: str,
             recompute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Score before and after changing columns of a segment; one row of comparisons."""
    before = scorer(df).withColumnsRenamed({"pred": "pred_before", weight: "_w"}).withColumn(weight, F.col("_w"))
    inside = F.coalesce(segment, F.lit(False))
    changed = before.withColumns({c: F.when(inside, v).otherwise(F.col(c)) for c, v in changes.items()})
    if recompute:
        changed = recompute(changed)
    after = scorer(changed)
    old, new = F.sum(F.col("_w") * F.col("pred_before")), F.sum(F.col("_w") * F.col("pred"))
    return after.agg(
        F.avg("pred_before").alias("mean_before"), F.avg("pred").alias("mean_after"),
        old.alias("total_before"), new.alias("total_after"),
        (new / old).alias("proportion"), (new - old).alias("absolute"))


def discount_sweep(df: DataFrame, scorer: Scorer, key: str, revenue: str,
                   discounts: Sequence[float] = (0.01, 0.02, 0.03, 0.04, 0.05), margin: float = 0.05,
                   recompute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Best discount per row by expected profit.

    Gives ``key, pred, e_profit, best_discount, best_pred, max_profit``. All
    discounts are scored in one pass. The offers of a row sit in one task, so
    they are folded into one row of numbers before anything is shuffled. Ties
    keep the smaller discount.
    """
    offers = sorted({0.0, *map(float, discounts)})
    swept = df.select("*", F.posexplode(F.array(*[F.lit(d) for d in offers])).alias("_offer", "_discount"))
    swept = swept.withColumn(revenue, F.col(revenue) * (1 - F.col("_discount")))
    if recompute:
        swept = recompute(swept)
    swept = scorer(swept).select(key, "_offer", "pred", (F.col(revenue) * margin * F.col("pred")).alias("_profit"))
    wide = swept.groupBy(key).agg(*[
        F.max(F.when(F.col("_offer") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(offers)) for c in ("pred", "_profit")])
    best = F.greatest(*[F.col(f"_profit{i}") for i in range(len(offers))])

    def at_best(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.col(f"_profit{i}") == best, v) for i, v in enumerate(values)])

    return wide.select(
        key, F.col("pred0").alias("pred"), F.col("_profit0").alias("e_profit"),
        at_best([F.lit(d) for d in offers]).alias("best_discount"),
        at_best([F.col(f"pred{i}") for i in range(len(offers))]).alias("best_pred"), best.alias("max_profit"))


def sweep_totals(sweep: DataFrame) -> DataFrame:
    best, base = F.sum("max_profit"), F.sum("e_profit")
    return sweep.agg((best / base).alias("proportion"), (best - base).alias("absolute"))


def largest_uplift(sweep: DataFrame) -> DataFrame:
    return largest(sweep.withColumn("uplift", F.col("max_profit") - F.col("e_profit")), "uplift")


def segments(df: DataFrame, cols: Sequence[str], target: str, exposure: str | None = None) -> DataFrame:
    """Target rate by every level of every listed column, in one stacked table."""
    long = df.select(
        target, *([exposure] if exposure else []),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])))
    weight = F.col(exposure) if exposure else F.lit(1)
    out = long.groupBy("column", "level").agg(F.sum(weight).alias("expo"), F.sum(target).alias("tot"))
    return out.withColumn("ave", F.try_divide("tot", "expo"))


def by_group_size(df: DataFrame, size: str, target: str, breaks: Sequence[float]) -> DataFrame:
    return target_by_level(df, size, target, breaks=breaks)
