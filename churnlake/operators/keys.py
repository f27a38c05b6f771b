"""Keys that must be derived from composite identifiers, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_prefix(text: Column, prefix: Column, guarded: bool = False) -> Column:
    """Drop as many leading characters as ``prefix`` has; ``guarded`` only on a match."""
    cut = F.substring(text, F.length(prefix) + 1, F.length(text))
    return F.when(text.startswith(prefix), cut).otherwise(text) if guarded else cut


def strip_suffix(text: Column, suffix: Column, guarded: bool = False) -> Column:
    cut = F.substring(text, F.lit(1), F.length(text) - F.length(suffix))
    return F.when(text.endswith(suffix), cut).otherwise(text) if guarded else cut


def split_composite(df: DataFrame, id_col: str, prefix_col: str | None = None,
                    suffix_col: str | None = None, empty_prefix: tuple[str, ...] = (),
                    null_prefix: str = "", guarded: bool = False) -> DataFrame:
    """Add ``id_actual`` and whether the ID starts and ends as the code columns say.

    ``empty_prefix`` lists codes that are not written into the ID;
    ``null_prefix`` is what the ID carries where the code is missing.
    """
    ident = F.col(id_col)
    prefix, suffix = F.lit(""), F.lit("")
    if prefix_col:
        prefix = F.coalesce(F.col(prefix_col), F.lit(null_prefix))
        if empty_prefix:
            prefix = F.when(prefix.isin(*empty_prefix), F.lit("")).otherwise(prefix)
    if suffix_col:
        suffix = F.coalesce(F.col(suffix_col), F.lit(""))
    actual = strip_suffix(strip_prefix(ident, prefix, guarded), suffix, guarded)
    return df.withColumns({
        "id_actual": actual,
        "prefix_ok": ident.startswith(prefix),
        "suffix_ok": ident.endswith(suffix),
    })


def key_frequency(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, ...: one row ``n = 1`` means unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(
        F.count(F.lit(1)).alias("n_keys"))


def reconciliation_report(left: DataFrame, right: DataFrame, key: str = "id_actual") -> DataFrame:
    """One ``(check, n)`` table: odd IDs, sizes, repeated keys and unmatched rows.

    Both sides come from ``split_composite``. They are stacked and counted per
    key, so each side is read once and a frequent key is combined before the
    shuffle. A missing key matches nothing.
    """
    sides = ("left", "right")
    facts = {"rows": F.lit(True), "prefix_mismatch": ~F.col("prefix_ok"), "suffix_mismatch": ~F.col("suffix_ok")}
    stacked = None
    for side, df in zip(sides, (left, right)):
        part = df.select(F.col(key).alias("_key"), *[
            (fact.cast("long") if s == side else F.lit(0)).cast("long").alias(f"{s}_{name}")
            for s in sides for name, fact in facts.items()])
        stacked = part if stacked is None else stacked.unionByName(part)
    names = [f"{s}_{name}" for s in sides for name in facts]
    per_key = stacked.groupBy("_key").agg(*[F.sum(n).alias(n) for n in names])
    totals = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    for side, other in (sides, sides[::-1]):
        mine, theirs = F.col(f"{side}_rows"), F.col(f"{other}_rows")
        alone = (theirs == 0) | F.col("_key").isNull()
        totals += [
            F.count(F.when(mine > 1, 1)).alias(f"{side}_repeated_keys"),
            F.coalesce(F.sum(F.when(alone, mine)), F.lit(0)).alias(f"{side}_unmatched")]
    row = per_key.agg(*totals)
    return row.unpivot([], row.columns, "check", "n")
