"""Order statistics without putting all rows, or one whole group, into one task.

Rows are first counted per distinct value, then spread over value ranges found
by an approximate quantile sketch. The sketch only balances the work; results
are exact because range totals carry the offsets from one range to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlake.session import broadcast_if_small, checkpoint, shuffle_width

RANGE = "_range"


def value_ranges(df: DataFrame, col: str, n_ranges: int | None = None) -> list[float]:
    n = max(n_ranges or shuffle_width(df.sparkSession), 2)
    cuts = df.approxQuantile(col, [i / n for i in range(1, n)], 1.0 / (4 * n))
    inner = sorted(set(cuts)) or [0.0]
    return [float("-inf"), *inner, float("inf")]


def add_range(df: DataFrame, col: str, cuts: Sequence[float]) -> DataFrame:
    ranged = Bucketizer(splits=list(cuts), inputCol=col, outputCol=RANGE).transform(df)
    return ranged.withColumn(RANGE, F.col(RANGE).cast("int"))


def is_number(col: str) -> Column:
    return F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))


def running_totals(df: DataFrame, order_col: str, sums: dict[str, Column],
                   descending: bool = True, n_ranges: int | None = None, distinct: bool = False) -> DataFrame:
    """Running sums over a global order, one row per distinct ``order_col`` value.

    Gives ``order_col``, the per-value sums, and ``cum_<name>`` for every name.
    ``distinct`` says that every value occurs once already. Rows without a value
    (NULL or NaN) have no place in the order and are left out.
    """
    df = df.filter(is_number(order_col))
    if distinct:
        per_value = df.select(order_col, *[e.alias(n) for n, e in sums.items()])
    else:
        # Stored, so that the rows are read once; the ranges then hold like numbers of distinct values.
        per_value = checkpoint(df.groupBy(order_col).agg(*[F.sum(e).alias(n) for n, e in sums.items()]))
    per_value = add_range(per_value, order_col, value_ranges(per_value, order_col, n_ranges))
    direction = F.desc if descending else F.asc
    before = Window.orderBy(direction(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many rows as there are cuts.
    offsets = per_value.groupBy(RANGE).agg(*[F.sum(n).alias(n) for n in sums]).select(
        RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    within = Window.partitionBy(RANGE).orderBy(direction(order_col)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return per_value.join(F.broadcast(offsets), RANGE).select(
        order_col, *sums,
        *[(F.sum(n).over(within) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in sums])


def group_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float],
                    n_ranges: int | None = None, few_groups: bool = False) -> DataFrame:
    """Exact interpolated quantiles of ``col`` per group; NULL and NaN are skipped.

    A group may be arbitrarily large: only the value ranges that hold a wanted
    rank are looked at row by row. ``few_groups`` says that the groups are few
    by design (columns of a table); the wanted ranges, at most two per group and
    quantile, are then broadcast and the other counts are dropped unshuffled.
    """
    by = list(by)
    value = df.filter(is_number(col)).select(*by, F.col(col).cast("double").alias("_v"))
    counts = checkpoint(value.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    counts = add_range(counts, "_v", value_ranges(counts, "_v", n_ranges))
    if not by:
        by, few_groups = ["_all"], True
        counts = counts.withColumn("_all", F.lit(1))

    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranges = counts.groupBy(*by, RANGE).agg(F.sum("_n").alias("_rn")).select(
        *by, RANGE, "_rn",
        F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_before"),
        F.sum("_rn").over(whole).alias("_total"))

    def low(p: float) -> Column:
        return F.floor((F.col("_total") - 1) * F.lit(float(p)))

    def high(p: float) -> Column:
        return F.ceil((F.col("_total") - 1) * F.lit(float(p)))

    def inside(rank: Column, start: Column, length: Column) -> Column:
        return (rank >= start) & (rank < start + length)

    wanted = F.lit(False)
    for p in probs.values():
        for rank in (low(p), high(p)):
            wanted = wanted | inside(rank, F.col("_before"), F.col("_rn"))
    needed = ranges.filter(wanted)
    hit = counts.join(F.broadcast(needed) if few_groups else needed, [*by, RANGE])
    upto = Window.partitionBy(*by, RANGE).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("_start", F.col("_before") + F.sum("_n").over(upto) - F.col("_n"))
    picks = []
    for name, p in probs.items():
        for side, rank in (("lo", low(p)), ("hi", high(p))):
            here = inside(rank, F.col("_start"), F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{name}"))
    picked = hit.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    out = [
        (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
         * ((F.col("_total") - 1) * F.lit(float(p)) - low(p))).alias(name)
        for name, p in probs.items()
    ]
    return picked.select(*[c for c in by if c != "_all"], *out)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1,
                    rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts to ``n`` rows before the shuffle."""
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def largest(df: DataFrame, col: str, smallest: bool = False) -> DataFrame:
    """All rows that share the largest (or smallest) value of ``col``."""
    edge = (F.min if smallest else F.max)(col)
    return df.filter(F.col(col) == df.select(edge).scalar())


def nearest_to(df: DataFrame, col: str, target: float, key: str, tolerance: float = 0.01) -> DataFrame:
    """The first row by key whose value lies within ``tolerance`` of the target."""
    low, high = target * (1 - tolerance), target * (1 + tolerance)
    return df.filter((F.col(col) > low) & (F.col(col) < high)).orderBy(key).limit(1)


def share_of_total(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(col) / df.select(F.sum(col)).scalar())


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in a repeatable random order: the smallest hashes of key and seed."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def shuffled_position(df: DataFrame, key: str, seed: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Number the rows 0..n-1 in a repeatable random order, group after group.

    The order is that of the hashes of key and seed. Rows with the same leading
    hash digits form buckets of about equal size, are numbered there, and
    shifted by the sizes of the buckets before. With ``by``, equal ``by`` values
    get consecutive numbers.
    """
    by = list(by)
    digits = 1
    while 16 ** digits < 4 * shuffle_width(df.sparkSession):
        digits += 1
    h = hash_order(key, seed)
    marked = df.withColumns({"_h": h, "_b": F.substring(h, 1, digits)})
    place = [*by, "_b"]
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket and group of ``by``; used with a handful of classes.
    offsets = marked.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).select(
        *place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    number = F.row_number().over(Window.partitionBy(*place).orderBy("_h", key)) - 1 + F.col("_off")
    return marked.join(broadcast_if_small(offsets), place).withColumn(name, number).drop("_h", "_b", "_off")
