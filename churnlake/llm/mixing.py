"""Mixing sources to target weights, in DataFrame functions only.

A source's rate is its target over its size. Each document is taken floor(rate) times, and
once more if a hash of the seed and its id falls below the fraction of the rate.

A null text has size 0; a source whose documents are all empty has target 0. A null source is
a source of its own, last in order. Repeated rows are taken alike. Extra columns pass through
unless they bear the name of a result, which then takes their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
MAX_RATE = 3.0
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
RESULTS = ("size", "source_size", "target", "copies")
_HEX = 13  # hex digits of the hash that make the draw: exact in a double


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, _HEX), 16, 10).cast("double") / F.lit(float(16 ** _HEX))


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """``(source, source_size)`` with ``target``: shares by weight, none above ``max_rate`` sizes.

    Sources in the order of cap per weight: those before the level are held at their cap, the
    others share the rest by weight. One row per source, so the windows see no documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = per_source.withColumn("w", w).withColumn("cap", F.lit(max_rate) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    held = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) - held) / rest
    leveled = one.withColumn("_level", level)
    # The level is that of the first source which it leaves below its cap.
    final = F.min(F.when(F.col("cap") >= F.col("w") * F.col("_level"), F.struct(F.col("cap") / F.col("w"), F.col("_level").alias("v")))).over(every)["v"]
    return leveled.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * final), F.col("cap")).alias("target"))


def with_copies(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED,
                with_text: bool = False) -> DataFrame:
    """``docs`` (without texts unless asked for) with ``size, source_size, target, copies``.

    The sizes are counted once and stored as narrow rows; the sources' sums are partially
    aggregated, and adaptive execution splits a source that holds many rows in the join.
    """
    kept = [c for c in docs.columns if c not in RESULTS and (with_text or c != "text")]
    sized = docs.select(*kept, sizes(docs).alias("size"))
    if with_text:
        per_doc = docs.select("source", sizes(docs).alias("size"))
    else:
        per_doc = sized = checkpoint(sized)
    per_source = per_doc.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, weights).withColumnRenamed("source", "_source")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw(F.col(key), seed) < rate - whole, 1).otherwise(0)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        *kept, "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as its copies say, with its columns."""
    out = with_copies(docs, key, with_text=True, **options)
    return out.withColumn("_copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(
        F.array().cast("array<int>")))).select(*docs.columns)
