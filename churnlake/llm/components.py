"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.session import checkpoint, shuffle_width

CHUNK = 1 << 20  # links contracted at once in a task


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after rows i and j are joined, pair by pair; a root is the least row of its class."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def star_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones connect, each node to the least one that it reaches."""
    node, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    least = joined(np.arange(len(node)), code[:len(u)], code[len(u):])
    at = np.flatnonzero(least != np.arange(len(node)))
    return node[at], node[least[at]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in star_of(table["u"].to_numpy(), table["v"].to_numpy())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield star()
            held = []
    if held:
        yield star()


def _with_least(links: DataFrame) -> DataFrame:
    """Both directions of each link, with the least neighbour of ``u`` (itself included)."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one link down at most, and none of the nodes it leads to has any."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def roots(links: DataFrame, a: str, b: str, contractions: int = 2) -> DataFrame:
    """``(node, root)`` for every node of a link; the root is the least node that can be reached.

    At first tasks contract the links they hold, dealt by the greater node, a million at a time. Then
    star steps finish: a node with very many links is a skewed key of a join with one row per node,
    which adaptive execution splits; no task gathers the links of a node. Empty links give no rows.
    """
    edges = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).filter("u <> v")
    width = shuffle_width(links.sparkSession)
    for _ in range(contractions):
        edges = edges.repartition(width, "u").mapInArrow(_contract, "u bigint, v bigint")
    edges = checkpoint(edges.distinct())
    while not _is_star(edges):
        large = _with_least(edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node and its lesser neighbours point to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = down.join(least, F.col("u") == F.col("k"))
        edges = checkpoint(small.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select(
            "e.*").filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
