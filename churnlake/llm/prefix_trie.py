"""A trie over the turns of conversations: which beginnings are shared, by how many, and what sharing saves.

A turn is named by a 128-bit hash of role and text, so only names and lengths leave the scan.
Conversations are sorted by their sequence of names, dealt to range shards, and cut in blocks whose
padded matrix is bounded. In a block numpy sorts the rows of the matrix (lexsort); a row differs from
the one above it from some column on: the masks of changed columns, OR-accumulated from left to right,
mark at every depth the rows where nodes start, and reduceat sums the rows of each node. Padding sorts
last, so a longer conversation stands before those that are its beginning. With that order and the
depth that a row shares with the row above it, all results are sums over the rows of a node:

* a child starts at every row that shares at most ``d`` turns with the row above and has more than ``d``;
* a leaf starts at every row that shares less than all of its turns with the row above;
* every row but the first of a node repeats the turns from depth ``d`` to the depth that it shares.

Nodes that go on beyond a block, on the paths of its first and last row, come out as partial sums with
the hash of their path, and one shuffle of these rows adds them up in order of shards. The driver holds
one number per shard: the depth that its first row shares with the last row of the shard before.

Turns are ordered by turn number (null first), ties by role and then by the hash of the text; a repeated
row is a turn of its own. A null role or text is empty. Rows without a conversation id are left out. An
empty table has no nodes. Extra columns are ignored. The names of one conversation's turns (24 bytes
each) must fit in a task; the text of a conversation is nowhere held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm import scan
from churnlake.session import broadcast_if_small, checkpoint, shuffle_width, stored

CELLS = 1 << 17         # turns of the padded matrix of a block
SHARD_TURNS = 1 << 20   # turns of a shard aimed at
PAD = np.iinfo(np.int64).max

SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
RESULT = "conv_id bigint, depth bigint, parent_conv_id bigint, " + ", ".join(f"{c} bigint" for c in SUMS) + ", ends_sha256 string"
# A node that lies in its block is whole; otherwise it has the hash of its path, its place, and the ids that end there.
PARTIAL = RESULT + ", path binary, parent_path binary, place bigint, ends binary"
SCHEMA = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", *SUMS)] + [
    ("ends_sha256", pa.string()), ("path", pa.binary()), ("parent_path", pa.binary()), ("place", pa.int64()), ("ends", pa.binary())])


def named_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, as names in two halves and the bytes of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))

    def half(seed: int) -> Column:
        return F.least(F.xxhash64(F.lit(seed), role, text), F.lit(PAD - 1))

    one = F.struct(F.col("turn"), role.alias("role"), half(1).alias("a"), half(2).alias("b"), F.octet_length(text).cast("bigint").alias("bytes"))
    return turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["a"], t["b"], t["bytes"])).alias("turns"))


@dataclass
class Rows:
    """Some conversations in order of their names: ``names`` has two columns a turn, padded; ``size`` the turns."""

    conv: np.ndarray
    size: np.ndarray
    names: np.ndarray
    nbytes: np.ndarray

    @classmethod
    def of(cls, conv: np.ndarray, seqs: list[np.ndarray], sizes: list[np.ndarray]) -> Rows:
        size = np.array([len(s) for s in sizes], np.int64)
        names = np.full((len(conv), 2 * max(int(size.max(initial=0)), 1)), PAD)
        nbytes = np.zeros((len(conv), names.shape[1] // 2), np.int64)
        for i, (s, b) in enumerate(zip(seqs, sizes)):
            names[i, :2 * len(b)], nbytes[i, :len(b)] = s[:2 * len(b)], b
        order = np.lexsort((conv, *names.T[::-1]))
        return cls(conv[order], size[order], names[order], nbytes[order])

    def shared(self, before: int) -> np.ndarray:
        """Turns that each row shares with the row above it; for the first row that is given (-1: there is none)."""
        changed = self.names[1:] != self.names[:-1]
        changed = changed[:, ::2] | changed[:, 1::2]
        same = (~np.logical_or.accumulate(changed, axis=1)).sum(axis=1)
        # Columns of padding are no turns.
        return np.concatenate([[before], np.minimum(same, np.minimum(self.size[1:], self.size[:-1]))]).astype(np.int64)

    def paths(self, row: int) -> list[bytes]:
        """128-bit hashes of the beginnings of a row, by number of turns."""
        n = 2 * int(self.size[row])
        names = scan.mix(self.names[row, :n].astype(np.uint64))
        with np.errstate(over="ignore"):
            halves = [scan.mix(np.cumsum(np.concatenate([[k[0]], names * k[1:]]), dtype=np.uint64)[::2]) for k in (scan.keys(n + 1, 31), scan.keys(n + 1, 32))]
        return [h.tobytes() for h in np.stack(halves, axis=1)]


def _block(rows: Rows, before: int, place: int) -> pa.RecordBatch:
    """Nodes of a block; those that may go on in another block as partial sums."""
    shared = rows.shared(before)
    passed = np.concatenate([np.zeros((len(rows.conv), 1), np.int64), np.cumsum(rows.nbytes, axis=1)], axis=1)
    repeated = passed[np.arange(len(shared)), np.maximum(shared, 0)]
    first_size, last_size = int(rows.size[0]), int(rows.size[-1])
    first_paths, last_paths = rows.paths(0), rows.paths(-1)

    def path(depth: int, node: int, nodes: int) -> bytes:
        return last_paths[depth] if node == nodes - 1 and last_size >= depth else first_paths[depth]

    out = []
    above_of, above_open, above_conv = None, None, None
    for depth in range(int(rows.size.max()) + 1):
        member = np.flatnonzero(rows.size >= depth)
        start = np.flatnonzero((shared[member] < depth) | (member == 0))
        if not len(start):
            break
        count = np.diff(np.append(start, len(member)))
        seen = shared[member] >= depth  # the row repeats the node's turns
        below = passed[member, depth - 1] if depth else np.zeros(len(member), np.int64)
        conv = np.minimum.reduceat(rows.conv[member], start)
        ended = rows.size[member] == depth
        sums = (count, np.add.reduceat(((shared[member] <= depth) & ~ended).astype(np.int64), start),
                np.add.reduceat((shared[member] < rows.size[member]).astype(np.int64), start),
                np.add.reduceat(np.where(seen, repeated[member] - below, 0), start))
        # A node goes on before the block if the first row shares it, and may go on behind if the last row has it.
        open_ = np.zeros(len(start), bool)
        open_[0] |= before >= depth and first_size >= depth
        open_[-1] |= last_size >= depth
        ids = rows.conv[member]
        stop = np.append(start[1:], len(member))
        node = np.repeat(np.arange(len(start)), count)
        up = None if depth == 0 else above_of[member]
        for k in range(len(start)):
            mine = ids[start[k]:stop[k]][ended[start[k]:stop[k]]]
            text = ",".join(map(str, np.sort(mine).tolist())).encode()
            parent = None if depth == 0 else int(up[start[k]])
            parent_open = depth > 0 and above_open[parent]
            out.append((int(conv[k]), depth, None if depth == 0 or parent_open else int(above_conv[parent]), *(int(s[k]) for s in sums),
                        None if open_[k] else hashlib.sha256(text).hexdigest(), path(depth, k, len(start)) if open_[k] else None,
                        path(depth - 1, parent, len(above_conv)) if parent_open else None, place, text if open_[k] else None))
        above_of = np.full(len(rows.conv), -1)
        above_of[member] = node
        above_open, above_conv = open_, conv
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _nodes(batches: Iterator[pa.RecordBatch], before: dict[int, int], cells: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a shard, whose rows come in order, as nodes."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    widest, number, shard, last = 0, 0, 0, None

    def done() -> pa.RecordBatch:
        nonlocal last
        rows = Rows.of(np.array([h[0] for h in held], np.int64), [h[1] for h in held], [h[2] for h in held])
        if last is None:
            reach = before.get(shard, -1)
        else:
            n = min(len(last), 2 * int(rows.size[0]))
            other = np.flatnonzero(last[:n] != rows.names[0, :n])
            reach = (int(other[0]) if len(other) else n) // 2
        last = rows.names[-1, :2 * int(rows.size[-1])].copy()
        return _block(rows, reach, (shard << 32) + number)

    for batch in batches:
        shard = batch.column("shard")[0].as_py() if len(batch) else shard
        names, sizes = batch.column("names"), batch.column("nbytes")
        name_at, size_at = names.offsets.to_numpy(), sizes.offsets.to_numpy()
        name, size = names.values.to_numpy(), sizes.values.to_numpy()
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            n = int(size_at[i + 1] - size_at[i])
            if held and max(widest, n, 1) * (len(held) + 1) > cells:
                yield done()
                held, widest, number = [], 0, number + 1
            held.append((conv, name[name_at[i]:name_at[i + 1]].copy(), size[size_at[i]:size_at[i + 1]].copy()))
            widest = max(widest, n)
    if held:
        yield done()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the same node, which come one behind the other in order of place, as one row each.

    Only the running hash of the ids that end at the node is held, however many there are.
    """
    key, row, digest, empty = None, None, None, True
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            mine = (r["depth"], r["path"])
            if mine != key:
                if row is not None:
                    out.append(row | {"ends_sha256": digest.hexdigest()})
                key, row, digest, empty = mine, r, hashlib.sha256(), True
            else:
                row["conv_id"] = min(row["conv_id"], r["conv_id"])
                for c in SUMS:
                    row[c] += r[c]
            if r["ends"]:
                digest.update((b"" if empty else b",") + r["ends"])
                empty = False
        if out:
            yield pa.RecordBatch.from_pylist([r | {"ends": None} for r in out], schema=SCHEMA)
    if row is not None:
        yield pa.RecordBatch.from_pylist([row | {"ends_sha256": digest.hexdigest(), "ends": None}], schema=SCHEMA)


def trie(convs: DataFrame, cells: int = CELLS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct beginning of the conversations ``(conv_id, turns)``, the root (depth 0) included.

    ``turns`` as ``named_turns`` gives it; ids are distinct and not null. Results as the module says;
    ``saved_tokens`` counts, over all nodes of the subtree, the bytes of the node's last turn once for
    every member but one. ``ends_sha256`` is the hash of the ids of the conversations that end at the
    node, in order, joined by commas.
    """
    flat = convs.select(
        "conv_id", F.concat(F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))), F.array(F.lit(PAD))).alias("names"),
        F.transform("turns", lambda t: t["bytes"]).alias("nbytes"))
    flat = stored(flat, "turns")
    turns = flat.agg(F.sum(F.size("nbytes") + 1)).first()[0] or 0
    width = max(shuffle_width(convs.sparkSession), turns // shard_turns)
    # Partitions and their order stay in a checkpoint, so a shard is the same for every later job.
    shards = checkpoint(flat.repartitionByRange(width, "names", "conv_id").sortWithinPartitions("names", "conv_id")).withColumn(
        "shard", F.spark_partition_id().cast("bigint"))
    ends = shards.groupBy("shard").agg(F.min("names").alias("head"), F.max("names").alias("tail"))
    above = F.lag("tail").over(Window.orderBy("shard"))  # one row per shard
    same = F.array_position(F.zip_with("head", "above", lambda a, b: ~a.eqNullSafe(b)), True) - 1
    turn = F.when(same >= 0, F.floor(same / 2)).otherwise(F.floor((F.size("head") - 1) / 2))
    before = {r["shard"]: r["n"] for r in ends.withColumn("above", above).filter("above is not null").select("shard", turn.cast("long").alias("n")).collect()}

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nodes(batches, before, cells)

    found = stored(shards.mapInArrow(nodes, PARTIAL), "nodes")
    # All partial sums of a node meet in one task, which reads them in order and holds one row.
    partial = found.filter("path is not null").repartition(width, "depth", "path").sortWithinPartitions("depth", "path", "place")
    merged = stored(partial.mapInArrow(_merged, PARTIAL), "nodes")
    result = [c.split()[0] for c in RESULT.split(", ")]
    both = found.filter("path is null").select(*result, "parent_path").unionByName(merged.select(*result, "parent_path"))
    parents = broadcast_if_small(merged.select((F.col("depth") + 1).alias("d"), F.col("path").alias("p"), F.col("conv_id").alias("parent")))
    joined = both.join(parents, (F.col("depth") == F.col("d")) & (F.col("parent_path") == F.col("p")), "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent", "parent_conv_id")).select(*result)


def prefix_trie(turns: DataFrame, cells: int = CELLS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations given as rows ``(conv_id, turn, role, text)``."""
    return trie(named_turns(turns), cells, shard_turns)


def with_borrowed_beginnings(convs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """``convs`` where each conversation's first turns come from the first one of its family.

    The first is the id rounded down to a multiple of ``family``; its first ``h`` turns stand for those of
    the conversation, with ``h`` the crc32 of the id modulo ``most``. A first one that is not there has none.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = convs.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).otherwise(F.slice("turns", 1, 0))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return convs.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left").select(
        "conv_id", F.concat(head, own).alias("turns"))
