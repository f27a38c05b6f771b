"""Near copies: set similarity join along chosen paths of minwise values.

A document's set is its distinct two-word shingles. Documents with equal sets are one vertex.
Each vertex has minwise values; independent trees branch it recursively: at a node, the node's
own hash chooses coordinates, and the values there name the child nodes. Similar sets choose
the same children, so they meet in some node. Nodes that are still large branch on, then go
to blocks. Members of a node are compared exhaustively by short sketches, and what may be linked
joins a candidate group; in a node of several blocks, all members that the blocks left outside the
node's largest candidate group are then compared with every block. Each group is then compared exhaustively on the full sets, in blocks if
it is large: blocks first, then one member of each class found, then all members outside the
largest class with every block. So sketches only decide who is compared, and no link between
members of a group is lost.

Null and empty texts have an empty set and no links; a text of one word is one shingle. Rows
with a null id have links too, but never name a component unless no other row does. Repeated
rows are equal sets. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import components, scan
from churnlake.session import checkpoint, shuffle_width, stored

SHINGLE = 2
PERCENT = 80            # links have 100 * intersection >= PERCENT * union
COORDINATES = 64        # minwise values of one byte each
SKETCH = 24             # of these, compared in nodes
LEAST_EQUAL = 13        # equal values of a sketch that make a candidate: 0.9995 of links at the limit pass
TREES = 3
DEPTH = 4               # each level takes two coordinates: a link at the limit survives a tree with 0.94
EXTRA_DEPTH = 3         # further levels, of one coordinate each, for nodes that are still large
NODE_BLOCK = 512        # rows of a node compared at once
SAMPLE = 16             # node sizes are estimated on every 16th vertex; this only decides on branching
BLOCK = 1024            # members of a candidate group compared at once on their full sets,
BLOCK_SHINGLES = 2_000_000  # and their shingles

BROADCAST_ROWS = 100_000    # of two or three numbers each: a few MB

_MIN = scan.keys(COORDINATES, 31)
_TREE = scan.keys(TREES, 32)

ROW = "struct<sid:bigint,n:bigint,sig:binary,s0:bigint,s1:bigint,s2:bigint>"
PARTS = ("s0", "s1", "s2")


def shingle_sets(part: scan.Part, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of the distinct shingles of each text, sorted."""
    starts, ends, owner = scan.words(part)
    word = scan.hashes(part.data, starts, ends, scan.LOWER)
    at, hashed = scan.windows(word, owner, size)
    counts = np.bincount(owner, minlength=len(part)) if len(owner) else np.zeros(len(part), np.int64)
    short = (counts > 0) & (counts < size)
    firsts = np.searchsorted(owner, np.flatnonzero(short))
    lone = scan.sequence_hashes(word, firsts, counts[short])
    return scan.distinct(np.concatenate([owner[at], np.flatnonzero(short)]), np.concatenate([hashed, lone]))


def _signatures(text: pa.Array, shingle: int = SHINGLE) -> pa.Array:
    ids, sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, COORDINATES), np.uint8)]
    for part in scan.parts(text):
        owner, item = shingle_sets(part, shingle)
        n = len(part)
        count = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
        full = np.flatnonzero(count)
        first = np.searchsorted(owner, full)
        sid, sig = np.zeros(n, np.uint64), np.zeros((n, COORDINATES), np.uint8)
        if len(full):
            # Equal sets have equal sums of mixed shingles.
            sid[full] = np.add.reduceat(scan.mix(item ^ np.uint64(0x5851F42D4C957F2D)), first)
            for k in range(COORDINATES):
                least = np.minimum.reduceat(scan_spread(item, _MIN[k]), first)
                sig[full, k] = (scan.mix(least) >> np.uint64(56)).astype(np.uint8)
        ids.append(sid.view(np.int64))
        sizes.append(count.astype(np.int64))
        values.append(sig)
    sig = np.concatenate(values)
    short = np.ascontiguousarray(sig[:, :SKETCH]).view(np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array([r.tobytes() for r in sig], pa.binary()),
         *(pa.array(np.ascontiguousarray(short[:, k])) for k in range(len(PARTS)))],
        names=["sid", "n", "sig", *PARTS])


def scan_spread(item: np.ndarray, key: np.uint64) -> np.ndarray:
    """Another order of the same hashes."""
    return (item ^ (item >> np.uint64(32))) * key


def _paths(sid: pa.Array, sig: pa.Array) -> pa.Array:
    """The nodes that each vertex reaches at ``DEPTH`` in all trees."""
    n = len(sig)
    values = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(n, COORDINATES).astype(np.uint64)
    rows = np.arange(n)[:, None]
    nodes = np.repeat(_TREE[None, :], n, axis=0)
    for _ in range(DEPTH):
        chosen = scan.mix(nodes)
        children = []
        for half in (0, 1):  # one coordinate of each half, so the two differ
            place = ((chosen >> np.uint64(8 * half)) % np.uint64(COORDINATES // 2)).astype(np.int64) + half * (COORDINATES // 2)
            children.append(scan.mix(nodes ^ (place.astype(np.uint64) << np.uint64(8)) ^ (values[rows, place] * np.uint64(0x9E3779B97F4A7C15))))
        nodes = np.concatenate(children, axis=1)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * nodes.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(nodes.ravel().view(np.int64)))


def _child(node: Column) -> Column:
    """The node below along one coordinate of the sketch."""
    place = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(SKETCH)).cast("int")
    held = F.element_at(F.array(*PARTS), (place / 8).cast("int") + 1)
    return F.xxhash64(node, place, F.call_function("shiftright", held, (place % 8) * 8).bitwiseAND(255))


def _small(some: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if a count shows that it is small; a larger one is joined by shuffles."""
    return F.broadcast(some) if some.count() <= BROADCAST_ROWS else some


def node_rows(vertices: DataFrame) -> DataFrame:
    """``(node, sid, sketch, whole, blocks, block)``: each vertex in all its nodes; large nodes are branched on, at last cut into blocks.

    Below a large node one coordinate after another names a child, the same for all its members,
    so the sizes at all further levels are counted at once. Blocks of a node have its name in ``whole``;
    elsewhere that is null.
    """
    def reached(some: DataFrame) -> DataFrame:
        out = some.select("sid", *PARTS, F.explode(arrow_udf(_paths, "array<bigint>")("sid", "sig")).alias("n0"))
        for k in range(EXTRA_DEPTH):
            out = out.withColumn(f"n{k + 1}", _child(F.col(f"n{k}")))
        return out

    levels = [f"n{k}" for k in range(EXTRA_DEPTH + 1)]
    sample = reached(vertices.filter(F.pmod("sid", F.lit(SAMPLE)) == 0))
    large = checkpoint(sample.select(F.explode(F.array(*levels)).alias("big")).groupBy("big").agg(
        (F.count(F.lit(1)) * SAMPLE).alias("size")).filter(F.col("size") > NODE_BLOCK))
    every = reached(vertices)
    n = large.count()
    if not n:
        none = [F.lit(None).cast("bigint").alias(c) for c in ("whole", "blocks", "block")]
        return every.select("sid", *PARTS, F.col("n0").alias("node"), *none)
    for c in levels:
        mine = large.select(F.col("big").alias(f"big_{c}"), F.col("size").alias(f"size_{c}"))
        every = every.join(F.broadcast(mine) if n <= BROADCAST_ROWS else mine, F.col(c) == F.col(f"big_{c}"), "left")
    last = levels[-1]
    small = F.coalesce(*[F.when(F.col(f"big_{c}").isNull(), F.col(c)) for c in levels])
    cut = every.withColumns({"small": small, "blocks": F.when(small.isNull(), F.ceil(F.col(f"size_{last}") / F.lit(NODE_BLOCK)))})
    cut = cut.withColumns({"whole": F.when(F.col("small").isNull(), F.col(last)), "block": F.pmod(F.xxhash64("sid", last), "blocks")})
    return cut.select("sid", *PARTS, F.coalesce("small", F.xxhash64("whole", "block")).alias("node"), "whole", "blocks", "block")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive equal keys, of about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for k in keys:
            column = table[k].to_numpy()
            last &= column == column[-1]
        if last.all():
            continue
        cut = int(np.flatnonzero(~last)[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Number of the group of each row."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _roots(group: np.ndarray, sketch: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """The least row that each row reaches along rows of its group whose sketches agree enough, one of which asks.

    Rows are compared at one distance after another, and only if they aren't joined yet, so no
    list of pairs is held.
    """
    root = np.arange(len(group))
    left = root
    d = 1
    while len(left):
        left = left[left + d < len(group)]
        left = left[group[left] == group[left + d]]
        i = left[(root[left] != root[left + d]) & (asking[left] | asking[left + d])]
        near = (sketch[i] == sketch[i + d]).sum(axis=1) >= LEAST_EQUAL
        root = components.joined(root, i[near], i[near] + d)
        d += 1
    return root


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that agree with others of their node, each with one of them: enough to connect all that agree."""
    for table in _groups(batches, ["node"], 1 << 15):
        group = _numbers(table, ["node"])
        sketch = np.stack([table[c].to_numpy() for c in PARTS], axis=1).view(np.uint8)
        root = _roots(group, sketch, table["asking"].to_numpy(zero_copy_only=False))
        at = np.flatnonzero(root != np.arange(len(root)))
        # What several nodes of this task connect is handed on as one link for each vertex.
        sid = table["sid"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in components.star_of(sid[at], sid[root[at]])], names=["a", "b"])


def _similar(count: np.ndarray, owner: np.ndarray, item: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """The least text that each text reaches along links; a link has an asking text at one end at least.

    ``owner, item`` are the shingles of the texts and ``count`` their numbers. The texts that share
    shingles with one are counted from an inverted list; a text all of whose possible partners are
    in its class already is passed over.
    """
    n = len(count)
    label = np.arange(n)
    order = np.argsort(item, kind="stable")
    posted = owner[order]
    _, code, df = np.unique(item, return_inverse=True, return_counts=True)
    offset = np.concatenate([[0], np.cumsum(df)])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    asked = np.zeros(n, bool)
    for i in np.flatnonzero(asking & (count > 0)):
        fit = (100 * np.minimum(count, count[i]) >= PERCENT * np.maximum(count, count[i])) & (label != label[i]) & ~asked
        asked[i] = True
        if not fit.any():
            continue
        codes = code[bounds[i]:bounds[i + 1]]
        sizes = df[codes]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes) + np.repeat(offset[codes], sizes)
        shared = np.bincount(posted[place], minlength=n)
        links = fit & (100 * shared >= PERCENT * (count + count[i] - shared))
        if links.any():
            classes = np.unique(np.append(label[links], label[i]))
            label[np.isin(label, classes)] = classes[0]
    return label


def _linked(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """``(a, b)``: each vertex and the least one that it reaches within its group, along confirmed links."""
    for table in _groups(batches, ["cand", "block"], 2 * BLOCK):
        group = _numbers(table, ["cand", "block"])
        sid, asking = table["sid"].to_numpy(), table["asking"].to_numpy(zero_copy_only=False)
        owners, items = [], []
        for part in scan.parts(table["text"]):
            owner, item = shingle_sets(part, shingle)
            owners.append(owner + part.first)
            items.append(item)
        owner, item = np.concatenate(owners), np.concatenate(items)
        bounds = np.searchsorted(group, np.arange(group[-1] + 2))
        cuts = np.searchsorted(owner, bounds)
        count = np.bincount(owner, minlength=len(group))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in range(len(bounds) - 1):
            lo, hi = bounds[g], bounds[g + 1]
            label = _similar(count[lo:hi], owner[cuts[g]:cuts[g + 1]] - lo, item[cuts[g]:cuts[g + 1]], asking[lo:hi])
            at = np.flatnonzero(label != np.arange(hi - lo))
            a.append(sid[lo:hi][at])
            b.append(sid[lo:hi][label[at]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


PAIR = "a bigint, b bigint"


def _grouped(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Rows with equal keys in a row, in one task."""
    return rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def candidates(vertices: DataFrame) -> DataFrame:
    """``(node, cand)``: each vertex whose sketch agrees with another's in a node, and the least one that it reaches so."""
    def compared(rows: DataFrame) -> DataFrame:
        return checkpoint(_grouped(rows.select("node", "sid", *PARTS, "asking"), ["node"], _candidates, PAIR))

    every = node_rows(vertices)
    maybe = compared(every.withColumn("asking", F.lit(True)))
    cand = components.roots(maybe, "a", "b")
    cut = checkpoint(every.filter("whole is not null").select("sid", *PARTS, "whole", "blocks", "block"))
    if not cut.isEmpty():
        # What the blocks of a node left apart: all members outside its largest class ask every block.
        own = cut.join(cand, F.col("sid") == F.col("node"), "left").withColumn("class", F.coalesce("root", "sid"))
        sizes = own.groupBy(F.col("whole").alias("w"), "class").agg(F.count(F.lit(1)).alias("size"))
        most = sizes.groupBy("w").agg(F.max_by("class", F.struct("size", "class")).alias("main"), (F.sum("size") - F.max("size")).alias("rest"))
        ready = checkpoint(own.join(most.filter("rest > 0").withColumn("chunks", F.ceil(F.col("rest") / F.lit(NODE_BLOCK))), F.col("whole") == F.col("w")))
        if not ready.isEmpty():
            none = F.lit(0).cast("bigint")
            member = ready.select("sid", *PARTS, "whole", F.lit(False).alias("asking"), F.col("block").alias("p"), F.explode(F.sequence(none, F.col("chunks") - 1)).alias("q"))
            asker = ready.filter(F.col("class") != F.col("main")).select(
                "sid", *PARTS, "whole", F.lit(True).alias("asking"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("p"), F.pmod(F.xxhash64("sid", F.lit(5)), "chunks").alias("q"))
            # An asking member stands once in its own block, as one that asks.
            dealt = member.union(asker).groupBy("sid", *PARTS, "whole", "p", "q").agg(F.max("asking").alias("asking"))
            more = compared(dealt.withColumn("node", F.xxhash64("whole", "p", "q")))
            cand = components.roots(more.union(cand.select("node", "root")), "a", "b")
    return cand.select("node", F.col("root").alias("cand"))


def links(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(rows, labels)``: each row's vertex ``sid`` and set size ``n``, and ``(sid, root)`` of linked vertices.

    Rows are stored once with their signatures; only vertices of candidate groups have their texts
    moved for the comparison of full sets.
    """
    def signatures(text: pa.Array) -> pa.Array:
        return _signatures(text, shingle)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(batches, shingle)

    rows = checkpoint(docs.select(F.col(key), F.xxhash64("text").alias("tid"), arrow_udf(signatures, ROW)(
        F.coalesce("text", F.lit(""))).alias("s")).select(key, "tid", "s.*"))
    vertices = checkpoint(rows.filter("n > 0").groupBy("sid").agg(
        *(F.first(c).alias(c) for c in ("n", "sig", *PARTS)), F.min(F.struct(F.col(key), "tid")).alias("at")))
    cand = candidates(vertices)
    group = vertices.join(cand, F.col("sid") == F.col("node")).select("sid", "n", "at", "cand")
    blocks = group.groupBy(F.col("cand").alias("c")).agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    wanted = checkpoint(group.join(blocks, F.col("cand") == F.col("c")).select(
        "sid", "cand", "blocks", F.pmod(F.xxhash64("sid"), "blocks").alias("block"), F.col(f"at.{key}").alias("k"), F.col("at.tid").alias("t")))
    texts = stored(docs.select(F.col(key), "text").join(
        _small(wanted), (F.xxhash64("text") == F.col("t")) & F.col(key).eqNullSafe(F.col("k"))).select(
        "sid", "cand", "blocks", "block", "text").dropDuplicates(["sid"]), "near-copies")

    def compared(some: DataFrame) -> DataFrame:
        return checkpoint(_grouped(some.select("cand", "block", "sid", "asking", "text"), ["cand", "block"], linked, PAIR))

    # In one block all members are compared, so each leads to the least of its class.
    found = compared(texts.withColumn("asking", F.lit(True)))
    large = texts.filter("blocks > 1")
    if large.isEmpty():
        return rows, found.select(F.col("a").alias("sid"), F.col("b").alias("root"))

    def relabeled(own: DataFrame, step: DataFrame) -> DataFrame:
        """Members with the class that a step leads their class to."""
        to = step.select(F.col("a").alias("from"), F.col("b").alias("to"))
        return checkpoint(own.join(to, F.col("class") == F.col("from"), "left").withColumn("class", F.coalesce("to", "class")).drop("from", "to"))

    def unsettled(own: DataFrame) -> DataFrame:
        split = own.groupBy(F.col("cand").alias("c")).agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi")
        return own.join(split, F.col("cand") == F.col("c"), "left_semi")

    own = relabeled(large.select("sid", "cand", "blocks", "block", F.col("sid").alias("class")), found)
    # One member of each class, so that classes of several blocks meet.
    heads = unsettled(own).filter("sid = class").select(F.col("sid").alias("h"), F.col("cand").alias("hc"))
    width = heads.groupBy(F.col("hc").alias("c")).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("wide"))
    heads = heads.join(width, F.col("hc") == F.col("c")).select("h", F.pmod(F.xxhash64("h", F.lit(2)), "wide").alias("hb"))
    met = large.join(heads, F.col("sid") == F.col("h")).select("cand", F.col("hb").alias("block"), "sid", "text", F.lit(True).alias("asking"))
    own = relabeled(own, compared(met))

    # All members outside the largest class of a group ask every block of it.
    rest = checkpoint(unsettled(own))
    if not rest.isEmpty():
        sizes = rest.groupBy(F.col("cand").alias("c"), "class").agg(F.count(F.lit(1)).alias("size"))
        most = sizes.groupBy("c").agg(F.max_by("class", F.struct("size", "class")).alias("main"), (F.sum("size") - F.max("size")).alias("rest"))
        most = most.withColumn("chunks", F.ceil(F.col("rest") / F.lit(BLOCK)))
        ready = rest.join(most, F.col("cand") == F.col("c"))
        none = F.lit(0).cast("bigint")
        member = ready.select("sid", F.lit(False).alias("asking"), F.col("block").alias("p"), F.explode(F.sequence(none, F.col("chunks") - 1)).alias("q"))
        asker = ready.filter(F.col("class") != F.col("main")).select(
            "sid", F.lit(True).alias("asking"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("p"), F.pmod(F.xxhash64("sid", F.lit(3)), "chunks").alias("q"))
        # An asking member stands once in its own block, as one that asks.
        dealt = member.union(asker).groupBy("sid", "p", "q").agg(F.max("asking").alias("asking"))
        last = compared(large.select("sid", "cand", "text").join(dealt, "sid").select(
            "cand", F.xxhash64("p", "q").alias("block"), "sid", "text", "asking"))
        named = own.select(F.col("sid").alias("x"), F.col("class").alias("xc"))
        both = last.join(named, F.col("a") == F.col("x")).select("b", F.col("xc").alias("ca")).join(
            named, F.col("b") == F.col("x")).select("ca", F.col("xc").alias("cb")).filter("ca <> cb")
        own = relabeled(own, components.roots(both, "ca", "cb").select(F.col("node").alias("a"), F.col("root").alias("b")))
    settled = found.join(large.select(F.col("sid").alias("x")), F.col("a") == F.col("x"), "left_anti")
    return rows, settled.select(F.col("a").alias("sid"), F.col("b").alias("root")).union(own.select("sid", "class"))


def classes(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(key, tid, n_shingles, component_id)`` per row; the component is named by its smallest key."""
    rows, labels = links(docs, key, shingle)
    root = labels.select(F.col("sid").alias("node"), "root")
    per_set = rows.filter("n > 0").groupBy("sid").agg(F.min(key).alias("least"))
    named = per_set.join(root, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    final = named.join(least, F.col("root") == F.col("r")).select(F.col("sid").alias("s"), "component")
    return rows.join(final, (F.col("sid") == F.col("s")) & (F.col("n") > 0), "left").select(
        key, "tid", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col(key)).alias("component_id"))


def near_copies(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` per row."""
    out = classes(docs, key, shingle).drop("tid")
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, and of repeated rows; documents without words stay."""
    def name(tid: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), tid)

    kept = classes(docs, key, shingle).filter(F.col(key).eqNullSafe(F.col("component_id"))).select(name(F.col("tid")).alias("_name"))
    single = docs.withColumn("_name", name(F.xxhash64("text"))).dropDuplicates(["_name"])
    return single.join(kept, "_name", "left_semi").drop("_name")
