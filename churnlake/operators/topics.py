"""Topics of a collection of texts from its long ``(doc, term, weight)`` table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators.ranking import first_per_group
from churnlake.operators.sums import array_sum
from churnlake.operators.texts import dense_index
from churnlake.session import checkpoint, stored

# Most bytes of the term factor that tasks get whole; beyond it, factors stay distributed.
FACTOR_BYTES = 16 << 20
# Entries of a block of documents, where factors stay distributed.
BLOCK_ENTRIES = 4 << 20
# Entries times topics of a block of documents in the rounds of LDA.
LDA_CELLS = 8 << 20


@dataclass
class Lsa:
    singular_values: list[float]
    terms: DataFrame       # term, t0, t1, ...
    projection: DataFrame  # doc, t0, t1, ...
    measure: Callable[[], list[float]]

    @property
    def residuals(self) -> list[float]:
        """``|A'A v - s^2 v| / s^2`` of each component; distributed factors are multiplied once more for it."""
        return self.measure()

    @property
    def names(self) -> list[str]:
        return [f"t{i}" for i in range(len(self.singular_values))]


def _gram(df: DataFrame, names: list[str]) -> np.ndarray:
    """The small matrix of inner products of the columns, summed per task in numpy."""
    k = len(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(k * k), "value": total.ravel()})

    sums = df.select(*names).mapInPandas(partial, "cell int, value double").groupBy("cell").agg(
        F.sum("value").alias("value"))
    flat = np.zeros(k * k)
    for cell, value in sums.collect():  # k x k numbers
        flat[cell] = value
    return flat.reshape(k, k)


def _rotate(df: DataFrame, key: str, names: list[str], matrix: np.ndarray, new: list[str]) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turned = pd.DataFrame(batch[names].to_numpy(dtype=float) @ matrix, columns=new)
            turned.insert(0, key, batch[key].to_numpy())
            yield turned

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *names).mapInPandas(apply, f"{key} {kind}, " + ", ".join(f"{c} double" for c in new))


def _whitener(gram: np.ndarray) -> np.ndarray:
    """Matrix that makes columns with these inner products orthonormal, null directions left out."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values[-1], 0.0) * 1e-12
    return (vectors[:, keep] / np.sqrt(values[keep]))[:, ::-1]


def _signs(terms: DataFrame, names: list[str]) -> np.ndarray:
    """A component's sign is free: its largest entry is made positive."""
    peak = terms.agg(*[F.max(F.struct(F.abs(c).alias("a"), F.col("term").alias("t"), F.signum(c).alias("s"))).alias(c)
                       for c in names]).first()  # one row of signs
    return np.array([-1.0 if peak[c] and peak[c]["s"] < 0 else 1.0 for c in names])


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each entry of a block of documents."""
    cells = batch.column(batch.schema.get_field_index("cells"))
    row = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    return row, flat.field("id").to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)


def _times(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, q: np.ndarray) -> np.ndarray:
    """A block of documents times a term factor, column by column, so that memory follows the entries."""
    row, term, weight = entries
    return np.stack([np.bincount(row, weight * q[term, c], n) for c in range(q.shape[1])], axis=1)


def _with_columns(df: DataFrame, key: str, names: list[str], of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The key of ``df`` with the columns of a small matrix for each batch."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *[
                pa.array(np.ascontiguousarray(x[:, c])) for c in range(len(names))]], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(apply, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names))


def _lsa_by_blocks(long: DataFrame, doc: str, index: DataFrame, size: int, k: int, width: int,
                   n_iter: int, seed: int, tolerance: float) -> Lsa:
    """Documents lie in blocks with all their terms, so that both products of a round are one pass.

    A task sends the sum of its blocks once; nothing else is shuffled in a round. The factors of all
    rounds and their images span the space that is searched: the driver holds ``2 * n_iter`` factors at most.
    """
    blocks = stored(long.join(index, "term").groupBy(doc).agg(
        F.collect_list(F.struct(F.col("id").cast("int").alias("id"), F.col("weight").cast("double").alias("weight"))).alias("cells")), "topics")
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(n_iter):
        def both(batch: pa.RecordBatch, q=q) -> np.ndarray:
            row, term, weight = entries = _entries(batch)
            y = _times(entries, batch.num_rows, q)
            return np.stack([np.bincount(term, weight * y[row, c], size) for c in range(q.shape[1])], axis=1)

        z = array_sum(blocks, both, q.size).reshape(q.shape)
        basis, images = np.hstack([basis, q]), np.hstack([images, z])
        inner = basis.T @ images
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
        values[values <= values[0] * 1e-12] = 0.0  # directions that the matrix has not
        found = basis @ vectors
        off = np.linalg.norm(images @ vectors - found * values, axis=0)
        if (off <= tolerance * np.maximum(values, values[0] * 1e-9)).all():
            break
        for _ in range(2):  # once more for what rounding leaves
            z = z - basis @ (basis.T @ z)
        fresh, length, _ = np.linalg.svd(z, full_matrices=False)
        q = fresh[:, (length > 1e-10 * values[0])][:, :size - basis.shape[1]]
        if not q.shape[1]:
            break
    names = [f"t{i}" for i in range(found.shape[1])]
    of_terms = lambda batch, v: v[batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)]
    found = found * _signs(_with_columns(index, "term", names, lambda batch: of_terms(batch, found)), names)
    return Lsa([float(v) for v in np.sqrt(values)], _with_columns(index, "term", names, lambda batch: of_terms(batch, found)),
               _with_columns(blocks, doc, names, lambda batch: _times(_entries(batch), batch.num_rows, found)),
               lambda: [float(o / v) if v > 0 else 0.0 for o, v in zip(off, values)])


def _lsa_by_exchange(long: DataFrame, doc: str, index: DataFrame, size: int, k: int, width: int, n_iter: int, seed: int,
                     max_broadcast: int, entries: int) -> Lsa:
    """Term and document factors stay distributed; only inner products of the columns come to the driver.

    Documents lie in blocks of about ``entries`` entries. A round brings each block the rows of the term factor that it
    needs, and takes back one row for each of its terms, so a term moves once for a block and not once for an entry.
    """
    names = [f"t{i}" for i in range(width)]
    n_blocks = max(long.sparkSession.sparkContext.defaultParallelism, -(-long.count() // entries))
    kind = long.schema[doc].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2)
            ends = np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))
            flat = cells.flatten()
            ids, weights = (np.split(flat.field(c).to_numpy(zero_copy_only=False), ends)[:-1] for c in ("id", "weight"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(
                pa.array([x.tobytes() for x in some], pa.binary()) for some in (ids, weights))], names=[doc, "block", "ids", "weights"])

    blocks = stored(long.join(index, "term").groupBy(doc).agg(F.collect_list(F.struct(
        F.col("id").cast("int").alias("id"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))).alias("cells")).select(
        doc, F.pmod(F.xxhash64(doc, F.lit(n_blocks)), F.lit(n_blocks)).cast("int").alias("block"), "cells").mapInArrow(
        packed, f"`{doc}` {kind}, block int, ids binary, weights binary"), "topics")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            ids = batch.column(1).to_pylist()
            for b in np.unique(block):
                own = np.unique(np.frombuffer(b"".join(ids[i] for i in np.flatnonzero(block == b)), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b, np.int32)), pa.array(own)], names=["block", "id"])

    needs = checkpoint(blocks.select("block", "ids").mapInArrow(held, "block int, id int").distinct())
    small = size <= max_broadcast

    def exchanged(q: DataFrame, columns: list[str], key: str, back: bool) -> DataFrame:
        """The documents' rows times the factor ``q``; with ``back`` their sums over the terms of each block."""
        def of(factor: pa.Table, rows: pa.Table) -> pa.Table:
            ids = factor["id"].to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            sizes = np.array([len(x) // 4 for x in rows["ids"].to_pylist()], np.int64)
            place = np.searchsorted(ids, np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int32))
            weight = np.frombuffer(b"".join(rows["weights"].to_pylist()))
            row = np.repeat(np.arange(len(sizes)), sizes)
            out = {}
            for c in columns:
                y = np.bincount(row, weight * factor[c].to_numpy()[order][place], len(sizes))
                out[c] = np.bincount(place, weight * y[row], len(ids)) if back else y
            return pa.table({key: pa.array(ids) if back else rows[doc], **out})

        sent = needs.join(F.broadcast(q) if small else q, "id").groupBy("block")
        form = f"{key} int, " if back else f"`{key}` {kind}, "
        return sent.cogroup(blocks.groupBy("block")).applyInArrow(of, form + ", ".join(f"{c} double" for c in columns))

    def image(q: DataFrame, columns: list[str]) -> DataFrame:
        return exchanged(q, columns, "id", True).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])

    q = index.select(F.col("id").cast("int").alias("id"), *[
        (F.pmod(F.xxhash64("term", F.lit(seed), F.lit(i)), F.lit(20001)) / 10000.0 - 1).alias(c) for i, c in enumerate(names)])
    for _ in range(n_iter):
        z = checkpoint(image(q, names))
        whiten = _whitener(_gram(z, names))
        fresh = names[:whiten.shape[1]]
        q = _rotate(z, "id", names, whiten, fresh)
        names = fresh
    y = checkpoint(exchanged(q, names, doc, False))
    values, vectors = np.linalg.eigh(_gram(y, names))
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    out = [f"t{i}" for i in range(vectors.shape[1])]
    named = checkpoint(_rotate(q, "id", names, vectors, out).join(index, "id").select("term", "id", *out))
    signs = _signs(named, out)
    terms = named.select("term", *[(F.col(c) * float(s)).alias(c) for c, s in zip(out, signs)])
    projection = _rotate(y, doc, names, vectors @ np.diag(signs), out)

    def residuals() -> list[float]:
        v = named.select("id", *out)
        both = image(v, out).join(v.select("id", *[F.col(c).alias(f"v_{c}") for c in out]), "id")
        square = both.agg(*[F.sum((F.col(c) - float(x) * F.col(f"v_{c}")) ** 2).alias(c) for c, x in zip(out, values)]).first()
        return [float(np.sqrt(square[c]) / x) if x > 0 else 0.0 for c, x in zip(out, values)]

    return Lsa([float(v) for v in np.sqrt(values)], terms, projection, residuals)


def lsa(tfidf: DataFrame, doc: str, k: int = 30, oversample: int = 8, n_iter: int = 12, seed: int = 1,
        max_broadcast: int = 20_000, factor_bytes: int = FACTOR_BYTES, tolerance: float = 1e-3, entries: int = BLOCK_ENTRIES) -> Lsa:
    """Truncated SVD, until the residuals of all components are small or rounds are used up.

    A term factor of at most ``factor_bytes`` goes to tasks whole, and a round is one pass over blocks of
    documents. Of a larger one, each block of documents gets the rows of its terms (subspace iteration, four rounds at most);
    that of ``max_broadcast`` terms at most is broadcast for it. A document's terms are one row, bounded by its text. An empty table
    has no components.
    """
    long = checkpoint(tfidf.select(doc, "term", "weight"))
    index = checkpoint(dense_index(long, "term", "id"))
    size = index.count()
    width = k + oversample
    if not size:
        return Lsa([], index.select("term"), long.select(doc).limit(0), list)
    if size * width * 8 <= factor_bytes:
        return _lsa_by_blocks(long, doc, index, size, min(k, size), min(width, size), n_iter, seed, tolerance)
    return _lsa_by_exchange(long, doc, index, size, k, width, min(n_iter, 4), seed, max_broadcast, entries)


def topic_terms(model: Lsa, n: int = 7) -> DataFrame:
    """``(topic, position, term, weight)``: the strongest terms of each component."""
    long = model.terms.unpivot(["term"], model.names, "topic", "weight")
    return first_per_group(long, ["topic"], [F.desc("weight"), F.asc("term")], n, "position")


def flags(model: Lsa, doc: str, cut: float = 0.1, n: int = 10) -> DataFrame:
    """``doc, topic_0 ..``: 1 where the document's projection reaches the cut."""
    return model.projection.select(doc, *[
        (F.col(c) >= cut).cast("int").alias(f"topic_{i}") for i, c in enumerate(model.names[:n])])


# The generator of ``java.util.Random``: multiplier, addend and the bits of a state.
JAVA_MUL, JAVA_ADD, JAVA_MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


def _ahead(state: np.ndarray, n: np.ndarray, draws: int) -> np.ndarray:
    """States of the generator ``n`` times ``draws`` doubles later."""
    mul, add = 1, 0
    for _ in range(2 * draws):  # a double takes two steps
        mul, add = mul * JAVA_MUL & JAVA_MASK, (add * JAVA_MUL + JAVA_ADD) & JAVA_MASK
    state, n = np.broadcast_to(state, n.shape).astype(np.uint64), n.copy()
    while n.any():
        odd = n % 2 == 1
        state[odd] = (state[odd] * np.uint64(mul) + np.uint64(add)) & np.uint64(JAVA_MASK)
        mul, add, n = mul * mul & JAVA_MASK, (mul * add + add) & JAVA_MASK, n // 2
    return state


def _doubles(state: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The next ``n`` doubles after each state, one array after the other."""
    for _ in range(n):
        high, low = (state := (state * np.uint64(JAVA_MUL) + np.uint64(JAVA_ADD)) & np.uint64(JAVA_MASK) for _ in range(2))
        yield ((high >> np.uint64(22) << np.uint64(27)) + (low >> np.uint64(21))) * 2.0 ** -53


def lda(counts: DataFrame, doc: str, k: int = 10, max_iter: int = 10, seed: int = 1, n_terms: int = 7,
        doc_concentration: float = 1.1, topic_concentration: float = 1.1, cells: int = LDA_CELLS) -> DataFrame:
    """``(topic, term, weight)``: strongest terms of each topic.

    The expectation-maximisation form of Spark ML with its start: the draws of a partition of documents follow one another.
    Documents lie in blocks of about ``cells / k`` entries. A round brings each block the counts of its terms and documents
    by topic, and takes back their new counts in parts by the key, so a term moves once for a block and not once for an entry.
    """
    words = checkpoint(counts.select(doc, "term", "tf"))
    index = checkpoint(dense_index(words, "term", "id"))
    size = index.count()
    n_blocks = max(4 * words.sparkSession.sparkContext.defaultParallelism, -(-words.count() * k // cells))
    alpha, eta = doc_concentration - 1, topic_concentration - 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, state = part << 33, (part + seed ^ JAVA_MUL) & JAVA_MASK
        for batch in batches:
            row, term, weight = _entries(batch)
            if not np.isfinite(weight).all():
                raise ValueError("a count is not a number")
            order = np.lexsort((term, row))
            order = order[weight[order] != 0]
            row, term, weight = row[order], term[order].astype(np.int32), weight[order]
            if ((np.diff(row) == 0) & (np.diff(term) == 0)).any():
                raise ValueError("a document has a term twice")
            ends = np.searchsorted(row, np.arange(batch.num_rows), "right")
            states = _ahead(np.uint64(state), np.concatenate([[0], ends]), k)
            numbers = np.arange(number, number + batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                pa.array((numbers % n_blocks).astype(np.int32)), pa.array(numbers), pa.array(states[:-1].astype(np.int64)), *(
                    pa.array([x.tobytes() for x in np.split(some, ends[:-1])], pa.binary()) for some in (term, weight))],
                names=["block", "number", "state", "ids", "weights"])
            number, state = number + batch.num_rows, int(states[-1])

    texts = words.join(index, "term").groupBy(doc).agg(F.collect_list(F.struct(
        F.col("id"), F.col("tf").cast("double").alias("weight"))).alias("cells"))
    # The draws follow the partitions and the order that this join gives.
    blocks = stored(texts.join(dense_index(words, doc, "number"), doc).select("cells").mapInArrow(
        packed, "block int, number long, state long, ids binary, weights binary"), "topics")

    def flat(rows: pa.Table) -> tuple[np.ndarray, ...]:
        """Row, key of the document, key of the term and weight of each entry; documents have negative keys."""
        ids, weights = rows["ids"].to_pylist(), rows["weights"].to_pylist()
        row = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
        return row, (-1 - rows["number"].to_numpy())[row], np.frombuffer(b"".join(ids), np.int32), np.frombuffer(b"".join(weights))

    def counted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Keys and their counts by topic, a row for each."""
        return np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int64), np.frombuffer(b"".join(rows["counts"].to_pylist())).reshape(-1, k)

    def dealt(rows: pa.Table, keys: np.ndarray, places: tuple, weight: np.ndarray, shares: Iterator[np.ndarray]) -> pa.Table:
        """Entries dealt to topics by their shares, summed by document and by term, in parts by the key."""
        whole = sum(shares := list(shares))
        sums = np.empty((len(keys), k))
        for c, share in enumerate(shares):
            own = share / whole * weight
            sums[:, c] = sum(np.bincount(p, own, len(keys)) for p in places)
        parts = [np.flatnonzero(keys % n_blocks == part) for part in range(n_blocks)]
        return pa.table({
            "block": pa.array([rows["block"][0].as_py()] * n_blocks, pa.int32()), "part": pa.array(range(n_blocks), pa.int32()),
            "keys": pa.array([keys[p].tobytes() for p in parts], pa.binary()),
            "counts": pa.array([sums[p].tobytes() for p in parts], pa.binary()),
            "of_terms": pa.array([sums[p[keys[p] >= 0]].sum(0).tolist() for p in parts], pa.list_(pa.float64()))})

    def start(rows: pa.Table) -> pa.Table:
        row, document, term, weight = flat(rows)
        keys, place = np.unique(np.concatenate([document, term]), return_inverse=True)
        position = np.arange(len(row)) - np.searchsorted(row, row)
        state = _ahead(rows["state"].to_numpy().astype(np.uint64)[row], position, k)
        return dealt(rows, keys, (place[:len(row)], place[len(row):]), weight, _doubles(state, k))

    def summed(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of a part in the order of blocks, its keys, their counts over all blocks, and the key's place of each entry."""
        rows = rows.sort_by("block")
        keys, counts = counted(rows)
        keys, place = np.unique(keys, return_inverse=True)
        return rows, keys, np.stack([np.bincount(place, counts[:, c], len(keys)) for c in range(k)], axis=1), place

    def sent(rows: pa.Table) -> pa.Table:
        rows, _, counts, place = summed(rows)
        ends = np.cumsum([len(x) // 8 for x in rows["keys"].to_pylist()])
        return pa.table({"block": rows["block"], "keys": rows["keys"], "counts": pa.array(
            [counts[p].tobytes() for p in np.split(place, ends[:-1])], pa.binary())})

    form = "block int, part int, keys binary, counts binary, of_terms array<double>"
    sums = checkpoint(blocks.groupBy("block").applyInArrow(start, form))
    totals = lambda: np.array([x or 0.0 for x in sums.agg(*[F.sum(F.col("of_terms")[c]) for c in range(k)]).first()])
    for _ in range(max_iter):
        total = totals()

        def step(factor: pa.Table, rows: pa.Table) -> pa.Table:
            _, document, term, weight = flat(rows)
            keys, counts = counted(factor)
            order = np.argsort(keys)
            keys, counts = keys[order], np.ascontiguousarray(counts[order].T)
            places = np.searchsorted(keys, document), np.searchsorted(keys, term)
            return dealt(rows, keys, places, weight, (
                (own[places[1]] + eta) * (own[places[0]] + alpha) / (n + size * eta) for n, own in zip(total, counts)))

        factor = sums.select("block", "part", "keys", "counts").groupBy("part").applyInArrow(sent, "block int, keys binary, counts binary")
        sums = checkpoint(factor.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(step, form))
    total = totals()

    def described(rows: pa.Table) -> pa.Table:
        """The strongest terms of a part in each topic, of equal ones the last."""
        _, keys, counts, _ = summed(rows)
        keys, weights = keys[keys >= 0], counts[keys >= 0] / total
        best = [np.lexsort((keys, weights[:, c]))[::-1][:n_terms] for c in range(k)]
        return pa.table({"topic": pa.array(np.repeat(np.arange(k, dtype=np.int32), [len(b) for b in best])),
                         "id": pa.array(np.concatenate([keys[b] for b in best])), "weight": pa.array(np.concatenate([weights[b, c] for c, b in enumerate(best)]))})

    strongest = sums.select("block", "part", "keys", "counts").groupBy("part").applyInArrow(described, "topic int, id long, weight double")
    return first_per_group(strongest, ["topic"], [F.desc("weight"), F.desc("id")], n_terms).join(index, "id").select("topic", "term", "weight")
