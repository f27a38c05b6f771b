"""Lexical retrieval packing: windows filled with the nearest documents by BM25.

Documents are dealt to shards of bounded size, in documents and in ids, by lexical closeness: a tree of
planes, grown on at most ``SAMPLE`` of the hashed BM25 vectors, brings documents of like words to one leaf, and
neighbouring leaves fill a shard; every document finds its leaf. A leaf that is larger than a shard is cut by a tree
grown on all of its own vectors. All weights, those of the vectors
and those that score documents against each other in a shard, come from the document counts of the words
and the mean length over all documents. The counts stand in two rows of ``BUCKETS`` counters, where a
word's count is the lesser of its two, at every size of the input. In a shard, whole windows of a long
document stand alone; its tail waits in a BM25 index of the shard's documents. Each unused tail in turn seeds a window, and the index returns its nearest
unused neighbours by all words of the seed: those that fit are taken in order of score, and the best
that doesn't fit is cut to fill the rest. What is left of a cut tail stays in the index. So only the
last window of a shard is padded.

A null text is an empty one: its only id is the end id. Repeated rows are documents of their own.
Rows with a null id are dealt by their text. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan
from churnlake.session import stored

WINDOW = 2048
END = 1
SHARD = 1024            # documents of a shard
SHARD_IDS = 1 << 21     # and their ids
CHUNK_IDS = 1 << 17     # ids whose words are counted at a time
PART_BYTES = 2 << 20    # of text that is cut into pieces at a time
NEIGHBOURS = 32         # returned for a seed at a time
BUCKETS = 1 << 20       # counters of a row, by hash of the word; a power of two, of at most 22 bits
COUNTER_PARTS = 64      # parts in which counters are sent
CHUNK_WORDS = 1 << 16   # words that are hashed at a time
ROWS = 256              # documents whose ids a task takes from a batch at a time
DIMENSIONS = 256        # of the hashed vectors that deal documents to shards
LEAF = 512              # documents of a leaf aimed at
LEAF_SAMPLE = 8         # of these, at least so many in the sample that grows the tree
SAMPLE = 1 << 15        # documents at most that grow the tree
GROUP = 4               # shards, about, whose documents are read in a row
SIZES = 1 << 14         # rows, about, that tell how leaves are dealt to groups
DOCUMENT_BITS = 20      # of a number that holds a word and its document
COMMON = 16             # words in one of so many documents of a shard are scored by one matrix product
K1, B = 1.2, 0.75
_ID_HASHES = scan.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Within these characters both libraries split alike, and one of them is five times as fast.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*")
# Without an apostrophe, and so without its endings, pieces follow from the kinds of neighbouring characters.
_BY_KIND = re.compile(r"[\t\n\r -&(-~¡-ɏ]*")
_LETTER, _NUMBER, _WHITE, _OTHER = range(4)
_KIND = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(i))[0], _WHITE if chr(i).isspace() else _OTHER)
                  for i in range(0x250)], np.uint8)


@lru_cache(maxsize=8)
def _ranked(ranks: str, pattern: str):
    """An encoder of texts that the pattern cuts into pieces."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def _full(vocabulary: str):
    """The tokenizer file itself; most tasks never need it, so it takes no memory there."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=2)
def _vocabulary(vocabulary: str) -> tuple[np.ndarray, tuple[str, ...]]:
    """Whether an id begins a word, as its piece begins with white space; and the strings that are ids by themselves."""
    with open(vocabulary) as f:
        held = json.load(f)
    starts = np.zeros(1 << 16, bool)
    for piece, i in held["model"]["vocab"].items():
        starts[i] = piece[:1] in "ĠĊĉč"
    return starts, tuple(t["content"] for t in held.get("added_tokens", []))


def _word_starts(vocabulary: str) -> np.ndarray:
    return _vocabulary(vocabulary)[0]


def encode(text: str, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> np.ndarray:
    """Ids of the text as ``vocabulary`` gives them, and the end id; all are below 65,536."""
    if _PLAIN.fullmatch(text) and not any(s in text for s in _vocabulary(vocabulary)[1]):
        ids = _ranked(ranks, public_tokenizers.PATTERN).encode_ordinary(text)
    else:
        ids = _full(vocabulary).encode(text, add_special_tokens=False).ids
    ids.append(END)
    return np.array(ids, np.uint16)


def _pieces(part: scan.Part) -> np.ndarray:
    """Where the pieces of the tokenizers' pattern begin in texts that ``_BY_KIND`` matches: the bytes of all, in order.

    A piece is a run of one kind of characters, with one blank before it if there is one. Of a run of white
    space, the last character stands by itself or goes with what follows.
    """
    data = part.data
    kind = _KIND[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _KIND[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    edge = np.zeros(len(data) + 1, bool)
    edge[part.bounds[:-1]] = True
    edge = edge[:len(data)]
    begin = edge.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    ahead = (kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~edge[1:]
    begin[:-1] |= ahead
    begin[1:] &= ~(ahead & (data[:-1] == 32))
    return np.flatnonzero(begin)


def _part_ids(part: scan.Part, encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a part, end ids included, and the bounds of each; every distinct piece is encoded once."""
    starts = _pieces(part)
    if not len(starts):
        return np.full(len(part), END, np.uint16), np.arange(len(part) + 1)
    found = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(part.data))), pa.py_buffer(part.data)).dictionary_encode()
    # The pieces in one text: a zero ends each, which the encoder takes by itself and which is in none of them.
    _, bounds, data = found.dictionary.buffers()
    bounds = np.frombuffer(bounds, np.int64)[:len(found.dictionary) + 1]
    joined = np.insert(np.frombuffer(data, np.uint8)[:bounds[-1]], bounds[1:], np.uint8(0)).tobytes().decode()
    flat = np.array(encoder.encode_ordinary(joined), np.uint16)
    ends = np.flatnonzero(flat == encoder.encode_single_token("\0"))
    first = np.concatenate([[0], ends[:-1] + 1])
    at = found.indices.to_numpy(zero_copy_only=False)
    sizes = (ends - first)[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = flat[np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], sizes)]
    last = ends[np.searchsorted(starts, part.bounds[1:])]
    return np.insert(ids, last, np.uint16(END)), np.concatenate([[0], last + np.arange(1, len(part) + 1)])


def encode_all(texts: list[str], vocabulary: str = VOCABULARY, ranks: str = RANKS) -> list[bytes]:
    """``encode`` of each text, as bytes."""
    special = _vocabulary(vocabulary)[1]
    out = [b""] * len(texts)
    alike = []
    for i, t in enumerate(texts):
        if _BY_KIND.fullmatch(t) and not any(s in t for s in special):
            alike.append(i)
        else:
            out[i] = encode(t, vocabulary, ranks).tobytes()
    for part in scan.parts(pa.array([texts[i] for i in alike], pa.large_string()), PART_BYTES):
        ids, bounds = _part_ids(part, _ranked(ranks, r"[^\x00]+|\x00"))
        for k in range(len(part)):
            out[alike[part.first + k]] = ids[bounds[k]:bounds[k + 1]].tobytes()
    return out


def _terms(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, word, count)`` of distinct words, by word and document, and the number of words of each document.

    Word and document share one number, so that one sort groups them; the low bits of a word are 0.
    """
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    first = starts[ids]
    ends = np.cumsum(sizes)
    first[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(first)
    owner = np.searchsorted(ends, at, "right")
    bounds = np.append(at, len(ids))
    word = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), CHUNK_WORDS):
        b = min(a + CHUNK_WORDS, len(at))
        word[a:b] = scan.sequence_hashes(_ID_HASHES[ids[bounds[a]:bounds[b]]], at[a:b] - at[a], np.diff(bounds[a:b + 1]))
    low = np.uint64((1 << DOCUMENT_BITS) - 1)
    word &= ~low
    word |= owner.astype(np.uint64)
    word.sort()
    pair = word
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    tf = np.diff(np.append(begin, len(pair)))
    pair = pair[begin]
    return (pair & low).astype(np.int64), pair & ~low, tf, np.bincount(owner, minlength=len(sizes))


def _buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each word in both rows, from different bits; the low ``DOCUMENT_BITS`` of a word are 0."""
    last = np.uint64(BUCKETS - 1)
    return ((words >> np.uint64(42)) & last).astype(np.int64), ((words >> np.uint64(DOCUMENT_BITS)) & last).astype(np.int64)


@dataclass
class Counts:
    """Documents, mean words, and the document counts of words over a whole table."""

    documents: int
    mean: float
    words: np.ndarray
    df: np.ndarray

    def of(self, words: np.ndarray, otherwise: np.ndarray | int) -> np.ndarray:
        """Document counts; what stands for words that are not in the table is given."""
        if not len(self.words):
            return np.broadcast_to(otherwise, words.shape)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.df[at], otherwise)

    def weights(self, df: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        idf = np.log1p((np.maximum(self.documents, df) - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def vectors(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Unit vectors whose products are near the cosines of the documents' weighted words."""
        doc, word, tf, size = _terms(ids, sizes, starts)
        new = np.concatenate([[True], word[1:] != word[:-1]])[:len(word)]
        df = np.repeat(self.of(word[new], 1), np.diff(np.append(np.flatnonzero(new), len(word))))
        weight = np.where(df > 1, self.weights(df, tf, size[doc]), 0.0)
        spread = scan.mix(word)
        place = doc * DIMENSIONS + (spread % np.uint64(DIMENSIONS)).astype(np.int64)
        sign = np.where(spread >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(place, weight * sign, len(sizes) * DIMENSIONS).reshape(len(sizes), DIMENSIONS)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass
class Counters(Counts):
    """Counts of all words in ``df``, two rows of counters one after the other; ``words`` is not used."""

    def of(self, words: np.ndarray, otherwise: np.ndarray | int) -> np.ndarray:
        """Document counts; ``otherwise`` is their least."""
        one, two = _buckets(words)
        return np.maximum(np.minimum(self.df[one], self.df[BUCKETS + two]).astype(np.int64), otherwise)


@dataclass
class Tree:
    """Planes that lead a vector to its leaf; leaves are numbered in order, so neighbours are alike."""

    planes: np.ndarray
    limits: np.ndarray
    children: np.ndarray  # of each plane: the next planes, or a leaf as -1 - number

    @classmethod
    def grown(cls, x: np.ndarray, least: int) -> Tree:
        """A tree on the rows of ``x``: nodes of over ``least`` rows are cut between two centres."""
        planes, limits, children = [], [], []
        leaves = 0
        r = np.random.default_rng(7)
        # (rows, plane above, its side); the left side is taken off the stack first.
        stack = [(np.arange(len(x)), -1, 0)]
        while stack:
            at, above, side = stack.pop()
            cut = cls._cut(x[at], r) if len(at) > least else None
            if cut is None:
                name = -1 - leaves
                leaves += 1
            else:
                name = len(planes)
                planes.append(cut[0])
                limits.append(cut[1])
                children.append([0, 0])
                right = x[at] @ cut[0] > cut[1]
                stack += [(at[right], name, 1), (at[~right], name, 0)]
            if above >= 0:
                children[above][side] = name
        return cls(np.array(planes, np.float32).reshape(-1, x.shape[1]), np.array(limits, np.float32), np.array(children, np.int64).reshape(-1, 2))

    @staticmethod
    def _cut(x: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, np.float32] | None:
        one = x[r.integers(len(x))]
        two = x[(x @ one).argmin()]
        for _ in range(6):
            near = x @ (one - two) > 0
            if near.all() or not near.any():
                break
            one, two = (c / max(np.linalg.norm(c), 1e-12) for c in (x[near].mean(axis=0), x[~near].mean(axis=0)))
        plane = (one - two).astype(np.float32)
        along = x @ plane
        limit = np.float32(0)
        if not 0.1 <= (along > limit).mean() <= 0.9:
            limit = np.float32(np.median(along))
        share = (along > limit).mean()
        return (plane, limit) if 0 < share < 1 else None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            k = node[inner]
            side = np.einsum("ij,ij->i", x[inner], self.planes[k]) > self.limits[k]
            node[inner] = self.children[k, side.astype(np.int64)]
        return -1 - node


def _index(docs: list[np.ndarray], starts: np.ndarray, counts: Counts):
    """What scores a document of a shard against the others: common products, postings of the rest, and each document's words.

    Words that no two documents of the shard share score nothing between them and are left out.
    """
    doc, word, tf, size = _terms(np.concatenate(docs), np.array([len(d) for d in docs]), starts)
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    df = np.diff(np.append(np.flatnonzero(new), len(word)))
    over_all = np.repeat(np.maximum(counts.of(word[new], df), df), df)
    weight = counts.weights(over_all, tf, size[doc])
    common = np.repeat((df > 1) & (df * COMMON >= len(docs)), df)
    column = np.cumsum(new & common) - 1
    held = np.zeros((len(docs), int((new & common).sum())), np.float32)
    held[doc[common], column[common]] = weight[common]
    products = (held > 0).astype(np.float32) @ held.T
    rest = np.repeat(df > 1, df) & ~common
    doc, weight, new = doc[rest], weight[rest], new[rest]
    df = np.diff(np.append(np.flatnonzero(new), len(doc)))
    term = np.cumsum(new) - 1
    by_doc = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[by_doc], np.arange(len(docs) + 1))
    return products, np.concatenate([[0], np.cumsum(df)]), doc, weight, [term[by_doc[bounds[i]:bounds[i + 1]]] for i in range(len(docs))]


def _scores(index, seed: int, n: int) -> np.ndarray:
    """BM25 scores of all documents of a shard for the words of one of them."""
    products, offsets, posting, weight, terms = index
    first = offsets[terms[seed]]
    sizes = offsets[terms[seed] + 1] - first
    place = np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    return products[seed] + np.bincount(posting[place], weight[place], n)


def fill(docs: list[np.ndarray], starts: np.ndarray, counts: Counts, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, window number, offset)`` of each piece of a shard."""
    out = []
    at = np.zeros(len(docs), np.int64)
    sizes = np.array([len(d) for d in docs])
    number = 0
    for i, n in enumerate(sizes):
        for s in range(0, n - window + 1, window):
            out.append((i, s, window, number, 0))
            number += 1
        at[i] = n // window * window
    left = sizes - at
    if not (left > 0).any():
        return out
    index = _index(docs, starts, counts)
    for seed in range(len(docs)):
        while left[seed]:
            room = window
            take = [(seed, int(left[seed]))]
            room -= take[0][1]
            taken = {seed}
            scores = None
            while room:
                free = left > 0
                free[list(taken)] = False
                if not free.any():
                    break
                if scores is None:
                    scores = _scores(index, seed, len(docs))
                ranked = np.where(free, scores, -1.0)
                near = np.argsort(-ranked, kind="stable")[:NEIGHBOURS]
                near = near[ranked[near] >= 0]
                whole = False
                for j in near:
                    if left[j] <= room:
                        take.append((int(j), int(left[j])))
                        taken.add(int(j))
                        room -= int(left[j])
                        whole = True
                if room and not whole:  # none fits: cut the best
                    take.append((int(near[0]), room))
                    room = 0
            offset = 0
            for j, n in take:
                out.append((j, int(at[j]), n, number, offset))
                at[j] += n
                left[j] -= n
                offset += n
            number += 1
    return out


PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _chunks(tokens: list[bytes], ids: int = CHUNK_IDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of some documents in a row, and their number by document: few at a time, so that the arrays of words stay small."""
    held, size = [], 0
    for b in tokens:
        if held and size + len(b) // 2 > ids:
            yield np.frombuffer(b"".join(held), np.uint16), np.array([len(x) // 2 for x in held], np.int64)
            held, size = [], 0
        held.append(b)
        size += len(b) // 2
    if held:
        yield np.frombuffer(b"".join(held), np.uint16), np.array([len(x) // 2 for x in held], np.int64)


def document_counts(encoded: DataFrame, vocabulary: str = VOCABULARY) -> Counters:
    """Counts over all rows of ``tokens``; a task sends its counters once, whatever the number of its rows.

    They are sent in ``COUNTER_PARTS`` parts, each added up by itself, so that the driver reads one set of counters.
    """
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _word_starts(vocabulary)
        total, out = np.zeros(2, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            tokens = batch.column(0)
            for at in range(0, batch.num_rows, ROWS):
                for some in _chunks(tokens.slice(at, ROWS).to_pylist()):
                    _, word, _, size = _terms(*some, starts)
                    total[1] += size.sum()
                    new = np.concatenate([[True], word[1:] != word[:-1]])[:len(word)]
                    df = np.diff(np.append(np.flatnonzero(new), len(word)))
                    for row, place in enumerate(_buckets(word[new])):
                        np.add.at(out, row * BUCKETS + place, df)
        for i, part in enumerate([total, *np.array_split(out, COUNTER_PARTS)]):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["part", "counts"])

    def added(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b, np.int64) for b in table["counts"].to_pylist())
        part = table["part"][0].as_py()
        # Counters of 32 bits stay at their largest number; a word in so many documents weighs nothing.
        kept = whole if part == 0 else np.minimum(whole, (1 << 32) - 1).astype(np.uint32)
        return pa.table({"part": pa.array([part]), "counts": pa.array([kept.tobytes()], pa.binary())})

    width = max(1, encoded.sparkSession.sparkContext.defaultParallelism)
    form = "part bigint, counts binary"
    parts = encoded.select("tokens").coalesce(width).mapInArrow(seen, form).groupBy("part").applyInArrow(added, form).collect()
    found = {p["part"]: bytes(p["counts"]) for p in parts}  # COUNTER_PARTS parts
    n, total = (int(x) for x in np.frombuffer(found.pop(0, bytes(16)), np.int64))
    df = np.frombuffer(b"".join(found[i] for i in sorted(found)), np.uint32) if found else np.zeros(2 * BUCKETS, np.uint32)
    return Counters(n, max(1.0, total / n) if n else 1.0, np.zeros(0, np.uint64), df)


def _dealt(sizes: dict[int, tuple[float, float]], leaves: int, documents: int, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each of ``leaves`` leaves, by its documents and ids.

    Small leaves share one with the leaves beside them, large ones are dealt to several.
    """
    first, parts = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    number, held = 0, np.zeros(2)
    for leaf in range(leaves):
        own = np.array(sizes.get(leaf, (0, 0))) / (documents, ids)
        if held.any() and (held + own > 1).any():
            number, held = number + 1, np.zeros(2)
        first[leaf], parts[leaf] = number, max(1, int(np.ceil(own.max())))
        if (own > 1).any():
            number, held = number + parts[leaf], np.zeros(2)
        else:
            held = held + own
    return first, parts


def _fits(rows: list[tuple[int | None, bytes]], documents: int, ids: int) -> bool:
    return len(rows) <= documents and sum(len(b) for _, b in rows) <= 2 * ids


def _runs(batches: Iterator[pa.RecordBatch], documents: int, ids: int) -> Iterator[tuple[int, int, list[tuple[int | None, bytes]], bool]]:
    """``(group, leaf, rows, whether it is the leaf's whole)`` of batches in this order; a leaf above the bounds comes in several runs."""
    at, held, size, whole = None, [], 0, True
    for batch in batches:
        for group, leaf, doc, b in zip(*(batch.column(c).to_pylist() for c in range(4))):
            ends = held and (group, leaf) != at
            if held and (ends or len(held) == documents or size + len(b) // 2 > ids):
                whole = whole and bool(ends)
                yield *at, held, whole
                held, size, whole = [], 0, bool(ends)
            at = group, leaf
            held.append((doc, b))
            size += len(b) // 2
    if held:
        yield *at, held, whole


def _cut(rows: list[tuple[int | None, bytes]], documents: int, ids: int, counts: Counts, starts: np.ndarray) -> Iterator[list[tuple[int | None, bytes]]]:
    """The rows of a large leaf in shards: a tree on the vectors of all of them tells which are alike."""
    x = np.concatenate([counts.vectors(*held, starts) for held in _chunks([b for _, b in rows])])
    tree = Tree.grown(x, max(1, min(LEAF, documents // 2)))
    leaf = tree.leaves(x)
    held: list[tuple[int | None, bytes]] = []
    for k in range(len(tree.planes) + 1):
        own = [rows[i] for i in np.flatnonzero(leaf == k)]
        if held and not _fits(held + own, documents, ids):
            yield held
            held = []
        size = sum(len(b) for _, b in held)
        for row in own:  # a leaf that no plane cuts is cut in the order of its rows
            if held and (len(held) == documents or size + len(row[1]) > 2 * ids):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield held


def _shards(runs: Iterator[tuple[int, int, list[tuple[int | None, bytes]], bool]], documents: int, ids: int, counts: Counts,
            starts: np.ndarray) -> Iterator[tuple[int, list[tuple[int | None, bytes]]]]:
    """``(first leaf, rows)`` of each shard: leaves that follow one another in a group, by their own numbers of documents and ids."""
    held, name, of = [], -1, -1
    for group, leaf, rows, whole in runs:
        alone = not whole or not _fits(rows, documents, ids)
        if held and (alone or group != of or not _fits(held + rows, documents, ids)):
            yield name, held
            held = []
        if alone:
            yield from ((leaf, part) for part in _cut(rows, documents, ids, counts, starts))
        else:
            name, of = leaf if not held else name, group
            held = held + rows
    if held:
        yield name, held


def sharded(docs: DataFrame, key: str = "doc_id", shard: int = SHARD, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> tuple[DataFrame, Counts]:
    """``(doc_id, tie, tokens, shard, leaf)`` of each row, and the counts over all rows.

    ``shard`` is a group of about ``GROUP`` shards that are filled in a row. Ids are stored once, and the leaf of a row is found
    once, when it is dealt. About ``SIZES`` rows, copies among them, tell how the work is dealt to groups, and nothing else:
    where a shard ends follows from all its rows. The driver holds the counters, a sample of vectors and three numbers
    per leaf; the tree has ``SAMPLE / LEAF_SAMPLE`` leaves at most, and leaves above the size of a group are dealt by hash to several.
    """
    whole = F.coalesce("text", F.lit(""))

    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(encode_all(texts.to_pylist(), vocabulary, ranks), pa.binary())

    # Repeated rows get numbers of their own, so that a hot one is split like others; they share ``pick``.
    encoded = stored(docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.xxhash64(key, "text", F.monotonically_increasing_id()).alias("spread"),
        F.xxhash64(F.lit(1), F.col(key), "text").alias("pick"), arrow_udf(tokens, "binary")(whole).alias("tokens")), "packing")
    counts = document_counts(encoded, vocabulary)
    share = min(1.0, SAMPLE / max(1, counts.documents))
    tree = None
    if counts.documents > shard:
        def vectors(column: pa.Array) -> pa.Array:
            return pa.array([v.tobytes() for held in _chunks(column.to_pylist()) for v in counts.vectors(*held, _word_starts(vocabulary))], pa.binary())

        some = encoded.filter(F.pmod("pick", F.lit(1_000_000)) < int(1_000_000 * share)).dropDuplicates(["pick"])
        sample = some.select("pick", arrow_udf(vectors, "binary")("tokens").alias("v")).toArrow()  # 1 KB for each of SAMPLE documents
        x = np.frombuffer(b"".join(sample["v"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
        tree = Tree.grown(x[np.argsort(sample["pick"].to_numpy(), kind="stable")], max(LEAF_SAMPLE, int(share * min(LEAF, shard // 2))))

    def leaves(column: pa.Array) -> np.ndarray:
        if tree is None:
            return np.zeros(len(column), np.int64)
        return np.concatenate([np.zeros(0, np.int64), *(
            tree.leaves(counts.vectors(*held, _word_starts(vocabulary))) for held in _chunks(column.to_pylist()))])

    def leaf(column: pa.Array) -> pa.Array:
        return pa.array(leaves(column))

    seen = min(1.0, SIZES / max(1, counts.documents)) if tree else 1.0
    by_leaf = encoded.filter(F.pmod("spread", F.lit(1_000_000)) < round(1_000_000 * seen)).groupBy(
        arrow_udf(leaf, "bigint")("tokens").alias("leaf") if tree else F.lit(0).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("tokens") / 2).alias("ids")).collect()
    first, parts = _dealt({r["leaf"]: (r["n"] / seen, r["ids"] / seen) for r in by_leaf}, len(tree.planes) + 1 if tree else 1, GROUP * shard, GROUP * SHARD_IDS)
    named = np.cumsum(parts) - parts  # a leaf in several groups is a leaf in each

    def number(column: pa.Array, spread: pa.Array) -> pa.Array:
        k = leaves(column)
        part = spread.to_numpy(zero_copy_only=False) % parts[k]
        return pa.StructArray.from_arrays([pa.array(first[k] + part), pa.array(named[k] + part)], names=["shard", "leaf"])

    place = arrow_udf(number, "shard bigint, leaf bigint")("tokens", "spread").alias("place")
    return encoded.select("doc_id", "tie", "tokens", place).select("doc_id", "tie", "tokens", "place.shard", "place.leaf"), counts


def pack(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, shard: int = SHARD,
         vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Pieces of documents with their ids (unsigned 32-bit, little-endian) and their place in a sequence.

    One shuffle moves two bytes per id. A task reads its groups leaf by leaf and holds a shard and a leaf, of which it takes at
    most ``GROUP`` shards at a time. The number of shards follows the number of documents.
    """
    dealt, counts = sharded(docs, key, shard, vocabulary, ranks)

    def packed(first: int, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = [np.frombuffer(b, np.uint16) for _, b in rows]
        pieces = fill(ids, _word_starts(vocabulary), counts, window)
        column = list(zip(*pieces))
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][0] for i in column[0]], pa.int64()), "start": pa.array(column[1], pa.int64()),
            "length": pa.array(column[2], pa.int64()),
            "ids": pa.array([ids[i][s:s + n].astype("<u4").tobytes() for i, s, n, _, _ in pieces], pa.binary()),
            "doc_tokens": pa.array([len(ids[i]) for i in column[0]], pa.int64()),
            "sequence_id": pa.array([first + q for q in column[3]], pa.int64()), "offset": pa.array(column[4], pa.int64())})

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = -1, 0
        runs = _runs(batches, GROUP * shard, GROUP * SHARD_IDS)
        for number, rows in _shards(runs, shard, SHARD_IDS, counts, _word_starts(vocabulary)):
            if number != at:
                at, first = number, number << 32
            out = packed(first, sorted(rows, key=lambda row: (row[0] is None, row[0] or 0)))
            yield out
            first = pc.max(out["sequence_id"]).as_py() + 1

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "leaf", F.col("doc_id").asc_nulls_last(), "tie")
    return ordered.select("shard", "leaf", "doc_id", "tokens").mapInArrow(filled, PIECES)
