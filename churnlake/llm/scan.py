"""Words, lines and hashes of whole Arrow string batches, as numpy arrays over their UTF-8 bytes.

A batch is cut into parts of a few MB, so that the arrays of one part stay small
whatever the length of the texts. Words are runs of bytes other than space and
0x09-0x0D; these bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PART_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Lower case, and every digit alike: lines that differ in a date or a counter are one line.
LOWER_DIGITS = LOWER.copy()
LOWER_DIGITS[48:58] = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = keys(256, 11)
_PLACE = keys(1 << 12, 12)


def _place(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = keys(2 * n, 12)
    return _PLACE


@dataclass
class Part:
    """Some texts in a row: ``data`` holds their bytes, text i is ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a number or truth per byte, by text."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Number of the text that holds each position."""
        return np.searchsorted(self.bounds, starts, "right") - 1


def parts(texts: pa.Array, size: int = PART_BYTES) -> Iterator[Part]:
    """The texts of an Arrow string array; a null is an empty text here."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Part(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


def words(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    inside = ~SPACE[part.data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = part.bounds[:-1][part.bounds[:-1] < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, part.owner(starts)


def lines(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each line, split at ``\\n``; every text has at least one."""
    breaks = np.flatnonzero(part.data == 10)
    owner = np.concatenate([np.arange(len(part)), part.owner(breaks)])
    starts = np.concatenate([part.bounds[:-1], breaks + 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.ones(len(starts), bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends = np.where(last, part.bounds[owner + 1], np.concatenate([starts[1:], [0]]) - 1)
    return starts, ends, owner


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each segment of bytes; segments are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    full = sizes > 0
    starts, sizes = starts[full], sizes[full]
    if len(starts):
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        taken = data[place + np.repeat(starts, sizes)]
        table = _BYTE if fold is None else _BYTE[fold]
        products = table[taken] * _place(int(sizes.max()))[place]
        out[full] = mix(np.add.reduceat(products, first) + sizes.astype(np.uint64))
    return out


def sequence_hashes(items: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``counts`` hashes that begins at ``firsts``; runs are in order."""
    out = np.zeros(len(firsts), np.uint64)
    full = counts > 0
    firsts, counts = firsts[full], counts[full]
    if len(firsts):
        at = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) - np.repeat(at, counts)
        # Runs that lie one after another are all items as they are.
        taken = items if len(items) == len(place) and np.array_equal(at, firsts) else items[place + np.repeat(firsts, counts)]
        products = taken * _place(int(counts.max()))[place]
        out[full] = mix(np.add.reduceat(products, at) + counts.astype(np.uint64))
    return out


def windows(items: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of ``size`` items within one text."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[size - 1:])
    total = np.zeros(len(at), np.uint64)
    for k, key in enumerate(keys(size, 13)):
        total += items[at + k] * key
    return at, mix(total)


def distinct(owner: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``(owner, item)`` pairs, sorted."""
    order = np.lexsort((items, owner))
    owner, items = owner[order], items[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], items[new]


def list_array(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """One list per text of values that are ordered by text."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
