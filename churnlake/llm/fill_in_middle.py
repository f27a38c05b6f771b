"""Fill-in-the-middle: texts cut at two unit ranks and put together so that a model learns to fill the gap.

The units of a text (lines with their line break) stand in an indexable skip list. Its lowest lane
has one link per unit; each express lane keeps about every fourth node, chosen by a hash of the rank,
and the width of its links is the sum of the widths below: in units and in code points. A cut rank is
reached from the top lane: a link is followed while its unit width does not pass the rank, and the
code points passed on the way are the exact place of the cut. The lists of all texts of a batch lie in
the same arrays, so that all cuts of a batch descend together.

Two ranks are drawn from the hash of seed and key; prefix, middle and suffix are joined by marks in
the order prefix-suffix-middle or suffix-prefix-middle. A text stays plain if it is empty, contains a
mark, is not drawn, or could not be taken apart again (marks that overlap with the text around them).

A null text is an empty one; a null key hashes as the word null. Repeated rows, and rows of equal key
and text, get equal results. Texts are whole, whatever their length: a task holds one Arrow batch and
the lanes of 2 MB of it. Extra columns pass through unless they bear the name of a result, which then
takes their place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan

MARKS = ("<P>", "<S>", "<M>")   # before the prefix, the suffix and the middle
SEED = 7
RATE = 100                      # percent of texts that are cut
SUFFIX_FIRST = 50               # percent of these with the suffix first
LANE_BITS = 2                   # a node reaches the next lane with probability 1 / 2 ** LANE_BITS

FORMS = ("plain", "psm", "spm")
RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
RESULT_DDL = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


@dataclass
class Lane:
    """The nodes of one lane, text after text; each text begins with its head, the node of rank 0.

    ``units`` and ``points`` are the widths of the link from a node to the next one of its text (or to
    the end of the text); ``below`` is the place of the node in the lane below.
    """

    first: np.ndarray
    units: np.ndarray
    points: np.ndarray
    below: np.ndarray


class SkipLists:
    """One indexable skip list per text over units of the given code points.

    ``counts`` has the number of units of each text and ``points`` the code points of all units in order.
    """

    def __init__(self, counts: np.ndarray, points: np.ndarray):
        n = len(counts)
        first = np.concatenate([[0], np.cumsum(counts + 1)])
        rank = np.arange(first[-1]) - np.repeat(first[:-1], counts + 1)
        # The link of the node before a unit has the unit's width; the last node of a text leads nowhere.
        units, width = np.ones(first[-1], np.int64), np.zeros(first[-1], np.int64)
        units[first[1:] - 1] = 0
        width[units > 0] = points
        height = self._heights(rank)
        self.lanes = [Lane(first, units, width, np.arange(first[-1]))]
        while len(self.lanes[-1].units) > n:
            low = self.lanes[-1]
            up = np.flatnonzero(height >= len(self.lanes))
            height = height[up]
            self.lanes.append(Lane(np.searchsorted(up, low.first), np.add.reduceat(low.units, up), np.add.reduceat(low.points, up), up))
            # Nodes of the new lane are numbered anew, so their heights stand in its order already.

    @staticmethod
    def _heights(rank: np.ndarray) -> np.ndarray:
        """Lanes above the lowest that a rank reaches: its hash's trailing zeros; heads reach all."""
        bits = scan.mix(rank.astype(np.uint64) + np.uint64(1))
        low = bits & (~bits + np.uint64(1))
        zeros = np.where(low > 0, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)), 64).astype(np.int64)
        return np.where(rank == 0, 1 << 30, zeros // LANE_BITS)

    def reach(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the unit of each rank, in the text of each number."""
        node = self.lanes[-1].first[text]
        units, points = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for lane in reversed(self.lanes):
            end = lane.first[text + 1]
            moving = np.arange(len(text))
            while len(moving):
                at = node[moving]
                on = (at + 1 < end[moving]) & (units[moving] + lane.units[at] <= rank[moving])
                moving, at = moving[on], at[on]
                units[moving] += lane.units[at]
                points[moving] += lane.points[at]
                node[moving] += 1
            node = lane.below[node]
        return points


def units_of(part: scan.Part) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text (lines with their break; what follows the last break, if anything), and code points of each."""
    last = part.bounds[1:][np.diff(part.bounds) > 0]
    ends = np.union1d(np.flatnonzero(part.data == 10) + 1, last)
    passed = np.concatenate([[0], np.cumsum(scan.LEAD[part.data])])
    points = np.diff(passed[np.concatenate([[0], ends])])
    return np.bincount(part.owner(ends - 1), minlength=len(part)), points


def joined(prefix: str, middle: str, suffix: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    p, s, m = marks
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def taken_apart(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that an output came from."""
    p, s, m = marks
    if form == "plain":
        return output
    lead, second = (p, s) if form == "psm" else (s, p)
    a, _, rest = output[len(lead):].partition(second)
    b, _, middle = rest.partition(m)
    return a + middle + b if form == "psm" else b + middle + a


def _cut(texts: list[str | None], part: scan.Part, draws: np.ndarray, marks, rate: int, suffix_first: int):
    counts, points = units_of(part)
    lists = SkipLists(counts, points)
    rows = np.arange(len(part))
    one, two = draws[:, 0] % (counts + 1), draws[:, 1] % (counts + 1)
    a, b = lists.reach(rows, np.minimum(one, two)), lists.reach(rows, np.maximum(one, two))
    chosen, kind = draws[:, 2] % 100 < rate, np.where(draws[:, 3] % 100 < suffix_first, 2, 1)
    for i in rows:
        text = texts[part.first + i] or ""
        if chosen[i] and text and not any(x in text for x in marks):
            form = FORMS[kind[i]]
            out = joined(text[:a[i]], text[a[i]:b[i]], text[b[i]:], form, marks)
            if taken_apart(out, form, marks) == text:
                yield counts[i], form, a[i], b[i] - a[i], out
                continue
        yield counts[i], FORMS[0], None, None, text


def transformed(text: Column, draws: Column, marks: tuple[str, str, str] = MARKS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Column:
    """Units, form, code points of prefix and middle, and output of each text; ``draws`` has four numbers."""
    def cut(column: pa.Array, numbers: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        four = numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        rows = [r for part in scan.parts(column) for r in _cut(texts, part, four[part.first:part.first + len(part)], marks, rate, suffix_first)]
        columns = list(zip(*rows)) or [[]] * len(RESULT)
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, RESULT)], fields=list(RESULT))

    return arrow_udf(cut, RESULT_DDL)(text, draws)


def drawn(key: str | Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit("null"))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)))


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The texts that outputs came from, whole."""
    def apart(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([o if o is None else taken_apart(o, f, marks) for o, f in zip(outputs.to_pylist(), forms.to_pylist())], pa.string())

    return arrow_udf(apart, "string")(output, form)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", marks: tuple[str, str, str] = MARKS,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output``.

    Row by row, without a shuffle. ``restored`` gives the exact texts back from output and form.
    """
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks that are not empty")
    kept = [c for c in docs.columns if c not in RESULT.names]
    cut = transformed(F.coalesce(F.col(text), F.lit("")), drawn(key, seed), marks, rate, suffix_first)
    return docs.select("*", cut.alias("_fim")).select(*kept, "_fim.*")
