"""Quality rules: base counts of each text, and lines that many documents of a host share.

Lines are normalised (lower case, digits alike, white space squeezed), hashed, and
counted in distinct documents per host. Documents whose normalised lines are the same
count once, so copies that differ in case, digits or spacing don't deplete each other.
A line that stands in enough documents of its host is boilerplate and removed; a document
that loses most of its words is depleted.

Null or empty texts have no words and fail the base rule. A null host is a host of its
own. Repeated rows get equal results. Extra columns pass through unless they bear the
name of a result, which then takes their place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan
from churnlake.session import checkpoint, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCUMENTS = 10      # documents of a host from which a line may be boilerplate
MAX_REMOVED = 0.7       # share of words that a document may lose

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINE = pa.struct([("line", pa.int64()), ("words", pa.int64())])
SCAN = pa.struct([*((c, pa.int64()) for c in BASE), ("lines", pa.list_(LINE))])
SCAN_DDL = ("struct<" + ",".join(f"{c}:bigint" for c in BASE)
            + ",lines:array<struct<line:bigint,words:bigint>>>")


def _repeated(hashed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words in windows found twice or more in their text, by text."""
    at, window = scan.windows(hashed, owner, WINDOW)
    if not len(at):
        return np.zeros(n, np.int64)
    key = scan.mix(owner[at].astype(np.uint64)) ^ window
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    covered = np.cumsum(step)[:-1] > 0
    return np.bincount(owner[covered], minlength=n)


def _line_words(part: scan.Part):
    """Lines with a word: owner, first word, number of words, start and end; and the words."""
    starts, ends, owner = scan.words(part)
    line_start, line_end, line_owner = scan.lines(part)
    first = np.searchsorted(starts, line_start)
    count = np.searchsorted(starts, line_end) - first
    full = count > 0
    return (line_owner[full], first[full], count[full], line_start[full], line_end[full]), (starts, ends, owner)


def _normalised(part: scan.Part, word_start, word_end, first, count) -> np.ndarray:
    return scan.sequence_hashes(scan.hashes(part.data, word_start, word_end, scan.LOWER_DIGITS), first, count)


def _scan_part(part: scan.Part) -> list[pa.Array]:
    n = len(part)
    (line_owner, first, count, line_start, line_end), (starts, ends, owner) = _line_words(part)
    inside = ~scan.SPACE[part.data]
    exact = scan.hashes(part.data, line_start, line_end)
    alike, _ = scan.distinct(line_owner, exact)
    base = [
        np.bincount(owner, minlength=n), part.sums(inside & scan.LEAD[part.data]), part.sums(SYMBOL[part.data]),
        np.bincount(line_owner, minlength=n) - np.bincount(alike, minlength=n),
        _repeated(scan.hashes(part.data, starts, ends), owner, n)]
    line = _normalised(part, starts, ends, first, count)
    # One row per distinct line of a text, with the words of all its places.
    order = np.lexsort((line, line_owner))
    new = np.ones(len(order), bool)
    new[1:] = (line[order][1:] != line[order][:-1]) | (line_owner[order][1:] != line_owner[order][:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(count[order], at) if len(at) else np.zeros(0, np.int64)
    rows = pa.StructArray.from_arrays(
        [pa.array(line[order][at].view(np.int64)), pa.array(total.astype(np.int64))],
        fields=list(LINE))
    return [*(pa.array(b.astype(np.int64)) for b in base), scan.list_array(line_owner[order][at], n, rows)]


def _scan_texts(text: pa.Array) -> pa.Array:
    found = [_scan_part(p) for p in scan.parts(text)]
    columns = [pa.concat_arrays(c) for c in zip(*found)] if found else [pa.array([], f.type) for f in SCAN]
    return pa.StructArray.from_arrays(columns, fields=list(SCAN))


def scan_text(text: Column) -> Column:
    return arrow_udf(_scan_texts, SCAN_DDL)(text)


def _without_lines(text: pa.Array, drop: pa.Array) -> pa.Array:
    """The text without the lines whose hashes are given; null stays null."""
    out = text.to_pylist()
    lists = drop.to_pylist()
    for part in scan.parts(text):
        ids = [i for i in range(part.first, part.first + len(part)) if lists[i]]
        if not ids:
            continue
        (owner, first, count, start, end), (word_start, word_end, _) = _line_words(part)
        line = _normalised(part, word_start, word_end, first, count).view(np.int64)
        for i in ids:
            mine = np.flatnonzero(owner == i - part.first)
            gone = mine[np.isin(line[mine], lists[i])]
            lo, hi = part.bounds[i - part.first], part.bounds[i - part.first + 1]
            keep = np.ones(hi - lo + 1, bool)
            for k in gone:
                keep[start[k] - lo:end[k] - lo + 1] = False  # with its line break
            out[i] = part.data[lo:hi][keep[:-1]].tobytes().decode()
    return pa.array(out, pa.string())


def without_lines(text: str | Column, lines: str | Column) -> Column:
    return arrow_udf(_without_lines, "string")(text, lines)


def verdicts(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS,
             max_removed: float = MAX_REMOVED, with_text: bool = False) -> DataFrame:
    """``docs`` with base counts, ``base_failed``, ``words_removed``, ``kept`` and, if asked for, the ``cleaned`` text.

    The scan of the texts is stored once, without them if they are not asked for; the lines are counted from that. Only
    hashes are shuffled, partially aggregated, so a line in a third of the rows is one row per
    task. The final join is by host and the hash of the lines, which adaptive execution splits if skewed.
    """
    drop = [c for c in (*BASE, "base_failed", "words_removed", "kept", "cleaned") if c in docs.columns]
    carried = [c for c in docs.columns if c not in drop and (with_text or c != "text")]
    scanned = docs.select(F.col(host).alias("_host"), F.struct(*carried).alias("_row"), scan_text(F.coalesce("text", F.lit(""))).alias("_scan"))
    # Equal normalised lines with equal numbers of words name a document: they lose the same words.
    scanned = scanned.withColumn("_text", F.xxhash64("_scan.lines"))
    # With texts, as columns: the lines are read without them, and the texts once more when lines are taken out.
    scanned = stored(scanned, "lines") if with_text else checkpoint(scanned)
    found = scanned.select("_host", "_text", F.inline("_scan.lines"))
    once = found.groupBy("_host", "line", "_text").agg(F.first("words").alias("words"))
    common = once.groupBy("_host", "line").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).select(
        F.col("_host").alias("h"), F.col("line").alias("l"))
    lost = once.join(common, F.col("_host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_semi").groupBy(
        F.col("_host").alias("h"), F.col("_text").alias("t")).agg(
        F.sum("words").alias("words"), F.collect_list("line").alias("lines"))
    joined = scanned.join(lost, F.col("_host").eqNullSafe(F.col("h")) & (F.col("_text") == F.col("t")), "left")
    base = {c: F.col(f"_scan.{c}") for c in BASE}
    n, removed = base["n_words"], F.coalesce("words", F.lit(0))
    failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    out = joined.select("_row.*", *(v.alias(c) for c, v in base.items()), failed.alias("base_failed"),
                        removed.alias("words_removed"), (~failed & (removed <= max_removed * n)).alias("kept"),
                        *([F.col("lines").alias("_lines")] if with_text else []))
    if with_text:
        out = out.withColumn("cleaned", without_lines("text", "_lines")).drop("_lines")
    return out
