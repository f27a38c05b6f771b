"""Fingerprints of texts: quartile bucket digests, and the order of documents needed to compare neighbours.

Hashed byte triplets are counted in 128 buckets. Each bucket is encoded by the quartile
of its count (2 bits), after a byte for the length and a byte for the ratios of the quartiles.
The difference of two digests sums the steps between their buckets' quartiles, a step of
three counting six, and adds bounded differences of the header; likeness is one minus the
difference over its bound.

A null or empty text has the digest of no triplets (all zeros); texts of one or two bytes
have no triplets either and differ by length only. Equal texts have equal digests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan
from churnlake.session import shuffle_width

BUCKETS = 128
# Triplets of a sliding window of five bytes: the newest byte with each pair of the four before it.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
BOUND = 300  # differences from here on are "nothing alike"
_KEYS = scan.keys(3 * len(TRIPLETS), 21).astype(np.uint32)


def _counts(part: scan.Part) -> np.ndarray:
    n = len(part)
    data = part.data.astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(part.bounds))
    counts = np.zeros(n * BUCKETS, np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        a, b, c = _KEYS[3 * k:3 * k + 3]
        far = max(i, j)
        if len(data) <= far:
            continue
        h = data[far:] * a + data[far - i:len(data) - i] * b + data[far - j:len(data) - j] * c
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        own = owner[far:]
        inside = own == owner[:len(data) - far]
        slot = own * BUCKETS + (h >> np.uint32(25)).astype(np.int32)
        counts += np.bincount(slot[inside], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def digests(texts: pa.Array) -> pa.Array:
    out: list[str] = []
    for part in scan.parts(texts):
        counts = _counts(part)
        ordered = np.sort(counts, axis=1)
        q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
        codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
        packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
        size = np.diff(part.bounds)
        length = np.minimum(255, np.round(np.log1p(size) * 12)).astype(np.uint8)
        top = np.maximum(q3, 1)
        ratios = ((q1 * 15 // top) | (q2 * 15 // top) << 4).astype(np.uint8)
        rows = np.column_stack([length, ratios, packed.astype(np.uint8)])
        out += [r.tobytes().hex() for r in rows]
    return pa.array(out, pa.string())


def digest(text: str | Column) -> Column:
    return arrow_udf(digests, "string")(text)


_STEP = np.array([0, 1, 2, 6])


def differences(left: list[str], right: list[str]) -> np.ndarray:
    """The bounded difference of digests, pair by pair."""
    if not left:
        return np.zeros(0, np.int64)
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(left), -1).astype(np.int64) for x in (left, right))
    total = np.minimum(np.abs(a[:, 0] - b[:, 0]), 24)
    for shift in (0, 4):
        d = np.abs((a[:, 1] >> shift & 15) - (b[:, 1] >> shift & 15))
        total += np.minimum(d, 16 - d)
    for shift in (0, 2, 4, 6):
        total += _STEP[np.abs((a[:, 2:] >> shift & 3) - (b[:, 2:] >> shift & 3))].sum(axis=1)
    return np.minimum(total, BOUND)


def _likenesses(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = left.to_pylist(), right.to_pylist()
    full = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
    out: list[float | None] = [None] * len(a)
    for i, d in zip(full, differences([a[i] for i in full], [b[i] for i in full]).tolist()):
        out[i] = 1 - d / BOUND
    return pa.array(out, pa.float64())


def likeness(left: str | Column, right: str | Column) -> Column:
    """1 for equal digests, 0 at the bound; null if either is null."""
    return arrow_udf(_likenesses, "double")(left, right)


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows in the order of ``key``; the last row gets the first's.

    Ranges of the key go to tasks of their own; the first row of each range is also sent to
    the range before it, so every row finds its successor in its own task with one shuffle.
    Nulls come first; equal keys are ordered by ``columns``.
    """
    spark = docs.sparkSession
    ranges = max(1, shuffle_width(spark))
    cuts = sorted(set(docs.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    cuts = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    bucket = F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col(key))))
    # The smallest key of each range that has rows: as many rows as ranges.
    heads = sorted((tuple(r) for r in docs.groupBy(bucket.alias("b")).agg(
        F.min(key), F.max(F.col(key).isNull())).collect()), key=lambda r: r[0])
    before = {b: heads[i - 1][0] for i, (b, _, _) in enumerate(heads)}  # the first range's head goes to the last
    ordered = sorted(before)
    to = F.element_at(F.array(*[F.lit(before[b]) for b in ordered]), F.array_position(F.array(*map(F.lit, ordered)), bucket).cast("int"))
    lows = F.array(*[F.lit(None if null else low).cast("bigint") for _, low, null in heads])
    head = F.element_at(lows, F.array_position(F.array(*[F.lit(b) for b, _, _ in heads]), bucket).cast("int"))
    first = F.coalesce(F.col(key).eqNullSafe(head), F.lit(False))
    wrap = F.lit(ordered[0] if ordered else 0)
    own = F.struct(bucket.alias("range"), F.lit(False).alias("sent"), F.lit(0).alias("late"))
    sent = F.struct(to.alias("range"), F.lit(True).alias("sent"), F.when(bucket == wrap, 2).otherwise(1).alias("late"))
    dealt = docs.withColumn("_at", F.explode(F.when(first, F.array(own, sent)).otherwise(F.array(own)))).select("*", "_at.*").drop("_at")
    order = Window.partitionBy("range").orderBy("late", F.col(key).asc_nulls_first(), *columns)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col("sent")).drop("range", "sent", "late")


def edited_pairs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's digest, that of its edited text, and its likeness to that and to the next document.

    The edited text has the last half of the code points replaced by the first as many of the
    next document, in the order of ``key``. Texts move once, to the task of their key range.
    """
    texts = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(texts.withColumn("fingerprint", digest("text")), key, ["text", "fingerprint"])
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 2) as int))"),
                      F.substring("next_text", F.lit(1), half))
    out = paired.select(F.col(key), n.alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    out = out.select("*", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), digest("edited").alias("edited_fingerprint"))
    return out.select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"))
