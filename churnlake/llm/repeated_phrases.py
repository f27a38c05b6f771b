"""Passages that stand in more than one place, found by sharded Aho-Corasick automata and taken out.

A window of so many words recurs if its word sequence starts anywhere else, in the same document or
another. Every window has an anchor: the first of its eight-word runs with the least hash. Equal windows
have equal anchors, so only documents with an anchor that stands in several places can hold a repeat.
Windows in a row with the same anchor form a segment of less than two windows.

1. Segments of all texts are named by two hashes (of the anchor and of the whole), and anchors are
   counted. What goes on is the places of anchors that stand in two places or more.
2. One text of each distinct segment sends its words to the shard of the anchor. There the recurring
   passages are confirmed word by word, compiled to an Aho-Corasick automaton over words, and all
   segments of the shard stream through it; it tells every place where a passage occurs.
3. Every document takes the places found in its segments, and words within a passage are removed.

Shards are bounded. An anchor with very many distinct segments (a frequent phrase in ever new
surroundings) does not fill one: its windows are dealt one by one, equal ones counted before they are
sent. Hashes are shuffled, and of texts what distinct segments hold; whole texts move twice, to the numbers of
the segments that they send and to the places found in them, and so at every size of the table.

Null and empty texts have no words. Repeated rows are places like any other: equal texts lose all words
that windows cover, in all rows. Extra columns pass through unless they bear the name of a result, which
then takes their place. Very long texts are scanned whole, with arrays in proportion to the text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan
from churnlake.session import broadcast_if_small, stored

WINDOW = 35
GRAM = 8
SHARD = 8192    # distinct segments of a shard aimed at
HOT = 2048      # distinct segments of an anchor from which its windows are dealt one by one

_BASE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)

SPAN = "struct<start:int,size:int>"
NAME = pa.struct([("g", pa.int64()), ("s", pa.int64())])
SENT = pa.struct([("g", pa.int64()), ("s", pa.int64()), ("first", pa.int32()), ("twice", pa.bool_()),
                  ("u", pa.int64()), ("v", pa.int64()), ("words", pa.binary())])
SENT_DDL = "array<struct<g:bigint,s:bigint,first:int,twice:boolean,u:bigint,v:bigint,words:binary>>"
CLEAN = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


class _Rolling:
    """Hashes of all runs of words of one size, from running sums: a power of an odd base for each place."""

    def __init__(self, hashed: np.ndarray):
        self.n = len(hashed)
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base, inverse in zip(_BASE, _INVERSE):
                power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, base)]))
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(hashed * power[:-1])]))
                self.back.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, inverse)])))

    def of(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return scan.mix((self.sums[which][at + size] - self.sums[which][at]) * self.back[which][at])


@dataclass
class Segments:
    """Segments of some texts in order: text, first word, windows, and the two hashes of the name."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray   # of words
    text: np.ndarray    # of segments
    first: np.ndarray
    windows: np.ndarray
    g: np.ndarray
    s: np.ndarray
    rolling: _Rolling | None

    @classmethod
    def of(cls, part: scan.Part, window: int) -> Segments:
        starts, ends, owner = scan.words(part)
        gram = min(GRAM, window)
        n, wide = len(starts) - window + 1, window - gram + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return cls(starts, ends, owner, none, none, none, none, none, None)
        rolling = _Rolling(scan.hashes(part.data, starts, ends))
        grams = rolling.of(np.arange(len(starts) - gram + 1), gram)
        anchor = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1)
        at = np.flatnonzero(owner[:n] == owner[window - 1:])
        anchor = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])[:len(at)])
        first, windows = at[new], np.diff(np.append(new, len(at)))
        with np.errstate(over="ignore"):
            whole = scan.mix(rolling.of(first, window) + windows.astype(np.uint64)) + rolling.of(first + windows - 1, window, 1)
        return cls(starts, ends, owner, owner[first], first, windows, grams[anchor[new]].view(np.int64), whole.view(np.int64), rolling)


def _names(window: int):
    def names(texts: pa.Array) -> pa.Array:
        found = []
        for part in scan.parts(texts):
            x = Segments.of(part, window)
            found.append(scan.list_array(x.text, len(part), pa.StructArray.from_arrays([pa.array(x.g, pa.int64()), pa.array(x.s, pa.int64())], fields=list(NAME))))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(NAME))

    return names


def _sent(window: int):
    """Words of the segments that are asked for: numbers of segments, times 4, with 1 if it stands in two places, 2 if its anchor is hot."""
    def sent(texts: pa.Array, codes: pa.Array) -> pa.Array:
        asked = codes.to_pylist()
        out = []
        for part in scan.parts(texts):
            x = Segments.of(part, window)
            begins = np.searchsorted(x.text, np.arange(len(part)))
            for i in range(len(part)):
                mine = []
                for code in asked[part.first + i] or []:
                    k = begins[i] + (code >> 2)
                    first, twice = int(x.first[k]), bool(code & 1)
                    if code & 2:
                        for w in range(int(x.windows[k])):
                            at = np.array([first + w])
                            words = part.data[x.starts[first + w]:x.ends[first + w + window - 1]].tobytes()
                            mine.append((int(x.g[k]), int(x.s[k]), w, twice, *(int(x.rolling.of(at, window, b).view(np.int64)[0]) for b in (0, 1)), words))
                    else:
                        words = part.data[x.starts[first]:x.ends[first + x.windows[k] + window - 2]].tobytes()
                        mine.append((int(x.g[k]), int(x.s[k]), None, twice, int(x.g[k]), int(x.s[k]), words))
                out.append([dict(zip(SENT.names, m)) for m in mine])
        return pa.array(out, pa.list_(SENT))

    return sent


def occurrences(segments: list[tuple[bytes, int]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Places of recurring passages in each segment, as first word and words, by an automaton of the passages.

    A segment comes with the number of its places, 2 standing for more. A window recurs if its segments
    have two places together; windows that recur in a row make a passage.
    """
    names: dict[bytes, int] = {}
    # Words are runs of bytes between the white space that bytes.split() knows.
    coded = [tuple([names.setdefault(w, len(names)) for w in words.split()]) for words, _ in segments]
    seen: Counter = Counter()
    for ids, (_, n) in zip(coded, segments):
        for k in range(len(ids) - window + 1):
            seen[ids[k:k + window]] += n
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for ids in coded:
        begin = None
        for k in range(len(ids) - window + 2):
            recurs = k + window <= len(ids) and seen[ids[k:k + window]] > 1
            if recurs and begin is None:
                begin = k
            elif not recurs and begin is not None:
                automaton.add_word(ids[begin:k + window - 1], k + window - 1 - begin)
                begin = None
    if not len(automaton):
        return [[] for _ in coded]
    automaton.make_automaton()
    out = []
    for ids in coded:
        spans: list[tuple[int, int]] = []
        for start, stop in sorted((end + 1 - size, end + 1) for end, size in automaton.iter(ids)):
            if spans and start <= spans[-1][0] + spans[-1][1]:
                spans[-1] = (spans[-1][0], max(stop - spans[-1][0], spans[-1][1]))
            else:
                spans.append((start, stop - start))
        out.append(spans)
    return out


def _without(window: int):
    """Words, removed words and the rest of each text; places are ``(segment, first word in it, words)``."""
    def without(texts: pa.Array, places: pa.Array) -> pa.Array:
        lists = places.to_pylist()
        rows = []
        for part in scan.parts(texts):
            held = [lists[part.first + i] for i in range(len(part))]
            x = Segments.of(part, window) if any(held) else None
            starts, ends, owner = (x.starts, x.ends, x.owner) if x else scan.words(part)
            step = np.zeros(len(starts) + 1, np.int64)
            if x:
                begins = np.searchsorted(x.text, np.arange(len(part)))
                for i, places_of in enumerate(held):
                    for p in places_of or []:
                        for span in p["spans"]:
                            at = x.first[begins[i] + p["ord"]] + span["start"]
                            step[at] += 1
                            step[at + span["size"]] -= 1
            gone = np.cumsum(step)[:-1] > 0
            n, removed = np.bincount(owner, minlength=len(part)), np.bincount(owner[gone], minlength=len(part))
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            data = part.data.tobytes()
            for i in range(len(part)):
                if removed[i]:
                    stay = bounds[i] + np.flatnonzero(~gone[bounds[i]:bounds[i + 1]])
                    kept = b" ".join([data[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())])
                else:
                    kept = b" ".join(data[part.bounds[i]:part.bounds[i + 1]].split())
                rows.append((int(n[i]), int(removed[i]), kept.decode()))
        columns = list(zip(*rows)) or [[]] * len(CLEAN)
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, CLEAN)], fields=list(CLEAN))

    return without


def _key(text: Column) -> list[Column]:
    """A 128-bit name of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def repeated_places(docs: DataFrame, text: str = "text", window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``(k1, k2, places)``: recurring passages of each distinct text that has some, by segment of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    scanned = stored(docs.select(*_key(whole), arrow_udf(_names(window), "array<struct<g:bigint,s:bigint>>")(whole).alias("names")), "segments")
    # Anchors, then segments, with the number of their places.
    anchors = stored(scanned.select(F.explode("names.g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "anchors")
    placed = stored(scanned.select("k1", "k2", F.posexplode("names").alias("ord", "name")).select("k1", "k2", "ord", "name.*").join(
        anchors, "g", "left_semi"), "places")
    distinct = stored(placed.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "ord")).alias("of")), "distinct")
    crowded = stored(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot).select("g", F.lit(2).alias("hot")), "hot")
    code = F.col("of.ord") * 4 + F.coalesce("hot", F.lit(0)) + (F.col("n") > 1).cast("int")
    asked = stored(distinct.join(broadcast_if_small(crowded), "g", "left").groupBy("of.k1", "of.k2").agg(F.collect_list(code).alias("codes")), "asked")
    # One text of each distinct segment sends its words; copies of that text send the same.
    texts = docs.select(whole.alias("text"), *_key(whole)).join(asked.hint("merge"), ["k1", "k2"])
    sent = stored(texts.select(F.inline(arrow_udf(_sent(window), SENT_DDL)("text", "codes"))).groupBy("g", "s", "first").agg(
        F.first("u").alias("u"), F.first("v").alias("v"), F.max("twice").alias("twice"), F.first("words").alias("words")), "words")
    times = F.when(F.col("twice"), 2).otherwise(1)
    units = sent.filter("first is null").select("u", "v", times.alias("n"), "words").unionByName(
        sent.filter("first is not null").groupBy("u", "v").agg(F.sum(times).cast("int").alias("n"), F.first("words").alias("words")))
    shards = max(1, sent.count() // shard)

    def confirmed(table: pa.Table) -> pa.Table:
        spans = occurrences(list(zip(table["words"].to_pylist(), table["n"].to_pylist())), window)
        full = [i for i, s in enumerate(spans) if s]
        told = pa.array([[{"start": a, "size": n} for a, n in spans[i]] for i in full], pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))
        return pa.table({"u": table["u"].take(pa.array(full, pa.int64())), "v": table["v"].take(pa.array(full, pa.int64())), "spans": told})

    found = stored(units.withColumn("shard", F.pmod("u", F.lit(shards))).groupBy("shard").applyInArrow(
        confirmed, f"u bigint, v bigint, spans array<{SPAN}>"), "found")
    # The windows of a hot anchor go back to their segments.
    single = sent.filter("first is not null").select("g", "s", "first", "u", "v").join(found, ["u", "v"]).groupBy("g", "s").agg(
        F.flatten(F.collect_list(F.transform("spans", lambda x: F.struct((x["start"] + F.col("first")).alias("start"), x["size"].alias("size"))))).alias("spans"))
    in_segments = stored(sent.filter("first is null").select("g", "s", "u", "v").join(found, ["u", "v"]).select("g", "s", "spans").unionByName(single), "found")
    return stored(placed.join(in_segments, ["g", "s"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("ord", "spans")).alias("places")), "repeats")


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words outside recurring windows, joined by one space."""
    places = repeated_places(docs, text, window, shard, hot)
    columns = [c for c in docs.columns if c not in CLEAN.names]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("_row"), whole.alias("_text"), *_key(whole)).join(places.hint("merge"), ["k1", "k2"], "left")
    clean = arrow_udf(_without(window), "struct<n_words:bigint,n_removed:bigint,kept:string>")("_text", "places")
    return rows.select("_row", clean.alias("_clean")).select("_row.*", "_clean.*")
