"""Cuts through the skip list against cuts of the list of units, and round trips."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import fill_in_middle as fim
from churnlake.llm import scan
from churnlake.llm.registry import ready

TEXTS = st.lists(st.text(alphabet="ab\n<PSM>é🙂", max_size=60), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 80))
def test_every_rank_is_reached(texts, size):
    for part in scan.parts(pa.array(texts, pa.string()), size):
        counts, points = fim.units_of(part)
        lists = fim.SkipLists(counts, points)
        for i in range(len(part)):
            units = re.findall(r"[^\n]*\n|[^\n]+", texts[part.first + i])
            assert counts[i] == len(units)
            ranks = np.arange(len(units) + 1)
            assert lists.reach(np.full(len(ranks), i), ranks).tolist() == [len("".join(units[:k])) for k in ranks]


def test_lanes_are_short_and_their_widths_add_up():
    counts = np.array([0, 5000, 1, 700])
    points = np.arange(counts.sum()) % 90 + 1
    lanes = fim.SkipLists(counts, points).lanes
    assert len(lanes) > 4 and len(lanes[-1].units) == len(counts)
    for low, high in zip(lanes, lanes[1:]):
        assert len(high.units) <= max(3 * len(counts), 0.4 * len(low.units))
        assert high.units.sum() == counts.sum() and high.points.sum() == points.sum()


@given(st.text(alphabet="aPSM<>\n"), st.text(alphabet="aPSM<>\n"), st.text(alphabet="aPSM<>\n"), st.sampled_from(["psm", "spm"]))
def test_round_trip(a, b, c, form):
    whole = a + b + c
    if not any(m in whole for m in fim.MARKS):
        # What the operator checks before it cuts.
        out = fim.joined(a, b, c, form)
        if fim.taken_apart(out, form) != whole:
            assert any(m in a + m2 for m in fim.MARKS for m2 in fim.MARKS) or any(m in c + m2 for m in fim.MARKS for m2 in fim.MARKS)


def brute(doc, text, rate=100, suffix_first=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate, suffix_first", [(100, 50), (40, 100), (60, 0)])
def test_odd_rows(spark, rate, suffix_first):
    ready(spark)
    rows = [(1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\n\nb\n"), (None, "x\ny"), (6, "has <M> inside\nand more"), (7, "é\n🙂\n" * 60_000),
            (7, "é\n🙂\n" * 60_000), (8, "\r\n\u2028 line\n"), *((k, f"l{k}\n" * (k % 7)) for k in range(100, 160))]
    docs = spark.createDataFrame([(d, t, "own", "out") for d, t in rows], "doc_id bigint, text string, form string, other string")
    out = fim.fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    assert out.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored("output", "form")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"] or "", rate, suffix_first)
        assert r["back"] == (r["text"] or "")
    assert fim.fill_in_middle(docs.filter("doc_id = -1")).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, marks=("a", "a", "b"))
