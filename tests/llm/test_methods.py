"""The methods themselves: automata, field, alignment, density, digests."""

import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlake.llm import license_scan, main_text, private_data, quartile_digest, scan, toxic_terms
from test_contracts import WORD, brute_spans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=11))
def test_automaton_finds_what_edit_distance_finds(word):
    terms = {"abcab": 1.0, "cab": 1.0, "bcabcab": 1.0, "aaaabbbbcc": 1.0}
    got = toxic_terms.Automaton(terms, {}).match(word)
    near = [distance(word, t) for t in terms if distance(word, t) <= toxic_terms.errors_allowed(t)]
    assert (got[0] if got else None) == min(near, default=None)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=11))
def test_stems_do_not_lead_to_other_terms(word):
    terms = {"abcab": 1.0, "cab": 1.0, "bcabcab": 1.0, "aaaabbbbcc": 1.0}
    got = toxic_terms.Automaton(terms, {"dab": 2.0, "dcc": 3.0}).match(word)
    near = [distance(word, t) for t in terms if distance(word, t) <= toxic_terms.errors_allowed(t)]
    if not word.startswith(("dab", "dcc")):
        assert (got[0] if got else None) == min(near, default=None)


def test_a_stem_leaves_unrelated_terms_alone():
    assert toxic_terms.Automaton({"grabble": 9.0, "marrowing": 9.0}, {"zort": 5.0}).match("zortrabble")[1] == 5.0


def test_quotation_counts_apart():
    lexicon = toxic_terms.Lexicon({"moron": 9.0, "disgusting": 9.0}, {"vequ": 9.0})
    assert lexicon.features("you m0ron")[1] > 0 and lexicon.features("you moron")[0] > 0 and lexicon.features("vequlo")[3] > 0
    quoted = lexicon.features('a paper printed "moron" here')
    assert quoted[4] > 0 and quoted[0] == 0
    assert lexicon.features("a clean text") == [0.0] * toxic_terms.FEATURES


@settings(max_examples=400, deadline=None)
@given(st.text("a1@.+- (7\né", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [(private_data.KINDS[k], s, e) for k, s, e in private_data.base_spans(text)] == brute_spans(text)


def test_field_adds_rewritten_forms_and_leaves_decoys():
    r = random.Random(1)
    windows = [f"call +1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)} or mail ab.{k}@mail{k}.example.com from "
               f"{r.randint(11, 99)}.{r.randint(11, 99)}.3.{k + 1} please" for k in range(60)]
    weights = private_data.fit(windows)
    for text, kind in (("call (619) 555-0053 now", 3), ("x 619-555-0053 y", 3), ("mail bob.smith (at) mail2.example.com", 0), ("at 70[.]214[.]118[.]188 is", 1)):
        assert [s[0] for s in private_data.all_spans(text, weights)] == [kind], text
    for text in ("date 2024-05-06 07:08:09 ok", "version 3.0.1.2000 of", "isbn 978-3-16-148410-0", "token 0641917ea4e9feb9cda83477b57ac2654884f485"):
        assert private_data.all_spans(text, weights) == [], text


def test_long_hostile_texts_take_linear_time():
    start = time.time()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1(" * 60_000, "(" * 200_000, "1 " * 100_000, "@a." * 60_000):
        private_data.base_spans(text)
        private_data.regions(text)
    for text in ("<" * 200_000, "<!--" * 50_000, "<div>" * 50_000 + "x", '<a "' * 50_000, "<script>" * 30_000, "&amp" * 50_000):
        main_text.main_text(text)
    assert time.time() - start < 20


def test_alignment_spans_edits_within_the_band():
    text = "intro words here. Licensed under the new Apache License, edition Version 2.0. And more."
    index = license_scan.Index(license_scan.TEMPLATES)
    part = next(scan.parts(pa.array([text])))
    (found,), = license_scan._scan_part(part, index, 0.7),
    assert found[0]["license"] == "apache-2.0-notice" and found[0]["coverage"] == 1
    assert text[found[0]["start"]:found[0]["end"]].startswith("Licensed under") and text[:found[0]["end"]].endswith("2.0")


def test_density_selects_the_article_without_naming_it():
    page = ("<body><div id='x1'><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div id='x2'><h2>Title of it</h2>"
            + "".join(f"<p>{'many words of the story go here ' * 6}{k}</p>" for k in range(4)) + "</div><div class='ad'>buy</div></body>")
    got = main_text.main_text(page)
    assert got.startswith("Title of it\nmany words") and got.count("\n") == 4 and "three" not in got and "buy" not in got


def test_digests_by_counting():
    text = "the quick brown fox jumps over the lazy dog " * 3
    counts = np.zeros(quartile_digest.BUCKETS, int)
    data = text.encode()
    with np.errstate(over="ignore"):
        for k, (i, j) in enumerate(quartile_digest.TRIPLETS):
            a, b, c = quartile_digest._KEYS[3 * k:3 * k + 3]
            for p in range(max(i, j), len(data)):
                h = np.uint32(data[p]) * a + np.uint32(data[p - i]) * b + np.uint32(data[p - j]) * c
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                counts[int(h >> np.uint32(25))] += 1
    part = next(scan.parts(pa.array(["x", text, ""])))
    assert (quartile_digest._counts(part)[1] == counts).all()
    one, two = quartile_digest.digests(pa.array([text, text])).to_pylist()
    assert one == two and quartile_digest.differences([one], [two])[0] == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(" \t\nab\x0bé ", max_size=12), max_size=6))
def test_scan_finds_the_words_and_lines(texts):
    for size in (4, 1 << 20):
        words, lines = [[] for _ in texts], [[] for _ in texts]
        for part in scan.parts(pa.array(texts, pa.string()), size):
            for find, out in ((scan.words, words), (scan.lines, lines)):
                for s, e, o in zip(*find(part)):
                    out[part.first + o].append(part.data[s:e].tobytes().decode())
        assert words == [WORD.findall(t) for t in texts] and lines == [t.split("\n") for t in texts]


def test_notices_close_to_each_other_are_all_found():
    index = license_scan.Index(license_scan.TEMPLATES)
    for text, name, n in (("All rights reserved. " * 10, "all-rights-reserved", 10), ("Released under the MIT License. " * 3, "mit-notice", 3),
                          ("All rights reserved. Photos by B. All rights reserved.", "all-rights-reserved", 2)):
        found = license_scan._scan_part(next(scan.parts(pa.array([text]))), index, 0.7)[0]
        assert [(m["license"], m["coverage"]) for m in found] == [(name, 1)] * n
        assert len({text[m["start"]:m["end"]] for m in found}) == 1
