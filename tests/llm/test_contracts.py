"""Each query of the corpus operators against a brute-force version over whole small tables."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest

from churnlake.llm import compression_language, private_data, queries  # noqa: F401  registers the queries
from churnlake.llm.registry import QUERIES

ROOT = "/root/testdata"
SMALL, MIDDLE = f"{ROOT}/sf0.001", f"{ROOT}/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, name, sf):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def documents(sf, columns="doc_id, text"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def test_op1_base_counts(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op1_line_frequency", SMALL)}
    docs = documents(SMALL)
    assert len(got) == len(docs)
    for doc, text in docs:
        words = WORD.findall(text or "")
        windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = set()
        for i in range(len(words) - 7):
            if windows[tuple(words[i:i + 8])] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[doc]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op2_pieces_cover_all_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(full.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in documents(SMALL)}
    got = rows(spark, "op2_packing", SMALL)
    at, sequences = collections.Counter(), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        d, s, n = r["doc_id"], r["start"], r["length"]
        assert s == at[d] and n > 0 and r["doc_tokens"] == len(ids[d])
        assert r["ids_crc32"] == zlib.crc32(ids[d][s:s + n].tobytes())
        at[d] += n
        sequences[r["sequence_id"]].append((r["offset"], n))
    assert at == {d: len(x) for d, x in ids.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048
        padding += 2048 - end
    assert padding < 2048 * 2


def test_op3_held_out_accuracy(spark):
    lang = dict(documents(MIDDLE, "doc_id, lang"))
    held = [r for r in rows(spark, "op3_compression_language", MIDDLE) if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.96 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_op4_held_out_accuracy(spark):
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{MIDDLE}/labels.parquet'").fetchall())
    held = [r for r in rows(spark, "op4_toxic_terms", MIDDLE) if r["held_out"] and r["doc_id"] in toxic]
    hits = [r for r in held if r["predicted"]]
    assert sum(toxic[r["doc_id"]] for r in hits) >= 0.9 * len(hits)
    assert sum(toxic[r["doc_id"]] for r in hits) >= 0.7 * sum(toxic[r["doc_id"]] for r in held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in held)


def test_op5_targets_and_taken(spark):
    got = rows(spark, "op5_mixing", MIDDLE)
    taken, target = collections.Counter(), {}
    source = dict(documents(MIDDLE, "doc_id, source"))
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = (r["target"], r["source_size"])
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(t for t, _ in target.values()) - sum(s for _, s in target.values())) < 1
    assert sum(abs(taken[s] - target[s][0]) for s in target) < 0.15 * sum(taken.values())
    assert got == rows(spark, "op5_mixing", MIDDLE)


def test_op6_article_blocks(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall())
    got = {r["page_id"]: r for r in rows(spark, "op6_main_text", SMALL)}
    assert len(got) == len(pages)
    for page, source in pages.items():
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page]["text"] == "\n".join(b for b in blocks if b)
        assert got[page]["n_chars"] == len(got[page]["text"])


def brute_spans(text):
    """The base rules with plain patterns, as their definition reads."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_op7_base_spans(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op7_private_data", MIDDLE)}
    seen = collections.Counter()
    for doc, text in documents(MIDDLE):
        spans = brute_spans(text or "")
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[doc]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        for kind in private_data.KINDS:
            assert got[doc][f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        assert set(filter(None, told.split(","))) <= set(got[doc]["spans"].split(","))
        seen.update(k for k, _, _ in spans)
    assert all(seen[k] for k in private_data.KINDS)


def brute_components(sets):
    """Smallest id reachable along links of at least 0.8, by comparing all pairs of fitting sizes."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    a2, b2 = find(a), find(b)
                    root[max(a2, b2)] = min(a2, b2)
    return {d: find(d) for d in sets}


def shingles(text):
    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = WORD.findall((text or "").translate(fold))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_op8_components(spark, sf):
    sets = {d: shingles(t) for d, t in documents(sf)}
    want = brute_components(sets)
    got = {r["doc_id"]: r for r in rows(spark, "op8_near_copies", sf)}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (d == want[d]) for d, r in got.items())


def test_op9_notices(spark):
    texts = dict(documents(MIDDLE))
    got = [r for r in rows(spark, "op9_license_scan", MIDDLE) if r["license"]]
    notices = {"mit-notice": "Released under the MIT License", "all-rights-reserved": "All rights reserved",
               "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0", "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
               "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3"}
    want = {(d, name, m.start(), m.end()) for d, t in texts.items() for name, notice in notices.items() for m in re.finditer(notice, t or "")}
    assert {(r["doc_id"], r["license"], r["start"], r["end"]) for r in got if r["coverage"] == 1} >= want > set()


def test_op10_edited_texts(spark):
    docs = [(d, t or "") for d, t in documents(SMALL)]
    got = {r["doc_id"]: r for r in rows(spark, "op10_quartile_digest", SMALL)}
    for k, (doc, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[:len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1
    same = collections.defaultdict(set)
    for doc, text in docs:
        same[text].add(got[doc]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_every_query_has_a_brute_version_or_sql():
    """Each operator has a query; one without SQL is run by name in a test of its result."""
    from pathlib import Path

    from churnlake.llm.registry import ORACLES

    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert all(n in ORACLES or f'"{n}"' in tests for n in names)
