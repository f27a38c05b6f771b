"""Repeated passages against a count of all windows, with small shards, hot anchors and odd rows."""

import collections
import hashlib
import random
import re

import pytest

from churnlake.llm import queries, repeated_phrases  # noqa: F401  registers the queries
from churnlake.llm.registry import QUERIES, ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """``(words, removed, kept)`` of each text by counting all windows."""
    docs = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def planted(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é\u00a0x", "🙂", "a\u2028b"]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    shared = [prose(k) for k in (34, 35, 36, 60, 200)]
    common = prose(10)
    texts = []
    for i in range(n):
        words = prose(r.choice([0, 5, 34, 35, 80]))
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            a = r.randrange(len(p))
            words += p[a:] if r.random() < 0.5 else p[:a + 1] if r.random() < 0.5 else p
            words += prose(r.choice([0, 1, 40])) + common
        texts.append(r.choice([" ", "\n", "\t "]).join(words))
    whole = " ".join(prose(90))
    texts += [whole] * 40 + [whole.replace(" ", "\n"), "x " * 300, "y " * 35, "y " * 36, None, "", "  \n", " ".join(prose(50) * 3)]
    return texts


@pytest.mark.parametrize("window, shard, hot", [(35, 8192, 2048), (35, 20, 3), (12, 50, 5), (5, 8192, 2048)])
def test_places_by_brute_force(spark, window, shard, hot):
    ready(spark)
    texts = planted(window + shard)
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, kept string, g int").repartition(5)
    out = repeated_phrases.without_repeats(df, window=window, shard=shard, hot=hot)
    assert out.columns == ["doc_id", "text", "g", "n_words", "n_removed", "kept"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()}
    want = brute(texts, window)
    assert len(got) == len(texts) and sum(w[1] > 0 for w in want) > 40
    assert [got[i] for i in range(len(texts))] == want
    assert repeated_phrases.without_repeats(df.filter("doc_id = -1")).collect() == []


def test_automaton_confirms_words():
    a = b" ".join(b"%d" % i for i in range(40))
    assert repeated_phrases.occurrences([(a, 1), (a.replace(b" 20 ", b" 20x "), 1)], 35) == [[], []]
    assert repeated_phrases.occurrences([(a, 2)], 35) == [[(0, 40)]]
    b = b" ".join(b"%d" % i for i in range(3, 60))
    assert repeated_phrases.occurrences([(a, 1), (b, 1)], 35) == [[(3, 37)], [(0, 37)]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs], 35))}
    got = {r["doc_id"]: r for r in QUERIES["op12_repeated_phrases"](spark, f"/root/testdata/{sf}").collect()}
    assert got.keys() == want.keys() and any(w[1] for w in want.values())
    for d, (n, removed, kept) in want.items():
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
