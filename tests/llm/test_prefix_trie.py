"""The conversation trie against a dictionary of all beginnings, with shards and blocks of a few rows."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from churnlake.llm import prefix_trie
from churnlake.llm.registry import ready

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, path string"


def brute(convs):
    """Nodes of ``{conv_id: [(role, text), ...]}``."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(ids) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    out = []
    for p, ids in members.items():
        ended = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p],
                    hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(seed, n):
    """Conversations over few texts, so that beginnings are shared; a third are the same one, and one is long."""
    r = random.Random(seed)
    convs = {}
    for c in range(n):
        turns = [(r.choice(["user", "system"]), r.choice(["", "a", "bé", "ccc"])) for _ in range(r.randrange(1, 6))]
        convs[c] = [("user", "hot")] * 3 if c % 3 == 0 else turns
    convs[n] = [("user", "hot")] * 300
    return convs


@pytest.mark.parametrize("cells, shard_turns", [(4, 5), (64, 40), (1 << 17, 1 << 20)])
def test_trie_by_brute_force(spark, cells, shard_turns):
    ready(spark)
    convs = planted(3, 90)
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    assert result(prefix_trie.prefix_trie(frame(spark, rows), cells, shard_turns)) == brute(convs)


def test_order_nulls_ties_repeats_and_empty_tables(spark):
    ready(spark)
    rows = [(1, None, "user", "first"), (1, 0, None, "x"), (1, 3, "user", None), (2, 0, "user", "first"), (2, 1, "", "x"), (2, 2, "user", ""),
            (3, 7, "b", "t"), (3, 7, "a", "t"), (4, 0, "a", "t"), (4, 1, "b", "t"), (5, 1, "a", "t"), (5, 1, "a", "t"), (None, 0, "user", "left out"),
            (9, 0, "user", "z" * 200_000)]
    convs = {1: [("user", "first"), ("", "x"), ("user", "")], 3: [("a", "t"), ("b", "t")], 5: [("a", "t"), ("a", "t")], 9: [("user", "z" * 200_000)]}
    convs |= {2: convs[1], 4: convs[3]}
    df = frame(spark, rows)
    assert result(prefix_trie.prefix_trie(df)) == brute(convs)
    assert prefix_trie.prefix_trie(df.filter("conv_id = -1")).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    turns = "array<struct<a:bigint,b:bigint,bytes:bigint>>"
    convs = spark.createDataFrame([(4, []), (7, []), (9, [(1, 2, 5)])], f"conv_id bigint, turns {turns}")
    assert result(prefix_trie.trie(convs)) == brute({4: [], 7: [], 9: [("", "five.")]})
    assert result(prefix_trie.trie(convs.filter("conv_id < 9"))) == brute({4: [], 7: []})


def test_borrowed_beginnings(spark):
    own = {c: [(c, i, 1) for i in range(n)] for c, n in [(0, 9), (1, 2), (3, 12), (7, 4), (10, 0)]}
    turns = "array<struct<a:bigint,b:bigint,bytes:bigint>>"
    got = prefix_trie.with_borrowed_beginnings(spark.createDataFrame(list(own.items()), f"conv_id bigint, turns {turns}"))
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got.collect()} == want
    assert got.filter(F.col("turns").isNull()).count() == 0
