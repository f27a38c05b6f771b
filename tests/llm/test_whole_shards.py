"""Shards of packing: their bounds follow from all rows, and large leaves are cut by likeness."""

import random

import pytest

from churnlake.llm import packing
from churnlake.llm.registry import ready


@pytest.mark.parametrize("name, value, shards", [("SIZES", 20, 2), ("SAMPLE", 64, 5)])
def test_documents_of_a_subject_stay_in_few_shards(spark, monkeypatch, name, value, shards):
    """However few rows tell how leaves are dealt, or grow the tree; texts are short, so a shard is one sequence."""
    ready(spark)
    monkeypatch.setattr(packing, name, value)
    rows = []
    for i in range(1000):
        r = random.Random(i)
        rows.append((i, " ".join(r.sample([f"s{i % 50}w{k}" for k in range(15)], 12))))
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=40).collect()
    found, held = {}, {}
    for g in got:
        found.setdefault(g.doc_id % 50, set()).add(g.sequence_id)
        held.setdefault(g.sequence_id, set()).add(g.doc_id)
    assert sum(g.length for g in got) == sum(len(packing.encode(t)) for _, t in rows)
    assert sum(map(len, found.values())) < shards * len(found)
    assert max(map(len, held.values())) <= 40 and len(held) <= 40


def test_runs_and_cuts_keep_every_row():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    rows = []
    for group, leaf, n in [(0, 0, 3), (0, 1, 4), (0, 2, 25), (0, 3, 0), (0, 4, 2), (1, 5, 2), (1, 6, 70), (2, 7, 1)]:
        rows += [(group, leaf, len(rows) + k, r.integers(2, 900, r.integers(1, 30)).astype(np.uint16).tobytes()) for k in range(n)]
    rows[5] = (*rows[5][:3], bytes(2 * 400))  # a document above the bound of ids is a shard
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k:k + 7])], names=["shard", "leaf", "doc_id", "tokens"]) for k in range(0, len(rows), 7)]
    counts = packing.Counts(100, 10.0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shards = list(packing._shards(packing._runs(iter(batches), 40, 1200), 10, 300, counts, packing._word_starts(packing.VOCABULARY)))
    assert sorted(row for _, held in shards for row in held) == sorted(row[2:] for row in rows)
    assert all(len(held) == 1 or packing._fits(held, 10, 300) for _, held in shards)
    of = {row[2]: row[0] for row in rows}
    assert all(len({of[d] for d, _ in held}) == 1 for _, held in shards)
    names = [n for n, _ in shards]
    assert names == sorted(names)
