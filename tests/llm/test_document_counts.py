"""Document counts of packing: of all words at every size, and weights from all documents."""

import numpy as np

from churnlake.llm import packing
from churnlake.llm.registry import ready


def test_rare_words_count_over_the_whole_table(spark):
    ready(spark)
    rows = [(i, f"common rare{i // 2:05d}xyz") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt, counts = packing.sharded(docs, shard=100)
    assert dealt.count() == 3000 and counts.documents == 3000
    starts = packing._word_starts(packing.VOCABULARY)
    ids = [packing.encode(t) for _, t in rows]
    _, word, _, _ = packing._terms(np.concatenate(ids), np.array([len(x) for x in ids]), starts)
    words, df = np.unique(word, return_counts=True)
    assert len(words) > 1500 and (counts.of(words, 0) >= df).all() and (counts.of(words, 0) == df).mean() > 0.99


def test_counts_follow_one_rule_at_every_size(monkeypatch):
    """No word falls back to a count of its shard, however few counters there are."""
    monkeypatch.setattr(packing, "BUCKETS", 4)
    words = np.array([(7 * i + 1) << 42 | i << packing.DOCUMENT_BITS for i in range(16)], np.uint64)
    one, two = packing._buckets(words)
    table = np.zeros(8, np.int64)
    np.add.at(table, one, 3)
    np.add.at(table, 4 + two, 3)
    counts = packing.Counters(100, 10.0, np.zeros(0, np.uint64), table)
    assert (counts.of(words, 1) >= 3).all() and (counts.of(words, 1) == np.minimum(table[one], table[4 + two])).all()
