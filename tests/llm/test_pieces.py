"""Packing: pieces encoded once a batch, leaves found once, shards cut as they are read."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnlake.llm import packing
from churnlake.llm.registry import ready


def texts(n):
    r = np.random.default_rng(5)
    some = [*"ab1 ²\n\t\r.,-éÀßʼ  ", "  ", "\n\n", " \n", " the", "word", "日本", "'s", "<|endoftext|>", "\x0b", "\xa0", "ĸª·´"]
    return ["", " ", "\n", "a  b", "\n\nx ", *("".join(r.choice(some, r.integers(0, 30))) for _ in range(n))]


@pytest.mark.parametrize("size", [1, 50, 2 << 20])
def test_a_batch_has_the_ids_of_the_tokenizer(monkeypatch, size):
    monkeypatch.setattr(packing, "PART_BYTES", size)
    full = Tokenizer.from_file(packing.VOCABULARY)
    rows = texts(500)
    got = [np.frombuffer(b, np.uint16).tolist() for b in packing.encode_all(rows)]
    assert got == [[*full.encode(t, add_special_tokens=False).ids, packing.END] for t in rows]


@pytest.mark.parametrize("rows", [[], [""], ["", ""], [" "], ["a"]])
def test_hardly_any_text(rows):
    assert packing.encode_all(rows) == [packing.encode(t).tobytes() for t in rows]


def test_a_piece_is_encoded_once_a_batch():
    class Watched:
        def __init__(self, of):
            self.of, self.texts = of, []

        def encode_ordinary(self, text):
            self.texts.append(text)
            return self.of.encode_ordinary(text)

        def encode_single_token(self, text):
            return self.of.encode_single_token(text)

    seen = Watched(packing._ranked(packing.RANKS, r"[^\x00]+|\x00"))
    part, = packing.scan.parts(packing.pa.array(["one two one two one two"] * 100))
    ids, bounds = packing._part_ids(part, seen)
    assert len(seen.texts) == 1 and sorted(seen.texts[0].split("\0")[:-1]) == [" one", " two", "one"]
    assert ids[bounds[99]:bounds[100]].tolist() == packing.encode("one two one two one two").tolist()


def test_a_leaf_is_found_once_and_shards_keep_their_bound(spark, monkeypatch):
    """Sizes come from a part of the rows; shards that turn out larger are cut, and every id has one place."""
    ready(spark)
    monkeypatch.setattr(packing, "SIZES", 100)
    rows = [(i, f"subject{i % 7} common word{i % 50} x{i}" if i % 3 else "the same text") for i in range(1000)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id bigint, text string")
    asked = spark.sparkContext.accumulator(0)
    grown = packing.Tree.grown

    class Watched(packing.Tree):
        def leaves(self, x):
            asked.add(len(x))
            return super().leaves(x)

    def watched(x, least):
        tree = grown(x, least)
        return Watched(tree.planes, tree.limits, tree.children)

    monkeypatch.setattr(packing.Tree, "grown", watched)
    got = packing.pack(docs, shard=40).collect()
    assert len(rows) < asked.value < 1.5 * len(rows)  # about 100 rows for sizes, and each row once
    assert sum(r.length for r in got) == sum(len(packing.encode(t or "")) for _, t in [*rows, (None, None)])
    docs_of, place = {}, {}
    for r in got:
        docs_of.setdefault(r.sequence_id >> 32, set()).add((r.doc_id is None, r.doc_id))
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    # A shard is cut after each 40 of its documents, in order.
    part = {doc: (shard, k // 40) for shard, held in docs_of.items() for k, (_, doc) in enumerate(sorted(held, key=lambda d: (d[0], d[1] or 0)))}
    assert max(len(held) for held in docs_of.values()) > 40
    assert all(len({part[r.doc_id] for r in got if r.sequence_id == q}) == 1 for q in place)
    for pieces in place.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
