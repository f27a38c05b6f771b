"""Nodes of several blocks: what the blocks leave apart is compared as well."""

import numpy as np
import pyarrow as pa

from churnlake.llm import near_copies
from churnlake.llm.registry import ready


def test_members_of_different_blocks_meet(spark, monkeypatch):
    ready(spark)

    def one_node(sid: pa.Array, sig: pa.Array) -> pa.Array:
        return pa.array([[7]] * len(sid), pa.list_(pa.int64()))

    monkeypatch.setattr(near_copies, "_paths", one_node)
    for name, value in (("EXTRA_DEPTH", 0), ("SAMPLE", 1), ("NODE_BLOCK", 8)):
        monkeypatch.setattr(near_copies, name, value)
    r = np.random.default_rng(3)
    pairs = 40
    sketch = r.integers(0, 256, (pairs, near_copies.SKETCH)).astype(np.uint8)
    rows = []
    for k in range(2 * pairs):
        own = sketch[k // 2].copy()
        own[r.permutation(near_copies.SKETCH)[:5 * (k % 2)]] ^= 1  # the second of a pair differs in five values
        rows.append((1000 + k, bytes(64), *map(int, own.view(np.int64))))
    vertices = spark.createDataFrame(rows, "sid bigint, sig binary, s0 bigint, s1 bigint, s2 bigint")
    got = {r["node"]: r["cand"] for r in near_copies.candidates(vertices).collect()}
    assert got == {1000 + k: 1000 + k - k % 2 for k in range(2 * pairs)}
