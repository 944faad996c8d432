from collections import Counter

import numpy as np
import pytest

from wiresift.llm import sharding
from wiresift.llm.sharding import Permutation, op6_feistel_shards, row_at, shard_rows

SCHEMA = "doc_id long, text string, shard string, slot string"


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(total):
    p = Permutation(total)
    out = p.forward(np.arange(total))
    assert sorted(out.tolist()) == list(range(total))
    assert p.backward(out).tolist() == list(range(total))


def test_shuffles():
    out = Permutation(1 << 16).forward(np.arange(1 << 16))
    assert abs(np.corrcoef(out, np.arange(1 << 16))[0, 1]) < 0.02
    assert (out != Permutation(1 << 16, seed=5).forward(np.arange(1 << 16))).mean() > 0.99


def test_shards_are_even_and_computable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    data = [(i, f"t{i % 9}") for i in range(300)] + [(None, None)] * 40 + [(3, "same")] * 100
    rows = spark.createDataFrame(data, "doc_id long, text string")
    a = shard_rows(rows.repartition(4), 7).collect()
    b = shard_rows(rows.coalesce(1), 7).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert Counter((r["doc_id"], r["text"]) for r in a) == Counter(data)
    sizes = Counter(r["shard"] for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in a if r["shard"] == s) == list(range(sizes[s]))
    assert row_at([r["shard"] for r in a], [r["slot"] for r in a], len(data), 7).tolist() == [r["row_number"] for r in a]


def test_small_tables(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long"), 40).count() == 0
    assert [(r["shard"], r["slot"]) for r in shard_rows(spark.createDataFrame([(1,)], "doc_id long"), 40).collect()] == [(0, 0)]


def test_registered_query(spark):
    out = op6_feistel_shards(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs)
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 16 for r in docs}
    assert all(r["size"] == size[r["doc_id"]] and r["law"] == "rows" for r in out)
