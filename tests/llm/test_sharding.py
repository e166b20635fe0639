"""Op 10: the permutation is a bijection with an inverse; one law holds."""

import zlib

import numpy as np
import pytest

from limnospark.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 20)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, 20, back=True) == np.arange(n)).all()


def check(rows, shards):
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_odd_rows(odd_docs, crowded):
    want = odd_docs.collect()
    got = sharding.shard_documents(crowded(odd_docs)).collect()
    assert len(got) == len(want)
    check(got, 24)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(
        ((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in want), key=key)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_reproducible_and_computable(spark, odd_docs):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs, 7).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(5), 7).collect()}
    assert a == b
    for doc, (shard, slot) in list(a.items())[:50]:
        assert sharding.row_at(shard, slot, 500, 7, 20) == doc


def test_empty(no_docs):
    assert sharding.shard_documents(no_docs).count() == 0
