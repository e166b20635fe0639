"""Op 9: fingerprints and components against brute force."""

import re

import numpy as np
import xxhash

from limnospark.llm import simhash
from limnospark.llm.graph import components


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius=4):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprint(odd_docs):
    for r in odd_docs.collect():
        if len(r["text"] or "") < 10_000:
            assert simhash.fingerprint((r["text"] or "").encode()) == slow_print(r["text"] or "")


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    h = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(1, 300):
        if rng.random() < 0.6:
            fps[i] = fps[i - 1]
            for b in rng.choice(64, rng.integers(0, 9), replace=False):
                fps[i] ^= np.uint64(1) << np.uint64(b)
    planes = simhash._planes(fps)
    for shift in (1, 2, 63, 64, 65, 130, 299):
        for radius in (0, 1, 3, 4, 6):
            mask = np.arange(300) + shift < 300
            want = [i for i in range(300 - shift) if bin(int(fps[i] ^ fps[i + shift])).count("1") <= radius]
            assert sorted(simhash.within(planes, shift, simhash._pack(mask), radius).tolist()) == want


def planted(spark, n=400):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], None
    for i in range(n):
        if base is None or rng.random() < 0.4:
            base = list(rng.choice(words, 120))
        text = list(base)
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(0, 120))] = str(rng.choice(words))
        rows.append((i * 3 % 1009, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components_against_brute_force(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)  # buckets are dealt into chunks
    docs = planted(spark)
    got = simhash.near_duplicates(crowded(docs)).collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_classes(prints)


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[9] == {("0" * 16, 2)}
    assert by[1] == {(f"{slow_print('the cat sat on the mat and the dog ran'):016x}", 1)}
    assert {c for _, c in by[5]} == {1} and {c for _, c in by[None]} == {None}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each(odd_docs, crowded, no_docs):
    got = simhash.one_of_each(crowded(odd_docs))
    assert got.columns == crowded(odd_docs).columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert ids.count(None) == 2 and [i for i in ids if i is not None] == [1, 2, 4, 6, 7, 8]
    assert simhash.one_of_each(no_docs).count() == 0


def test_star_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (200, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
