"""Op 2: the merge against brute force, and the whole operator."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from limnospark.llm import bwt, repeats, suffix_dedup
from limnospark.llm.common import load


def covered(texts):
    counts = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        c = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i:i + 200]] > 1:
                c[i:i + 200] = b"\1" * 200
        out.append(bytes(c))
    return out


def expect(texts):
    out = []
    for t, c in zip(texts, covered(texts)):
        kept = bytes(x for x, y in zip(t, c) if not y)
        out.append((len(t), sum(c), sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_merged_transforms():
    r = random.Random(1)
    for _ in range(150):
        depth = r.randint(1, 9)
        strings = [np.array([r.randint(1, 3) for _ in range(r.randint(depth, 25))], np.uint16) for _ in range(r.randint(1, 12))]
        if r.random() < 0.3:
            strings.append(strings[0].copy())
        windows = [r.randint(1, len(s) - depth + 1) for s in strings]
        weights = [r.choice([1, 1, 1, 2]) for _ in strings]
        count = Counter()
        for s, w, c in zip(strings, windows, weights):
            for i in range(w):
                count[tuple(s[i:i + depth])] += c
        want = [[count[tuple(s[i:i + depth])] > 1 for i in range(w)] for s, w in zip(strings, windows)]
        assert [x.tolist() for x in bwt.repeated(strings, windows, weights, depth, r.randint(1, 4))] == want


def test_common_prefixes():
    r = random.Random(2)
    strings = [np.array([r.randint(1, 2) for _ in range(12)], np.uint16) for _ in range(6)]
    text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.uint16)
    half = 3 * 13
    shards = [bwt.Shard(text[:half], np.arange(3, dtype=np.int32) * 13, np.full(3, 13, np.int32)),
              bwt.Shard(text[half:], np.arange(3, dtype=np.int32) * 13, np.full(3, 13, np.int32))]
    merged, common = bwt.merge(shards, 8)
    circle = [tuple(text[p // 13 * 13 + (p % 13 + k) % 13] for k in range(8)) for p in merged]
    assert circle == sorted(circle)
    for a, b, c in zip(circle, circle[1:], common[1:]):
        assert c == next((k for k in range(8) if a[k] != b[k]), 8)


def planted(seed, n=40):
    r = random.Random(seed)
    parts = [bytes(r.choice(b"abcd efgh") for _ in range(r.randint(150, 600))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = bytearray(b"".join(r.choice(parts)[r.randint(0, 90):] for _ in range(r.randint(0, 3))))
        for _ in range(r.randint(0, 3)):
            if t:
                t[r.randrange(len(t))] = ord("z")
        out.append(bytes(t))
    return out + [b"x" * 900, b"ab" * 300, out[0]]


def test_units_hold_every_window():
    powers = repeats.Powers()
    texts = planted(3)
    counts, cores, rows = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199)), Counter(), []
    for t in texts:
        at = 0
        for core, _, place in repeats.units(t, powers):
            first, distance, n = repeats.unplace(place)
            assert first == at
            at += n
            cores[core] += 1
            rows.append((core, t, first, n))
        assert at == max(0, len(t) - 199)
    for core, t, first, n in rows:
        assert cores[core] > 1 or all(counts[t[i:i + 200]] == 1 for i in range(first, first + n))


@pytest.mark.parametrize("most, batch, piece", [(30_000, 1 << 19, 1 << 21), (1, 1 << 19, 1 << 21), (30_000, 500, 300)])
def test_report_against_brute_force(spark, crowded, monkeypatch, most, batch, piece):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts = planted(4)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.report(crowded(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == expect(texts)


def test_given_table(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.report(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == expect([r["text"].encode() for r in rows])


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = sorted(tuple(r)[1:] for r in suffix_dedup.report(odd_docs).collect())
    assert got == sorted(expect([(r["text"] or "").encode() for r in rows]))
    assert suffix_dedup.report(no_docs).count() == 0


def test_clean(odd_docs, no_docs, crowded):
    table = crowded(odd_docs)
    got = suffix_dedup.clean(table)
    assert got.dtypes == table.dtypes
    rows = got.collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[1]["text"].startswith("the cat")
    assert "passage" not in by[6]["text"] and by[6]["text"].startswith("first") and by[6]["n_chars"] == len(by[6]["text"])
    assert by[4]["text"] == next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 4)
    assert len(rows) == odd_docs.count()  # nothing loses its whole text here
    assert suffix_dedup.clean(no_docs).count() == 0


def test_clean_drops_emptied_rows_and_keeps_characters_whole(spark):
    twin = "é" * 150
    docs = spark.createDataFrame([(1, twin), (2, twin), (3, "a" + twin + "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(docs).collect()}
    assert got == {3: "ab"}
