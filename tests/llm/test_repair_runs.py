"""Op 12: the grammar, runs against a definition by trial, digests, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from limnospark.llm import queries, repair_runs


def slow_runs(w):
    """Every (start, end, smallest period) by the definition."""
    out = set()
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.add((s, e, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    drop = {k for s, e, q in found for k in range(s + q, e)}
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(found), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def random_words(rng):
    kind = rng.randrange(5)
    n = rng.randrange(0, 90)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(30) for _ in range(n)]
    if kind == 2:
        return [7] * n
    out = []
    while len(out) < n:
        unit = [rng.randrange(4) for _ in range(rng.randrange(1, 8))]
        out += (unit * rng.randrange(1, 9))[:rng.randrange(1, 60)]
        out += [rng.randrange(100) for _ in range(rng.randrange(0, 4))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        flat = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = list(zip(*(x.tolist() for x in repair_runs.runs(flat, doc))))
        base, want = 0, []
        for d in docs:
            want += [(s + base, e + base, q) for s, e, q in slow_runs(d)]
            base += len(d)
        assert got == want, docs


def test_grammar_covers_and_repeats():
    rng = random.Random(3)
    docs = [random_words(rng) for _ in range(40)] + [[1, 2, 3, 4, 5] * 40]
    flat = np.array([x for d in docs for x in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    r = repair_runs.re_pair(flat, doc)
    assert (r.start < r.mid).all() and (r.mid < r.end).all() and (doc[r.start] == doc[r.end - 1]).all()
    for k in range(len(r.start)):  # a nonterminal's places all hold its words
        unit = flat[r.start[k]:r.end[k]]
        places = r.where[r.rule == k]
        assert r.start[k] in places
        assert all((flat[p:p + len(unit)] == unit).all() for p in places)
    spans = {(a, b) for k in range(len(r.start)) for a in r.where[r.rule == k].tolist() for b in [a + int(r.end[k] - r.start[k])]}
    ends = np.cumsum([len(d) for d in docs])
    assert all((e - len(d), e) in spans for d, e in zip(docs, ends.tolist()) if len(d) > 1)
    # Binary trees: a node per boundary, far fewer nonterminals than nodes in repeated text.
    assert len(r.where) == sum(max(len(d) - 1, 0) for d in docs)
    last = (r.start >= ends[-2])
    assert last.sum() < 60


def test_alike_fingerprints_are_seen():
    w = np.array([1, 2, 3, 4, 5, 6, 7, 8])
    with pytest.raises(ArithmeticError):
        repair_runs.verify(w, np.array([0]), np.array([8]), np.array([2]))


def test_long_same_words():
    w = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in repair_runs.runs(w, w)] == [[0], [200_000], [1]]
    w = np.tile(np.arange(1000), 120)
    assert [x.tolist() for x in repair_runs.runs(w, np.zeros(len(w), np.int64))] == [[0], [120_000], [1000]]


def test_report_equals_slow_version(spark, crowded, odd_docs):
    rows = [(i, " ".join(random.Random(i).choices(["a", "b", "c d", "é"], k=i % 70)) + "\x1c \t\x0b z" * (i % 9)) for i in range(-20, 250)]
    rows += [(None, "x " * 9), (3, None), (4, ""), (5, " \n\t "), (5, " \n\t "), (6, "q w " * 700), (None, None)]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, repair_runs.report(df, portion=4000).collect()), key=str)
    assert got == sorted((slow_row(k, t) for k, t in rows), key=str)
    whole = [tuple(r) for r in repair_runs.report(odd_docs).collect()]
    short = [r for r in odd_docs.select("doc_id", "text").collect() if len(r["text"] or "") < 9999]
    assert len(whole) == len(short) + 1
    assert sorted((r for r in whole if r[0] != 4), key=str) == sorted((slow_row(r["doc_id"], r["text"]) for r in short), key=str)
    assert repair_runs.report(df.where("false")).count() == 0


def test_query_equals_slow_version(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_repair_runs(spark, small_dir).collect()}
    assert len(got) == len(docs)
    short = [d for d in docs if len(d["text"] or "") < 6000]
    assert len(short) > 100
    for d in short:
        assert got[d["doc_id"]] == slow_row(d["doc_id"], d["text"])
