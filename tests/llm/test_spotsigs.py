"""Op 6: signatures, edited texts in key order, likeness."""

import hashlib

import numpy as np
import pytest

from limnospark.llm import spotsigs
from limnospark.llm.common import load


def test_signatures():
    a = spotsigs.signatures("The quick brown fox is on the lazy dog")
    # the -> quick brown, is -> lazy dog, on -> lazy dog, the -> lazy dog
    assert len(a) == 4 and (np.diff(a.astype(np.int64)) > 0).all()
    assert len(spotsigs.signatures("")) == 0
    assert len(spotsigs.signatures("alpha | beta | gamma")) == 3  # no anchor: every word is one
    assert (spotsigs.read(spotsigs.printed(a)) == a).all()


def test_likeness():
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)
    assert spotsigs.likeness(a, b) == 0.5 and spotsigs.likeness(a, a) == 1.0
    assert spotsigs.likeness(a[:0], b[:0]) == 1.0 and spotsigs.likeness(a, b[:0]) == 0.0


def expect(rows):
    """rows (doc_id, text) in the order of the query."""
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        new = t[:len(t) - k] + after[:k]
        own, sigs = set(spotsigs.signatures(t).tolist()), set(spotsigs.signatures(new).tolist())
        other = set(spotsigs.signatures(after).tolist())
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), like(own, sigs), like(own, other)))
    return out


def test_given_table(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.edit_check(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, n, sha, near, nxt in expect(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(near) and r["near_next"] == pytest.approx(nxt)
        prints.setdefault(dict(rows)[i], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 + np.mean([r["near_next"] for r in got.values()])


def test_odd_rows(spark, odd_docs, no_docs, crowded):
    got = spotsigs.edit_check(crowded(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    assert sorted(r["n_chars"] for r in got) == sorted(len(r["text"] or "") for r in odd_docs.collect())
    empty = [r for r in got if r["doc_id"] in (2, 3)]
    assert all(r["fingerprint"] == "" and r["edited_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    assert spotsigs.edit_check(no_docs).count() == 0
    one = spark.createDataFrame([(1, "the cat sat here")], "doc_id long, text string")
    assert spotsigs.edit_check(one).first()["near_next"] == 1.0  # its own follower


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(5000)]
    texts = []
    for i in range(60):
        w = list(rng.choice(words, 150))
        w[::3] = ["the"] * len(w[::3])
        texts.append(" ".join(w))
        if i % 3 == 0:
            w[1] = "changed"
            texts.append(" ".join(w))
        if i % 5 == 0:
            texts.append(texts[-1])
    texts += ["", "", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spotsigs.near_duplicates(docs, 0.8).collect()}
    sigs = [set(spotsigs.signatures(t).tolist()) for t in texts]
    like = lambda x, y: (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if like(sigs[i], sigs[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(root))
    distinct = {frozenset(s) for s in sigs}
    links = {s: sum(like(s, o) for o in distinct) - 1 for s in distinct}
    assert {i: n for i, (_, n) in got.items()} == {i: links[frozenset(s)] for i, s in enumerate(sigs)}
