"""Op 13: assignments against brute force, whole codes, odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from limnospark.llm import laesa, queries


def slow(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, label, vector) rows -> sorted result rows, in plain Python."""
    kept = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for *_, v in kept if v and len(v) % parts == 0)
    if not sizes:
        return []
    d = min(sizes, key=lambda k: (-sizes[k], k))
    kept = sorted((r for r in kept if len(r[2]) == d), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = d // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x[i] for x in own[k]) // len(own[k]) for i in range(w)) if own[k] else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    total = defaultdict(int)
    for (_, lab, _), f in zip(kept, found):
        total[lab] += sum(x[0] for x in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(x[0] for x in f), total[lab], sha) for (i, lab, _), f in zip(kept, found)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_assign_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    for spread, least in ((400, 0.5), (3, 0.0)):  # with a small spread many distances are equal
        x = rng.integers(-spread, spread, (3000, 4))
        book = rng.integers(-spread, spread, (64, 4))
        book[9] = book[3]
        pivots = laesa.far_apart(book, 4)
        own, best, done = laesa.assign(x, laesa.to_pivots(x, pivots).astype(np.float32), pivots, book)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        assert done <= (1 - least) * d.size
    big = rng.integers(-laesa.TOP, laesa.TOP, (500, 4))
    own, best, _ = laesa.assign(big, laesa.to_pivots(big, big[:4]).astype(np.float32), big[:4], big[:64])
    d = ((big[:, None] - big[None, :64]) ** 2).sum(2)
    assert (own == d.argmin(1)).all() and (best == d.min(1)).all()


def test_query_equals_slow_version(spark, small_dir):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_laesa(spark, small_dir)) == slow(rows)


def test_odd_rows(spark, crowded, monkeypatch):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i) if i < 60 else None, ["a", "b", None][i % 3], [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(70)]
    rows += [(3, "hot", [0.5] * 8)] * 50 + [rows[5]] * 3
    rows += [(900, "a", None), (901, "a", [nan] + [1.0] * 7), (902, "a", [inf] + [1.0] * 7), (903, "a", [None] + [1.0] * 7),
             (904, "a", [-inf] + [1.0] * 7), (905, "zero", [0.0] * 8), (906, "short", [1.0] * 4), (907, "odd", [1.0] * 7), (908, "none", []), (-4, "a", [-0.001] * 8)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([r for r in rows], f"vec_id long, label string, embedding array<{kind}>")
        exact = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, lab, v in rows]
        want = slow(exact, parts=4, entries=7)
        got = rows_of(laesa.encode(crowded(df), parts=4, entries=7))
        assert got == want and len(got) == len(rows) - 8
    # Labels joined instead of sent, frequent ones sent.
    monkeypatch.setattr(laesa, "FEW", 1)
    assert rows_of(laesa.encode(df, parts=4, entries=7)) == want
    assert rows_of(laesa.encode(df.where("vec_id < 2"), parts=4, entries=7)) == slow([r for r in exact if r[0] is not None and r[0] < 2], parts=4, entries=7)
    assert laesa.encode(df.where("false")).count() == 0
    assert laesa.encode(df.where("vec_id >= 900 and vec_id < 905"), parts=4).count() == 0


def test_too_many_entries(spark):
    with pytest.raises(ValueError):
        laesa.encode(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), entries=300)
