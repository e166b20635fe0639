"""Op 3: order of the walk, exact scores, recall, hot vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.llm import imi
from limnospark.llm.common import load


def exact(rows, q, n=20):
    best = [(-float(sum(np.float64(a) * np.float64(b) for a, b in zip(rows[q], v))), i) for i, v in rows.items() if i != q]
    return [(i, -s) for s, i in sorted(best)[:n]]


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    index = imi.Index(imi.kmeans(x[:, :4], 6, 1), imi.kmeans(np.column_stack([x[:, 4:], np.zeros(500)]), 6, 2), 4, 0.0)
    cells = index.cells(x)
    index.count({int(c): int(k) for c, k in zip(*np.unique(cells, return_counts=True))}, 50)
    q = rng.normal(size=8)
    order = index.walk(q, 1.0)
    assert sorted(order) == sorted(set(cells.tolist()))
    d = imi.distances(q[None, :4], index.first)[0][:, None] + imi.distances(np.append(q[4:], 0)[None], index.second)[0][None]
    assert (np.diff(d.ravel()[order]) >= -1e-12).all()
    some = index.walk(q, 0.3)
    assert order[:len(some)] == some and index.sizes[some].sum() >= 150 > index.sizes[some[:-1]].sum()


def test_recall_and_scores(spark):
    df = load(spark, "/root/testdata/sf0.01", "embeddings")
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    got = {}
    for r in imi.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(np.dot(np.float64(rows[q]), np.float64(rows[i]))), abs=1e-12) for _, i, s in found)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(found, found[1:]))
        want = {i for i, _ in exact(rows, q)}
        hit, total = hit + len(want & {f[1] for f in found}), total + len(want)
    assert hit / total >= 0.9


def test_odd_rows_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(imi, "BLOCK", 16)
    monkeypatch.setattr(imi, "GROUP", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))], "x") for i in range(100)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "hot") for i in range(60)]
    good = {i: v for i, v, _ in rows}
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, "x"), (1020, [0.0] * 6, "x"), (1040, [nan] + [1.0] * 5, "x"), (1060, [inf] + [1.0] * 5, "x"), (1080, [None] + [1.0] * 5, "x"),
             (1100, [1.0], "x"), (None, [1.0] * 6, "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = {}
    for r in imi.search(df, F.col("vec_id") % 20 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():  # every cell is walked: exact, ties to the smaller id
        want = exact(good, q)
        assert [i for i, _ in found] == [i for i, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-9)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = imi.search(df, F.col("vec_id") % 20 == 0, share=1.0).collect()
    assert {r["query_id"]: 0 for r in got} == {0: 0, 20: 0} and len(got) == 4
    assert imi.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert imi.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
