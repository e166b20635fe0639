"""Ops 7 and 8: held-out accuracy, and the defined cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.llm import quality, toxicity
from limnospark.llm.common import load

SF = "/root/testdata/sf0.01"


def held(doc_id, k, r):
    return zlib.crc32(str(doc_id).encode()) % k == r


def scored(spark, classify, label, k, r):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    got = {x["doc_id"]: x for x in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    for x in got.values():
        assert 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) and x["held_out"] == held(x["doc_id"], k, r)
    pairs = [(got[x["doc_id"]], x[label]) for x in labels.collect()]
    return np.array([[p["score"], p["predicted"], y] for p, y in pairs if p["held_out"]])


def test_toxicity_held_out(spark):
    t = scored(spark, toxicity.classify, "toxic", 4, 2)
    assert (t[:, 1] == t[:, 2]).mean() > 0.9
    assert t[t[:, 2] == 1, 0].mean() > 0.3 + t[t[:, 2] == 0, 0].mean()


def test_quality_held_out(spark):
    t = scored(spark, quality.classify, "quality", 5, 0)
    assert (t[:, 1] == t[:, 2]).mean() > 0.95
    assert t[t[:, 2] == 1, 0].mean() > 0.3 + t[t[:, 2] == 0, 0].mean()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_are_never_read(spark, module, label):
    docs, labels = load(spark, "/root/testdata/sf0.001", "documents"), load(spark, "/root/testdata/sf0.001", "labels")
    k, r = (4, 2) if label == "toxic" else (5, 0)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == r
    other = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    a = {x["doc_id"]: x["score"] for x in module.classify(docs, labels).collect()}
    b = {x["doc_id"]: x["score"] for x in module.classify(docs, other).collect()}
    assert a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, odd_docs, no_docs, crowded, module, label):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (3, 0), (4, 0), (6, 1), (7, 0), (None, 1), (5, None), (8, 0), (8, 1), (9, 5)], f"doc_id long, {label} int")
    got = module.classify(crowded(odd_docs), crowded(labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1  # null and empty alike
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert module.classify(no_docs, labels).count() == 0
    for few in (labels.where("false"), labels.where(f"{label} = 1")):
        assert len({r["score"] for r in module.classify(odd_docs, few).collect()}) == 1


def test_clean_keeps_columns(spark, crowded):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    got = toxicity.clean(crowded(docs), labels)
    assert got.columns == crowded(docs).columns
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}


def test_ratio_of_unseen_features_is_zero():
    assert toxicity.log_ratio(np.array([0.0]), np.array([0.0]), 10, 90)[0] == pytest.approx(0)


def test_grams_are_distinct():
    g = toxicity.Grams(20, (4, 5, 6))
    found = g("abcabcabc  ABC")
    assert len(found) == len(set(found.tolist())) and len(g("")) == 0
    plain = " abcabcabc abc "
    assert len(found) == len({plain[i:i + n] for n in (4, 5, 6) for i in range(len(plain) - n + 1)})


def test_quality_learns_from_every_row(spark):
    """More rows than the old draw took: each one's vector reaches the model."""
    rng = np.random.default_rng(0)
    n = 24_000
    f = rng.normal(size=(n, quality.N_FEATURES)).astype(np.float32)
    y = (f[:, 0] + 0.5 * f[:, 1] + rng.normal(size=n) > 0).astype(int)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "doc_id long, f array<float>")
    told = lambda y: spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    m = quality.train(table, told(y))
    assert m.mean == pytest.approx(f.astype(float).mean(0), abs=1e-9) and m.scale == pytest.approx(f.astype(float).std(0), rel=1e-6)
    raw = np.sort(m.raw(f.astype(float)))
    assert m.cut == pytest.approx((raw[(y == 0).sum() - 1] + raw[(y == 0).sum()]) / 2, abs=1e-9)
    assert m.w[0] / m.w[1] == pytest.approx(2, rel=0.15) and np.abs(m.w[2:]).max() < 0.1
    # Partitioning does not matter.
    again = quality.train(table.repartition(3), told(y))
    assert again.w == pytest.approx(m.w, abs=1e-6)


@pytest.mark.parametrize("n, m", [(1, 5), (5, 1), (7, 20), (20, 7), (3, 3)])
def test_every_row_of_a_group_meets_another(n, m):
    good, bad = np.arange(1.0, n + 1)[:, None] * 1000, -np.arange(1.0, m + 1)[:, None]
    d, c = quality.pairs(good, bad, np.ones(n), np.ones(m))
    met = set(d[:, 0].astype(int).tolist())
    assert {x // 1000 for x in met} == set(range(1, n + 1)) and {x % 1000 for x in met} == set(range(1, m + 1))
    assert len(met) == len(d) == len(c) == max(n, m) * min(n, m, quality.MEETS)
