"""Kriging by conjugate gradients against the dense solve; block sizes;
choice of the kernel; odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.operators import kriging as KR


def places(spark, n=1000, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.random(), rng.random(), rng.gauss(0, 1), i % 3) for i in range(n)]
    rows += [(n, 0.0, 0.0, 0.5, 0), (n + 1, 1.0, 1.0, -0.5, 1)]
    return spark.createDataFrame(rows, "id long, x double, y double, r double, fold int"), rows


def test_equals_the_dense_solve(spark):
    df, rows = places(spark)
    kernel = KR.Kernel(0.05, 0.5)
    df = df.withColumns({f"r{f}": F.when(F.col("fold") != f, F.col("r")) for f in range(2)})
    out, _, took = KR.krige(df, "id", "x", "y", ["r0", "r1"], ["k0", "k1"], [kernel, KR.Kernel(0.03, 1.0)], reach=6.0, tolerance=1e-10)
    got = {r["id"]: (r["k0"], r["k1"]) for r in out.collect()}
    a = np.array(rows)
    for f, k in ((0, kernel), (1, KR.Kernel(0.03, 1.0))):
        own = a[a[:, 4] != f]
        m, s = own[:, 3].mean(), own[:, 3].std()
        K = KR.gauss(own[:, 1], own[:, 2], own[:, 1], own[:, 2], k.length, 6.0) + k.noise * np.eye(len(own))
        w = np.linalg.solve(K, (own[:, 3] - m) / s)
        want = KR.gauss(a[:, 1], a[:, 2], own[:, 1], own[:, 2], k.length, 6.0) @ w * s + m
        assert max(abs(got[int(r[0])][f] - v) for r, v in zip(a, want)) < 1e-8
    assert took < 200


def test_blocks_stay_small_where_places_are_dense(spark):
    sizes = []
    for n in (500, 5000):
        rng = random.Random(1)
        df = spark.createDataFrame([(rng.gauss(0.5, 0.01), rng.gauss(0.5, 0.01), [0.0], [1.0]) for _ in range(n)], "_x double, _y double, _r array<double>, _m array<double>")
        b = KR.blocks_of(df, 0.5, {"r": "_r", "m": "_m"})
        sizes.append(b.agg(F.max(F.size("x")), F.sum(F.size("x")), F.count("*")).first())
        assert b.where(F.size("r") != F.size("x")).count() == 0
    assert all(s[0] <= KR.BLOCK for s in sizes) and [s[1] for s in sizes] == [500, 5000] and sizes[1][2] > 5 * sizes[0][2]


def test_chooses_the_kernel_that_made_the_field():
    rng = np.random.default_rng(3)
    x, y = rng.random((2, 600))
    for length, noise in ((0.05, 1e-3), (0.4, 1e-1)):
        K = KR.gauss(x, y, x, y, length, 100.0) + noise * np.eye(600)
        r = np.linalg.cholesky(K + 1e-9 * np.eye(600)) @ rng.normal(size=600)
        assert KR.choose(x, y, r, np.ones(600), reach=100.0).length == length


def test_repeated_places_are_one_with_their_number(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 3.0), (3, 1.0, 1.0, 0.0), (4, 0.02, 0.0, None), (5, None, 1.0, 2.0)], "id long, x double, y double, r double")
    k = KR.Kernel(0.1, 0.5)
    out, _, _ = KR.krige(df, "id", "x", "y", ["r"], ["k"], [k])
    got = {r["id"]: r["k"] for r in out.collect()}
    m, s = np.mean([1, 3, 0]), np.std([1, 3, 0])
    x = np.array([0, 0, 1.0])
    K = KR.gauss(x, x, x, x, 0.1, KR.REACH) + 0.5 * np.eye(3)
    want = KR.gauss(np.array([0, 0.02]), np.array([0, 0.0]), x, x, 0.1, KR.REACH) @ np.linalg.solve(K, (np.array([1, 3, 0]) - m) / s) * s + m
    assert got[1] == got[2] == pytest.approx(want[0]) and got[4] == pytest.approx(want[1]) and got[5] == 0.0
    assert KR.krige(df.where("false"), "id", "x", "y", ["r"], ["k"])[0].count() == 0
    assert [r["k"] for r in KR.krige(df.withColumn("r", F.lit(None).cast("double")), "id", "x", "y", ["r"], ["k"])[0].collect()] == [0.0] * 5


def test_a_step_writes_one_table(spark, monkeypatch):
    """A solver step is one pass over the blocks; blocks that nothing reaches
    keep their rows."""
    written, real = [], KR.materialize
    monkeypatch.setattr(KR, "materialize", lambda df, label: written.append(label) or real(df, label))
    df, _ = places(spark, 300, seed=3)
    df = df.unionByName(spark.createDataFrame([(9000, 40.0, 40.0, None, 0)], df.schema))
    out, _, took = KR.krige(df, "id", "x", "y", ["r"], ["k"], [KR.Kernel(0.01, 0.5)], reach=2.0, tolerance=1e-6)
    assert took > 2
    assert written.count("krige") <= took + 2
    got = {r["id"]: r["k"] for r in out.collect()}
    mean = df.agg(F.avg("r")).first()[0]
    assert len(got) == 303 and abs(got[9000] - mean) < 1e-12
