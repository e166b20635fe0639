"""Forests and boosted regression trees over 32 bins against slow versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.operators import forests as FR
from limnospark.operators import models as M
from limnospark.operators import trees as TE

FEATS = ["a", "b", "c"]


def rows_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.random(), float(rng.randrange(6)), rng.gauss(0, 1)
        out.append((i, a, b, c, 3 * a + (2 if b > 2 else 0) * (1 if c > 0 else -1) + rng.gauss(0, 0.2), i % 4))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int").repartition(parts)


def grown_slowly(x, y, w, edges, depth, value=None):
    """One tree on all features, eight rows a side, by recursion over the cuts
    between bins."""
    out = np.zeros(len(x))

    def grow(rows, level):
        n = w[rows].sum()
        out[rows] = (w[rows] * y[rows]).sum() / max(n, 1)
        best = None
        for f in range(x.shape[1] if level < depth else 0):
            for cut in edges[f]:
                left = x[rows, f] <= cut
                L, R = rows[left], rows[~left]
                if w[L].sum() < 8 or w[R].sum() < 8:
                    continue
                part = lambda k: (w[k] * y[k]).sum() ** 2 / w[k].sum()
                worth = part(L) + part(R) - part(rows)
                if worth > 1e-7 and (best is None or worth > best[0] * (1 + 1e-9)):
                    best = (worth, L, R)
        if best:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    grow(np.arange(len(x)), 0)
    return out


def test_trees_equal_slow_version(spark, monkeypatch):
    monkeypatch.setattr(TE, "CHUNK", 70)
    rows = rows_of(400)
    df = frame(spark, rows)
    x, y, fold = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    edges = TE.bin_edges(df, FEATS, FR.BINS)
    models = [TE.Model(0, f, (0, 1, 2)) for f in (None, 0, 2)]
    forest, boosted = FR.fit(df, FEATS, ["y"], "fold", [(FR.How(1, 7, False, min_leaf=8), models), (FR.How(3, 3, False, "all", rate=0.1, min_leaf=8), models)])
    for i, m in enumerate(models):
        w = (np.ones(400) if m.held is None else (fold != m.held)).astype(float)
        assert forest.predict(np.ascontiguousarray(x.T), i, {}) == pytest.approx(grown_slowly(x, y, w, edges, 7), abs=1e-5)
        want = np.zeros(400)
        for r in range(3):
            want += (0.1 if r else 1.0) * grown_slowly(x, 2 * (y - want) if r else y, w, edges, 3)
        assert boosted.predict(np.ascontiguousarray(x.T), i, {}) == pytest.approx(want, abs=1e-5)


def test_rows_are_drawn(spark):
    """Poisson of mean 1, other rows in each tree; alike rows are drawn apart."""
    ident = np.random.default_rng(1).integers(0, 1 << 32, 200_000).astype(np.uint64)
    one, two = (FR.taken(ident, k).astype(float) for k in (0x1234567890ABCDEF, 0x0FEDCBA987654321))
    assert abs(one.mean() - 1) < 0.01 and abs(one.var() - 1) < 0.02 and abs((one == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.01
    same = spark.createDataFrame([(1.0, 2.0)] * 500, "a double, y double").coalesce(1)
    rows = same.select(F.array("a").alias("_x"), F.array("y").alias("_y"), F.lit(0).alias("_fold"), F.xxhash64("a", "y").alias("_id"))
    blk = FR.packed(rows, [np.array([1.5])], 1).collect()
    assert len(np.unique(np.concatenate([np.frombuffer(b["id"], np.uint32) for b in blk]))) == 500


def test_forest_on_any_partitioning(spark):
    rows, got = rows_of(600, 1), []
    for parts in (1, 7):
        p = M.cv_predictions(frame(spark, rows, parts), FEATS, "y", "fold", [0, 1, 2, 3], M.random_forest(8, 6), ["id"]).collect()
        got.append(sorted((r["id"], r["pred"]) for r in p))
    assert got[0] == got[1] and len(got[0]) == 600
    y, p = np.array([r[4] for r in rows]), np.array([v for _, v in got[0]])
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.85


def test_folds_grow_in_the_same_passes(spark):
    """Jobs do not follow the number of folds, and nothing is cached."""
    df = frame(spark, rows_of(200)).cache()
    df.count()
    tracker, held = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.getPersistentRDDs().size()

    def jobs(folds):
        name = f"folds-{folds}"
        spark.sparkContext.setJobGroup(name, name)
        M.cv_predictions(df, FEATS, "y", "fold", list(range(folds)), M.random_forest(3, 3), ["id"])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs(2) == jobs(4) > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_gaps_take_the_folds_own_medians(spark):
    """With gaps all folds still share their passes, each with its medians."""
    rows = [(i, None if i % 5 == 0 else float(i % 50) + 100 * (i % 4), 1.0, float(i % 3), float(i % 7), i % 4) for i in range(400)]
    df = frame(spark, rows, 2)
    got, cols, groves = M.fold_fits(df, FEATS, "fold", [0, 1, 2, 3], {"p": (M.random_forest(2, 3), "y")})
    assert cols == ["b", "c", *[f"_filled{f}_a" for f in range(4)]]
    for r in got.collect():
        if r["a"] is None:
            for f in range(4):
                own = sorted(v[1] for v in rows if v[1] is not None and v[5] != f)
                assert own[len(own) // 2 - 1] <= r[f"_filled{f}_a"] <= own[len(own) // 2]
    p = M.cv_predictions(df, FEATS, "y", "fold", [0, 1, 2, 3], M.random_forest(2, 3), ["id"]).collect()
    assert len(p) == 400 and all(np.isfinite(r["pred"]) for r in p)


def test_odd_rows(spark):
    rows = [(i, float(i % 3), 0.0, None, float(i % 5), None if i % 11 == 0 else i % 2) for i in range(90)]
    df = frame(spark, rows).withColumn("c", F.lit(1.0))
    p = M.cv_predictions(df, FEATS, "y", "fold", [0, 1], M.random_forest(2, 2), ["id"]).collect()
    assert len(p) == 90 and all((r["pred"] is None) == (r["fold"] is None) for r in p)
    m, out = M.fit_predict(df.where("fold = 0"), df, FEATS, "y", M.gbt(2, 2))
    assert all(np.isfinite(r["pred"]) for r in out.collect())
    gone = df.withColumn("y", F.when(F.col("id") % 7 != 0, F.col("y")))
    with pytest.raises(Exception, match="labels of training rows"):
        M.fit_predict(gone, df, FEATS, "y", M.random_forest(2, 2))
    assert M.fit_predict(gone.where("y is not null"), gone, FEATS, "y", M.random_forest(2, 2))[1].count() == 90


def test_scratch_tables_go(spark):
    """What is made inside goes at the end, also after an error; kept ones stay."""
    import os

    from limnospark.session import cut_lineage, kept, scratch

    at = lambda t: os.path.exists(t._limno_table.removeprefix("file://"))
    before = cut_lineage(spark.range(3))
    with scratch(spark):
        with scratch(spark):
            inner = cut_lineage(spark.range(4))
            stays = kept(cut_lineage(spark.range(5)))
        outer = cut_lineage(spark.range(6))
        assert not at(inner) and at(outer) and at(stays)
    assert at(before) and at(stays) and not at(outer) and stays.count() == 5
    with pytest.raises(ValueError):
        with scratch(spark):
            lost = cut_lineage(spark.range(7))
            raise ValueError
    assert not at(lost)


def test_a_label_per_fold(spark):
    """The residual of the model that does not see the fold is fitted."""
    rows = rows_of(300, 2)
    df = frame(spark, rows).withColumns({f"r{i}": F.col("y") * (i + 1) for i in range(4)})
    got, cols, fits = M.fold_fits(df, FEATS, "fold", [0, 1, 2, 3], {"p": (M.extra_trees(2, 4), {i: f"r{i}" for i in range(4)})})
    x = np.ascontiguousarray(np.array([r[1:4] for r in rows]).T)
    y, fold = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    for i in range(4):
        p = fits["p"].predict(x, i, {})
        assert np.corrcoef(p[fold != i], y[fold != i])[0, 1] > 0.8
        assert p[fold != i].mean() == pytest.approx((i + 1) * y[fold != i].mean(), abs=1e-5)
    own = {r["id"]: r["p"] for r in M.own_folds(df, FEATS, "fold", [0, 1, 2, 3], {"p": (M.extra_trees(2, 4), {i: f"r{i}" for i in range(4)})}).collect()}
    assert [own[r[0]] for r in rows] == pytest.approx([fits["p"].predict(x, r[5], {})[k] for k, r in enumerate(rows)], abs=1e-9)
