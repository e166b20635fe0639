"""Model operators on small frames: known answers, leakage, guards."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.operators import evaluate as EV
from limnospark.operators import models as M


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(300):
        a, b, c = r.gauss(0, 1), r.gauss(5, 2), r.uniform(-1, 1)
        out.append((i, i % 3, i % 40, a, b, c, 3 * a - 2 * b + 0.5 * c + r.gauss(0, 0.1) + 40))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, fold int, grp int, a double, b double, c double, y double").cache()


FEATS = ["a", "b", "c"]


def test_ridge_from_sums(frame, rows):
    x, y = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows])
    w, b = M.ridge_fit(sum(M.gram_by_fold(frame, FEATS, "y", "fold").values()), 7.0)
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 7.0 * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(w, want) and abs(b - (y.mean() - want @ x.mean(0))) < 1e-8
    g = M.gram_by_fold(frame, FEATS, "y")[0]
    assert abs(M.squared_error(g, w, b) - ((y - x @ w - b) ** 2).sum()) < 1e-6


def test_elastic_net_is_optimal(frame, rows):
    g = M.gram_by_fold(frame, FEATS, "y")[0]
    x, y = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows])
    dev, lam, l1 = x.std(0), 0.3, 0.5
    w, b = M.elastic_net_fit(g, lam, l1)
    u = w * dev

    def cost(u, b):
        e = y - x @ (u / dev) - b
        return (e @ e) / (2 * len(y)) + lam * (l1 * np.abs(u).sum() + (1 - l1) / 2 * (u @ u))

    base = cost(u, b)
    rng = np.random.default_rng(0)
    assert all(cost(u + rng.normal(scale=1e-2, size=3), b + rng.normal(scale=1e-2)) >= base - 1e-9 for _ in range(200))
    assert M.elastic_net_fit(g, 1e6, 1.0)[0].tolist() == [0.0, 0.0, 0.0]


def test_one_pass_folds_equal_fold_loop(frame, rows):
    p = M.linear_cv_predictions(frame, FEATS, "y", "fold", ["id"], {"pred": M.ridge(1.0), "best": M.ridge_cv()}).collect()
    for f in range(3):
        tr = [r for r in rows if r[1] != f]
        x, y = np.array([r[3:6] for r in tr]), np.array([r[6] for r in tr])
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
        for r in p:
            if r["fold"] == f:
                v = np.array(rows[r["id"]][3:6])
                assert abs(r["pred"] - (v @ w + y.mean() - w @ x.mean(0))) < 1e-8
    s = EV.fold_scores(frame.join(M.linear_cv_predictions(frame, FEATS, "y", "fold", ["id"], {"best": M.ridge_cv()}).select("id", "best"), "id"), "y", "best", "fold")
    assert all(r["r2"] > 0.99 for r in s.collect())


def test_fold_scores(frame, rows):
    got = {r["fold"]: r for r in EV.fold_scores(frame.withColumn("p", F.col("y") + F.col("c")), "y", "p", "fold").collect()}
    for f, r in got.items():
        y, e = np.array([x[6] for x in rows if x[1] == f]), np.array([x[5] for x in rows if x[1] == f])
        assert abs(r["r2"] - (1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
        assert abs(r["rmse"] - np.sqrt((e ** 2).mean())) < 1e-9 and r["n"] == len(y)


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_held_out_targets_do_not_leak(frame, kind):
    def predict(df):
        if kind == "linear":
            p = M.linear_cv_predictions(df, FEATS, "y", "fold", ["id"], {"pred": M.ridge_cv()})
        else:
            p = M.fit_predict(df.where("fold != 1"), df.where("fold = 1"), FEATS, "y", M.extra_trees(4, 3))[1]
        return {r["id"]: r["pred"] for r in p.collect() if r["fold"] == 1}

    other = frame.withColumn("y", F.when(F.col("fold") == 1, F.col("y") * -7 + 1000).otherwise(F.col("y")))
    a, b = predict(frame), predict(other)
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_gaps_take_the_training_median(spark, frame):
    holes = frame.withColumn("a", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("a")))
    assert M.missing(holes, FEATS) == ["a"] and M.missing(frame, FEATS) == []
    p = M.cv_predictions(holes, FEATS, "y", "fold", [0, 1, 2], M.elastic_net(0.0, 0.0), ["id"]).collect()
    assert len(p) == 300 and all(np.isfinite(r["pred"]) for r in p)


def test_routes_and_clip(frame):
    d = frame.withColumn("gate", F.when(F.col("id") % 10 == 9, None).otherwise(F.col("b") > 8)).withColumn("y", F.col("y") - 45)
    tr, te = d.where("fold != 0"), d.where("fold = 0")
    out = M.gated_experts(tr, te, FEATS, "y", "gate", M.random_forest(3, 3), "fold", "grp", {"min_rows": 60, "min_fold": 10, "min_groups": 5}).collect()
    want = {True: "fallback_global_high", False: "expert_low", None: "global"}
    assert len(out) == 100 and all(r["route"] == want[r["gate"]] and r["pred"] >= 0 for r in out)
    none = M.gated_experts(tr.where("gate is null or not gate"), te, FEATS, "y", "gate", M.random_forest(3, 3), "fold", "grp",
                           {"min_rows": 1, "min_fold": 1, "min_groups": 1})
    assert {r["route"] for r in none.where("gate").collect()} <= {"fallback_global_high"}


def test_branch_support_reasons(frame):
    d = frame.withColumn("gate", (F.col("fold") == 2) & (F.col("id") < 60))
    got = {r["branch"]: r for r in M.branch_support(d, "gate", "fold", "grp", 3, min_rows=50, min_fold=10, min_groups=30).collect()}
    assert got[True]["reasons"] == "missing_fold;too_few_rows;thin_fold;too_few_groups" and not got[True]["supported"]
    assert got[False]["supported"]


def test_two_stage_is_clipped(frame):
    d = frame.withColumn("y", F.col("y") - 30).withColumn("q", F.lit(5.0))
    out = M.two_stage(d.where("fold != 0"), d.where("fold = 0"), FEATS, "y", "q").collect()
    assert len(out) == 100 and min(r["pred"] for r in out) >= 0.0 and max(r["pred"] for r in out) > 0


def test_replayed_batch_is_written_once(spark, tmp_path):
    from limnospark.streaming import append_each_batch

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(src)
    for name in ("one", "two"):  # a second checkpoint runs batch 0 again
        s = spark.readStream.schema("id long").parquet(src)
        append_each_batch(s, lambda b: b.where("id > 3"), out, f"{uuid.uuid4().hex}-{name}").awaitTermination(120)
    assert spark.read.parquet(out).count() == 6


def test_random_configurations_follow_the_seed():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    first = M.random_configs(space, 20, seed=5)
    assert first == M.random_configs(space, 20, seed=5) != M.random_configs(space, 20, seed=6)
    assert len(first) == 20 and all(c["kind"] == "random" and c["a"] in space["a"] and c["b"] in space["b"] for c in first)
    assert len({(c["a"], c["b"]) for c in first}) > 2
    grid = M.grid_configs(space)
    assert len(grid) == 6 and len({(c["a"], c["b"]) for c in grid}) == 6


def test_large_offsets_keep_their_digits(spark, rows):
    """Values near 1e9 that differ by about 1: the fit is that of the small
    values."""
    far = spark.createDataFrame([(r[0], r[1], *[v + 1e9 for v in r[3:6]], r[6] - 1e9) for r in rows], "id long, fold int, a double, b double, c double, y double")
    x, y = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows])
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
    w, b = M.fit_linear(far, FEATS, "y", lambda g: M.ridge_fit(g, 1.0))
    assert np.allclose(w, want, atol=1e-5)
    p = M.linear_cv_predictions(far, FEATS, "y", "fold", ["id"], {"pred": M.ridge(1.0)}).collect()
    assert max(abs(r["pred"] - r["y"]) for r in p) < 1.0
