"""Boosted and extremely randomised trees against slow versions."""

import math
import random

import numpy as np
import pytest

from limnospark.operators import trees as TR

FEATS = ["a", "b", "c"]


def frame(spark, n=400, seed=0, missing=0.1, parts=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), float(rng.randrange(6)), rng.gauss(0, 1)
        y = 3 * a + (2 if b > 2 else 0) * (1 if c > 0 else -1) + rng.gauss(0, 0.2)
        rows.append((i, None if rng.random() < missing else a, b, c, y, math.exp(y / 3), float(y > 1), i % 4))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, pos double, hi double, fold int").repartition(parts)


def slow_boost(x, y, train, loss, rounds, depth, rate, l2, min_leaf):
    """Plain histogram boosting on bins, one model; scores of all rows."""
    grad, hess, begin, _ = TR.LOSSES[loss]
    s = np.full(len(x), begin(y[train].mean()))
    for _ in range(rounds):
        g, h = grad(s, y), hess(s, y)
        add = np.zeros(len(x))
        nodes = [(np.ones(len(x), bool), None)]
        for level in range(depth):
            kids = []
            for rows, value in nodes:
                own = rows & train
                best = None
                for f in range(x.shape[1]):
                    for cut in np.unique(x[own, f]):
                        if cut == TR.MISSING:
                            continue
                        for miss in ((False, True) if (x[own, f] == TR.MISSING).any() else (False,)):
                            left = np.where(x[:, f] == TR.MISSING, miss, x[:, f] <= cut)
                            L, R = own & left, own & ~left
                            if L.sum() < min_leaf or R.sum() < min_leaf:
                                continue
                            w = lambda k: g[k].sum() ** 2 / (h[k].sum() + l2)
                            gain = w(L) + w(R) - w(own)
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9 * abs(best[0])):
                                v = lambda k: -rate * g[k].sum() / (h[k].sum() + l2)
                                best = (gain, (rows & left, v(L)), (rows & ~left, v(R)))
                if best is None:
                    add[rows] = value or 0.0
                else:
                    kids += best[1:]
            nodes = kids
        for rows, value in nodes:
            add[rows] = value
        s = s + add
    return s


@pytest.mark.parametrize("loss,label", [("squared", "y"), ("poisson", "pos"), ("logistic", "hi")])
def test_boost_equals_slow_version(spark, loss, label, monkeypatch):
    monkeypatch.setattr(TR, "SAVE", 2)
    df = frame(spark)
    edges = TR.bin_edges(df, FEATS, 20)
    table = TR.prepare(df, FEATS, [label], "fold", ["id", label], edges)
    models = [TR.Model(0, f, (0, 1, 2)) for f in (0, 1)]
    how = dict(rounds=5, depth=3, rate=0.3, l2=0.5, min_leaf=10)
    _, scored = TR.boost(table, models, edges, 1, loss, **how)
    rows = sorted(scored.collect(), key=lambda r: r["id"])
    x = np.array([list(r["_b"]) for r in rows])
    y = np.array([r[label] for r in rows])
    fold = np.array([r["_fold"] for r in rows])
    for i, m in enumerate(models):
        want = slow_boost(x, y, fold != m.held, loss, **how)
        assert np.array([r["_s"][i] for r in rows]) == pytest.approx(want, abs=1e-5)


def test_bins(spark):
    df = frame(spark, missing=0.2)
    edges = TR.bin_edges(df, FEATS, 16)
    assert edges[1].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5] and len(edges[0]) == 15
    a = np.sort([r["a"] for r in df.collect() if r["a"] is not None])
    share = np.diff(np.searchsorted(a, np.concatenate([[-1], edges[0], [2]]), "right"))
    assert share.min() >= len(a) // 16 - 1 and share.max() <= len(a) // 16 + 1
    empty = df.where("false")
    assert [len(e) for e in TR.bin_edges(empty, FEATS)] == [0, 0, 0]


def test_same_on_any_partitioning(spark):
    got = []
    for parts in (1, 7):
        df = frame(spark, 600, parts=parts)
        b = TR.boosted_oof(df, FEATS, "pos", "fold", [0, 1, 2, 3], ["id"], loss="poisson", rounds=4, depth=3, min_leaf=5)
        e = TR.extra_trees_oof(df.fillna(0.0), FEATS, "y", "fold", [0, 1, 2, 3], ["id"], trees=5, depth=4)
        got.append([sorted((r["id"], r["pred"]) for r in x.collect()) for x in (b, e)])
    assert got[0] == got[1]


def test_jobs_do_not_grow_with_folds(spark):
    df = frame(spark, 200)
    edges = TR.bin_edges(df, FEATS)
    table = TR.prepare(df, FEATS, ["y"], "fold", ["id"], edges)
    raw = TR.prepare(df.fillna(0.0), FEATS, ["y"], "fold", ["id"])
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    for what, run in (("boost", lambda m: TR.boost(table, m, edges, 1, rounds=3, depth=2, min_leaf=5)), ("extra", lambda m: TR.extra_trees(raw, m, 3, 1, trees=3, depth=2))):
        few = jobs(f"{what}-1", lambda: run([TR.Model(0, 0, (0, 1, 2))]))
        many = jobs(f"{what}-4", lambda: run([TR.Model(0, f, (0, 1, 2)) for f in range(4)]))
        assert few == many > 0


def slow_extra(x, y, seed, model, tree, depth, min_leaf, k):
    """One extremely randomised tree, by recursion; its prediction of x."""
    out = np.zeros(len(x))

    def grow(rows, path, level):
        out[rows] = y[rows].mean()
        if level == depth or len(rows) < 2 * min_leaf:
            return
        v = x[rows]
        ids = (np.array([model]), np.array([tree]), np.array([path]))
        rank, u = ([TR.uniform(seed, *ids, np.array([f]), np.array([s]))[0] for f in range(x.shape[1])] for s in (0, 1))
        usable = [f for f in sorted(range(x.shape[1]), key=lambda f: rank[f]) if v[:, f].max() > v[:, f].min()][:k]
        best = None
        for f in usable:
            cut = v[:, f].min() + u[f] * (v[:, f].max() - v[:, f].min())
            left = v[:, f] <= cut
            n = left.sum()
            if n >= min_leaf and len(rows) - n >= min_leaf:
                worth = y[rows][left].sum() ** 2 / n + y[rows][~left].sum() ** 2 / (len(rows) - n) - y[rows].sum() ** 2 / len(rows)
                if worth > 1e-12 and (best is None or worth > best[0]):
                    best = (worth, rows[left], rows[~left])
        if best:
            grow(best[1], 2 * path, level + 1)
            grow(best[2], 2 * path + 1, level + 1)

    grow(np.arange(len(x)), 1, 0)
    return out


def test_extra_trees_equal_slow_version(spark, monkeypatch):
    monkeypatch.setattr(TR, "GROUP", 2)
    monkeypatch.setattr(TR, "CHUNK", 50)
    df = frame(spark, 300, missing=0.0)
    table = TR.prepare(df, FEATS, ["y", "pos"], None, ["id"])
    models = [TR.Model(0, None, (0, 1, 2)), TR.Model(1, None, (0, 1, 2))]
    grown = TR.extra_trees(table, models, 3, 2, trees=3, depth=5, min_leaf=4, max_features=2, seed=9)
    rows = sorted(df.collect(), key=lambda r: r["id"])
    x = np.array([[r[f] for f in FEATS] for r in rows])
    for i, label in enumerate(("y", "pos")):
        y = np.array([r[label] for r in rows])
        want = np.mean([slow_extra(x, y, 9, i, t, 5, 4, 2) for t in range(3)], axis=0)
        got = {r["id"]: r["p"] for r in TR.predict_trees(table, grown, ["id"], {"p": [i]}).collect()}
        assert [got[r["id"]] for r in rows] == pytest.approx(want, abs=1e-6)
    assert TR.importance(grown.forest, 3, 3).sum() == pytest.approx(1.0)


def test_thresholds_are_uniform():
    n = 200_000
    u = TR.uniform(5, np.arange(n), np.zeros(1), np.ones(1))
    assert u.min() >= 0 and u.max() < 1
    lo, hi = np.full(n, -2.0), np.full(n, 3.0)
    cut = TR.drawn(lo, hi, u)
    assert (cut >= lo).all() and (cut < hi).all()
    counts = np.histogram(cut, 100, (-2, 3))[0]
    assert ((counts - n / 100) ** 2 / (n / 100)).sum() < 150  # chi square, 99 degrees: 99.9 % below 148
    assert abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
    tiny = np.nextafter(1.0, 2)
    assert TR.drawn(np.ones(1), np.array([tiny]), np.array([0.9]))[0] == 1.0


def r2(rows, label):
    y, p = (np.array([r[c] for r in rows]) for c in (label, "pred"))
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_learns_a_known_function(spark):
    df = frame(spark, 3000, missing=0.0)
    folds = [0, 1, 2, 3]
    e = TR.extra_trees_oof(df, FEATS, "y", "fold", folds, ["id"], trees=20, depth=8, max_features=3).collect()
    b = TR.boosted_oof(df, FEATS, "y", "fold", folds, ["id"], rounds=25, depth=3, rate=0.2).collect()
    p = TR.boosted_oof(df, FEATS, "pos", "fold", folds, ["id"], loss="poisson", rounds=25, depth=3, rate=0.2).collect()
    assert len(e) == len(b) == 3000 and r2(e, "y") > 0.9 and r2(b, "y") > 0.9 and r2(p, "pos") > 0.9
    assert min(r["pred"] for r in p) > 0


def test_odd_rows(spark):
    rows = [(i, [None, float("nan"), 1.0, 2.0][i % 4], float(i % 5), 1.0, None if i % 7 == 0 else float(i % 3), None if i % 11 == 0 else i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int")
    for got in (TR.boosted_oof(df, FEATS, "y", "fold", [0, 1], ["id"], rounds=2, depth=2, min_leaf=3).collect(),
                TR.extra_trees_oof(df, FEATS, "y", "fold", [0, 1], ["id"], trees=2, depth=2).collect()):
        assert len(got) == 120
        assert all((r["pred"] is None) == (r["fold"] is None) for r in got)
    none = df.where("false")
    assert TR.boosted_oof(none, FEATS, "y", "fold", [0, 1], ["id"], rounds=2, depth=2).count() == 0
    assert TR.extra_trees_oof(none, FEATS, "y", "fold", [0, 1], ["id"], trees=2, depth=2).count() == 0


def test_two_stage(spark):
    df = frame(spark, 800, missing=0.0)
    rows = TR.two_stage_oof(df, FEATS, "pos", "fold", [0, 1, 2, 3], ["id"], {"pred": 0.75, "low": 0.5},
                            boosting=dict(rounds=5, depth=2), forest=dict(trees=8, depth=6, max_features=4)).collect()
    assert len(rows) == 800 and min(min(r["pred"], r["low"]) for r in rows) >= 0
    y, p, q = (np.array([r[c] for r in rows]) for c in ("pos", "pred", "low"))
    assert np.corrcoef(y, p)[0, 1] > 0.9 and np.corrcoef(y, q)[0, 1] > 0.9 and (p != q).any()
    assert TR.two_stage_oof(df.where("false"), FEATS, "pos", "fold", [0, 1], ["id"], {"pred": 0.75}, boosting=dict(rounds=1), forest=dict(trees=1)).count() == 0


def test_passes_read_blocks(spark):
    """The passes read a row per block; missing values, negative zero and
    values at a cut go the way that single rows go."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 3)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:4, 0] = [0.0, -0.0, np.inf, -np.inf]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(i % 7), i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int").coalesce(2)
    table = TR.prepare(df, ["a", "b", "c"], ["y"], "fold", ["id"])
    blocks = TR.packed(table, 3, 1)
    assert blocks.count() <= 2
    forest = TR.Forest()
    root = int(forest.add(1)[0])
    kids = forest.split(np.array([root]), np.array([0]), np.array([0.0]), np.ones(1))
    forest.split(np.array([kids[0], kids[0] + 1]), np.array([1, 2]), np.array([-0.3, 0.7]), np.ones(2))
    for blk in TR.opened(iter(blocks.toArrow().to_batches()), 3, 1):
        plain = np.stack([np.where(c == TR.ABSENT, np.nan, np.append(v, 0)[np.minimum(c, len(v))]) for c, v in zip(blk.x, blk.values)], axis=1)
        grown = TR._Grown(forest, root, np.arange(3, 7), np.arange(4))
        assert grown.walk(blk.x, blk.values, np.arange(len(plain))).tolist() == (forest.walk(plain, root, False) - 3).tolist()


def test_leaves_of_bins_as_row_by_row():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (400, 2)).astype(np.uint8)
    forest = TR.Forest()
    root = int(forest.add(1)[0])
    kids = forest.split(np.array([root]), np.array([1]), np.array([100]), np.ones(1), np.array([True]))
    forest.split(kids + 1, np.array([0]), np.array([31]), np.ones(1))
    at, leaves = forest.leaves(np.ascontiguousarray(x.T), root)
    assert leaves[at].tolist() == forest.walk(x, root, True).tolist()
    assert forest.leaves(np.ascontiguousarray(x.T), int(kids[0]))[0].tolist() == [0] * 400


def test_one_pass_a_level(spark):
    """A level's sides and the next level's ends come from one pass."""
    raw = TR.prepare(frame(spark, 300, missing=0.0), FEATS, ["y"], "fold", ["id"])
    tracker = spark.sparkContext.statusTracker()

    def jobs(depth):
        name = f"depth-{depth}"
        spark.sparkContext.setJobGroup(name, name)
        TR.extra_trees(raw, [TR.Model(0, f, (0, 1, 2)) for f in (0, 1)], 3, 1, trees=3, depth=depth, min_leaf=2)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    one, three = jobs(1), jobs(3)
    assert three - one <= 2 * 2  # a pass is two jobs: its parts, and their sums


def test_ends_of_parts_without_values(spark):
    """Missing values go right and are no ends; a part may hold none."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:300, 0] = np.nan
    x[:, 2] = np.where(x[:, 1] > 0, np.nan, x[:, 2])
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(r[1] > 0) + 0.1 * i % 3, i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int").coalesce(2)
    table = TR.prepare(df, ["a", "b", "c"], ["y"], "fold", ["id"])
    m = [TR.Model(0, None, (2, 0, 1))]
    grown = TR.extra_trees(table, m, 3, 1, trees=4, depth=7, min_leaf=2, max_features=3)
    y = np.array([r[4] for r in rows])
    for root in grown.roots[0]:
        at = grown.forest.walk(x, root, False)
        for leaf in np.unique(at):
            assert grown.forest.value[leaf] == pytest.approx(y[at == leaf].mean(), abs=1e-6)
        one = TR._Grown(grown.forest, root, np.zeros(0, int), np.zeros(0, int))
        assert one.value[one.leaf(np.ascontiguousarray(x.T), np.arange(400))].tolist() == grown.forest.value[at].tolist()
        assert one.steps > TR.TOP
