"""Property tests: equivalences that must hold on any data."""

import heapq
import random

import pytest

from pyspark.sql import functions as F

from limnospark.operators import encoding as EN
from limnospark.operators import folds as FO
from limnospark.operators import spatial as SP
from limnospark.operators import windows as W


def test_split_windows_equal_plain(spark):
    rnd = random.Random(3)
    rows = [(s, i, rnd.choice([None, 0.0, 0.05, 1.0, 7.5])) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "st long, i long, v double").withColumn("d", F.timestamp_seconds(F.col("i") * 3600))

    def run(split):
        s = W.series(df, ["st"], ["d", "i"], lookback=20, split_rows=split, carry_predicates={"wet": W.wet_predicate("v")})
        out = s.frame.select(*s.frame.columns, W.prior_sum(s, "v", 20).alias("a"), W.dry_spell_count(s, "v", 14).alias("b"),
                             W.dry_streak(s, "v", carry="wet").alias("c"), W.lag(s, "v", 7).alias("e"))
        return sorted(tuple(r) for r in s.finish(out).select("st", "i", "a", "b", "c", "e").collect())

    assert run(None) == run(7) == run(25)


def test_oof_subtraction_equals_fold_loop(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 6), rnd.randint(0, 4), None if i % 9 == 0 else float(rnd.randint(0, 100))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, cell long, fold long, y double")
    tr, _ = EN.oof_mean(df, None, ["cell"], "y", "fold", "te", "fold")
    got = {r["id"]: r["te"] for r in tr.collect()}
    for i, cell, fold, _ in rows:
        others = [y for j, c, f, y in rows if f != fold and y is not None]
        same = [y for j, c, f, y in rows if f != fold and c == cell and y is not None]
        want = sum(same) / len(same) if same else sum(others) / len(others)
        assert abs(got[i] - want) < 1e-9


def _greedy(sizes, k):
    """Largest group first (equal ones by key), to the lightest fold."""
    heap, out = [(0, f) for f in range(k)], {}
    for g, n in sorted(sizes, key=lambda gs: (-gs[1], gs[0])):
        total, f = heapq.heappop(heap)
        out[g] = f
        heapq.heappush(heap, (total + n, f))
    return out


def test_greedy_folds_match_python(spark):
    sizes = [("a", 9), ("b", 7), ("c", 7), ("d", 3), ("e", 1)]
    rows = [(g, i) for g, n in sizes for i in range(n)] + [(None, 99)]
    df = spark.createDataFrame(rows, "g string, i long")
    got = {r["g"]: r["fold"] for r in FO.group_folds(df, "g", 3).select("g", "fold").distinct().collect()}
    assert got == {**_greedy(sizes, 3), None: 2} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 2, None: 2}


def test_greedy_folds_of_many_groups(spark):
    """More groups than the 200,000 that once switched to another rule."""
    from pyspark.sql import functions as F

    df = spark.range(230_000).select(
        F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 1000 == 0, 40).when(F.col("id") % 7 == 0, 3).otherwise(1))), "id").drop("col")
    sizes = [(i, 40 if i % 1000 == 0 else 3 if i % 7 == 0 else 1) for i in range(230_000)]
    want = _greedy(sizes, 5)
    got = FO.group_folds(df, "id", 5).select("id", "fold").distinct().toPandas()
    assert dict(zip(got["id"], got["fold"])) == want


def test_round_robin_in_closed_form():
    rnd = random.Random(5)
    for _ in range(300):
        k = rnd.randint(1, 6)
        sizes = sorted((rnd.choice([1, 1, 2, 3, 8, 100]) for _ in range(rnd.randint(1, 40))), reverse=True)
        want, totals, got = _greedy(list(enumerate(sizes)), k), [0] * k, {}
        for s in sorted(set(sizes), reverse=True):
            mine = [i for i, x in enumerate(sizes) if x == s]
            rounds = FO.size_rounds(totals, s, len(mine))
            for n, i in enumerate(mine):
                at, turn = [x for x in rounds if x[0] <= n][-1]
                got[i] = turn[(n - at) % len(turn)]
        assert got == want


def test_split_series_with_nulls_and_bursts(spark):
    """NULL times, a series without a station and a burst at one time: cut
    into pieces or not, the features are the same."""
    from limnospark.operators import windows as W
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    rows = []
    for st in ("a", "b", None):
        for i in range(160):
            d = None if i % 9 == 0 else (100 if 40 <= i < 120 else i)
            rows.append((st, d, len(rows), rnd.choice([0.0, 0.0, 1.0, 2.5])))
    df = spark.createDataFrame(rows, "st string, d int, i long, v double").withColumn("d", F.timestamp_seconds("d"))
    out = []
    for split in (None, 20):
        s = W.series(df, ["st"], ["d", "i"], lookback=5, split_rows=split, carry_predicates={"wet": W.wet_predicate("v")})
        f = s.frame.withColumn("m", F.sum("v").over(s.rows(-5, -1))).withColumn("pos", s.pos)
        out.append(sorted((r["i"], r["m"], r["pos"]) for r in s.finish(f).select("i", "m", "pos").collect()))
        if split:
            assert s.split and s.frame.where("_ls_own").groupBy("_ls_key", "_ls_chunk").count().where("count > 80").isEmpty()
    assert len(out[1]) == len(rows) and out[0] == out[1]


def test_equally_near_vectors_by_id(spark):
    from limnospark.operators import neighbors as NB

    pts = spark.createDataFrame([(i, [0.5, 0.5, 0.25]) for i in range(1, 41)] + [(99, [9.0, 9.0, 9.0])], "id long, v array<double>")
    q = spark.createDataFrame([(1000, [0.1, 0.2, 0.3])], "q long, v array<double>")
    got = NB.block_knn(q, pts, "q", "id", "v", 2).orderBy("rank").collect()
    assert [r["nn_id"] for r in got] == [1, 2]


def test_kriging_is_the_same_in_larger_tables(spark):
    """Repeated observations stand for themselves: each residual four times
    with four times the noise variance gives the same prediction."""
    from limnospark.operators import kriging as KR

    rnd = random.Random(2)
    tr = [(rnd.random(), rnd.random(), rnd.gauss(0, 1)) for _ in range(60)]
    te = spark.createDataFrame([(i, rnd.random(), rnd.random()) for i in range(20)], "id long, x double, y double")
    one = spark.createDataFrame(tr, "x double, y double, r double")
    four = spark.createDataFrame(tr * 4, "x double, y double, r double")
    a = {r["id"]: r["kriged"] for r in KR.krige_rows(one, te, "id", "x", "y", "r", kernel=KR.Kernel(0.05, 0.5)).collect()}
    b = {r["id"]: r["kriged"] for r in KR.krige_rows(four, te, "id", "x", "y", "r", kernel=KR.Kernel(0.05, 2.0)).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_points_with_null_attributes_in_polygons(spark):
    from limnospark.operators import spatial as SP

    pts = spark.createDataFrame([(1, 0.5, 0.5, None), (1, 0.5, 0.5, None), (2, 5.0, 5.0, None), (3, 0.2, 0.1, "a")],
                                "id long, x double, y double, note string")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    poly = spark.createDataFrame([("sq", square)], "name string, ring array<struct<x: double, y: double>>")
    got = SP.points_in_polygons(pts, poly, "x", "y", "ring").select("id", "name").collect()
    assert sorted((r["id"], r["name"] or "") for r in got) == [(1, "sq"), (1, "sq"), (2, ""), (3, "sq")]


def test_log_keeps_every_append(spark):
    from limnospark.sources import files as FS

    path = FS.scratch_path(spark, "log")
    for i in range(3):
        row = spark.createDataFrame([(i,)], "n long") if i < 2 else spark.createDataFrame([(i, 0.5)], "n long, extra double")
        last = FS.append_log(spark, row, path)
    assert sorted(r["n"] for r in last.collect()) == [0, 1, 2]
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_cache_is_found_again(spark, tmp_path):
    from limnospark.sources import files as FS

    src, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(src).selectExpr("id * 2 as id")

    spark.range(5).write.parquet(src)
    for _ in range(2):
        assert FS.cached(spark, "twice", [src], build).count() == 5
    assert len(built) == 1
    spark.range(7).write.mode("overwrite").parquet(src)
    assert FS.cached(spark, "twice", [src], build).count() == 7 and len(built) == 2


def test_metric_lines_and_manifests(spark):
    from limnospark.sources import artifacts as AR

    text = ("noise\nTotal Alkalinity | mean=0.41 ± 0.02 | folds=[0.3 0.5]\nElectrical Conductance|mean=-0.1 +/- 1.2.3 | folds=[1 x 3]\n"
            "target=TA mean=abc")
    df = spark.createDataFrame([(text,), ("nothing here",), (None,)], "t string")
    got = sorted(tuple(r) for r in AR.parse_metric_lines(df, "t").drop("folds").collect())
    assert got == [("Electrical Conductance", -0.1, None, 3), ("Total Alkalinity", 0.41, 0.02, 2)]
    forms = spark.createDataFrame([('["a", "b"]',), ('{"columns": ["a"]}',), ('{"features": ["a", "b", "c"]}',), ('{"x": 1, "y": 2}',), ("oops",), (None,)], "j string")
    assert [r["n"] for r in forms.select(AR.manifest_count("j").alias("n")).collect()] == [2, 1, 3, 2, 0, 0]


def test_non_finite_values_take_the_median(spark):
    from limnospark.operators import blend as BL

    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,), (-4.0,), (9.0,)], "y double")
    got = [r["z"] for r in BL.safe_clip(df, "y", "z").collect()]
    assert got == [1.0, 3.0, 2.0, 2.0, 2.0, 2.0, 0.0, 9.0]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from limnospark import session

    bare = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(bare)


def test_knn_equals_brute_force(spark):
    rnd = random.Random(11)
    pts = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(300)]
    qs = [(1000 + i, rnd.uniform(-2, 12), rnd.uniform(-2, 12)) for i in range(40)]
    p = spark.createDataFrame(pts, "id long, x double, y double")
    q = spark.createDataFrame(qs, "id long, x double, y double")
    got = {}
    for r in SP.knn(q, p, "id", "id", "x", "y", 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nn_id"]))
    for qi, qx, qy in qs:
        brute = sorted(pts, key=lambda t: (((t[1] - qx) ** 2 + (t[2] - qy) ** 2) ** 0.5, t[0]))[:4]
        assert [n for _, n in sorted(got[qi])] == [t[0] for t in brute]


def test_radius_pairs_equal_brute_force(spark):
    import math

    rnd = random.Random(2)
    pts = [(round(rnd.uniform(-30, -29), 3), round(rnd.uniform(20, 21), 3)) for _ in range(150)]
    df = spark.createDataFrame(pts, "lat double, lon double").dropDuplicates()
    pairs = SP.radius_pairs(df, df, "lat", "lon", 15.0, [], [])
    got = {(r["lat"], r["lon"], r["p_lat"], r["p_lon"]) for r in pairs.collect()}

    def hav(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(b[1]) - math.radians(a[1])) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    u = sorted(set(pts))
    want = {(a[0], a[1], b[0], b[1]) for a in u for b in u if hav(a, b) <= 15.0}
    assert got == want
