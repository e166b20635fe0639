"""Spatial joins against brute force: dense places, outliers, the date line,
the poles, holes and parts, long segments, missing coordinates, empty sides;
and how many candidates they look at."""

import math
import random

import pytest
from pyspark.sql import functions as F

from limnospark.operators import space
from limnospark.operators import spatial as SP

NAN = float("nan")


def town(n, seed=0):
    """A dense town, spread places, far outliers, repeated coordinates."""
    rng = random.Random(seed)
    out = [(rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for _ in range(n)]
    out += [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n // 10)]
    out += [(1e6, -3e6), (-4e7, 2.0), (0.25, 0.25), (0.25, 0.25), (0.25, 0.25)]
    return out


def points(spark, places, start=0, group=None):
    rows = [(start + i, None if x is None else float(x), None if y is None else float(y), i % group if group else 0) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "id long, x double, y double, g int"), rows


def nearest(q, pts, k, group=False, skip_self=False):
    ok = [p for p in pts if p[1] is not None and p[2] is not None and not math.isnan(p[1] + p[2])
          and (not group or p[3] == q[3]) and not (skip_self and p[0] == q[0])]
    return [(p, d) for d, p in sorted((math.sqrt((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2), p[0]) for p in ok)[:k]]


@pytest.mark.parametrize("group,skip_self", [(None, False), (7, False), (None, True)])
def test_knn_is_exact(spark, monkeypatch, group, skip_self):
    monkeypatch.setattr(space, "CAP", 16)
    p, rows = points(spark, [*town(600), (None, 1.0), (NAN, 1.0), (1.0, None)], group=group)
    asked = town(60, seed=5) + [(None, None), (NAN, 0.0), (9e8, 9e8)]
    q, qrows = (p, rows) if skip_self else points(spark, asked, group=group)
    got = {}
    for r in SP.knn(q, p, "id", "id", "x", "y", 5, group="g" if group else None, exclude_self=skip_self).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nn_id"], r["dist"]))
    for qr in qrows:
        if qr[1] is None or qr[2] is None or math.isnan(qr[1] + qr[2]):
            assert qr[0] not in got
            continue
        want = nearest(qr, rows, 5, bool(group), skip_self)
        assert [(i + 1, n) for i, (n, _) in enumerate(want)] == [x[:2] for x in sorted(got[qr[0]])]
        assert [d for _, d in want] == pytest.approx([x[2] for x in sorted(got[qr[0]])], rel=1e-12)


def test_knn_looks_at_few_points(spark):
    p, _ = points(spark, town(20_000))
    q, rows = points(spark, town(300, seed=9))
    items = p.select("id", *[F.col(c).alias(n) for c, i in (("x", 0), ("y", 1)) for n in (f"_lo{i}", f"_hi{i}")])
    tree = space.build(items, 2)
    sizes = tree.items.groupBy("_leaf").count()
    assert sizes.agg(F.max("count")).first()[0] <= space.CAP
    met = space.nearest(q.select(F.col("id").alias("_q"), F.col("x").alias("_q0"), F.col("y").alias("_q1")), tree, 5).join(tree.items, "_leaf")
    per = met.groupBy("_q").count().agg(F.max("count"), F.avg("count"), F.count("*")).first()
    assert per[2] == len(rows) and per[1] < 5 * space.CAP and per[0] < 16 * space.CAP


def test_knn_empty_sides(spark):
    p, _ = points(spark, town(30))
    for q, pts in ((p.where("false"), p), (p, p.where("false")), (p, p.select("id", F.lit(NAN).alias("x"), "y", "g"))):
        assert SP.knn(q, pts, "id", "id", "x", "y", 3).collect() == []
    assert SP.knn(p, p.where("id < 2"), "id", "id", "x", "y", 3).groupBy("id").count().where("count <> 2").count() == 0


def great_circle(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    d = math.radians(b[1] - a[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def globe(seed=1):
    rng = random.Random(seed)
    out = [(rng.uniform(-0.2, 0.2), 180 - abs(rng.gauss(0, 0.1))) for _ in range(60)] + [(rng.uniform(-0.2, 0.2), -180 + abs(rng.gauss(0, 0.1))) for _ in range(60)]
    out += [(89.9 + rng.uniform(0, 0.1), rng.uniform(-180, 180)) for _ in range(60)] + [(-90.0, 0.0), (-90.0, 120.0), (90.0, 7.0)]
    out += [(48 + rng.gauss(0, 0.01), 9 + rng.gauss(0, 0.01)) for _ in range(200)] + [(48.0, 9.0)] * 30 + [(0.0, 180.0), (0.0, -180.0)]
    return [(round(a, 5), round(b, 5)) for a, b in out]


def test_radius_sums_and_pairs_are_exact(spark, monkeypatch):
    monkeypatch.setattr(space, "CAP", 16)
    places = globe()
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(places)] + [(None, 1.0, 5), (NAN, 1.0, 5)], "lat double, lon double, v long")
    got = {(r["lat"], r["lon"], r["radius_km"]): (r["n"], r["v"]) for r in SP.radius_sums(df, df.withColumn("n", F.lit(1)), "lat", "lon", [0.5, 12.0, 25_000.0], ["n", "v"]).collect()}
    want = {}
    for a in set(places):
        for r in (0.5, 12.0, 25_000.0):
            own = [i for i, b in enumerate(places) if great_circle(a, b) <= r]
            want[(*a, r)] = (len(own), sum(own))
    assert got == want
    some = df.where("v % 9 = 0").select("lat", "lon").distinct()
    pairs = {(r["lat"], r["lon"], r["p_v"]) for r in SP.radius_pairs(some, df, "lat", "lon", 12.0, [], ["v"]).collect()}
    assert pairs == {(*a, i) for a in {places[k] for k in range(0, len(places), 9)} for i, b in enumerate(places) if great_circle(a, b) <= 12.0}
    assert SP.radius_sums(df.where("false"), df, "lat", "lon", [1.0], ["v"]).count() == 0
    assert SP.radius_sums(df, df.where("false"), "lat", "lon", [1.0], ["v"]).count() == 0


def test_radius_compares_few_points(spark):
    """Within 50 km of a town are all its 20,000 places: they come as sums."""
    rng = random.Random(3)
    df = spark.createDataFrame([(48 + rng.gauss(0, 0.3), 9 + rng.gauss(0, 0.3)) for _ in range(20_000)], "lat double, lon double")
    xyz = SP.on_sphere(F.col("lat"), F.col("lon"))
    items = df.select("*", *[v.alias(f"_{s}{i}") for i, v in enumerate(xyz) for s in ("lo", "hi")])
    tree = space.build(items, 3)
    q = df.limit(50).select("*", *[v.alias(f"_q{i}") for i, v in enumerate(xyz)], SP.chord(F.lit(50.0)).alias("_reach"))
    _, border = space.within(q, tree, "_reach")
    per = border.join(tree.items.drop("lat", "lon"), "_leaf").groupBy("lat", "lon").count().agg(F.max("count"), F.avg("count")).first()
    assert per[0] < 6000 and per[1] < 4000  # of 20,000


def test_nearest_line(spark):
    rng = random.Random(8)
    lines = [(i, [(rng.uniform(-5, 5) + d, rng.uniform(-5, 5) + d / 2) for d in (0.0, 0.02, 0.05)]) for i in range(400)]
    lines += [(1000, [(-30.0, -30.0), (15.0, 20.0)]), (1001, [(3.0, 3.0)]), (1002, []), (1003, None), (1004, [(0.0, None), (1.0, 1.0)])]
    df = spark.createDataFrame([(i, None if p is None else [{"x": x, "y": y} for x, y in p], f"n{i}") for i, p in lines],
                               "lid long, path array<struct<x:double,y:double>>, name string")
    pts = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(150)] + [(500, None, 1.0), (501, NAN, 1.0), (502, 60.0, 170.0)]
    pdf = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {r["id"]: r for r in SP.nearest_line(pdf, df, "id", "lat", "lon", "lid", "path").collect()}
    R = 6378137.0
    merc = lambda x, y: (R * math.radians(x), R * math.log(math.tan(math.pi / 4 + math.radians(y) / 2)))

    def dist(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    segs = [(i, merc(*a), merc(*b)) for i, p in lines[:401] for a, b in zip(p, p[1:])]
    assert len(got) == len(pts)
    for i, lat, lon in pts:
        if lat is None or math.isnan(lat):
            assert got[i]["lid"] is None and got[i]["dist_to_river_m"] is None
            continue
        d, lid = min((dist(merc(lon, lat), a, b), k) for k, a, b in segs)
        assert got[i]["dist_to_river_m"] == pytest.approx(d, rel=1e-9, abs=1e-6) and got[i]["lid"] == lid and got[i]["name"] == f"n{lid}"
    for none in (SP.nearest_line(pdf.where("false"), df, "id", "lat", "lon", "lid", "path"), SP.nearest_line(pdf, df.where("lid > 1000"), "id", "lat", "lon", "lid", "path").where("lid is not null")):
        assert none.count() == 0


def test_a_long_segment_is_one_row(spark):
    rng = random.Random(2)
    small = [(i, x, y, x + 10, y + 10) for i in range(3000) for x, y in [(rng.uniform(0, 5e6), rng.uniform(0, 5e6))]]
    df = spark.createDataFrame([*small, (9999, 0.0, 0.0, 5e6, 5e6)], "id long, _lo0 double, _lo1 double, _hi0 double, _hi1 double")
    tree = space.build(df.withColumn("_size", SP.size_level(F.col("_hi0") - F.col("_lo0"))), 2, "_size")
    assert tree.items.where("id = 9999").count() == 1 and tree.items.count() == 3001
    q = df.where("id < 100").select(F.col("id").alias("_q"), F.col("_lo0").alias("_q0"), F.col("_lo1").alias("_q1"))
    per = space.nearest(q, tree, 1).join(tree.items, "_leaf").groupBy("_q").count().agg(F.max("count"), F.avg("count")).first()
    assert per[0] < 16 * space.CAP and per[1] < 6 * space.CAP


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


def test_holes_islands_and_parts(spark):
    shapes = {
        "ring": [[square(0, 0, 4), square(0, 0, 2)]],  # a hole
        "island": [[square(0, 0, 4), square(0, 0, 2)], [square(0, 0, 1)]],  # land in the hole
        "parts": [[square(10, 0, 1)], [square(14, 0, 1)]],
        "open": [[square(0, 10, 1)[:-1]]],
        "flat": [[[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]],
        "huge": [[square(0, 0, 1e5)]],
        "none": None, "empty": [], "line": [[[(0.0, 0.0), (1.0, 1.0)]]],
    }
    rows = [(k, None if s is None else [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in s]) for k, s in shapes.items()]
    df = spark.createDataFrame(rows, "name string, shape array<array<array<struct<x:double,y:double>>>>")
    rng = random.Random(1)
    pts = [(i, rng.uniform(-6, 16), rng.uniform(-6, 12)) for i in range(400)] + [(900, 3.0001, 0.0001)] * 3 + [(901, None, 0.0), (902, NAN, 0.0), (903, 1e9, 0.0)]
    got = sorted((r["id"], r["name"] or "") for r in SP.points_in_shapes(spark.createDataFrame(pts, "id long, x double, y double"), df, "x", "y", "shape").collect())

    def inside(x, y, rings):
        n = 0
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
                n += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return n % 2 == 1

    want = []
    for i, x, y in pts:
        own = [] if x is None or x != x else [k for k, s in shapes.items() if s and k != "line" and inside(x, y, [r for part in s for r in part])]
        want += [(i, k) for k in own] or [(i, "")]
    assert got == sorted(want)
    assert {n for _, n in got} == {"", "ring", "island", "parts", "open", "huge"}
    none = SP.points_in_shapes(spark.createDataFrame(pts, "id long, x double, y double"), df.where("false"), "x", "y", "shape")
    assert none.where("name is not null").count() == 0 and none.count() == len(pts)
    assert SP.points_in_shapes(none.select("id", "x", "y").where("false"), df, "x", "y", "shape").count() == 0
