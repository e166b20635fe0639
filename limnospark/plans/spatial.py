"""Spatial queries (J10-J14, G2, K8, A5, A6) on synthetic coordinates of
customers (data points) and suppliers (query points); polygons and lines
derived from nation / region rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import synth_lat, synth_lat_sql, synth_lon, synth_lon_sql
from ..operators import spatial as SP
from ..sources import geojson as GJ
from .catalog import query
from .common import events_obs, r, t

CUST = f"(SELECT c_custkey, c_nationkey, c_acctbal, (c_custkey % 10) * 10 AS landcover, {synth_lat_sql('c_custkey')} AS lat, {synth_lon_sql('c_custkey')} AS lon FROM customer)"
SUPP = f"(SELECT s_suppkey, s_nationkey, {synth_lat_sql('s_suppkey')} AS lat, {synth_lon_sql('s_suppkey')} AS lon FROM supplier)"


def cust(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", ((F.col("c_custkey") % 10) * 10).alias("landcover"),
        synth_lat("c_custkey").alias("lat"), synth_lon("c_custkey").alias("lon"))


def supp(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", synth_lat("s_suppkey").alias("lat"), synth_lon("s_suppkey").alias("lon"))


# Diamond polygon per nation around the rounded mean place of its customers;
# the half-width is chosen so that no 2-decimal point lies on an edge (points
# on an edge are undefined for the crossing-number test).
HALF = 0.9876543
POLY_SQL = f"(SELECT c_nationkey AS poly_id, round(avg(lon), 6) AS cx, round(avg(lat), 6) AS cy FROM {CUST} GROUP BY c_nationkey)"


def polygons(spark, sf_dir):
    c = cust(spark, sf_dir).groupBy(F.col("c_nationkey").alias("poly_id")).agg(
        r(F.avg("lon"), 6).alias("cx"), r(F.avg("lat"), 6).alias("cy"))
    v = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    return c.select("poly_id", "cx", "cy", F.array(v(HALF, 0.0), v(0.0, HALF), v(-HALF, 0.0), v(0.0, -HALF)).alias("ring"))


@query(
    "J10",
    f"""
SELECT c.c_custkey, p.poly_id FROM {CUST} c LEFT JOIN {POLY_SQL} p ON abs(c.lon - p.cx) + abs(c.lat - p.cy) < {HALF}
""",
)
def j10_point_in_polygon(spark, sf_dir):
    """Left point-in-polygon join (edges in bands, parity of crossings)."""
    pts = cust(spark, sf_dir).select("c_custkey", "lat", "lon")
    out = SP.points_in_polygons(pts, polygons(spark, sf_dir), "lon", "lat", "ring")
    return out.select("c_custkey", "poly_id")


# One polyline per region: four vertices across the box.
_OFFS = [(20.0, 0.0), (24.0, 0.5), (27.0, -0.3), (30.0, 0.0)]


def lines(spark, sf_dir):
    reg = t(spark, sf_dir, "region")
    base = F.lit(-34.5) + F.col("r_regionkey").cast("double") * 2.0
    path = F.array(*[F.struct(F.lit(x).alias("x"), (base + dy).alias("y")) for x, dy in _OFFS])
    return reg.select("r_regionkey", "r_name", path.alias("path"))


def _seg_sql() -> str:
    merc_x = lambda v: f"(6378137.0 * radians({v}))"
    merc_y = lambda v: f"(6378137.0 * ln(tan(pi() / 4 + radians({v}) / 2)))"
    parts = []
    for i in range(len(_OFFS) - 1):
        (x1, d1), (x2, d2) = _OFFS[i], _OFFS[i + 1]
        y1 = f"(-34.5::DOUBLE + CAST(r_regionkey AS DOUBLE) * 2.0 + {d1})"
        y2 = f"(-34.5::DOUBLE + CAST(r_regionkey AS DOUBLE) * 2.0 + {d2})"
        parts.append(f"SELECT r_regionkey, r_name, {merc_x(x1)} AS ax, {merc_y(y1)} AS ay, {merc_x(x2)} AS bx, {merc_y(y2)} AS by FROM region")
    return "(" + " UNION ALL ".join(parts) + ")"


def _dist_sql() -> str:
    px, py = "(6378137.0 * radians(c.lon))", "(6378137.0 * ln(tan(pi() / 4 + radians(c.lat) / 2)))"
    t_ = f"(CASE WHEN (s.bx - s.ax) * (s.bx - s.ax) + (s.by - s.ay) * (s.by - s.ay) > 0 THEN least(1.0, greatest(0.0, (({px} - s.ax) * (s.bx - s.ax) + ({py} - s.ay) * (s.by - s.ay)) / ((s.bx - s.ax) * (s.bx - s.ax) + (s.by - s.ay) * (s.by - s.ay)))) ELSE 0.0 END)"
    cx, cy = f"(s.ax + {t_} * (s.bx - s.ax))", f"(s.ay + {t_} * (s.by - s.ay))"
    return f"sqrt(({px} - {cx}) * ({px} - {cx}) + ({py} - {cy}) * ({py} - {cy}))"


@query(
    "J11",
    f"""
SELECT c_custkey, r_regionkey, r_name, round(d, 3) AS dist_to_river_m FROM (
  SELECT c.c_custkey, s.r_regionkey, s.r_name, {_dist_sql()} AS d,
    row_number() OVER (PARTITION BY c.c_custkey ORDER BY {_dist_sql()}, s.r_regionkey) AS rn
  FROM {CUST} c, {_seg_sql()} s) WHERE rn = 1
""",
)
def j11_nearest_line(spark, sf_dir):
    """Nearest polyline in Web-Mercator metres with its attributes."""
    pts = cust(spark, sf_dir).select("c_custkey", "lat", "lon")
    out = SP.nearest_line(pts, lines(spark, sf_dir), "c_custkey", "lat", "lon", "r_regionkey", "path")
    return out.select("c_custkey", "r_regionkey", "r_name", r("dist_to_river_m", 3))


def _hav_sql(a: str, b: str) -> str:
    return (f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + "
            f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))")


_PTS = f"(SELECT lat, lon, count(*) AS n, sum(c_acctbal) AS s FROM {CUST} GROUP BY lat, lon)"


@query(
    "J12",
    f"""
SELECT q.lat, q.lon, CAST(sum(p.n) AS BIGINT) AS n_within_50km, round(sum(p.s) / sum(p.n), 4) AS mean_acctbal_50km
FROM {_PTS} q, {_PTS} p WHERE {_hav_sql('q', 'p')} <= 50.0 GROUP BY q.lat, q.lon
""",
)
def j12_radius(spark, sf_dir):
    """Radius join (haversine <= 50 km, self included) on distinct
    coordinates: rows within the radius and their mean balance."""
    pts = cust(spark, sf_dir).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    pairs = SP.radius_pairs(pts.select("lat", "lon"), pts, "lat", "lon", 50.0, [], ["n", "s"])
    g = pairs.groupBy("lat", "lon").agg(F.sum("p_n").alias("_n"), F.sum("p_s").alias("_s"))
    return g.select("lat", "lon", F.col("_n").cast("long").alias("n_within_50km"),
                    r(F.col("_s") / F.col("_n"), 4).alias("mean_acctbal_50km"))


_CENTS = f"(SELECT lat, lon, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS s FROM {CUST} GROUP BY lat, lon)"


@query(
    "J12_sums",
    f"""
SELECT q.lat, q.lon, CAST(r.km AS DOUBLE) AS radius_km, CAST(sum(p.n) AS BIGINT) AS n_within, CAST(sum(p.s) AS DOUBLE) AS acctbal_within
FROM {_CENTS} q, {_CENTS} p, (VALUES (20), (50), (300)) r(km) WHERE {_hav_sql('q', 'p')} <= r.km GROUP BY q.lat, q.lon, r.km
""",
)
def j12_radius_sums(spark, sf_dir):
    """J12 without pairs: rows and sum of balances within 20, 50 and 300 km of
    every distinct coordinate, cells wholly inside by their stored sums."""
    pts = cust(spark, sf_dir).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("s"))
    g = SP.radius_sums(pts, pts, "lat", "lon", [20.0, 50.0, 300.0], ["n", "s"])
    return g.select("lat", "lon", "radius_km", F.col("n").cast("long").alias("n_within"), F.col("s").cast("double").alias("acctbal_within"))


def _g2_sql() -> str:
    pts = f"""(SELECT lat, lon, count(*) AS n, sum(CASE WHEN landcover = 40 THEN 1 ELSE 0 END) AS nc,
  sum(CASE WHEN landcover = 50 THEN 1 ELSE 0 END) AS nu,
  sum(CASE WHEN landcover NOT IN (40, 50) AND landcover >= 0 THEN 1 ELSE 0 END) AS nn FROM {CUST} GROUP BY lat, lon)"""
    cols = []
    for rad in (1, 5, 10):
        w = f"CASE WHEN d <= {rad} THEN"
        cols.append(f"round(sum({w} p.nc END) / sum({w} p.n END), 9) AS cropland_fraction_{rad}km")
        cols.append(f"round(sum({w} p.nu END) / sum({w} p.n END), 9) AS urban_fraction_{rad}km")
        if rad in (1, 5):
            cols.append(f"round(sum({w} p.nn END) / sum({w} p.n END), 9) AS natural_fraction_{rad}km")
    return f"""SELECT lat, lon, {", ".join(cols)} FROM (
  SELECT q.lat, q.lon, p.*, {_hav_sql('q', 'p')} AS d FROM {pts} q, {pts} p) p
WHERE d <= 10 GROUP BY lat, lon"""


@query("G2", _g2_sql())
def g2_landuse(spark, sf_dir):
    """Cropland / urban / natural fractions within 1, 5, 10 km."""
    out = SP.landuse_fractions(cust(spark, sf_dir), "lat", "lon", "landcover")
    return out.select("lat", "lon", *[r(c, 9) for c in out.columns if c not in ("lat", "lon")])


_KNN_SQL = f"""SELECT s.s_suppkey, c.c_custkey AS nn_c_custkey, CAST(row_number() OVER (PARTITION BY s.s_suppkey
  ORDER BY sqrt(pow(s.lon - c.lon, 2) + pow(s.lat - c.lat, 2)), c.c_custkey) AS INTEGER) AS rank,
  round(sqrt(pow(s.lon - c.lon, 2) + pow(s.lat - c.lat, 2)), 9) AS dist
FROM {SUPP} s JOIN {CUST} c ON {{cond}}"""


@query("J13", f"SELECT * FROM ({_KNN_SQL.format(cond='true')}) WHERE rank <= 5")
def j13_knn(spark, sf_dir):
    """5 nearest customers of every supplier (2-D Euclidean)."""
    q = supp(spark, sf_dir).select(F.col("s_suppkey").alias("id"), "lon", "lat")
    p = cust(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lon", "lat")
    nn = SP.knn(q, p, "id", "id", "lon", "lat", 5)
    return nn.select(F.col("id").alias("s_suppkey"), F.col("nn_id").alias("nn_c_custkey"), "rank", r("dist", 9))


@query("J14", f"SELECT * FROM ({_KNN_SQL.format(cond='s.s_nationkey = c.c_nationkey')}) WHERE rank <= 5")
def j14_knn_in_group(spark, sf_dir):
    """5 nearest customers of the same nation (basin-locked)."""
    q = supp(spark, sf_dir).select(F.col("s_suppkey").alias("id"), "lon", "lat", F.col("s_nationkey").alias("g"))
    p = cust(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lon", "lat", F.col("c_nationkey").alias("g"))
    nn = SP.knn(q, p, "id", "id", "lon", "lat", 5, group="g")
    return nn.select(F.col("id").alias("s_suppkey"), F.col("nn_id").alias("nn_c_custkey"), "rank", r("dist", 9))


def _k8_sql() -> str:
    tr = f"(SELECT c_custkey AS id, c_nationkey AS g, lon, lat, c_acctbal AS y FROM {CUST})"
    q = f"(SELECT 'train' AS role, id, g, lon, lat FROM {tr} UNION ALL SELECT 'valid', s_suppkey, s_nationkey, lon, lat FROM {SUPP})"
    glob = f"""(SELECT role, id, avg(y) AS e FROM (SELECT q.role, q.id, t.y, row_number() OVER (PARTITION BY q.role, q.id
        ORDER BY sqrt(pow(q.lon - t.lon, 2) + pow(q.lat - t.lat, 2)), t.id) AS rn FROM {q} q, {tr} t) WHERE rn <= 5 GROUP BY role, id)"""
    loc = f"""(SELECT role, id, avg(y) AS e FROM (SELECT q.role, q.id, t.y, row_number() OVER (PARTITION BY q.role, q.id
        ORDER BY sqrt(pow(q.lon - t.lon, 2) + pow(q.lat - t.lat, 2)), t.id) AS rn FROM {q} q JOIN {tr} t ON q.g = t.g) WHERE rn <= 5 GROUP BY role, id)"""
    gs = f"(SELECT g, count(*) AS gn, avg(y) AS gm FROM {tr} GROUP BY g)"
    return f"""SELECT q.role, q.id, round(a.e, 6) AS knn_global, round(CASE WHEN gs.gn < 3 THEN gs.gm ELSE b.e END, 6) AS knn_basin
FROM {q} q LEFT JOIN {glob} a USING (role, id) LEFT JOIN {loc} b USING (role, id) LEFT JOIN {gs} gs ON q.g = gs.g"""


@query("K8", _k8_sql())
def k8_knn_encoding(spark, sf_dir):
    """K8: k-NN target encoding (k = 5), global and basin-locked (groups of
    fewer than 3 train rows use the group mean); train rows include
    themselves (S11)."""
    tr = cust(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), "lon", "lat",
                                     F.col("c_acctbal").alias("y"))
    q = tr.select(F.lit("train").alias("role"), "id", "g", "lon", "lat").unionByName(
        supp(spark, sf_dir).select(F.lit("valid").alias("role"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), "lon", "lat"))
    # query ids must be unique: encode the role into the id for the search
    qk = q.withColumn("qid", F.when(F.col("role") == "train", F.col("id") * 2).otherwise(F.col("id") * 2 + 1))
    trk = tr.withColumn("qid", F.col("id"))
    a = SP.knn_target_mean(trk.select(F.col("id").alias("qid"), "lon", "lat", "y", "g"), qk.select("qid", "lon", "lat", "g"),
                           "qid", "lon", "lat", "y", 5, out="knn_global")
    b = SP.knn_target_mean(trk.select(F.col("id").alias("qid"), "lon", "lat", "y", "g"), qk.select("qid", "lon", "lat", "g"),
                           "qid", "lon", "lat", "y", 5, group="g", out="knn_basin")
    out = qk.join(a.select("qid", "knn_global"), "qid", "left").join(b.select("qid", "knn_basin"), "qid", "left")
    return out.select("role", "id", r("knn_global", 6), r("knn_basin", 6))


# Raster: 0.5 degree pixels, origin at lon 20, lat -25 (top-left).
RES, X0, Y0 = 0.5, 20.0, -25.0


@query(
    "A5",
    f"""
WITH ras AS (SELECT CAST(floor((lon - {X0}) / {RES}) AS BIGINT) AS col, CAST(floor(({Y0} - lat) / {RES}) AS BIGINT) AS row,
  avg(c_acctbal) AS band_mean, count(*) AS band_n FROM {CUST} GROUP BY 1, 2)
SELECT s.s_suppkey, round(r.band_mean, 4) AS band_mean, r.band_n
FROM {SUPP} s LEFT JOIN ras r ON r.col = CAST(floor((s.lon - {X0}) / {RES}) AS BIGINT) AND r.row = CAST(floor(({Y0} - s.lat) / {RES}) AS BIGINT)
""",
)
def a5_raster_sample(spark, sf_dir):
    """A5: first pixel under each point for several bands (raster as a
    (col, row, bands) table)."""
    c = cust(spark, sf_dir)
    ras = c.groupBy(F.floor((F.col("lon") - X0) / RES).cast("long").alias("col"),
                    F.floor((F.lit(Y0) - F.col("lat")) / RES).cast("long").alias("row")).agg(
        F.avg("c_acctbal").alias("band_mean"), F.count(F.lit(1)).alias("band_n"))
    out = SP.raster_sample(supp(spark, sf_dir), ras, "lon", "lat", X0, Y0, RES, ["band_mean", "band_n"])
    return out.select("s_suppkey", r("band_mean", 4), "band_n")


_EV_PTS = f"(SELECT event_id, event_type, CAST(ts AS DATE) AS d, value, {synth_lat_sql('user_id')} AS lat, {synth_lon_sql('user_id')} AS lon FROM events)"


@query(
    "A6",
    f"""
WITH img AS (SELECT CAST(floor((lon - {X0}) / {RES}) AS BIGINT) AS col, CAST(floor(({Y0} - lat) / {RES}) AS BIGINT) AS row, d,
  avg(value) AS chirps_ppt FROM {_EV_PTS} WHERE event_type = 'click' GROUP BY 1, 2, 3)
SELECT e.event_id, round(i.chirps_ppt, 6) AS chirps_ppt FROM {_EV_PTS} e LEFT JOIN img i
  ON i.col = CAST(floor((e.lon - {X0}) / {RES}) AS BIGINT) AND i.row = CAST(floor(({Y0} - e.lat) / {RES}) AS BIGINT) AND i.d = e.d
""",
)
def a6_dated_raster(spark, sf_dir):
    """Pixel of the image of the sample's day; NULL when there is no
    image that day (daily images built from click events)."""
    ev = events_obs(spark, sf_dir).select("event_id", "event_type", F.to_date("ts").alias("d"), F.col("rain").alias("value"),
                                          synth_lat("user_id").alias("lat"), synth_lon("user_id").alias("lon"))
    img = ev.where(F.col("event_type") == "click").groupBy(
        F.floor((F.col("lon") - X0) / RES).cast("long").alias("col"),
        F.floor((F.lit(Y0) - F.col("lat")) / RES).cast("long").alias("row"), "d").agg(F.avg("value").alias("chirps_ppt"))
    out = SP.raster_sample(ev, img, "lon", "lat", X0, Y0, RES, ["chirps_ppt"], date="d")
    return out.select("event_id", r("chirps_ppt", 6))


# ---------------------------------------------------------------------------
# Embedding-space neighbours
# ---------------------------------------------------------------------------

EMB_DBL = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(
    "J15",
    f"""
SELECT vec_id, nn_vec_id, rank FROM (
  SELECT q.vec_id, p.vec_id AS nn_vec_id,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance({EMB_DBL.replace('embedding', 'q.embedding')},
      {EMB_DBL.replace('embedding', 'p.embedding')}), p.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings p WHERE q.label = 0 AND p.label <> 0) WHERE rank <= 20
""",
)
def j15_embedding_knn(spark, sf_dir):
    """20 nearest embeddings (64-D Euclidean) of the label-0 rows among
    the other labels (blocked exact search)."""
    from ..operators.neighbors import block_knn

    e = t(spark, sf_dir, "embeddings")
    nn = block_knn(e.where(F.col("label") == 0), e.where(F.col("label") != 0), "vec_id", "vec_id", "embedding", 20)
    return nn.select("vec_id", "nn_vec_id", "rank")


def _j15_folds_sql() -> str:
    parts = []
    for f in range(5):
        for role, qcond, skip in (("train", f"q.vec_id % 5 <> {f}", 1), ("valid", f"q.vec_id % 5 = {f}", 0)):
            parts.append(f"""SELECT {f} AS fold, '{role}' AS role, vec_id, nn_vec_id, CAST(rn - {skip} AS INTEGER) AS rank FROM (
  SELECT q.vec_id, p.vec_id AS nn_vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
    list_distance({EMB_DBL.replace('embedding', 'q.embedding')}, {EMB_DBL.replace('embedding', 'p.embedding')}), p.vec_id) AS rn
  FROM embeddings q, embeddings p WHERE {qcond} AND p.vec_id % 5 <> {f})
WHERE rn > {skip} AND rn <= {skip} + 20""")
    return " UNION ALL ".join(parts)


@query("J15_folds", _j15_folds_sql())
def j15_fold_safe_knn(spark, sf_dir):
    """J15 as surveyed, on the whole table: 20 nearest embeddings of every row
    among the training folds' rows, for each of 5 folds; first neighbour
    dropped on the training side."""
    from ..operators.neighbors import fold_safe_neighbours

    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 5).cast("int").alias("fold"))
    nn = fold_safe_neighbours(e, "vec_id", "embedding", "fold", list(range(5)), 20)
    return nn.select(F.col("fold").cast("int").alias("fold"), "role", "vec_id", "nn_vec_id", "rank")


# Ten whole-numbered attributes of a customer's place (sums of their squares
# are exact on both sides), on about one scale.
_ATTRS = ["c_custkey % 45", "c_custkey % 50", "c_custkey % 40", "(c_custkey % 30) * 2", "(c_custkey % 10) * 5", "(c_custkey * 13) % 50", "(c_custkey % 5) * 10",
          "CAST(floor(c_acctbal / 200) AS BIGINT)", "(c_custkey * 37) % 1000 // 20", "(c_custkey * 91) % 1000 // 20"]


def _j15_attributes_sql() -> str:
    v = ", ".join(f"CAST({a} AS DOUBLE)" for a in _ATTRS)
    e = f"(SELECT c_custkey AS id, c_custkey % 5 AS fold, [{v}] AS v FROM customer)"
    parts = []
    for f in range(5):
        for role, qcond, skip in (("train", f"q.fold <> {f}", 1), ("valid", f"q.fold = {f}", 0)):
            parts.append(f"""SELECT {f} AS fold, '{role}' AS role, id, nn_id, CAST(rn - {skip} AS INTEGER) AS rank FROM (
  SELECT q.id, p.id AS nn_id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, p.v), p.id) AS rn
  FROM {e} q, {e} p WHERE {qcond} AND p.fold <> {f}) WHERE rn > {skip} AND rn <= {skip} + 20""")
    return " UNION ALL ".join(parts)


@query("J15_attributes", _j15_attributes_sql())
def j15_attributes(spark, sf_dir):
    """J15 as surveyed, in a space of ten attributes: 20 nearest places of
    every place among the training folds' places, for each of 5 folds; first
    neighbour dropped on the training side. All folds in one pruned search."""
    from ..operators.neighbors import fold_safe_neighbours

    v = F.array(*[F.expr(a.replace("// 20", "div 20")).cast("double") for a in _ATTRS])
    e = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).cast("int").alias("fold"), v.alias("v"))
    nn = fold_safe_neighbours(e, "id", "v", "fold", list(range(5)), 20)
    return nn.select(F.col("fold").cast("int").alias("fold"), "role", "id", "nn_id", "rank")


def _k9_sql() -> str:
    parts = []
    for f in range(5):
        for role, qcond, skip in (("train", f"q.vec_id % 5 <> {f}", 1), ("valid", f"q.vec_id % 5 = {f}", 0)):
            parts.append(f"""SELECT {f} AS fold, '{role}' AS role, vec_id, round(avg(label), 9) AS nbr_label_mean,
  round(avg(e0), 6) AS nbr_e0_mean FROM (
  SELECT q.vec_id, p.label, CAST(p.embedding[1] AS DOUBLE) AS e0, row_number() OVER (PARTITION BY q.vec_id ORDER BY
    list_distance({EMB_DBL.replace('embedding', 'q.embedding')}, {EMB_DBL.replace('embedding', 'p.embedding')}), p.vec_id) AS rn
  FROM embeddings q, embeddings p WHERE {qcond} AND p.vec_id % 5 <> {f})
WHERE rn > {skip} AND rn <= {skip} + 10 GROUP BY vec_id""")
    return " UNION ALL ".join(parts)


@query("K9", _k9_sql())
def k9_neighbour_means(spark, sf_dir):
    """K9: fold-safe neighbour attribute means (k = 10, 64-D embeddings):
    neighbours from the training folds only, first neighbour dropped on the
    training side."""
    from ..operators.neighbors import fold_safe_neighbour_means

    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label",
                                              F.col("embedding")[0].cast("double").alias("e0"))
    e = e.withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    out = fold_safe_neighbour_means(e, "vec_id", "embedding", "fold", list(range(5)), ["label", "e0"], 10)
    return out.select(F.col("fold").cast("int").alias("fold"), "role", "vec_id", r("nbr_label_mean", 9), r("nbr_e0_mean", 6))


GEOM = "struct<type:string, coordinates:array<array<double>>>"


@query(
    "A4",
    f"SELECT poly_id, 4 AS n_vertices, round(cx + {HALF}, 6) AS first_x FROM {POLY_SQL}",
)
def a4_vector_source(spark, sf_dir):
    """A4: vector source: polygon records as GeoJSON-like text parsed with a
    declared schema into rings of struct(x, y) with their attributes."""
    poly = polygons(spark, sf_dir)
    text = poly.select("poly_id", F.to_json(F.struct(F.lit("Polygon").alias("type"),
                                                      F.transform("ring", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))).alias("geojson"))
    parsed = text.select("poly_id", F.from_json("geojson", GEOM).alias("g"))
    ring = F.transform(F.col("g.coordinates"), lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    out = parsed.select("poly_id", ring.alias("ring"))
    return out.select("poly_id", F.size("ring").alias("n_vertices"), r(F.col("ring")[0]["x"], 6).alias("first_x"))


# A shape per nation: a diamond with a diamond hole around its middle, a small
# diamond in the hole, and a further part to the east; nations whose key is a
# multiple of 7 have no geometry, and every row has a broken twin.
HOLE, ISLE, EAST = HALF / 2.0123457, HALF / 5.0123457, 2.5


def shape_texts(spark, sf_dir):
    ring = lambda h, dx=0.0: F.array(*[F.array(F.col("cx") + F.lit(dx) + a * h, F.col("cy") + b * h) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])
    parts = F.array(F.array(ring(HALF), ring(HOLE)), F.array(ring(ISLE)), F.array(ring(ISLE, EAST)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), F.when(F.col("poly_id") % 7 != 0, geometry).alias("geometry"), F.struct("poly_id").alias("properties"))
    rows = polygons(spark, sf_dir).select("poly_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("text"))
    return rows.unionByName(rows.select("poly_id", F.expr("substring(text, 1, length(text) div 2)").alias("text")))


@query(
    "A4_shapes",
    f"""
SELECT poly_id, true AS ok, CASE WHEN poly_id % 7 <> 0 THEN 3 END AS n_parts, CASE WHEN poly_id % 7 <> 0 THEN 4 END AS n_rings,
  CASE WHEN poly_id % 7 <> 0 THEN 20 END AS n_vertices FROM {POLY_SQL}
UNION ALL SELECT poly_id, false, NULL, NULL, NULL FROM {POLY_SQL}
""",
)
def a4_shapes(spark, sf_dir):
    """A4 nested: GeoJSON features with several parts and holes, NULL
    geometries, and broken texts as flagged rows."""
    s = GJ.read_texts(shape_texts(spark, sf_dir), "text")
    rings = F.flatten("shape")
    size = lambda c: F.when(F.col("shape").isNotNull(), F.size(c))
    return s.select("poly_id", "ok", size("shape").alias("n_parts"), size(rings).alias("n_rings"), size(F.flatten(rings)).alias("n_vertices"))


def _j10_shapes_sql() -> str:
    d, e = "abs(c.lon - p.cx) + abs(c.lat - p.cy)", f"abs(c.lon - p.cx - {EAST}) + abs(c.lat - p.cy)"
    return f"""SELECT c.c_custkey, p.poly_id FROM {CUST} c LEFT JOIN (SELECT * FROM {POLY_SQL} WHERE poly_id % 7 <> 0) p
  ON ({d} < {HALF} AND {d} >= {HOLE}) OR {d} < {ISLE} OR {e} < {ISLE}"""


@query("J10_shapes", _j10_shapes_sql())
def j10_shapes(spark, sf_dir):
    """J10 on shapes with a hole, land in the hole and a further part, read
    from GeoJSON texts."""
    shapes = GJ.read_texts(shape_texts(spark, sf_dir), "text").where("ok").select(F.col("poly_id").cast("long").alias("poly_id"), "shape")
    pts = cust(spark, sf_dir).select("c_custkey", "lat", "lon")
    return SP.points_in_shapes(pts, shapes, "lon", "lat", "shape").select("c_custkey", "poly_id")
