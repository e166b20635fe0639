"""Spatial joins (J10-J14, G2, A5, A6), without a nested loop anywhere.

* k-nearest (J13, J14), nearest line (J11) and sums within a radius (J12, G2)
  go down search trees whose cells follow the density (:mod:`.space`). Points
  are distinct coordinates first, with the lowest ids or the sums of those who
  share them. Distances on the sphere are bounded in three dimensions by
  chords, so the date line and the poles are places like any other; the
  haversine decides. Ties are ordered by (distance, id).
* line segments are put into one tree per order of magnitude of their length,
  by their middle, so a segment is one row however long it is.
* point in polygon (J10): shapes are parts of rings; their edges go into bands
  of y as high as the edge (two bands at most), a point meets the edges of its
  band only, for the shapes whose box holds it, and the parity of the crossings
  over all rings decides: holes and several parts need nothing else.

NULL and NaN coordinates find nothing and are not found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, haversine_km, mercator_x, mercator_y
from ..session import materialize
from . import space


def real(*cols: str) -> Column:
    """All of the columns hold a finite number."""
    out = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


# --------------------------------------------------------------------------
# Radius sums (J12) and land-use fractions
# --------------------------------------------------------------------------

def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """The place as a point of the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def chord(radius_km: Column) -> Column:
    """Straight distance on the unit sphere of two places ``radius_km`` apart."""
    return 2 * F.sin(F.least(radius_km / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2)))


def radius_sums(queries: DataFrame, points: DataFrame, lat: str, lon: str, radii: list[float], sums: list[str]) -> DataFrame:
    """(lat, lon, radius_km, sums...): the ``sums`` columns of ``points``
    added up within each radius (haversine, edge included) of each distinct
    coordinate of ``queries``; coordinates that find nothing are absent."""
    xyz = on_sphere(F.col(lat), F.col(lon))
    pts = points.where(real(lat, lon)).groupBy(lat, lon).agg(*[F.sum(c).alias(c) for c in sums])
    pts = pts.select(F.col(lat).alias("_plat"), F.col(lon).alias("_plon"), *sums, *[f(v).alias(f"_{n}{i}") for i, v in enumerate(xyz)
                     for n, f in (("lo", lambda v: v), ("hi", lambda v: v))])
    tree = space.build(pts, 3, sums=sums)
    if tree is None:
        return points.where("false").select(lat, lon, F.lit(0.0).alias("radius_km"), *sums)
    q = queries.where(real(lat, lon)).select(lat, lon).distinct().select(lat, lon, *[v.alias(f"_q{i}") for i, v in enumerate(xyz)])
    q = q.withColumn("radius_km", F.explode(F.array(*[F.lit(float(r)) for r in radii]))).withColumn("_reach", chord(F.col("radius_km")))
    whole, border = space.within(q, tree, "_reach")
    near = border.join(tree.items, "_leaf").where(haversine_km(F.col(lat), F.col(lon), F.col("_plat"), F.col("_plon")) <= F.col("radius_km"))
    rows = whole.select(lat, lon, "radius_km", *sums).unionByName(near.select(lat, lon, "radius_km", *sums))
    return rows.groupBy(lat, lon, "radius_km").agg(*[F.sum(c).alias(c) for c in sums])


def radius_pairs(queries: DataFrame, points: DataFrame, lat: str, lon: str, radius_km: float,
                 qcols: list[str], pcols: list[str]) -> DataFrame:
    """Pairs (query, point) with haversine distance <= radius_km (self
    included). ``qcols`` / ``pcols`` are carried; output adds ``dist_km``.
    Both sides should already be distinct coordinates."""
    side = 2 * math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2)) * (1 + 1e-9) + 1e-12
    cell = lambda v: F.floor(v / side).cast("long")
    xyz = on_sphere(F.col(lat), F.col(lon))
    p = points.where(real(lat, lon)).withColumns({f"_c{i}": cell(v) for i, v in enumerate(xyz)})
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in [lat, lon, *pcols]], "_c0", "_c1", "_c2")
    q = queries.where(real(lat, lon)).select(lat, lon, *qcols)
    for i, v in enumerate(on_sphere(F.col(lat), F.col(lon))):
        q = q.withColumn(f"_c{i}", F.explode(F.array(*[cell(v) + d for d in (-1, 0, 1)])))
    d = haversine_km(F.col(lat), F.col(lon), F.col(f"p_{lat}"), F.col(f"p_{lon}"))
    return q.join(p, ["_c0", "_c1", "_c2"]).withColumn("dist_km", d).where(F.col("dist_km") <= radius_km).drop("_c0", "_c1", "_c2")


# Land-cover codes and radii of the land-use fractions.
CROP, URBAN = 40, 50
LANDUSE_RADII = (1, 5, 10)
NATURAL_RADII = (1, 5)


def landuse_fractions(df: DataFrame, lat: str, lon: str, landcover: str,
                      radii=LANDUSE_RADII, natural_radii=NATURAL_RADII) -> DataFrame:
    """Share of cropland (40), urban (50) and natural (other codes >= 0)
    rows within each radius (rows of ``df``, self included), for every
    distinct coordinate of ``df``. A NULL code counts in the denominator
    only. All radii go down the tree together."""
    lc = F.coalesce(F.col(landcover).cast("int"), F.lit(-1))
    pts = materialize(df.groupBy(lat, lon).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((lc == CROP).cast("long")).alias("n_crop"),
        F.sum((lc == URBAN).cast("long")).alias("n_urban"),
        F.sum(((lc != CROP) & (lc != URBAN) & (lc >= 0)).cast("long")).alias("n_nat"),
    ), "places")
    found = radius_sums(pts, pts, lat, lon, list(radii), ["n", "n_crop", "n_urban", "n_nat"])
    aggs = []
    for r in radii:
        at = lambda c: F.max(F.when(F.col("radius_km") == r, F.col(c)))  # noqa: E731, B023
        aggs.append((at("n_crop") / at("n")).alias(f"cropland_fraction_{r}km"))
        aggs.append((at("n_urban") / at("n")).alias(f"urban_fraction_{r}km"))
        if r in natural_radii:
            aggs.append((at("n_nat") / at("n")).alias(f"natural_fraction_{r}km"))
    return found.groupBy(lat, lon).agg(*aggs)


# --------------------------------------------------------------------------
# k-nearest neighbours
# --------------------------------------------------------------------------

def knn(queries: DataFrame, points: DataFrame, qid: str, pid: str, x: str, y: str, k: int,
        group: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, pid, dist, rank) for the k nearest points of every query by 2-D
    Euclidean distance on (x, y), ties by point id. With ``group`` only
    points of the same group count, and k is capped at the group size.
    ``exclude_self`` drops the point whose id equals the query id. Queries
    that share a place are searched once."""
    need = k + 1 if exclude_self else k
    gk = [group] if group else []
    some = real(x, y) & (F.col(group).isNotNull() if group else F.lit(True))
    place = [F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *[F.col(g).alias("_g") for g in gk]]
    at = ["_x", "_y", *(["_g"] if group else [])]
    pts = points.where(some).select(F.col(pid).alias("_pid"), *place)
    # Of those who share a place only the lowest ids can be among the nearest.
    first = Window.partitionBy(*at).orderBy("_pid")
    pts = pts.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= need)
    pts = pts.groupBy(*at).agg(F.sort_array(F.collect_list("_pid")).alias("_ids"))
    pts = pts.select("*", F.size("_ids").alias("_n"), *[F.col(c).alias(n) for c, i in (("_x", 0), ("_y", 1)) for n in (f"_lo{i}", f"_hi{i}")]).drop("_x", "_y")
    tree = space.build(pts, 2, "_g" if group else None, weight="_n")
    named = lambda df: df.select(F.col("_qid").alias(qid), F.col("_pid").alias("nn_" + pid), F.col("_d").alias("dist"),
                                 F.col("_rank").cast("int").alias("rank"))
    asked = queries.where(some).select(F.col(qid).alias("_qid"), *place)
    if tree is None:
        return named(asked.crossJoin(points.where("false").select(F.col(pid).alias("_pid"))).select(
            "_qid", "_pid", F.lit(0.0).alias("_d"), F.lit(0).alias("_rank")).where("false"))
    places = materialize(asked.select(*at).distinct().withColumn("_q", F.monotonically_increasing_id()), "asked")
    q = places.select("_q", F.col("_x").alias("_q0"), F.col("_y").alias("_q1"), *(["_g"] if group else []))
    met = space.nearest(q, tree, need).drop("_g").join(tree.items.drop("_g"), "_leaf")
    met = met.withColumn("_d", F.sqrt(F.pow(F.col("_q0") - F.col("_lo0"), 2) + F.pow(F.col("_q1") - F.col("_lo1"), 2)))
    near = Window.partitionBy("_q").orderBy("_d", F.element_at("_ids", 1))
    met = met.withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= need)
    each = met.select("_q", "_d", F.explode("_ids").alias("_pid"))
    each = each.withColumn("_rank", F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_pid"))).where(F.col("_rank") <= need)
    out = asked.join(places, at).join(each, "_q")
    if exclude_self:
        out = out.where(F.col("_pid") != F.col("_qid"))
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy("_qid").orderBy("_d", "_pid"))).where(F.col("_rank") <= k)
    return named(out)


def knn_target_mean(train: DataFrame, queries: DataFrame, id_col: str, x: str, y: str, target: str, k: int = 5,
                    group: str | None = None, min_group: int = 3, out: str = "knn_encoding") -> DataFrame:
    """K8: mean target of the k nearest train rows (self included when the
    query is a train row, S11). With ``group`` (basin-locked), neighbours
    come from the same group and groups with fewer than ``min_group`` train
    rows use the group mean; queries of unseen groups get NULL."""
    nn = knn(queries, train, id_col, id_col, x, y, k, group=group)
    ty = train.select(F.col(id_col).alias("nn_" + id_col), F.col(target).alias("_y"))
    enc = nn.join(ty, "nn_" + id_col).groupBy(id_col).agg(F.avg("_y").alias(out))
    res = queries.join(enc, id_col, "left")
    if group:
        gs = train.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"), F.avg(target).alias("_gm"))
        res = res.join(gs, group, "left").withColumn(
            out, F.when(F.col("_gn") < min_group, F.col("_gm")).otherwise(F.col(out))
        ).drop("_gn", "_gm")
    return res


# --------------------------------------------------------------------------
# Point in polygon (J10) and nearest line
# --------------------------------------------------------------------------

def shape_edges(shapes: DataFrame, sid: str, shape: str) -> DataFrame:
    """Edges (ax, ay, bx, by) of all rings of a shape (array of parts, of
    rings, of struct x, y), open or closed; those without a crossing (level
    ones) are left out."""
    ring = shapes.select(sid, F.explode(F.flatten(shape)).alias("_r")).where(F.size("_r") > 2)
    after = F.concat(F.slice("_r", 2, F.size("_r") - 1), F.slice("_r", 1, 1))
    e = ring.select(sid, F.explode(F.arrays_zip(F.col("_r").alias("a"), after.alias("b"))).alias("e"))
    e = e.select(sid, *[F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    return e.where(real("ax", "ay", "bx", "by") & (F.col("ay") != F.col("by")))


def size_level(v: Column) -> Column:
    """The least whole l with 2**l >= v, -40 at least."""
    return F.greatest(F.ceil(F.log2(F.greatest(v, F.lit(2.0 ** -40)))), F.lit(-40)).cast("int")


def _step(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def points_in_shapes(points: DataFrame, shapes: DataFrame, x: str, y: str, shape: str) -> DataFrame:
    """Left spatial join ``within``: every point kept; one row per shape
    that holds it (points on an edge are undefined); the shapes' columns NULL
    where none does. A shape's even-odd rule over all its rings makes holes
    and islands; a NULL or empty shape holds nothing. Distinct coordinates
    are asked once."""
    own = materialize(shapes.withColumn("_sid", F.monotonically_increasing_id()), "shapes")
    edges = shape_edges(own, "_sid", shape)
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    edges = edges.withColumn("_l", size_level(hi - lo))
    edges = edges.withColumn("_band", F.explode(F.array_distinct(F.array(_step(lo, F.col("_l")), _step(hi, F.col("_l"))))))
    edges = materialize(edges, "edges")
    ends = edges.groupBy("_sid").agg(F.min(F.least("ax", "bx")).alias("_x0"), F.max(F.greatest("ax", "bx")).alias("_x1"),
                                     F.min(F.least("ay", "by")).alias("_y0"), F.max(F.greatest("ay", "by")).alias("_y1"),
                                     F.collect_set("_l").alias("_ls"))  # a few dozen sizes at most
    ends = materialize(ends.withColumn("_m", size_level(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))), "boxes")
    sizes = [r["_m"] for r in ends.select("_m").distinct().collect()]  # as few
    # A box is in four cells at most of its size; a place looks into its own cell of each size.
    cells = ends
    for c, a, z in (("_cx", "_x0", "_x1"), ("_cy", "_y0", "_y1")):
        cells = cells.withColumn(c, F.explode(F.array_distinct(F.array(_step(F.col(a), F.col("_m")), _step(F.col(z), F.col("_m"))))))
    places = points.where(real(x, y)).select(F.col(x).alias("_kx"), F.col(y).alias("_ky")).distinct()
    at = places.select("*", F.col("_kx").cast("double").alias("_px"), F.col("_ky").cast("double").alias("_py"),
                       F.explode(F.array(*[F.lit(m) for m in sizes]).cast("array<int>")).alias("_m"))
    at = at.withColumns({"_cx": _step(F.col("_px"), F.col("_m")), "_cy": _step(F.col("_py"), F.col("_m"))})
    inbox = F.col("_px").between(F.col("_x0"), F.col("_x1")) & F.col("_py").between(F.col("_y0"), F.col("_y1"))
    met = at.join(cells, ["_m", "_cx", "_cy"]).where(inbox).select("_kx", "_ky", "_px", "_py", "_sid", F.explode("_ls").alias("_l"))
    met = met.withColumn("_band", _step(F.col("_py"), F.col("_l"))).join(edges, ["_sid", "_l", "_band"])
    cross = (F.col("ay") > F.col("_py")) != (F.col("by") > F.col("_py"))
    right = F.col("_px") < F.col("ax") + (F.col("_py") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    hit = met.where(cross & right).groupBy("_kx", "_ky", "_sid").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") % 2 == 1)
    found = hit.join(own.select("_sid", F.struct(*shapes.columns).alias("_shape")), "_sid")
    out = points.join(found, (F.col(x) == F.col("_kx")) & (F.col(y) == F.col("_ky")), "left")
    return out.select(*points.columns, *[F.col("_shape")[c].alias(c) for c in shapes.columns])


def points_in_polygons(points: DataFrame, polys: DataFrame, x: str, y: str, ring: str) -> DataFrame:
    """:func:`points_in_shapes` for polygons of one ring."""
    one = polys.withColumn("_one", F.array(F.array(F.col(ring))))
    return points_in_shapes(points, one, x, y, "_one").drop("_one")


def segments(lines: DataFrame, lid: str, path: str) -> DataFrame:
    """Polyline (array of struct x, y in degrees) -> Web-Mercator segments."""
    e = lines.where(F.size(path) > 1).select(lid, F.posexplode(F.arrays_zip(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path)))).alias("seg", "ab"))
    return e.select(
        lid, "seg",
        mercator_x(F.col("ab")["0"]["x"]).alias("ax"), mercator_y(F.col("ab")["0"]["y"]).alias("ay"),
        mercator_x(F.col("ab")["1"]["x"]).alias("bx"), mercator_y(F.col("ab")["1"]["y"]).alias("by"),
    )


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / len2))).otherwise(0.0)
    cx, cy = ax + t * dx, ay + t * dy
    return F.sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy))


def nearest_line(points: DataFrame, lines: DataFrame, pid: str, lat: str, lon: str, lid: str, path: str,
                 out: str = "dist_to_river_m") -> DataFrame:
    """Nearest polyline per point (Web-Mercator metres), ties by line
    id. A line without a segment is never found; points without a place, and
    all points where there is no line, get NULL. Distinct coordinates are
    asked once."""
    seg = segments(lines, lid, path).where(real("ax", "ay", "bx", "by"))
    far = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    seg = seg.select("*", size_level(far).alias("_size"), *[f(f"a{c}", f"b{c}").alias(f"_{n}{i}") for i, c in enumerate("xy")
                     for n, f in (("lo", F.least), ("hi", F.greatest))])
    tree = space.build(seg, 2, "_size")
    asked = points.where(real(lat, lon)).select(lat, lon).distinct().select(
        F.col(lat).alias("_klat"), F.col(lon).alias("_klon"), mercator_x(F.col(lon)).alias("_q0"), mercator_y(F.col(lat)).alias("_q1"))
    if tree is None:
        best = asked.select("_klat", "_klon", F.lit(None).cast(lines.schema[lid].dataType).alias(lid), F.lit(None).cast("double").alias(out))
    else:
        asked = materialize(asked.where(real("_q0", "_q1")).withColumn("_q", F.monotonically_increasing_id()), "asked")
        met = space.nearest(asked, tree, 1).join(tree.items, "_leaf")
        d = point_segment_distance(*[F.col(c) for c in ("_q0", "_q1", "ax", "ay", "bx", "by")])
        best = met.withColumn("_d", d).groupBy("_klat", "_klon").agg(F.min(F.struct("_d", F.col(lid).alias("_l"))).alias("_b"))
        best = best.select("_klat", "_klon", F.col("_b._l").alias(lid), F.col("_b._d").alias(out))
    here = (F.col(lat) == F.col("_klat")) & (F.col(lon) == F.col("_klon"))
    return points.join(best, here, "left").drop("_klat", "_klon").join(lines.drop(path), lid, "left")


# --------------------------------------------------------------------------
# Raster sampling as an equi-join
# --------------------------------------------------------------------------

def raster_sample(points: DataFrame, raster: DataFrame, x: str, y: str, x0: float, y0: float, res: float,
                  bands: list[str], date: str | None = None) -> DataFrame:
    """The pixel under each point: col = floor((x - x0) / res),
    row = floor((y0 - y) / res); with ``date`` the image of that day; NULL
    bands where no pixel (or no image that day) exists. ``raster`` has
    columns (col, row[, date], bands...)."""
    keys = ["_col", "_row"] + ([date] if date else [])
    p = points.withColumns({"_col": F.floor((F.col(x) - x0) / res).cast("long"),
                            "_row": F.floor((F.lit(y0) - F.col(y)) / res).cast("long")})
    r = raster.select(F.col("col").alias("_col"), F.col("row").alias("_row"), *([date] if date else []), *bands)
    return p.join(r, keys, "left").drop("_col", "_row")
