"""Folds, leakage checks and target encodings (K1-K7, K10, G16, G20) on
customer places (target c_acctbal, basin c_nationkey) and supplier places
as the valid side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as FX
from ..functions.keys import group_key
from ..functions.geo import synth_lat, synth_lon, synth_lat_sql, synth_lon_sql
from ..operators import aggregates as AG
from ..operators import encoding as EN
from ..operators import folds as FO
from .catalog import query
from .common import MART_SQL, obs_mart, places, r, t

K = 5


def fold_sql(src: str, grp: str, k: int = K) -> str:
    """Greedy size-balanced group folds as a recursive CTE: groups by size
    desc then key, each into the first lightest fold. Yields (grp, fold)."""
    zeros = ", ".join(["0"] * k)
    return f"""(WITH RECURSIVE g AS (
    SELECT {grp} AS grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {grp}) AS rn
    FROM {src} WHERE {grp} IS NOT NULL GROUP BY {grp}),
  s(step, sizes, grp, fold) AS (
    SELECT 0, [{zeros}]::BIGINT[], NULL::BIGINT, NULL::INTEGER
    UNION ALL
    SELECT s.step + 1,
      list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = list_position(s.sizes, list_min(s.sizes))
                                                    THEN s.sizes[i] + g.n ELSE s.sizes[i] END),
      g.grp, CAST(list_position(s.sizes, list_min(s.sizes)) - 1 AS INTEGER)
    FROM s JOIN g ON g.rn = s.step + 1)
  SELECT grp, fold FROM s WHERE grp IS NOT NULL)"""


CUST_SQL = f"""(SELECT c_custkey AS station_id, {synth_lat_sql('c_custkey')} AS lat, {synth_lon_sql('c_custkey')} AS lon,
  c_nationkey AS basin_id, c_acctbal AS y FROM customer)"""
SUPP_SQL = f"""(SELECT s_suppkey AS station_id, {synth_lat_sql('s_suppkey')} AS lat, {synth_lon_sql('s_suppkey')} AS lon,
  s_nationkey AS basin_id FROM supplier)"""
CUST_FOLD_SQL = f"(SELECT c.*, f.fold FROM {CUST_SQL} c JOIN {fold_sql('customer', 'c_nationkey')} f ON c.basin_id = f.grp)"


def _cust(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("station_id"), synth_lat("c_custkey").alias("lat"), synth_lon("c_custkey").alias("lon"),
        F.col("c_nationkey").alias("basin_id"), F.col("c_acctbal").alias("y"),
    )


def _supp(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_id"), synth_lat("s_suppkey").alias("lat"), synth_lon("s_suppkey").alias("lon"),
        F.col("s_nationkey").alias("basin_id"),
    )


def _cust_folds(spark, sf_dir):
    return FO.group_folds(_cust(spark, sf_dir), "basin_id", K)


@query(
    "K1",
    f"""
SELECT station_id, coalesce(CAST(basin_id AS VARCHAR), 'unknown') AS group_basin,
  CAST(CAST(floor(lat / 0.2) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(lon / 0.2) AS BIGINT) AS VARCHAR) AS group_grid
FROM {CUST_SQL}
""",
)
def k1_group_key(spark, sf_dir):
    """K1: basin group key (NULL -> 'unknown') and the grid-cell fallback."""
    c = _cust(spark, sf_dir)
    return c.select("station_id", group_key(basin="basin_id").alias("group_basin"),
                    group_key(lat="lat", lon="lon", grid=0.2).alias("group_grid"))


@query("K2", f"SELECT grp AS basin_id, fold FROM {fold_sql('customer', 'c_nationkey')}")
def k2_group_folds(spark, sf_dir):
    """K2: size-balanced group folds (largest group to the lightest fold)."""
    return _cust_folds(spark, sf_dir).select("basin_id", "fold").distinct()


@query(
    "K3",
    f"""
SELECT CAST(i AS INTEGER) AS split, CASE WHEN fold = i THEN 'valid' ELSE 'train' END AS role, count(*) AS n_rows
FROM {CUST_FOLD_SQL}, range(0, {K}) t(i) GROUP BY 1, 2
""",
)
def k3_fold_loop(spark, sf_dir):
    """K3: all train/valid splits of a fold column in one pass."""
    ex = FO.split_frames(_cust_folds(spark, sf_dir), "fold", K)
    return ex.groupBy(F.col("split").cast("int").alias("split"), "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "K4",
    f"""
SELECT basin_id, count(DISTINCT station_id % {K}) AS n_folds FROM {CUST_SQL} GROUP BY basin_id
HAVING count(DISTINCT station_id % {K}) > 1
""",
)
def k4_leakage(spark, sf_dir):
    """K4: groups present in several folds under a row-level fold column."""
    c = _cust(spark, sf_dir).withColumn("fold", F.col("station_id") % K)
    return FO.leakage(c, "basin_id", "fold")


@query(
    "K5",
    f"""
SELECT fold, count(*) AS n_rows, count(DISTINCT basin_id) AS n_groups, CAST(0 AS BIGINT) AS n_split_groups,
  min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max
FROM {CUST_FOLD_SQL} GROUP BY fold
""",
)
def k5_fold_report(spark, sf_dir):
    """K5: fold sizes, split groups and coordinate ranges."""
    return FO.fold_report(_cust_folds(spark, sf_dir), "basin_id", "fold", "lat", "lon")


def _k6_sql(grid: float) -> str:
    return f"""floor(lat / {grid}) AS cx_{str(grid).replace('.', 'p')}, floor(lon / {grid}) AS cy_{str(grid).replace('.', 'p')}"""


K6_SQL = f"""
WITH tr AS (SELECT *, {_k6_sql(0.05)}, {_k6_sql(0.2)} FROM {CUST_FOLD_SQL}),
va AS (SELECT *, {_k6_sql(0.05)}, {_k6_sql(0.2)} FROM {SUPP_SQL}),
fm AS (SELECT f.fold, (SELECT round(sum(y), 2) / count(y) FROM tr WHERE tr.fold <> f.fold) AS fb FROM (SELECT DISTINCT fold FROM tr) f),
gm AS (SELECT round(sum(y), 2) / count(y) AS gm FROM tr)
SELECT 'train' AS role, a.station_id,
  round(coalesce((SELECT round(sum(y), 2) / nullif(count(y), 0) FROM tr b WHERE b.cx_0p05 = a.cx_0p05 AND b.cy_0p05 = a.cy_0p05 AND b.fold <> a.fold), fm.fb), 6) AS te_g0p05,
  round(coalesce((SELECT round(sum(y), 2) / nullif(count(y), 0) FROM tr b WHERE b.cx_0p2 = a.cx_0p2 AND b.cy_0p2 = a.cy_0p2 AND b.fold <> a.fold), fm.fb), 6) AS te_g0p2
FROM tr a JOIN fm USING (fold)
UNION ALL
SELECT 'valid', v.station_id,
  round(coalesce((SELECT round(sum(y), 2) / nullif(count(y), 0) FROM tr b WHERE b.cx_0p05 = v.cx_0p05 AND b.cy_0p05 = v.cy_0p05), gm.gm), 6),
  round(coalesce((SELECT round(sum(y), 2) / nullif(count(y), 0) FROM tr b WHERE b.cx_0p2 = v.cx_0p2 AND b.cy_0p2 = v.cy_0p2), gm.gm), 6)
FROM va v, gm
"""


@query("K6", K6_SQL)
def k6_oof_cell_mean(spark, sf_dir):
    """K6: out-of-fold grid-cell target mean at two grids (fold-mean
    fallback), full map with global fallback for the valid side."""
    tr = _cust_folds(spark, sf_dir)
    va = _supp(spark, sf_dir)
    outs_tr, outs_va = tr, va
    for g in (0.05, 0.2):
        tag = str(g).replace(".", "p")
        cx, cy = f"cx_{tag}", f"cy_{tag}"
        cells = EN.grid_cells("lat", "lon", g)
        outs_tr = outs_tr.withColumns({cx: cells["_cx"], cy: cells["_cy"]})
        outs_va = outs_va.withColumns({cx: cells["_cx"], cy: cells["_cy"]})
        outs_tr, outs_va = EN.oof_mean(outs_tr, outs_va, [cx, cy], "y", "fold", f"te_g{tag}", "fold", digits=2)
    a = outs_tr.select(F.lit("train").alias("role"), "station_id", r("te_g0p05"), r("te_g0p2"))
    b = outs_va.select(F.lit("valid").alias("role"), "station_id", r("te_g0p05"), r("te_g0p2"))
    return a.unionByName(b)


K7_SQL = f"""
WITH tr AS {CUST_FOLD_SQL},
gm AS (SELECT round(sum(y), 2) / count(y) AS gm FROM tr)
SELECT 'train' AS role, a.station_id,
  round(coalesce((SELECT round(sum(y), 2) / nullif(count(y), 0) FROM tr b WHERE b.basin_id = a.basin_id AND b.fold <> a.fold), gm.gm), 6) AS basin_te
FROM tr a, gm
UNION ALL
SELECT 'valid', v.station_id,
  round(coalesce((SELECT round(sum(y), 2) / nullif(count(y), 0) FROM tr b WHERE b.basin_id = v.basin_id), gm.gm), 6)
FROM {SUPP_SQL} v, gm
"""


@query("K7", K7_SQL)
def k7_oof_basin_mean(spark, sf_dir):
    """K7: out-of-fold basin target mean with folds grouped by the same basin
    (S9: every train row gets the overall mean; only the valid side varies)."""
    tr = _cust_folds(spark, sf_dir)
    va = _supp(spark, sf_dir)
    a, b = EN.oof_mean(tr, va, ["basin_id"], "y", "fold", "basin_te", "overall", digits=2)
    return a.select(F.lit("train").alias("role"), "station_id", r("basin_te")).unionByName(
        b.select(F.lit("valid").alias("role"), "station_id", r("basin_te"))
    )


@query("K10", "SELECT o_orderkey, CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 7000 AS is_train FROM orders")
def k10_random_split(spark, sf_dir):
    """Deterministic 70/30 split by a hash of the row id."""
    return FO.random_split(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "G16",
    f"""
SELECT fold, count(*) AS n_rows, count(DISTINCT basin_id) AS n_groups, round(avg(y), 6) AS y_mean,
  min(y) AS y_min, max(y) AS y_max, round(stddev_samp(y), 6) AS y_std
FROM {CUST_FOLD_SQL} GROUP BY fold
""",
)
def g16_fold_summary(spark, sf_dir):
    """Describe / value counts / distinct groups per fold."""
    s = AG.fold_summary(_cust_folds(spark, sf_dir), "fold", "basin_id", "y")
    return s.select("fold", "n_rows", "n_groups", r("y_mean"), "y_min", "y_max", r("y_std"))


_G16_STATS = ("min", "25%", "50%", "75%", "max", "mean", "std", "count")


def _g16_describe_sql() -> str:
    aggs = ["min(y)", "quantile_cont(y, 0.25)", "quantile_cont(y, 0.5)", "quantile_cont(y, 0.75)", "max(y)", "avg(y)", "stddev_samp(y)", "count(y)"]
    parts = [f"SELECT fold, 'describe' AS kind, '{n}' AS name, round(CAST({a} AS DOUBLE), 6) AS value FROM {CUST_FOLD_SQL} GROUP BY fold" for n, a in zip(_G16_STATS, aggs)]
    counts = f"""SELECT fold, 'value_counts' AS kind, CAST(basin_id AS VARCHAR) AS name, CAST(n AS DOUBLE) AS value FROM (
  SELECT fold, basin_id, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, basin_id) AS rn
  FROM {CUST_FOLD_SQL} WHERE basin_id IS NOT NULL GROUP BY fold, basin_id) WHERE rn <= 5"""
    return " UNION ALL ".join([*parts, counts])


@query("G16_describe", _g16_describe_sql())
def g16_describe(spark, sf_dir):
    """G16 with what describe and value_counts give per fold: count, mean,
    std, least, quartiles and largest, and the five most frequent groups."""
    d = AG.fold_describe(_cust_folds(spark, sf_dir), "fold", "basin_id", "y", 5)
    return d.select("fold", "kind", "name", r("value"))


# Regime support on the observation mart: flags month == 1, pet > 50,
# dist_main_km > 498.1 (January data: month 12 never occurs).
_G20_FLAGS = """CAST(month(ts) = 1 AS INTEGER) AS is_m, CAST(coalesce(pet > 50, false) AS INTEGER) AS is_pet_high,
  CAST(coalesce(dist_main_km > 498.1, false) AS INTEGER) AS is_dist_high"""


def _g20_sql() -> str:
    regimes = [("is_m", "is_m = 1"), ("is_m&is_pet_high", "is_m = 1 AND is_pet_high = 1"),
               ("is_m&is_dist_high", "is_m = 1 AND is_dist_high = 1"), ("is_pet_high", "is_pet_high = 1"),
               ("is_pet_high&is_dist_high", "is_pet_high = 1 AND is_dist_high = 1"), ("is_dist_high", "is_dist_high = 1"),
               ("is_m&is_pet_high&is_dist_high", "is_m = 1 AND is_pet_high = 1 AND is_dist_high = 1")]
    src = f"(SELECT m.*, f.fold, {_G20_FLAGS} FROM {MART_SQL} m JOIN {fold_sql(MART_SQL, 'basin_id')} f ON m.basin_id = f.grp)"
    parts = []
    for name, cond in regimes:
        folds = ", ".join(f"count(*) FILTER (WHERE fold = {i}) AS fold_{i}" for i in range(K))
        parts.append(f"SELECT '{name}' AS regime, count(*) AS n_rows, count(DISTINCT basin_id) AS n_groups, {folds} FROM {src} WHERE {cond}")
    u = " UNION ALL ".join(parts)
    zero = " + ".join(f"CAST(fold_{i} = 0 AS INTEGER)" for i in range(K))
    least = ", ".join(f"fold_{i}" for i in range(K))
    return f"SELECT *, {zero} AS zero_folds, least({least}) AS min_fold_rows FROM ({u}) WHERE n_rows > 0"


@query("G20", _g20_sql())
def g20_regime_support(spark, sf_dir):
    """Regime support table (marginal, pair, triple flag counts, per-fold
    counts, zero folds, minimum, distinct basins)."""
    m = obs_mart(spark, sf_dir)
    m = FO.group_folds(m, "basin_id", K)
    flags = FX.regime_flags(F.month("ts"), "pet", "dist_main_km", m=1, pet_t=50.0, dist_t=498.1)
    m = m.withColumns({"is_m": flags["is_m12"], "is_pet_high": flags["is_pet_high"], "is_dist_high": flags["is_dist_high"]})
    out = AG.regime_support(m, ["is_m", "is_pet_high", "is_dist_high"], "fold", "basin_id", K)
    return out.select("regime", "n_rows", "n_groups", *[F.col(f"fold_{i}").cast("long").alias(f"fold_{i}") for i in range(K)],
                      F.col("zero_folds").cast("int").alias("zero_folds"), F.col("min_fold_rows").cast("long").alias("min_fold_rows"))
