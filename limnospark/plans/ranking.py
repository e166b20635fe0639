"""Ranks, bins and transforms on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as RK
from ..operators import transforms as TR
from .catalog import query
from .common import obs_mart, r, t, MART_SQL


@query(
    "D1",
    """
SELECT o_orderkey,
  (rank() OVER w + count(*) OVER w) / 2.0 AS rank_avg,
  CAST(rank() OVER w AS BIGINT) AS rank_min,
  CAST(count(*) OVER w AS BIGINT) AS rank_max,
  CAST(dense_rank() OVER w AS BIGINT) AS rank_dense,
  round(percent_rank() OVER w, 9) AS percent_rank
FROM orders WINDOW w AS (ORDER BY o_totalprice)
""",
)
def d1_rank(spark, sf_dir):
    """Distributed average / min / max / dense / percent rank."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rt = RK.rank_table(o, "o_totalprice")
    return o.join(rt, "o_totalprice").select(
        "o_orderkey",
        F.col("rank_avg"),
        F.col("rank_min").cast("long").alias("rank_min"),
        F.col("rank_max").cast("long").alias("rank_max"),
        F.col("rank_dense").cast("long").alias("rank_dense"),
        r("percent_rank", 9),
    )


@query(
    "W12",
    """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS shipdate,
  (rank() OVER w + count(*) OVER w) / 2.0 AS qty_rank,
  round(((rank() OVER w + count(*) OVER w) / 2.0) / count(*) OVER (), 9) AS qty_rank_pct
FROM lineitem WINDOW w AS (ORDER BY l_quantity)
""",
)
def w12_average_rank(spark, sf_dir):
    """Average-tie rank and rank / N of l_quantity over the whole table."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity")
    rt = RK.rank_table(li, "l_quantity").select("l_quantity", "rank_avg", "rank_pct")
    return li.join(rt, "l_quantity", "left").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("l_shipdate").cast("string").alias("shipdate"),
        F.col("rank_avg").alias("qty_rank"),
        r("rank_pct", 9).alias("qty_rank_pct"),
    )


@query(
    "W13",
    """
SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice DESC) AS BIGINT) AS price_rank_desc FROM part
""",
)
def w13_desc_rank(spark, sf_dir):
    """Min-tie descending rank."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return RK.with_desc_min_rank(p, "p_retailprice", "price_rank_desc").select(
        "p_partkey", F.col("price_rank_desc").cast("long").alias("price_rank_desc")
    )


@query(
    "T8",
    """
WITH q AS (SELECT list_distinct([quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5),
                                  quantile_cont(o_totalprice, 0.75)]) AS e FROM orders)
SELECT o_orderkey, CAST(len(list_filter(e, lambda x: o_totalprice > x)) AS BIGINT) AS price_band FROM orders, q
""",
)
def t8_quantile_bands(spark, sf_dir):
    """Quartile bands, right-closed, duplicate edges dropped."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return RK.quantile_bands(o, "o_totalprice", "price_band", 4).select("o_orderkey", "price_band")


_T8_SRC = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 7.0 ELSE o_totalprice END AS v FROM orders)"""


def _t8_names_sql() -> str:
    qs = ", ".join(f"quantile_cont(v, {p})" for p in (0, 0.25, 0.5, 0.75, 1))
    return f"""WITH s AS (SELECT * FROM {_T8_SRC}), e AS (SELECT o_orderstatus, list_sort(list_distinct([{qs}])) AS e FROM s GROUP BY o_orderstatus),
j AS (SELECT s.*, e.e, least(greatest(len(list_filter(e.e, lambda x: x < v)), 1), len(e.e) - 1) AS pos FROM s JOIN e USING (o_orderstatus))
SELECT o_orderkey, CASE WHEN len(e) < 2 THEN 'all' ELSE (CASE WHEN pos = 1 THEN '[' ELSE '(' END) || printf('%.4f', e[pos]) || ', ' || printf('%.4f', e[pos + 1]) || ']' END AS band FROM j"""


@query("T8_names", _t8_names_sql())
def t8_band_names(spark, sf_dir):
    """T8 with named bands per order status; orders of status P have one
    value, so they are in the one band 'all'."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.lit(7.0)).otherwise(F.col("o_totalprice").cast("double")).alias("v"))
    return RK.band_labels(o, "v", "band", 4, by=["o_orderstatus"]).select("o_orderkey", "band")


@query(
    "T9",
    """
WITH m AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey,
  CAST(least(coalesce(greatest(0, ceil((o_totalprice - mn) / nullif((mx - mn) / 6, 0)) - 1), 0), 5) AS BIGINT) AS price_bin
FROM orders, m
""",
)
def t9_equal_width(spark, sf_dir):
    """Six equal-width bins."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return RK.equal_width_bins(o, "o_totalprice", "price_bin", 6).select("o_orderkey", "price_bin")


@query(
    "G19",
    f"""
SELECT round(quantile_cont(lat, 0.5), 9) AS median_lat, round(quantile_cont(lon, 0.5), 9) AS median_lon,
       round(avg(lat), 9) AS mean_lat, round(avg(lon), 9) AS mean_lon
FROM {MART_SQL}
""",
)
def g19_global_scalars(spark, sf_dir):
    """Median and mean centre of the observations."""
    m = obs_mart(spark, sf_dir)
    med = RK.quantiles(m, "lat", [0.5], ["median_lat"]).crossJoin(RK.quantiles(m, "lon", [0.5], ["median_lon"]))
    mean = m.agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    return med.crossJoin(mean).select(*[r(c, 9) for c in ("median_lat", "median_lon", "mean_lat", "mean_lon")])


@query(
    "T1",
    """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS shipdate,
  round(least(greatest(l_extendedprice, lo), hi), 4) AS y_winsor
FROM lineitem, q
""",
)
def t1_winsor(spark, sf_dir):
    """Winsorise at the 1% / 99% train quantiles."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    out = TR.winsorize(li, li, "l_extendedprice", "y_winsor")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_shipdate").cast("string").alias("shipdate"),
                      r("y_winsor", 4))


@query(
    "T2",
    """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.95) AS p95, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders)
SELECT o_orderkey, round(least(o_totalprice, p95), 4) AS y_p95, round(least(o_totalprice, p99), 4) AS y_p99
FROM orders, q
""",
)
def t2_clip(spark, sf_dir):
    """Clip at p95 and p99."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    a = TR.clip_upper_quantile(o, o, "o_totalprice", "y_p95", 0.95)
    b = TR.clip_upper_quantile(o, a, "o_totalprice", "y_p99", 0.99)
    return b.select("o_orderkey", r("y_p95", 4), r("y_p99", 4))


@query(
    "T3_T6",
    """
SELECT o_orderkey,
  round(sqrt(greatest(o_totalprice - 100000, 0)), 6) AS y_sqrt,
  round(pow(sqrt(greatest(o_totalprice - 100000, 0)), 2), 4) AS y_sqrt_inv,
  round(ln(1 + greatest(o_totalprice - 100000, 0)), 9) AS y_log1p,
  round(exp(ln(1 + greatest(o_totalprice - 100000, 0))) - 1, 2) AS y_log1p_inv,
  round(greatest(o_totalprice - 100000, 0), 4) AS y_nonneg
FROM orders
""",
)
def t3_t6_transforms(spark, sf_dir):
    """Sqrt / log1p with inverses and the non-negative target, on a
    shifted target that has negative values."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("y"))
    return o.select(
        "o_orderkey",
        r(TR.sqrt_fwd("y"), 6).alias("y_sqrt"),
        r(TR.sqrt_inv(TR.sqrt_fwd("y")), 4).alias("y_sqrt_inv"),
        r(TR.log1p_fwd("y"), 9).alias("y_log1p"),
        r(TR.log1p_inv(TR.log1p_fwd("y")), 2).alias("y_log1p_inv"),
        r(TR.non_negative("y"), 4).alias("y_nonneg"),
    )


@query(
    "T7",
    """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.75) AS q75 FROM orders)
SELECT o_orderkey, CAST(coalesce(o_totalprice >= q75, false) AS INTEGER) AS is_high FROM orders, q
""",
)
def t7_high_low(spark, sf_dir):
    """High / low label at the train 75% quantile."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return TR.high_low_label(o, o, "o_totalprice", "is_high").select("o_orderkey", "is_high")


@query(
    "T10",
    """
WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer),
m AS (SELECT quantile_cont(bal, 0.5) AS med FROM b),
f AS (SELECT c_custkey, coalesce(bal, med) AS v FROM b, m),
s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM f)
SELECT c_custkey, round(CASE WHEN sd > 0 THEN (v - mu) / sd ELSE 0 END, 6) AS bal_z FROM f, s
""",
)
def t10_impute_scale(spark, sf_dir):
    """Train-median imputation and population standardisation."""
    cu = t(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("bal")
    )
    out = TR.median_impute_scale(cu, cu, ["bal"])
    return out.select("c_custkey", r("bal_z", 6))
