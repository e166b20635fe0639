"""Aggregate queries (G1-G18) and data-quality queries (Q1-Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import row_mean
from ..operators import aggregates as AG
from ..operators import quality as Q
from .catalog import query
from .common import PLACES_SQL, places, r, t


@query(
    "G1",
    """
SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS nation_mean_acctbal FROM customer
""",
)
def g1_group_mean_transform(spark, sf_dir):
    """G1: group mean broadcast back to the rows (aggregate + join)."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = AG.group_mean_transform(c, ["c_nationkey"], {"c_acctbal": "nation_mean_acctbal"})
    return out.select("c_custkey", r("nation_mean_acctbal", 6))


@query(
    "G3",
    """
WITH tr AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM tr GROUP BY o_orderpriority),
gl AS (SELECT avg(o_totalprice) AS gm FROM tr)
SELECT v.o_orderkey, round(coalesce(g.m, gl.gm), 4) AS basin_mean_o_totalprice
FROM orders v LEFT JOIN g ON v.o_orderpriority = g.o_orderpriority CROSS JOIN gl
WHERE v.o_orderstatus <> 'F'
""",
)
def g3_fitted_group_means(spark, sf_dir):
    """Group means fitted on the train side (status F), applied to the
    other rows with the global train mean as fallback."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    tr = o.where(F.col("o_orderstatus") == "F")
    va = o.where(F.col("o_orderstatus") != "F")
    fitted = AG.fit_group_means(tr, "o_orderpriority", ["o_totalprice"])
    out = AG.apply_group_means(va, "o_orderpriority", fitted, ["o_totalprice"])
    return out.select("o_orderkey", r("basin_mean_o_totalprice", 4))


@query(
    "G4",
    f"""
WITH p AS {PLACES_SQL},
c AS (SELECT basin_id, avg(lat) AS clat, avg(lon) AS clon FROM p WHERE basin_id IS NOT NULL GROUP BY basin_id)
SELECT p.station_id, round(sqrt(pow(p.lat - c.clat, 2) + pow(p.lon - c.clon, 2)), 6) AS dist_to_centroid
FROM p LEFT JOIN c USING (basin_id)
""",
)
def g4_centroid_distance(spark, sf_dir):
    """Distance to the own basin's train centroid."""
    p = places(spark, sf_dir)
    out = AG.dist_to_centroid(p, p, "basin_id", "lat", "lon")
    return out.select("station_id", r("dist_to_centroid", 6))


@query(
    "G5",
    """
WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT e.event_id, CAST(coalesce(c.n, 0) AS BIGINT) AS station_obs_count FROM events e LEFT JOIN c USING (user_id)
""",
)
def g5_station_count(spark, sf_dir):
    """Station observation count from the train side (non-error
    events), 0 when unseen."""
    ev = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    tr = ev.where(F.col("event_type") != "error")
    return AG.station_count(tr, ev, ["user_id"]).select("event_id", "station_obs_count")


@query(
    "G6",
    """
WITH top AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k
             FROM events WHERE event_type IS NOT NULL GROUP BY event_type)
SELECT e.event_id,
  coalesce(CAST(e.event_type = (SELECT event_type FROM top WHERE k = 1) AS INTEGER), 0) AS top1,
  coalesce(CAST(e.event_type = (SELECT event_type FROM top WHERE k = 2) AS INTEGER), 0) AS top2,
  coalesce(CAST(e.event_type = (SELECT event_type FROM top WHERE k = 3) AS INTEGER), 0) AS top3
FROM events e
""",
)
def g6_top_n_onehot(spark, sf_dir):
    """One-hot of the 3 most frequent categories fitted on train (named
    by frequency position)."""
    ev = t(spark, sf_dir, "events").select("event_id", "event_type")
    cats = AG.top_n_categories(ev, "event_type", 3)
    out = AG.one_hot(ev, "event_type", cats, prefix="_oh_")
    return out.select("event_id", *[F.col(f"_oh_{v}").alias(f"top{i + 1}") for i, v in enumerate(cats)])


@query(
    "G7",
    """
SELECT DISTINCT lat, lon FROM (
  SELECT -35.0::DOUBLE + CAST((c_custkey * 37) % 1000 AS DOUBLE) / 100.0 AS lat,
         20.0::DOUBLE + CAST((c_custkey * 91) % 1000 AS DOUBLE) / 100.0 AS lon FROM customer
  UNION ALL
  SELECT -35.0::DOUBLE + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 100.0,
         20.0::DOUBLE + CAST((s_suppkey * 91) % 1000 AS DOUBLE) / 100.0 FROM supplier)
""",
)
def g7_distinct_points(spark, sf_dir):
    """Distinct coordinates of two tables."""
    from ..functions.geo import synth_lat, synth_lon

    a = t(spark, sf_dir, "customer").select(synth_lat("c_custkey").alias("lat"), synth_lon("c_custkey").alias("lon"))
    b = t(spark, sf_dir, "supplier").select(synth_lat("s_suppkey").alias("lat"), synth_lon("s_suppkey").alias("lon"))
    return AG.distinct_points(a, b)


@query(
    "G8",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
""",
)
def g8_keep_first(spark, sf_dir):
    """One row per key, the first by declared order (min_by aggregate)."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return AG.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "G9",
    """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 9) AS mean, min(l_quantity) AS min, count(l_quantity) AS count
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
def g9_multi_aggregate(spark, sf_dir):
    """Mean, first (min) and count per group."""
    li = t(spark, sf_dir, "lineitem")
    g = AG.group_profile(li, ["l_returnflag", "l_linestatus"], "l_quantity")
    return g.select("l_returnflag", "l_linestatus", r("mean", 9), "min", "count")


@query(
    "G10",
    """
SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean, count(l_extendedprice) AS count
FROM lineitem GROUP BY l_suppkey ORDER BY avg(l_extendedprice) DESC NULLS LAST, l_suppkey LIMIT 25
""",
)
def g10_top_groups(spark, sf_dir):
    """Mean and count per group, top 25 by mean."""
    li = t(spark, sf_dir, "lineitem")
    g = AG.group_profile(li, ["l_suppkey"], "l_extendedprice", top=25)
    return g.select("l_suppkey", r("mean", 4), "count")


@query(
    "G11",
    """
SELECT prio, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS count FROM (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS prio, o_totalprice FROM orders)
GROUP BY prio
""",
)
def g11_null_group(spark, sf_dir):
    """Group mean keeping the NULL group."""
    o = t(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")).alias("prio"),
        "o_totalprice",
    )
    return AG.group_profile(o, ["prio"], "o_totalprice").select("prio", r("mean", 4), "count")


_PCT = AG.PROFILE_PERCENTILES
_PNAMES = [f"p{int(round(p * 100)):02d}" for p in _PCT]


@query(
    "G12",
    "SELECT stat, round(value, 4) AS value FROM (SELECT "
    + ", ".join(
        ["CAST(count(o_totalprice) AS DOUBLE) AS count", "min(o_totalprice) AS min", "max(o_totalprice) AS max",
         "avg(o_totalprice) AS mean", "quantile_cont(o_totalprice, 0.5) AS median", "stddev_samp(o_totalprice) AS std"]
        + [f"quantile_cont(o_totalprice, {p}) AS {n}" for p, n in zip(_PCT, _PNAMES)]
    )
    + " FROM orders) UNPIVOT (value FOR stat IN (count, min, max, mean, median, std, "
    + ", ".join(_PNAMES)
    + "))",
)
def g12_vector_profile(spark, sf_dir):
    """Min, max, mean, median, std and 9 percentiles as rows."""
    o = t(spark, sf_dir, "orders").select("o_totalprice")
    return AG.vector_profile(o, "o_totalprice").select("stat", r("value", 4))


@query(
    "G13",
    """
WITH d AS (SELECT o.o_orderkey, v.rev - o.o_totalprice AS delta FROM orders o JOIN
  (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev FROM lineitem GROUP BY l_orderkey) v
  ON o.o_orderkey = v.l_orderkey)
SELECT stat, round(value, 4) AS value FROM (
  SELECT avg(abs(delta)) AS mean_abs, max(delta) AS max, min(delta) AS min, stddev_samp(delta) AS std FROM d)
UNPIVOT (value FOR stat IN (mean_abs, max, min, std))
""",
)
def g13_delta_profile(spark, sf_dir):
    """Mean absolute, max, min and std of a prediction delta."""
    li = t(spark, sf_dir, "lineitem")
    rev = li.groupBy("l_orderkey").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("rev"))
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    d = o.join(rev, "l_orderkey").select((F.col("rev") - F.col("o_totalprice")).alias("delta"))
    return AG.delta_profile(d, "delta").select("stat", r("value", 4))


_G14_SRC = """(SELECT o.o_orderkey, c.c_mktsegment, v.revenue,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE o.o_orderpriority END AS prio
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS revenue FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) v
ON o.o_orderkey = v.l_orderkey)"""


@query(
    "G14",
    f"""
SELECT "column", round(missing_rate, 9) AS missing_rate FROM (
  SELECT avg(CASE WHEN o_orderkey IS NULL THEN 1.0 ELSE 0.0 END) AS o_orderkey,
         avg(CASE WHEN c_mktsegment IS NULL THEN 1.0 ELSE 0.0 END) AS c_mktsegment,
         avg(CASE WHEN revenue IS NULL THEN 1.0 ELSE 0.0 END) AS revenue,
         avg(CASE WHEN prio IS NULL THEN 1.0 ELSE 0.0 END) AS prio FROM {_G14_SRC})
UNPIVOT (missing_rate FOR "column" IN (o_orderkey, c_mktsegment, revenue, prio))
""",
)
def g14_missing_rates(spark, sf_dir):
    """Missing-rate profile of a mart, sorted (top 20)."""
    o = t(spark, sf_dir, "orders")
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    li = t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    v = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("revenue"))
    m = o.join(c, "o_custkey", "left").join(v, "o_orderkey", "left").select(
        "o_orderkey", "c_mktsegment", "revenue",
        F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")).alias("prio"),
    )
    return AG.missing_rates(m, top=20).select("column", r("missing_rate", 9))


@query(
    "G15",
    """
SELECT round(avg(CASE WHEN v.l_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS coverage
FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') v ON o.o_orderkey = v.l_orderkey
""",
)
def g15_coverage(spark, sf_dir):
    """Coverage ratio of a joined column."""
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    v = t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("hit")).distinct()
    return o.join(v, "o_orderkey", "left").agg(r(AG.coverage("hit"), 9).alias("coverage"))


@query(
    "G17",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""",
)
def g17_latest_per_key(spark, sf_dir):
    """Latest row per key by an ordinal (max_by)."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return AG.latest_per_key(o, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "G18",
    """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS shipdate,
  round(CASE WHEN n = 0 THEN NULL ELSE s / n END, 6) AS cv_mean
FROM (SELECT *,
  coalesce(l_discount, 0) + coalesce(l_tax, 0) + coalesce(CASE WHEN l_returnflag = 'R' THEN l_discount * 2 END, 0) AS s,
  (l_discount IS NOT NULL)::INT + (l_tax IS NOT NULL)::INT + (l_returnflag = 'R')::INT AS n FROM lineitem)
""",
)
def g18_row_mean(spark, sf_dir):
    """Row mean of several columns skipping missing values."""
    li = t(spark, sf_dir, "lineitem").withColumn(
        "extra", F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 2)
    )
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_shipdate").cast("string").alias("shipdate"),
        r(row_mean(["l_discount", "l_tax", "extra"]), 6).alias("cv_mean"),
    )


# -------------------------------------------------------------------------
# Data quality
# -------------------------------------------------------------------------

_Q1_SQL = """
SELECT '{name}' AS table_name, count(*) AS n_rows,
  count(*) FILTER (WHERE {nullcond}) AS n_null_keys,
  (SELECT count(*) FROM (SELECT {keys} FROM {name} GROUP BY {keys} HAVING count(*) > 1)) AS dup_keys,
  (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {name} GROUP BY {keys} HAVING count(*) > 1)) AS dup_rows
FROM {name}"""


@query("Q1", _Q1_SQL.format(name="lineitem", keys="l_orderkey, l_linenumber",
                            nullcond="l_orderkey IS NULL OR l_linenumber IS NULL"))
def q1_duplicate_keys(spark, sf_dir):
    """Q1 (+Q2): duplicate-key groups and rows, NULL keys, row count."""
    li = t(spark, sf_dir, "lineitem")
    return Q.key_integrity(li, ["l_orderkey", "l_linenumber"], "lineitem").select(
        "table_name", "n_rows", "n_null_keys", "dup_keys", F.col("dup_rows").cast("long").alias("dup_rows")
    )


@query("Q2", _Q1_SQL.format(name="orders", keys="o_custkey, o_orderdate",
                            nullcond="o_custkey IS NULL OR o_orderdate IS NULL"))
def q2_null_keys(spark, sf_dir):
    """Q2: NULL-key and row counts (with Q1 on the same keys)."""
    o = t(spark, sf_dir, "orders")
    return Q.key_integrity(o, ["o_custkey", "o_orderdate"], "orders").select(
        "table_name", "n_rows", "n_null_keys", "dup_keys", F.col("dup_rows").cast("long").alias("dup_rows")
    )


@query(
    "Q3",
    """
WITH c AS (
  SELECT 'lineitem_rows' AS check_name, CAST(count(*) AS DOUBLE) AS value, 1.0 AS lo, NULL::DOUBLE AS hi FROM lineitem
  UNION ALL SELECT 'orders_rows', CAST(count(*) AS DOUBLE), 1.0, NULL FROM orders
  UNION ALL SELECT 'lineitem_dup_keys', CAST((SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS DOUBLE), 0.0, 0.0
  UNION ALL SELECT 'price_max', max(o_totalprice), 0.0, 1e7 FROM orders),
v AS (SELECT *, CASE WHEN value IS NULL THEN 'FAIL' WHEN coalesce(value >= lo, true) AND coalesce(value <= hi, true) THEN 'PASS' ELSE 'FAIL' END AS status FROM c)
SELECT check_name, value, status,
  CASE WHEN (SELECT count(*) FILTER (WHERE status = 'PASS') FROM v) = (SELECT count(*) FROM v) THEN 'PASS'
       WHEN (SELECT count(*) FILTER (WHERE status = 'PASS') FROM v) = 0 THEN 'FAIL' ELSE 'PARTIAL' END AS overall
FROM v
""",
)
def q3_range_verdict(spark, sf_dir):
    """Q3: range verdict per check and overall PASS / PARTIAL / FAIL."""
    li = t(spark, sf_dir, "lineitem")
    o = t(spark, sf_dir, "orders")
    checks = (
        li.agg(F.lit("lineitem_rows").alias("check_name"), F.count(F.lit(1)).cast("double").alias("value"),
               F.lit(1.0).alias("lo"), F.lit(None).cast("double").alias("hi"))
        .unionByName(o.agg(F.lit("orders_rows").alias("check_name"), F.count(F.lit(1)).cast("double").alias("value"),
                           F.lit(1.0).alias("lo"), F.lit(None).cast("double").alias("hi")))
        .unionByName(
            Q.duplicate_keys(li.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).agg(
                F.lit("lineitem_dup_keys").alias("check_name"), F.count(F.lit(1)).cast("double").alias("value"),
                F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
        )
        .unionByName(o.agg(F.lit("price_max").alias("check_name"), F.max("o_totalprice").alias("value"),
                           F.lit(0.0).alias("lo"), F.lit(1e7).alias("hi")))
    )
    v = Q.range_verdict(checks)
    overall = Q.overall_verdict(v).select("overall")
    return v.crossJoin(overall).select("check_name", "value", "status", "overall")


@query(
    "Q4",
    """
WITH p AS (SELECT o.o_orderkey AS row_id, o.o_orderkey, v.rev AS pred FROM orders o
           LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) - 1000 AS rev
                      FROM lineitem GROUP BY l_orderkey) v ON o.o_orderkey = v.l_orderkey)
SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE pred IS NULL) AS rows_with_null,
  count(*) FILTER (WHERE pred < 0) AS rows_negative,
  CAST(0 AS BIGINT) AS rows_not_in_template, CAST(0 AS BIGINT) AS template_rows_missing,
  (SELECT count(*) FROM orders) AS template_rows, true AS columns_in_order,
  count(*) FILTER (WHERE pred IS NULL) = 0 AND count(*) FILTER (WHERE pred < 0) = 0 AS passed
FROM p
""",
)
def q4_output_contract(spark, sf_dir):
    """Q4: output contract of a prediction table against its template."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey")
    li = t(spark, sf_dir, "lineitem")
    rev = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4) - 1000).alias("pred")
    )
    out = o.join(rev, "o_orderkey", "left").select("row_id", "o_orderkey", "pred")
    return Q.output_contract(out, o, ["o_orderkey"], "row_id", ["pred"], ["pred"]).select(
        "n_rows", "rows_with_null", "rows_negative", "rows_not_in_template", "template_rows_missing",
        "template_rows", "columns_in_order", "passed"
    )


def _q5_sql() -> str:
    from .catalog import _SQL
    from . import marts  # noqa: F401  (registers J1 / J2)

    a, b = _SQL["J1"], _SQL["J2"]
    def side(sql: str) -> str:
        return f"""(SELECT c, n / (SELECT count(*) FROM ({sql})) AS f
  FROM (UNPIVOT (SELECT count(COLUMNS(*)) AS "\\0" FROM ({sql})) ON COLUMNS(*) INTO NAME c VALUE n))"""

    return f"""SELECT coalesce(a.c, b.c) AS "column", a.c IS NOT NULL AS in_a, b.c IS NOT NULL AS in_b,
  round(a.f, 9) AS filled_a, round(b.f, 9) AS filled_b
FROM {side(a)} a FULL OUTER JOIN {side(b)} b ON a.c = b.c"""


@query("Q5", _q5_sql())
def q5_column_parity(spark, sf_dir):
    """Q5: train / valid column parity: which side has a column, and the share
    of rows that hold a value."""
    from .marts import j1_train_mart, j2_valid_mart

    p = Q.column_parity(j1_train_mart(spark, sf_dir), j2_valid_mart(spark, sf_dir))
    return p.select("column", "in_a", "in_b", r("filled_a", 9), r("filled_b", 9))


@query(
    "Q6",
    """
SELECT 'orders' AS file, 6 AS n_cols, count(*) AS n_rows,
  count(*) FILTER (WHERE o_orderkey IS NULL) + count(*) FILTER (WHERE o_custkey IS NULL)
  + count(*) FILTER (WHERE o_totalprice IS NULL) AS n_null_cells,
  least(min(CAST(o_orderkey AS DOUBLE)), min(CAST(o_custkey AS DOUBLE)), min(o_totalprice)) AS min_value,
  greatest(max(CAST(o_orderkey AS DOUBLE)), max(CAST(o_custkey AS DOUBLE)), max(o_totalprice)) AS max_value
FROM orders
""",
)
def q6_file_profile(spark, sf_dir):
    """Q6: file profile (shape, NULL cells, min, max)."""
    o = t(spark, sf_dir, "orders")
    return Q.file_profile(o, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).select(
        "file", F.col("n_cols").cast("int").alias("n_cols"), "n_rows", "n_null_cells", "min_value", "max_value"
    )
