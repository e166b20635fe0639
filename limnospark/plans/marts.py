"""Marts, joins, schema operators (J1-J9, P1-P14) on lineitem / orders /
customer / part / supplier / events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as KY
from ..operators import joins as J
from ..operators import schema as S
from .catalog import query
from .common import PET_SQL, r, t

LI_KEY = ["l_orderkey", "l_partkey", "l_linenumber"]


def _shipdate():
    return F.col("l_shipdate").cast("string").alias("shipdate")


@query(
    "J1",
    """
SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, CAST(l.l_shipdate AS VARCHAR) AS shipdate,
  o.o_custkey, c.c_nationkey, c.c_mktsegment, p.p_brand, s.s_nationkey,
  round(l.l_extendedprice * (1 - l.l_discount), 4) AS revenue
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
""",
)
def j1_train_mart(spark, sf_dir):
    """Inner, inner, left, left mart (fact -> dimensions)."""
    li = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    m = J.mart(li, [(o, ["o_orderkey"], "inner"), (c, ["o_custkey"], "inner"), (p, ["l_partkey"], "left"),
                    (s, ["l_suppkey"], "left")])
    return m.select(
        F.col("o_orderkey").alias("l_orderkey"), "l_partkey", "l_linenumber", _shipdate(), "o_custkey",
        "c_nationkey", "c_mktsegment", "p_brand", "s_nationkey",
        r(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"),
    )


def _order_revenue(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
    )


ORDER_REV_SQL = """(SELECT l_orderkey AS o_orderkey, count(*) AS n_lines,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_orderkey)"""


@query(
    "J2",
    f"""
SELECT o.o_orderkey AS row_id, c.c_mktsegment, CAST(coalesce(v.n_lines, 0) AS BIGINT) AS n_lines, v.revenue
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN {ORDER_REV_SQL} v ON o.o_orderkey = v.o_orderkey
""",
)
def j2_valid_mart(spark, sf_dir):
    """Every template row kept (left joins from the template)."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    m = J.mart(o, [(c, ["o_custkey"], "left"), (_order_revenue(spark, sf_dir), ["o_orderkey"], "left")])
    return m.select(F.col("o_orderkey").alias("row_id"), "c_mktsegment",
                    F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "revenue")


@query(
    "J3",
    f"""
SELECT o.o_orderkey AS row_id, o.o_custkey, v.revenue AS pred
FROM orders o LEFT JOIN {ORDER_REV_SQL} v ON o.o_orderkey = v.o_orderkey
""",
)
def j3_realign(spark, sf_dir):
    """Prediction table re-aligned onto the template keys."""
    tpl = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", "o_custkey")
    pred = _order_revenue(spark, sf_dir).select("o_orderkey", F.col("revenue").alias("pred"))
    return J.realign(pred, tpl, ["o_orderkey"], "row_id").select("row_id", "o_custkey", "pred")


@query(
    "J4",
    """
SELECT o.o_orderkey, c.c_nationkey, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""",
)
def j4_checked_join(spark, sf_dir):
    """Many-to-one join with the uniqueness of the right key asserted."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    return J.checked_join(o, c, ["k"], "left", "many_to_one").select("o_orderkey", "c_nationkey", "c_mktsegment")


@query(
    "J5",
    f"""
WITH m AS (SELECT event_id, user_id, ts, value FROM events),
a AS (SELECT event_id, user_id, ts,
        round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS rain_7d_sum
      FROM events),
b AS (SELECT event_id, user_id, ts, {PET_SQL} AS pet FROM events)
SELECT m.event_id, m.value, a.rain_7d_sum, b.pet
FROM m LEFT JOIN a USING (user_id, ts, event_id) LEFT JOIN b USING (user_id, ts, event_id)
""",
)
def j5_versioned_mart(spark, sf_dir):
    """Base mart left-joined to two feature tables on the 3 keys."""
    from ..operators import windows as W
    from .common import pet_expr, split_rows

    ev = t(spark, sf_dir, "events")
    keys = ["user_id", "ts", "event_id"]
    s = W.series(ev.select(*keys, "value"), ["user_id"], ["ts", "event_id"], 7, split_rows(spark))
    a = s.finish(s.frame.select(*s.frame.columns, r(W.prior_sum(s, "value", 7), 6).alias("rain_7d_sum"))).drop("value")
    b = ev.select(*keys, pet_expr().alias("pet"))
    m = J.mart(ev.select(*keys, "value"), [(a, keys, "left"), (b, keys, "left")])
    return m.select("event_id", "value", "rain_7d_sum", "pet")


@query(
    "J7",
    """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""",
)
def j7_new_rows(spark, sf_dir):
    """Rows whose key is not present yet (anti join)."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return J.new_rows(c, o, ["k"]).select(F.col("k").alias("c_custkey"), "c_name")


@query(
    "J8",
    """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AS has_orders FROM customer
""",
)
def j8_exists_flag(spark, sf_dir):
    """Exists flag as a column (join on distinct ids)."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return J.exists_flag(c, o, ["k"], "has_orders").select(F.col("k").alias("c_custkey"), "has_orders")


@query(
    "J9",
    """
SELECT p_partkey, p_brand, round(CASE WHEN p_size > 40 THEN p_retailprice * 1.1 ELSE p_retailprice END, 4) AS p_retailprice
FROM part
""",
)
def j9_upsert(spark, sf_dir):
    """Upsert by id (updated rows replace their key, others kept)."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    upd = p.where(F.col("p_size") > 40).withColumn("p_retailprice", F.col("p_retailprice") * 1.1)
    return J.upsert(p, upd, ["p_partkey"]).select("p_partkey", "p_brand", r("p_retailprice", 4))


# -------------------------------------------------------------------------
# Schema / projection operators
# -------------------------------------------------------------------------

_P1_TEXT = """(SELECT o_orderkey,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y')
                      WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'not a date' END AS date_text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_totalprice / 7.0 AS VARCHAR) END AS lat_text
FROM orders)"""


@query(
    "P1",
    f"""
SELECT o_orderkey,
  CAST(CAST(CASE WHEN regexp_matches(trim(date_text), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')
       THEN try_strptime(substr(trim(date_text), 1, 10), '%Y-%m-%d')
       ELSE try_strptime(substr(trim(date_text), 1, 10), '%d-%m-%Y') END AS DATE) AS VARCHAR) AS sample_date,
  round(TRY_CAST(lat_text AS DOUBLE), 8) AS lat
FROM {_P1_TEXT}
""",
)
def p1_key_normalisation(spark, sf_dir):
    """Two date layouts, lenient numeric cast rounded to 8 digits."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    txt = o.select(
        "o_orderkey",
        F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy"))
        .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.lit("not a date"))
        .alias("date_text"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a"))
        .otherwise((F.col("o_totalprice") / 7.0).cast("string"))
        .alias("lat_text"),
    )
    out = txt.select(
        "o_orderkey",
        KY.parse_date("date_text").cast("string").alias("sample_date"),
        r(F.col("lat_text").try_cast("double"), 8).alias("lat"),
    )
    return out


@query(
    "P2",
    """
SELECT p_partkey AS P_PARTKEY, p_name AS P_NAME, p_brand AS P_BRAND, p_type AS P_TYPE, p_size AS P_SIZE,
  p_retailprice AS P_RETAIL_PRICE FROM part
""",
)
def p2_column_names(spark, sf_dir):
    """Strip, upper-case, space / '-' / '/' -> '_'."""
    p = t(spark, sf_dir, "part").toDF(" p partkey", "p-name", "p/brand", "p type ", "p size", "p retail-price")
    return KY.normalize_column_names(p)


@query("P4", "SELECT * EXCLUDE (l_shipdate, l_returnflag, l_linestatus) FROM lineitem")
def p4_exclude(spark, sf_dir):
    """Projection excluding columns (SELECT * EXCEPT)."""
    return S.exclude(t(spark, sf_dir, "lineitem"), ["l_shipdate", "l_returnflag", "l_linestatus"])


@query(
    "P5",
    """
SELECT o.o_orderkey, o.o_custkey AS custkey, c.c_nationkey
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""",
)
def p5_dedupe_columns(spark, sf_dir):
    """P5: after a join on an expression both sides keep ``custkey``; the
    first one is kept."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    j = o.join(c, o["custkey"] == c["custkey"])
    return S.dedupe_columns(j)


@query(
    "P6",
    """
SELECT o_orderkey, k FROM (
  SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k FROM orders)
WHERE k IS NOT NULL
""",
)
def p6_null_key_filter(spark, sf_dir):
    """Rows with a NULL key dropped."""
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_custkey")).alias("k")
    )
    return J.drop_null_keys(o, ["k"])


@query(
    "P7",
    """
SELECT l_extendedprice, l_quantity, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax FROM lineitem
""",
)
def p7_numeric_selection(spark, sf_dir):
    """Numeric columns selected by type, priority names first."""
    li = t(spark, sf_dir, "lineitem")
    cols = S.numeric_features(li, priority=("l_extendedprice", "l_quantity"))
    return li.select(*cols)


_P8_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "price_if_returned"]
_P8_SRC = """(SELECT *, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS price_if_returned FROM lineitem)"""


@query(
    "P8",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing_share,
  round(log10(var_samp({c})), 9) AS log10_variance,
  (avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.4 AND coalesce(var_samp({c}) > 1e-6, false)) AS kept
FROM {_P8_SRC}"""
        for c in _P8_FEATS
    ),
)
def p8_prune(spark, sf_dir):
    """Keep features with missing share <= 0.40 and variance > 1e-6
    (one aggregate over all candidates)."""
    li = t(spark, sf_dir, "lineitem").withColumn(
        "price_if_returned", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    )
    p = S.prune_features(li, _P8_FEATS)
    return p.select("feature", r("missing_share", 9), r(F.log10("variance"), 9).alias("log10_variance"), "kept")


@query(
    "P9_P11",
    """
SELECT o_orderkey,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END IS NULL AS INTEGER) AS isna_price,
  CAST(NULL AS DOUBLE) AS pet_lag1
FROM orders
""",
)
def p9_p11_flags(spark, sf_dir):
    """Missing flags; P11: absent columns added as NULL."""
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", None).otherwise(F.col("o_totalprice")).alias("price")
    )
    o = S.missing_flags(o, ["price", "not_there"])
    o = S.add_missing(o, ["pet_lag1"])
    return o.select("o_orderkey", "isna_price", "pet_lag1")


@query(
    "P12",
    """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""",
)
def p12_filter(spark, sf_dir):
    """Filter by status and membership (pushed into the scan)."""
    o = t(spark, sf_dir, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey"
    )


@query(
    "P13",
    """
SELECT event_id,
  TRY_CAST(coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.K'), '-1') AS BIGINT) AS k,
  coalesce(json_extract_string(props, '$.model_family'), 'unknown') AS model_family
FROM events
""",
)
def p13_json_paths(spark, sf_dir):
    """JSON path extraction with fallback paths and defaults."""
    ev = t(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.K"), F.lit("-1"))
        .try_cast("long")
        .alias("k"),
        F.coalesce(F.get_json_object("props", "$.model_family"), F.lit("unknown")).alias("model_family"),
    )


# Two score lines and a line of another kind per text, both signs in use.
_P14_TEXT = """(SELECT l_returnflag, 'start of run ' || l_returnflag || chr(10)
  || 'Flag ' || l_returnflag || ' | mean=' || printf('%.4f', avg(l_discount)) || ' ± ' || printf('%.4f', stddev_pop(l_discount))
  || ' | folds=[' || printf('%.4f', min(l_discount)) || ' ' || printf('%.4f', max(l_discount)) || ']' || chr(10)
  || 'Tax ' || l_returnflag || ' | mean=' || printf('%.4f', avg(l_tax)) || ' +/- ' || printf('%.4f', stddev_pop(l_tax))
  || ' | folds=[' || printf('%.4f', min(l_tax)) || ' ' || printf('%.4f', avg(l_tax)) || ' ' || printf('%.4f', max(l_tax)) || ']' AS txt
FROM lineitem GROUP BY l_returnflag)"""


@query(
    "P14",
    f"""
WITH l AS (SELECT unnest(string_split(txt, chr(10))) AS line FROM {_P14_TEXT}),
m AS (SELECT line FROM l WHERE contains(line, '| mean='))
SELECT trim(string_split(line, '|')[1]) AS target,
  CAST(regexp_extract(line, 'mean=([-0-9.]+)', 1) AS DOUBLE) AS mean,
  CAST(regexp_extract(line, '(?:±|\\+/-) *([-0-9.]+)', 1) AS DOUBLE) AS std,
  CAST(len(string_split(regexp_extract(line, 'folds=\\[([^\\]]*)\\]', 1), ' ')) AS BIGINT) AS n_folds
FROM m
""",
)
def p14_metric_lines(spark, sf_dir):
    """Parse score lines (target, mean, std, fold list) from texts that
    hold several lines, others among them."""
    li = t(spark, sf_dir, "lineitem")
    num = lambda c: F.format_string("%.4f", c)
    d, x = "l_discount", "l_tax"
    texts = li.groupBy("l_returnflag").agg(F.concat(
        F.lit("start of run "), F.col("l_returnflag"),
        F.lit("\nFlag "), F.col("l_returnflag"), F.lit(" | mean="), num(F.avg(d)), F.lit(" ± "), num(F.stddev_pop(d)),
        F.lit(" | folds=["), num(F.min(d)), F.lit(" "), num(F.max(d)),
        F.lit("]\nTax "), F.col("l_returnflag"), F.lit(" | mean="), num(F.avg(x)), F.lit(" +/- "), num(F.stddev_pop(x)),
        F.lit(" | folds=["), num(F.min(x)), F.lit(" "), num(F.avg(x)), F.lit(" "), num(F.max(x)), F.lit("]"),
    ).alias("txt"))
    from ..sources.artifacts import parse_metric_lines

    return parse_metric_lines(texts, "txt").drop("folds")


@query(
    "J6",
    """
SELECT c.c_custkey, coalesce(s.n_suppliers, 0) AS n_suppliers_in_nation
FROM customer c LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) s
ON c.c_nationkey = s.s_nationkey
""",
)
def j6_lookup_default(spark, sf_dir):
    """Lookup map with a default (left join to a small grouped table +
    coalesce)."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    s = t(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).groupBy(F.col("s_nationkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_suppliers"))
    return J.lookup(c, s, ["k"], {"n_suppliers": "n_suppliers_in_nation"}, default=0).select("c_custkey", "n_suppliers_in_nation")
