"""What a query must not do as its tables grow, on rows built here."""

from pyspark.sql import functions as F

from limnospark.operators import blend as BL
from limnospark.plans import catalog

QUERIES = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_b8_rows_are_not_shuffled_by_model(spark):
    """Two models' rows in two tasks: the weights go to the rows instead."""
    rows = [(k, m, float(k)) for k in range(40) for m in ("rev", "gross", "anchor")] + [(None, "rev", 1.0), (3, None, 5.0), (4, "rev", None)]
    preds = spark.createDataFrame(rows, "o_orderkey long, model string, pred double")
    weights = spark.createDataFrame([("rev", 2.0), ("gross", 1.0), ("unused", 0.5)], "model string, weight double")
    out = BL.weighted_ensemble(preds, weights, "o_orderkey")
    assert "hashpartitioning(model" not in plan(out) and "SortMergeJoin" not in plan(out)
    got = {r["o_orderkey"]: r["pred"] for r in out.collect()}
    assert len(got) == 41 and got[7] == 7.0 and got[None] == 1.0
    assert abs(got[4] - (2 * 4.0 + 4.0) / 5) < 1e-12


def test_r8_joins_orders_and_lines_once(spark, tmp_path):
    """Its parts read the joined table, not orders and lineitem again."""
    n = 60
    spark.range(n).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"),
        (F.col("id") * 10.0).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3 * n + 20).select(
        (F.col("id") % n).alias("l_orderkey"), (F.col("id") % 5 + 1.0).alias("l_quantity"), (F.col("id") % 9 * 7.0).alias("l_extendedprice"),
        (F.col("id") % 4 / 100).alias("l_discount"), (F.col("id") % 3 / 100).alias("l_tax")).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["R8"](spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
    got = {(r["metric"], r["series"]): r["value"] for r in out.collect()}
    assert got["profile_count", "old"] == got["profile_count", "new"] == n
    assert got["profile_max", "old"] == 590.0
