"""Distributed ranks and exact quantiles.

A global ``rank().over(Window.orderBy(x))`` runs in ONE task, and the exact
``percentile`` aggregate keeps every distinct value of a group in one buffer.
Neither survives a large table. D1 instead:

1. collapses the column to (value, n) pairs (map-side combined, so a value
   that holds a third of all rows costs one row), in one pass over the input;
2. deals the distinct values into ranges, as many as there are shuffle
   partitions, and writes the table once to the shared folder: every later
   step reads the same ranges, also after an executor is lost;
3. totals per range are prefix-summed, and the cumulative count inside a range
   is a window partitioned by range.

Exact quantiles read the two order statistics around ``(N-1)p`` from the
cumulative table (linear interpolation, same as numpy / DuckDB
``quantile_cont`` / Spark ``percentile``). Callers that need several results
of one column make the table once and hand it on as ``cc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def value_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n) with NULL values dropped."""
    by = by or []
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))


def cumulative_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values of ``col`` (within ``by``) with ``_n`` (rows holding
    the value), ``_cum`` (rows with value <= it), ``_dense`` (dense rank) and
    ``_total`` (non-NULL rows). ``by`` columns must not be NULL."""
    by = by or []
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    vc = value_counts(df, col, by).repartitionByRange(n, *by, col).withColumn("_b", F.spark_partition_id())
    vc = materialize(vc, "counts")
    tot = vc.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_bd"))
    all_ranges = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row per range and group
    before = all_ranges.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *by, "_b",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_bd").over(before), F.lit(0)).alias("_doff"),
        F.sum("_bn").over(all_ranges).alias("_total"),
    )
    w = Window.partitionBy(*by, "_b").orderBy(col)
    return vc.join(tot if by else F.broadcast(tot), [*by, "_b"]).select(
        *by, col, "_n",
        (F.col("_off") + F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("_cum"),
        (F.col("_doff") + F.row_number().over(w)).alias("_dense"),
        "_total",
    )


def rank_table(df: DataFrame, col: str, by: list[str] | None = None, cc: DataFrame | None = None) -> DataFrame:
    """(by,) value -> average / min / max / dense rank, percent rank (0-1) and
    pandas ``rank(pct=True)`` (average rank over N)."""
    cc = cc or cumulative_counts(df, col, by)
    avg = F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0
    return cc.select(
        *(by or []), col,
        avg.alias("rank_avg"),
        (F.col("_cum") - F.col("_n") + 1).alias("rank_min"),
        F.col("_cum").alias("rank_max"),
        F.col("_dense").alias("rank_dense"),
        F.when(F.col("_total") > 1, (F.col("_cum") - F.col("_n")) / (F.col("_total") - 1)).otherwise(F.lit(0.0)).alias(
            "percent_rank"
        ),
        (avg / F.col("_total")).alias("rank_pct"),
        F.col("_total").alias("n_valid"),
    )


def with_rank(df: DataFrame, col: str, out: str = "rank", method: str = "avg"):
    """Add the rank of ``col`` (NULL stays NULL). ``method`` is one
    of avg, min, max, dense, pct (average rank / N), percent (0-1)."""
    name = {"avg": "rank_avg", "min": "rank_min", "max": "rank_max", "dense": "rank_dense",
            "pct": "rank_pct", "percent": "percent_rank"}[method]
    rt = rank_table(df, col).select(col, F.col(name).alias(out))
    return df.join(rt, col, "left")


def with_desc_min_rank(df: DataFrame, col: str, out: str = "rank"):
    """Descending rank with ties sharing the smallest rank
    (1 + rows with a larger value); NULL stays NULL."""
    cc = cumulative_counts(df, col)
    rt = cc.select(col, (F.col("_total") - F.col("_cum") + 1).alias(out))
    return df.join(rt, col, "left")


def quantiles(df: DataFrame, col: str, probs: list[float], names: list[str] | None = None,
              cc: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """One-row DataFrame of exact linear quantiles of ``col`` (NULLs
    ignored); a row per group with ``by``. Columns are ``names`` (default q0,
    q1, ...)."""
    names = names or [f"q{i}" for i in range(len(probs))]
    cc = cc or cumulative_counts(df, col, by)
    picks = []
    for p in probs:
        h = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        picks.append((h, lo, hi))
    cond = F.lit(False)
    for _, lo, hi in picks:
        for k in (lo, hi):
            cond = cond | ((F.col("_cum") - F.col("_n") <= k) & (k < F.col("_cum")))
    sel = cc.where(cond)  # at most 2 rows per probability
    aggs = []
    for (h, lo, hi), nm in zip(picks, names):
        vlo = F.max(F.when((F.col("_cum") - F.col("_n") <= lo) & (lo < F.col("_cum")), F.col(col)))
        vhi = F.max(F.when((F.col("_cum") - F.col("_n") <= hi) & (hi < F.col("_cum")), F.col(col)))
        frac = F.max(h - lo)
        aggs.append((vlo.cast("double") + frac * (vhi.cast("double") - vlo.cast("double"))).alias(nm))
    return sel.groupBy(*(by or [])).agg(*aggs)


def quantile_bands(df: DataFrame, col: str, out: str = "band", q: int = 4) -> DataFrame:
    """``q`` quantile bands (right-closed, duplicate edges dropped): the
    band is the number of distinct interior edges strictly below the value;
    NULL stays NULL."""
    probs = [i / q for i in range(1, q)]
    qs = quantiles(df, col, probs)
    edges = F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(len(probs))]))
    j = df.crossJoin(F.broadcast(qs.select(edges.alias("_edges"))))
    band = F.size(F.filter(F.col("_edges"), lambda e: F.col(col) > e))
    return j.withColumn(out, F.when(F.col(col).isNotNull(), band.cast("long"))).drop("_edges")


def band_labels(df: DataFrame, col: str, out: str = "band", q: int = 4, by: list[str] | None = None) -> DataFrame:
    """T8 with names: the quantile band of a value as ``(low, high]``, the
    first one closed below; edges that are equal count once, and where no two
    different edges are left (one value, or none) every row is in the one band
    ``all``. Edges are printed with four decimals. NULL values get NULL where
    there are bands."""
    by = by or []
    probs = [i / q for i in range(q + 1)]
    qs = quantiles(df, col, probs, by=by)
    edges = F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(q + 1)]))
    edges = qs.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.when(F.size(edges) > 1, edges).alias("_edges"))
    same = F.lit(True)
    for b in by:
        same = same & (F.col(b) == F.col(f"_by_{b}"))
    j = df.join(F.broadcast(edges), same, "left") if by else df.crossJoin(F.broadcast(edges))
    e = F.col("_edges")
    at = F.least(F.greatest(F.size(F.filter(e, lambda x: x < F.col(col))), F.lit(1)), F.size(e) - 1)
    text = lambda v: F.format_string("%.4f", v)
    name = F.concat(F.when(at == 1, "[").otherwise("("), text(F.get(e, at - 1)), F.lit(", "), text(F.get(e, at)), F.lit("]"))
    return j.withColumn(out, F.when(e.isNull(), "all").when(F.col(col).isNotNull(), name)).drop("_edges", *[f"_by_{b}" for b in by])


def equal_width_bins(df: DataFrame, col: str, out: str = "bin", bins: int = 6) -> DataFrame:
    """Equal-width bins over [min, max], right-closed, lowest included."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.crossJoin(F.broadcast(mm))
    width = (F.col("_mx") - F.col("_mn")) / bins
    b = F.greatest(F.lit(0), F.ceil(F.try_divide(F.col(col) - F.col("_mn"), width)) - 1)
    b = F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1))
    return j.withColumn(out, F.when(F.col(col).isNotNull(), b.cast("long"))).drop("_mn", "_mx")
