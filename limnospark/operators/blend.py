"""Blending of prediction tables.

Rank blends need "the k-th smallest base value" for every row. That is an
order-statistic lookup done without a global sort window:

* the base column becomes (value, first position, last position) rows from
  the distributed cumulative counts (D1);
* positions 0..N-1 are dense, so ``floor(p / ceil(N / B))`` cuts them into B
  equal buckets; each bucket also gets one carry row for the value that
  spans its first position;
* inside a bucket, the value at position p is the last value row whose start
  is <= p (a window partitioned by bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import seq_asc
from ..session import materialize
from .ranking import cumulative_counts, quantiles, rank_table


def value_at_positions(cc: DataFrame, col: str, queries: DataFrame, pos: str, out: str, qkeys: list[str]) -> DataFrame:
    """For each query row (unique by ``qkeys``), the value at 0-based sorted
    position ``queries[pos]`` (ascending, NULLs excluded) of the column whose
    cumulative counts are ``cc``. As many position ranges as shuffle
    partitions."""
    buckets = max(1, int(cc.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tot = cc.agg(F.max("_total").alias("_ntot"))
    width = F.greatest(F.lit(1), F.ceil(F.col("_ntot") / buckets)).cast("long")
    qk = F.struct(*[F.col(k) for k in qkeys])
    qtype = queries.select(qk.alias("_qk")).schema["_qk"].dataType
    none = F.lit(None).cast(qtype)
    vals = cc.crossJoin(F.broadcast(tot)).select(
        F.col(col).cast("double").alias("_v"),
        (F.col("_cum") - F.col("_n")).alias("_start"),
        (F.col("_cum") - 1).alias("_end"),
        width.alias("_w"),
    )
    starts = vals.select(
        F.floor(F.col("_start") / F.col("_w")).alias("_b"), F.col("_start").alias("_p"), F.lit(0).alias("_k"),
        "_v", none.alias("_qk"),
    )
    carries = vals.select(
        F.explode(seq_asc((F.floor(F.col("_start") / F.col("_w")) + 1).cast("long"),
                          F.floor(F.col("_end") / F.col("_w")).cast("long"))).alias("_b"),
        "_w", "_v",
    ).select("_b", (F.col("_b") * F.col("_w")).alias("_p"), F.lit(0).alias("_k"), "_v", none.alias("_qk"))
    qpos = queries.select(qk.alias("_qk"), F.col(pos).cast("long").alias("_p")).crossJoin(F.broadcast(tot)).select(
        F.floor(F.col("_p") / width).alias("_b"), "_p", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_v"), "_qk"
    )
    w = Window.partitionBy("_b").orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        starts.unionByName(carries).unionByName(qpos)
        .withColumn("_found", F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_k") == 1)
        .select(*[F.col("_qk")[k].alias(k) for k in qkeys], F.col("_found").alias(out))
    )
    return queries.join(found, qkeys)


def linear(a, b, w) -> Column:
    """B1: (1 - w) * a + w * b."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    w = F.lit(w) if not isinstance(w, Column) else w
    return (1 - w) * a + w * b


def _ranked(df: DataFrame, key: str, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pair with its ranks, and the cumulative counts of both columns;
    the pair is computed once."""
    df = materialize(df.select(key, a, b), "pair")
    ca, cb = cumulative_counts(df, a), cumulative_counts(df, b)
    ra = rank_table(df, a, cc=ca).select(a, F.col("rank_avg").alias("_ra"), F.col("n_valid").alias("_n"))
    rb = rank_table(df, b, cc=cb).select(b, F.col("rank_avg").alias("_rb"))
    return materialize(df.join(ra, a).join(rb, b), "ranked"), ca, cb


def rank_interpolate(df: DataFrame, key: str, base: str, other: str, w: float, out: str = "blend") -> DataFrame:
    """B2: blend average ranks, then read the sorted base at the blended rank
    with linear interpolation between neighbours."""
    r, cc, _ = _ranked(df, key, base, other)
    br = (1 - w) * F.col("_ra") + w * F.col("_rb")
    ri = F.least(F.greatest(br - 1, F.lit(0.0)), F.col("_n") - 1)
    r = r.select(key, ri.alias("_ri"), "_n")
    r = r.select(key, "_ri", F.floor("_ri").alias("_lo"), F.least(F.floor("_ri") + 1, F.col("_n") - 1).alias("_hi"))
    q = r.select(key, "_ri", "_lo", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("_lo").alias("p")),
                                                    F.struct(F.lit(1).alias("t"), F.col("_hi").alias("p")))).alias("_q"))
    q = q.select(key, "_ri", "_lo", F.col("_q.t").alias("_t"), F.col("_q.p").alias("_pos"))
    v = value_at_positions(cc, base, q, "_pos", "_val", [key, "_t"])
    g = v.groupBy(key).agg(
        F.max(F.when(F.col("_t") == 0, F.col("_val"))).alias("_vlo"),
        F.max(F.when(F.col("_t") == 1, F.col("_val"))).alias("_vhi"),
        F.first("_ri").alias("_ri"), F.first("_lo").alias("_lo"),
    )
    frac = F.col("_ri") - F.col("_lo")
    return g.select(key, (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias(out))


def rank_truncate(df: DataFrame, key: str, base: str, other: str, w_base: float, out: str = "blend") -> DataFrame:
    """Blend percentile ranks (average rank / n), truncate to an index
    into the sorted base, clip at 0."""
    r, cc, _ = _ranked(df, key, base, other)
    rp = w_base * (F.col("_ra") / F.col("_n")) + (1 - w_base) * (F.col("_rb") / F.col("_n"))
    idx = F.least(F.greatest(F.floor(rp * (F.col("_n") - 1)), F.lit(0)), F.col("_n") - 1)
    q = r.select(key, idx.alias("_pos"))
    v = value_at_positions(cc, base, q, "_pos", "_val", [key])
    return v.select(key, F.greatest(F.col("_val"), F.lit(0.0)).alias(out))


def rank_two_sided(df: DataFrame, key: str, a: str, b: str, wa: float, wb: float, out: str = "blend") -> DataFrame:
    """Blended average rank -> percentile -> value interpolated in both
    sorted columns, then weighted."""
    r, ca, cb = _ranked(df, key, a, b)
    pct = (wa * F.col("_ra") + wb * F.col("_rb") - 1) / (F.col("_n") - 1)
    idx = F.least(F.greatest(pct * (F.col("_n") - 1), F.lit(0.0)), F.col("_n") - 1)
    r = r.select(key, idx.alias("_idx"), "_n").select(
        key, "_idx", F.floor("_idx").alias("_lo"), (F.col("_idx") - F.floor("_idx")).alias("_fr"),
        F.least(F.floor("_idx") + 1, F.col("_n") - 1).alias("_hi"),
    )
    parts = []
    for side, col, cc in (("a", a, ca), ("b", b, cb)):
        q = r.select(key, F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("_lo").alias("p")),
                                            F.struct(F.lit(1).alias("t"), F.col("_hi").alias("p")))).alias("_q"))
        q = q.select(key, F.col("_q.t").alias("_t"), F.col("_q.p").alias("_pos"))
        v = value_at_positions(cc, col, q, "_pos", "_val", [key, "_t"])
        parts.append(
            v.groupBy(key).agg(
                F.max(F.when(F.col("_t") == 0, F.col("_val"))).alias(f"_{side}lo"),
                F.max(F.when(F.col("_t") == 1, F.col("_val"))).alias(f"_{side}hi"),
            )
        )
    j = r.join(parts[0], key).join(parts[1], key)
    va = F.col("_alo") + F.col("_fr") * (F.col("_ahi") - F.col("_alo"))
    vb = F.col("_blo") + F.col("_fr") * (F.col("_bhi") - F.col("_blo"))
    return j.select(key, (wa * va + wb * vb).alias(out))


# The 20 conservative variants of B5.
RAW_WEIGHTS = [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10, 0.11, 0.12]
RANK_WEIGHTS = [0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.10, 0.12]
CLIP_LO, CLIP_HI = 0.002, 0.998


def twenty_variants(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """12 raw and 8 rank blends (weights as rows), each clipped to the
    0.2% / 99.8% quantiles of the old column. Rank blends use 0-1 scaled
    average ranks mapped back by a half-even rounded index into sorted old.
    Output: (variant, key, value)."""
    spark = df.sparkSession
    r, cc, _ = _ranked(df, key, old, new)
    lims = quantiles(df, old, [CLIP_LO, CLIP_HI], ["_lo", "_hi"], cc=cc)
    raw_w = spark.createDataFrame([(f"raw_w{int(round(w * 100)):02d}", w) for w in RAW_WEIGHTS], "variant string, w double")
    rank_w = spark.createDataFrame([(f"rank_w{int(round(w * 100)):02d}", w) for w in RANK_WEIGHTS], "variant string, w double")
    raw = r.select(key, old, new).crossJoin(F.broadcast(raw_w)).select(
        "variant", key, linear(old, new, F.col("w")).alias("_val")
    )
    mm = r.agg(F.min("_ra").alias("_ra0"), F.max("_ra").alias("_ra1"), F.min("_rb").alias("_rb0"), F.max("_rb").alias("_rb1"))
    r = r.crossJoin(F.broadcast(mm)).select(
        key, "_n",
        ((F.col("_ra") - F.col("_ra0")) / (F.col("_ra1") - F.col("_ra0") + 1e-12)).alias("_qa"),
        ((F.col("_rb") - F.col("_rb0")) / (F.col("_rb1") - F.col("_rb0") + 1e-12)).alias("_qb"),
    )
    q = r.crossJoin(F.broadcast(rank_w)).select(
        "variant", key,
        F.bround(F.least(F.greatest(linear("_qa", "_qb", F.col("w")), F.lit(0.0)), F.lit(1.0)) * (F.col("_n") - 1), 0)
        .cast("long").alias("_pos"),
    )
    ranked = value_at_positions(cc, old, q, "_pos", "_val", ["variant", key]).select("variant", key, "_val")
    both = raw.unionByName(ranked).crossJoin(F.broadcast(lims))
    return both.select("variant", key, F.least(F.greatest(F.col("_val"), F.col("_lo")), F.col("_hi")).alias("value"))


def safe_clip(df: DataFrame, col: str, out: str) -> DataFrame:
    """F21 as used by B6: non-finite -> median of the finite values, then >= 0."""
    v = F.col(col).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    med = quantiles(df.select(finite.alias(col)), col, [0.5], ["_med"])
    j = df.crossJoin(F.broadcast(med))
    return j.withColumn(out, F.greatest(F.coalesce(finite, "_med"), F.lit(0.0))).drop("_med")


def balanced(df: DataFrame, a_ec: str, b_ec: str, a_drp: str, b_drp: str) -> DataFrame:
    """EC 0.85 / 0.15 linear blend; DRP 0.60 / 0.40 with the safe clip."""
    out = df.withColumn("ec_blend", 0.85 * F.col(a_ec) + 0.15 * F.col(b_ec)).withColumn(
        "_drp", 0.60 * F.col(a_drp) + 0.40 * F.col(b_drp)
    )
    return safe_clip(out, "_drp", "drp_blend").drop("_drp")


def simplex_weights(spark, step_tenths: int = 1):
    """All (w1, w2, w3) on the simplex in tenths (66 triples for step 1),
    built with integers so no triple is lost to rounding (S14)."""
    rows = [(i / 10, j / 10, (10 - i - j) / 10) for i in range(0, 11, step_tenths) for j in range(0, 11 - i, step_tenths)]
    return spark.createDataFrame(rows, "w1 double, w2 double, w3 double")


def weighted_ensemble(preds: DataFrame, weights: DataFrame, key: str, model: str = "model", pred: str = "pred",
                      weight: str = "weight", out: str = "pred") -> DataFrame:
    """sum(w * p) / sum(w) per key over the models that have a weight.
    ``weights`` (a row per model) goes to the rows: a shuffle by model would
    put all rows of a model into one task."""
    j = preds.join(F.broadcast(weights), model)
    return j.groupBy(key).agg((F.sum(F.col(weight) * F.col(pred)) / F.sum(weight)).alias(out))


def anchor_preserving(anchor: DataFrame, gated: DataFrame, glob: DataFrame, key: str, copy_cols: list[str],
                      target: str, alpha: float) -> DataFrame:
    """Copy ``copy_cols`` from the anchor; target = anchor + alpha *
    (gated - global)."""
    g = gated.select(key, F.col(target).alias("_g"))
    h = glob.select(key, F.col(target).alias("_h"))
    j = anchor.select(key, *copy_cols, target).join(g, key, "left").join(h, key, "left")
    return j.select(key, *copy_cols, (F.col(target) + alpha * (F.col("_g") - F.col("_h"))).alias(target))
