"""Evaluation and similarity.

Scores are aggregates: R2 per fold takes its total sum of squares from the
streaming variance (numerically stable, one pass); correlations use Spark's
``corr``; Spearman is the Pearson correlation of D1 average ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import quantiles, rank_table


def fold_scores(df: DataFrame, y: str, p: str, fold: str) -> DataFrame:
    """Per fold n, R2 (1 - SSE/SST) and RMSE; plus the mean and the
    population std of R2 over folds on every row."""
    per = df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    ).select(
        fold, "n",
        (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
    )
    summ = per.agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))
    return per.crossJoin(F.broadcast(summ))


def spearman_pearson(df: DataFrame, a: str, b: str, min_n: int = 20) -> DataFrame:
    """Pearson and Spearman on the pairs with both values, NULL when
    fewer than ``min_n`` pairs."""
    pairs = materialize(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), "pairs")
    ra = rank_table(pairs, a).select(a, F.col("rank_avg").alias("_ra"))
    rb = rank_table(pairs, b).select(b, F.col("rank_avg").alias("_rb"))
    j = pairs.join(ra, a).join(rb, b)
    agg = j.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("_p"), F.corr("_ra", "_rb").alias("_s"))
    ok = F.col("n") >= min_n
    return agg.select("n", F.when(ok, F.col("_p")).alias("pearson"), F.when(ok, F.col("_s")).alias("spearman"))


def similarity_profile(df: DataFrame, anchor: str, cand: str) -> DataFrame:
    """Pearson, Spearman, MAE, RMSE, median / p05 / p50 / p95 shifts,
    1-99 range of the candidate, share of > 10% deviations."""
    df = materialize(df.select(anchor, cand), "profile")
    ps = spearman_pearson(df, anchor, cand, 0).select("pearson", "spearman")
    base = df.agg(
        F.avg(F.abs(F.col(cand) - F.col(anchor))).alias("mae"),
        F.sqrt(F.avg(F.pow(F.col(cand) - F.col(anchor), 2))).alias("rmse"),
        F.avg((F.abs(F.col(cand) - F.col(anchor)) > 0.1 * F.abs(F.col(anchor))).cast("double")).alias("frac_large_dev"),
    )
    qa = quantiles(df, anchor, [0.05, 0.5, 0.95], ["_a05", "_a50", "_a95"])
    qc = quantiles(df, cand, [0.01, 0.05, 0.5, 0.95, 0.99], ["_c01", "_c05", "_c50", "_c95", "_c99"])
    w = ps.crossJoin(base).crossJoin(qa).crossJoin(qc)
    return w.select(
        "pearson", "spearman", "mae", "rmse",
        (F.col("_c50") - F.col("_a50")).alias("median_diff"),
        (F.col("_c05") - F.col("_a05")).alias("p05_diff"),
        (F.col("_c50") - F.col("_a50")).alias("p50_diff"),
        (F.col("_c95") - F.col("_a95")).alias("p95_diff"),
        (F.col("_c99") - F.col("_c01")).alias("range_1_99"),
        "frac_large_dev",
    )


def closeness_labels(df: DataFrame, anchor: str, failed: str, cand: str) -> DataFrame:
    """Closer-to-anchor / closer-to-failed by Pearson, and the
    leaderboard risk label from the anchor similarity (corr > 0.8 and
    MAE < 0.1 -> LOW, corr > 0.6 -> MEDIUM, else HIGH)."""
    a = df.agg(
        F.corr(anchor, cand).alias("anchor_pearson"),
        F.corr(failed, cand).alias("failed_pearson"),
        F.avg(F.abs(F.col(cand) - F.col(anchor))).alias("anchor_mae"),
    )
    return a.withColumn(
        "comparison",
        F.when(F.col("failed_pearson") > F.col("anchor_pearson"), "closer_to_failed")
        .when(F.col("anchor_pearson") > F.col("failed_pearson"), "closer_to_anchor")
        .otherwise("similar_to_both"),
    ).withColumn(
        "risk",
        F.when((F.col("anchor_pearson") > 0.8) & (F.col("anchor_mae") < 0.1), "LOW RISK")
        .when(F.col("anchor_pearson") > 0.6, "MEDIUM RISK")
        .otherwise("HIGH RISK"),
    )


def rank_correlations(df: DataFrame, target: str, proxies: list[str]) -> DataFrame:
    """(proxy, n, pearson, spearman) of every proxy with ``target`` over the
    pairs with both values: one long (proxy, value, target) table, ranked
    within each proxy."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("proxy"), F.col(p).cast("double").alias("_v")) for p in proxies]))
    long = df.select(F.col(target).cast("double").alias("_t"), each.alias("_s")).select("_s.proxy", "_s._v", "_t")
    long = materialize(long.where("_v is not null and _t is not null"), "proxies")
    rv = rank_table(long, "_v", ["proxy"]).select("proxy", "_v", F.col("rank_avg").alias("_rv"))
    rt = rank_table(long, "_t", ["proxy"]).select("proxy", "_t", F.col("rank_avg").alias("_rt"))
    return long.join(rv, ["proxy", "_v"]).join(rt, ["proxy", "_t"]).groupBy("proxy").agg(
        F.count(F.lit(1)).alias("n"), F.corr("_v", "_t").alias("pearson"), F.corr("_rv", "_rt").alias("spearman"))


def proxy_correlations(df: DataFrame, delta: str, proxies: list[str], min_n: int = 10) -> DataFrame:
    """E5: correlation of each proxy with the delta (proxies unpivoted to
    rows, one grouped aggregate), n >= min_n, sorted by |corr|."""
    long = df.select(
        F.col(delta).alias("_d"),
        F.explode(F.array(*[F.struct(F.lit(p).alias("proxy"), F.col(p).cast("double").alias("v")) for p in proxies])).alias("_s"),
    ).select("_d", "_s.proxy", "_s.v").where(F.col("v").isNotNull() & F.col("_d").isNotNull())
    g = long.groupBy("proxy").agg(F.count(F.lit(1)).alias("n"), F.corr("v", "_d").alias("corr"))
    return g.where(F.col("n") >= min_n).orderBy(F.desc(F.abs("corr")), "proxy")


def anchor_similarity(cands: DataFrame, anchor: DataFrame, keys: list[str], cand_col: str = "candidate",
                      target: str = "target", value: str = "value") -> DataFrame:
    """Per candidate and target: correlation and MAE to the anchor."""
    a = anchor.select(*keys, target, F.col(value).alias("_a"))
    j = cands.join(a, [*keys, target])
    return j.groupBy(cand_col, target).agg(
        F.count(F.lit(1)).alias("n"), F.corr(value, "_a").alias("corr"),
        F.avg(F.abs(F.col(value) - F.col("_a"))).alias("mae"),
    )


# Feature ranking weights and the meaningful-gain threshold.
RANK_W_DELTA, RANK_W_SPEARMAN, RANK_W_PEARSON = 0.6, 0.25, 0.15
MEANINGFUL_GAIN = 0.002


def feature_ranking(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Min-tie descending ranks of delta_cv_r2, abs_spearman,
    abs_pearson; score 0.6 / 0.25 / 0.15; sorted by score then gain."""
    # One row per feature of a model: a plain window.
    place = {c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(c))))
             for c in ("delta_cv_r2", "abs_spearman", "abs_pearson")}
    out = df.select("*", place["delta_cv_r2"].alias("rk_delta"), place["abs_spearman"].alias("rk_spearman"),
                    place["abs_pearson"].alias("rk_pearson"))
    score = RANK_W_DELTA * F.col("rk_delta") + RANK_W_SPEARMAN * F.col("rk_spearman") + RANK_W_PEARSON * F.col("rk_pearson")
    return out.withColumn("rank_score", score).withColumn("meaningful", F.col("delta_cv_r2") >= MEANINGFUL_GAIN)


# Output proxy score (range thresholds and weights per target,
# median target and weight for the third target).
PROXY_RANGES = {"drp": (25.0, 0.9), "ec": (900.0, 0.02), "ta": (280.0, 0.05)}
PROXY_MEDIAN = (25.0, 0.3)


def output_proxy_score(df: DataFrame, ta: str, ec: str, drp: str) -> DataFrame:
    """1000 minus range penalties (p99 - p1 above a threshold) and the
    distance of the DRP median from its target."""
    cols = {"ta": ta, "ec": ec, "drp": drp}
    df = materialize(df.select(*cols.values()), "outputs")
    q = None
    for k, c in cols.items():
        qq = quantiles(df, c, [0.01, 0.5, 0.99], [f"_{k}01", f"_{k}50", f"_{k}99"])
        q = qq if q is None else q.crossJoin(qq)
    pen = F.lit(0.0)
    for k, (thr, wt) in PROXY_RANGES.items():
        pen = pen + F.greatest(F.lit(0.0), F.col(f"_{k}99") - F.col(f"_{k}01") - thr) * wt
    pen = pen + F.abs(F.col("_drp50") - PROXY_MEDIAN[0]) * PROXY_MEDIAN[1]
    return q.select((F.lit(1000.0) - pen).alias("proxy_score"))


def safe_choice(opts: DataFrame, name: str = "name", corr: str = "corr", mae: str = "mae",
                corr_min: float = 0.98, mae_max: float = 1.0, marginal_corr: float = 0.99) -> DataFrame:
    """Lowest-MAE safe option (corr >= corr_min and MAE <= mae_max); else
    the lowest-MAE marginal option (corr >= marginal_corr); else the lowest
    MAE overall. One row: choice and status."""
    safe = (F.col(corr) >= corr_min) & (F.col(mae) <= mae_max)
    marginal = F.col(corr) >= marginal_corr
    tier = F.when(safe, 0).when(marginal, 1).otherwise(2)
    best = opts.select(name, mae, tier.alias("_tier")).agg(
        F.min_by(F.struct(F.col(name), F.col(mae), F.col("_tier")), F.struct(F.col("_tier"), F.col(mae), F.col(name))).alias("b")
    )
    return best.select(
        F.col("b")[name].alias("choice"), F.col("b")[mae].alias("mae"),
        F.when(F.col("b._tier") == 0, "SAFE").when(F.col("b._tier") == 1, "MARGINAL").otherwise("RISKY").alias("status"),
    )


def residual_recommendation(r2) -> Column:
    """> 0.01 adopt, > -0.01 neutral, else reject."""
    c = F.col(r2) if isinstance(r2, str) else r2
    return F.when(c > 0.01, "adopt").when(c > -0.01, "neutral").otherwise("reject")


def improved_split(scores: DataFrame, benchmark: float, run: str = "run", target: str = "target",
                   score: str = "score") -> DataFrame:
    """Improved / degraded against a benchmark, and the best run per
    target (max_by)."""
    lab = scores.withColumn("status", F.when(F.col(score) > benchmark, "improved").otherwise("degraded"))
    best = scores.groupBy(target).agg(F.max_by(run, score).alias("best_run"), F.max(score).alias("best_score"))
    return lab.join(best, target)
