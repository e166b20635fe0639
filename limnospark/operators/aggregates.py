"""Aggregates.

Group statistics are computed with ``groupBy().agg()`` (partial aggregation
before the shuffle, so a group holding a third of the rows still costs one
row per map task) and joined back, instead of ``Window.partitionBy(group)``
which would put the whole group in one task. Keep-first / latest-row
operators use ``min_by`` / ``max_by`` aggregates for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import quantiles


def group_mean_transform(df: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """G1: per-group mean of each column, joined back (pandas
    ``groupby().transform('mean')``; a NULL key gives NULL)."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(o) for c, o in cols.items()])
    return df.join(means, keys, "left")


def non_null_flags(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    """Whether each column has at least one non-NULL value (one aggregate,
    one row to the driver)."""
    row = df.agg(*[(F.count(c) > 0).alias(c) for c in cols]).first()
    return {c: bool(row[c]) for c in cols}


def fit_group_means(train: DataFrame, key: str, cols: list[str], prefix: str = "basin_mean_") -> tuple:
    """G3 fit: (per-group means, one-row global means)."""
    g = train.groupBy(key).agg(*[F.avg(c).alias(prefix + c) for c in cols])
    glob = train.agg(*[F.avg(c).alias("_g_" + c) for c in cols])
    return g, glob


def apply_group_means(df: DataFrame, key: str, fitted: tuple, cols: list[str], prefix: str = "basin_mean_"):
    """G3 apply: group mean from the train side, global train mean when the
    group is unseen (J6 lookup with default)."""
    g, glob = fitted
    j = df.join(g, key, "left").crossJoin(F.broadcast(glob))
    j = j.withColumns({prefix + c: F.coalesce(F.col(prefix + c), F.col("_g_" + c)) for c in cols})
    return j.drop(*["_g_" + c for c in cols])


def dist_to_centroid(train: DataFrame, df: DataFrame, key: str, lat: str, lon: str, out="dist_to_centroid"):
    """Train centroid per group, Euclidean distance in degrees to the
    own group's centroid (NULL when the group is unknown)."""
    cen = train.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(lat).alias("_clat"), F.avg(lon).alias("_clon")
    )
    j = df.join(cen, key, "left")
    d = F.sqrt(F.pow(F.col(lat) - F.col("_clat"), 2) + F.pow(F.col(lon) - F.col("_clon"), 2))
    return j.withColumn(out, d).drop("_clat", "_clon")


def station_count(train: DataFrame, df: DataFrame, keys: list[str], out="station_obs_count"):
    """Number of train rows at the same station, 0 when unseen."""
    cnt = train.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(cnt, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def top_n_categories(train: DataFrame, col: str, n: int) -> list:
    """G6 fit: the n most frequent values (ties by value); n values reach
    the driver, bounded by n."""
    rows = (
        train.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("_c"))
        .orderBy(F.desc("_c"), F.asc(col))
        .limit(n)
        .collect()
    )
    return [r[col] for r in rows]


def one_hot(df: DataFrame, col: str, values: list, prefix: str | None = None) -> DataFrame:
    """G6 apply: 0/1 column per fitted value."""
    prefix = prefix or f"{col}_"
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def distinct_points(*dfs: DataFrame, cols=("lat", "lon")) -> DataFrame:
    """Distinct coordinates over several tables."""
    u = dfs[0].select(*cols)
    for d in dfs[1:]:
        u = u.unionByName(d.select(*cols))
    return u.dropDuplicates(list(cols))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (an aggregate, not a
    window: a hot key is reduced map-side)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    ordk = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.min_by(packed, ordk).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def latest_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the largest ordinal per key."""
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col(ordinal)).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def group_profile(df: DataFrame, keys: list[str], col: str, top: int | None = None, order_by="mean") -> DataFrame:
    """Mean, first (min), count per group; the NULL group is
    kept; optional top-N by the mean."""
    g = df.groupBy(*keys).agg(
        F.avg(col).alias("mean"), F.min(col).alias("min"), F.count(col).alias("count")
    )
    if top is not None:
        g = g.orderBy(F.desc_nulls_last(order_by), *[F.asc_nulls_last(k) for k in keys]).limit(top)
    return g


# Percentiles of the vector profile.
PROFILE_PERCENTILES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


def vector_profile(df: DataFrame, col: str) -> DataFrame:
    """Min, max, mean, median, sample std and 9 percentiles as
    (stat, value) rows."""
    names = [f"p{int(round(p * 100)):02d}" for p in PROFILE_PERCENTILES]
    q = quantiles(df, col, PROFILE_PERCENTILES + [0.5], names + ["median"])
    base = df.agg(
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.count(col).cast("double").alias("count"),
    )
    wide = base.crossJoin(q)
    stats = ["count", "min", "max", "mean", "median", "std", *names]
    return unpivot_row(wide, stats)


def unpivot_row(wide: DataFrame, stats: list[str], name="stat", value="value") -> DataFrame:
    return wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias(name), F.col(s).cast("double").alias(value)) for s in stats])).alias("_s")).select("_s.*")


def delta_profile(df: DataFrame, col: str) -> DataFrame:
    """Mean absolute, max, min and sample std of a delta column."""
    wide = df.agg(
        F.avg(F.abs(col)).alias("mean_abs"),
        F.max(col).cast("double").alias("max"),
        F.min(col).cast("double").alias("min"),
        F.stddev_samp(col).alias("std"),
    )
    return unpivot_row(wide, ["mean_abs", "max", "min", "std"])


def missing_rates(df: DataFrame, cols: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Share of NULL per column (one aggregate), sorted descending."""
    cols = cols or df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = unpivot_row(wide, cols, "column", "missing_rate")
    long = long.orderBy(F.desc("missing_rate"), F.asc("column"))
    return long.limit(top) if top else long


def coverage(col: str) -> Column:
    """Share of non-NULL values (an aggregate expression)."""
    return F.avg(F.col(col).isNotNull().cast("double"))


def fold_summary(df: DataFrame, fold: str, group: str, y: str) -> DataFrame:
    """Per fold: rows, distinct groups, mean / min / max / std of y."""
    return df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(group).alias("n_groups"),
        F.avg(y).alias("y_mean"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
        F.stddev_samp(y).alias("y_std"),
    )


def fold_describe(df: DataFrame, fold: str, group: str, y: str, top: int) -> DataFrame:
    """(fold, kind, name, value): count, mean, std, least, quartiles and
    largest of ``y`` per fold, and the rows of the ``top`` most frequent groups
    (ties by group; NULL groups left out, as value_counts does)."""
    rows = materialize(df.select(fold, group, y), "folds")
    plain = rows.groupBy(fold).agg(F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                                   F.count(y).alias("count"))
    quarters = quantiles(rows, y, [0.25, 0.5, 0.75], ["25%", "50%", "75%"], by=[fold])
    names = ["min", "25%", "50%", "75%", "max", "mean", "std", "count"]
    wide = plain.join(quarters, fold, "left")
    describe = wide.select(fold, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("s"))
    counts = rows.where(F.col(group).isNotNull()).groupBy(fold, group).agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy(fold).orderBy(F.desc("_n"), group)
    counts = counts.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= top)
    return describe.select(fold, F.lit("describe").alias("kind"), "s.name", "s.value").unionByName(
        counts.select(fold, F.lit("value_counts").alias("kind"), F.col(group).cast("string").alias("name"), F.col("_n").cast("double").alias("value")))


def regime_support(df: DataFrame, flags: list[str], fold: str, group: str, n_folds: int) -> DataFrame:
    """Support per regime (each flag, each pair, the triple): rows,
    distinct groups, rows per fold, folds with zero rows, minimum fold count.
    Flags become rows (explode) so one aggregate covers every regime."""
    regimes = []
    for i, a in enumerate(flags):
        regimes.append((a, F.col(a) == 1))
        for b in flags[i + 1:]:
            regimes.append((f"{a}&{b}", (F.col(a) == 1) & (F.col(b) == 1)))
    if len(flags) >= 3:
        regimes.append(("&".join(flags[:3]), (F.col(flags[0]) == 1) & (F.col(flags[1]) == 1) & (F.col(flags[2]) == 1)))
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in regimes])
    long = df.select(F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("regime"), fold, group)
    per_fold = long.groupBy("regime").pivot(fold, list(range(n_folds))).count()
    tot = long.groupBy("regime").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))
    out = tot.join(per_fold, "regime")
    fcols = [F.coalesce(F.col(str(i)), F.lit(0)) for i in range(n_folds)]
    return out.select(
        "regime",
        "n_rows",
        "n_groups",
        *[c.alias(f"fold_{i}") for i, c in enumerate(fcols)],
        sum((c == 0).cast("int") for c in fcols).alias("zero_folds"),
        F.least(*fcols).alias("min_fold_rows"),
    )


def mean_importance(df: DataFrame, feature: str, importance: str, top: int) -> DataFrame:
    """Mean importance per feature over targets, top list."""
    return (
        df.groupBy(feature)
        .agg(F.avg(importance).alias("mean_importance"), F.count(F.lit(1)).alias("n_targets"))
        .orderBy(F.desc("mean_importance"), F.asc(feature))
        .limit(top)
    )
