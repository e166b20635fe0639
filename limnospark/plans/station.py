"""Station series queries (W1-W11, W14, F9) on ``events`` and the monthly
panel (W8, W9) on ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as FX
from ..operators import windows as W
from .catalog import query
from .common import EVENTS_DRY, EVENTS_OBS_SQL, events_obs, r, split_rows, t

KEYS = ["user_id"]
ORDER = ["ts", "event_id"]
SQL_W = "PARTITION BY user_id ORDER BY ts, event_id"


def _events_series(spark, sf_dir, lookback, carries=None):
    df = events_obs(spark, sf_dir)
    return W.series(df, KEYS, ORDER, lookback=lookback, split_rows=split_rows(spark), carry_predicates=carries)


def station_pack(spark, sf_dir):
    """Minimum slice: key parse, lags, prior sums, dry streak, seasonal cycle."""
    s = _events_series(spark, sf_dir, 14, {"wet": W.wet_predicate("rain", EVENTS_DRY)})
    out = s.frame.select(
        "*",
        F.to_date("ts").cast("string").alias("sample_date"),
        W.lag(s, "rain", 1).alias("rain_lag_1"),
        W.lag(s, "rain", 7).alias("rain_lag_7"),
        W.prior_sum(s, "rain", 3).alias("rain_3d_sum"),
        W.prior_sum(s, "rain", 14).alias("rain_14d_sum"),
        W.dry_streak(s, "rain", EVENTS_DRY, carry="wet").alias("dry_days_before_sample"),
    )
    out = s.finish(out)
    out = out.withColumns(FX.seasonal_cycle(F.to_date("sample_date")))
    return out.select(
        "event_id",
        "user_id",
        "sample_date",
        r("rain_lag_1"),
        r("rain_lag_7"),
        r("rain_3d_sum"),
        r("rain_14d_sum"),
        "dry_days_before_sample",
        r("sin_doy"),
        r("cos_doy"),
        r("sin_month"),
        r("cos_month"),
    )


STATION_PACK_SQL = f"""
SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS sample_date,
  round(lag(rain, 1) OVER (w), 6) AS rain_lag_1,
  round(lag(rain, 7) OVER (w), 6) AS rain_lag_7,
  round(sum(rain) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rain_3d_sum,
  round(sum(rain) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6) AS rain_14d_sum,
  CAST(rn - 1 - coalesce(max(CASE WHEN coalesce(rain, 0) > {EVENTS_DRY} THEN rn END)
       OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dry_days_before_sample,
  round(sin(2 * pi() * dayofyear(ts) / 365.0), 6) AS sin_doy,
  round(cos(2 * pi() * dayofyear(ts) / 365.0), 6) AS cos_doy,
  round(sin(2 * pi() * month(ts) / 12.0), 6) AS sin_month,
  round(cos(2 * pi() * month(ts) / 12.0), 6) AS cos_month
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {EVENTS_OBS_SQL})
WINDOW w AS ({SQL_W})
"""

query("W_station_pack", STATION_PACK_SQL)(station_pack)


@query(
    "W1",
    f"""
SELECT event_id, user_id,
  round(lag(rain, 1) OVER w, 6) AS rain_lag_1, round(lag(rain, 3) OVER w, 6) AS rain_lag_3,
  round(lag(rain, 7) OVER w, 6) AS rain_lag_7, round(lag(rain, 14) OVER w, 6) AS rain_lag_14
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w1_lags(spark, sf_dir):
    """Lags 1, 3, 7, 14 per station."""
    s = _events_series(spark, sf_dir, 14)
    out = s.frame.select(*s.frame.columns, *[W.lag(s, "rain", n).alias(f"rain_lag_{n}") for n in (1, 3, 7, 14)])
    return _finish_sel(s, out, ["event_id", "user_id"], [f"rain_lag_{n}" for n in (1, 3, 7, 14)])


def _finish_sel(s, out, keep, rounded, digits=6):
    return s.finish(out).select(*keep, *[r(x, digits) for x in rounded])


PRIOR = (3, 7, 14, 30, 60, 90)


@query(
    "W2",
    f"""
SELECT event_id, user_id,
  {", ".join(f"round(sum(rain) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS rain_{n}d_sum" for n in PRIOR)}
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w2_prior_sums(spark, sf_dir):
    """Strictly-prior rolling sums 3/7/14/30/60/90 observations."""
    s = _events_series(spark, sf_dir, 90)
    out = s.frame.select(*s.frame.columns, *[W.prior_sum(s, "rain", n).alias(f"rain_{n}d_sum") for n in PRIOR])
    return _finish_sel(s, out, ["event_id", "user_id"], [f"rain_{n}d_sum" for n in PRIOR])


@query(
    "W3",
    f"""
SELECT event_id, user_id,
  round(max(rain) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rain_3d_max,
  round(max(rain) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS rain_7d_max
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w3_prior_max(spark, sf_dir):
    """Strictly-prior rolling max 3/7."""
    s = _events_series(spark, sf_dir, 7)
    out = s.frame.select(*s.frame.columns, *[W.prior_max(s, "rain", n).alias(f"rain_{n}d_max") for n in (3, 7)])
    return _finish_sel(s, out, ["event_id", "user_id"], ["rain_3d_max", "rain_7d_max"])


@query(
    "W4",
    f"""
SELECT event_id, user_id,
  {", ".join(f"round(round(sum(rain) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 2) / count(rain) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS ppt_obs{n}_mean" for n in (30, 60, 90))}
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w4_rolling_mean(spark, sf_dir):
    """Current-inclusive rolling mean over 30/60/90 observations."""
    s = _events_series(spark, sf_dir, 89)
    out = s.frame.select(*s.frame.columns, *[W.rolling_mean(s, "rain", n, digits=2).alias(f"ppt_obs{n}_mean") for n in (30, 60, 90)])
    return _finish_sel(s, out, ["event_id", "user_id"], [f"ppt_obs{n}_mean" for n in (30, 60, 90)])


OFFSETS = {"15_to_45": (30, 30), "7_to_14": (14, 7), "25_to_55": (50, 60)}


@query(
    "W5",
    f"""
SELECT event_id, user_id,
  {", ".join(f"round(sum(rain) OVER (w ROWS BETWEEN {s + n - 1} PRECEDING AND {s} PRECEDING), 6) AS precip_sum_{k}_days_prior" for k, (s, n) in OFFSETS.items())}
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w5_offset_windows(spark, sf_dir):
    """Offset windows (shift then roll) 15-45, 7-14, 25-55."""
    s = _events_series(spark, sf_dir, 109)
    out = s.frame.select(
        *s.frame.columns,
        *[W.offset_sum(s, "rain", sh, n).alias(f"precip_sum_{k}_days_prior") for k, (sh, n) in OFFSETS.items()],
    )
    return _finish_sel(s, out, ["event_id", "user_id"], [f"precip_sum_{k}_days_prior" for k in OFFSETS])


@query(
    "W6",
    f"""
SELECT event_id, user_id,
  CASE WHEN count(rain) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) >= 1 THEN
    CAST(sum(CASE WHEN coalesce(rain, 0) <= {EVENTS_DRY} THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)
         + CASE WHEN row_number() OVER w <= 14 THEN 1 ELSE 0 END AS BIGINT) END AS dry_spell_obs
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w6_dry_spell(spark, sf_dir):
    """Dry-spell count in the 14 prior observations (S5 quirk kept)."""
    s = _events_series(spark, sf_dir, 14)
    out = s.frame.select(*s.frame.columns, W.dry_spell_count(s, "rain", 14, EVENTS_DRY).alias("dry_spell_obs"))
    return s.finish(out).select("event_id", "user_id", "dry_spell_obs")


@query(
    "W7",
    f"""
SELECT event_id, user_id,
  CAST(rn - 1 - coalesce(max(CASE WHEN coalesce(rain, 0) > {EVENTS_DRY} THEN rn END)
       OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dry_days_before_sample
FROM (SELECT *, row_number() OVER ({SQL_W}) AS rn FROM {EVENTS_OBS_SQL}) WINDOW w AS ({SQL_W})
""",
)
def w7_dry_streak(spark, sf_dir):
    """Consecutive dry observations before the sample (gaps and islands)."""
    s = _events_series(spark, sf_dir, 0, {"wet": W.wet_predicate("rain", EVENTS_DRY)})
    out = s.frame.select(*s.frame.columns, W.dry_streak(s, "rain", EVENTS_DRY, carry="wet").alias("dry_days_before_sample"))
    return s.finish(out).select("event_id", "user_id", "dry_days_before_sample")


# Monthly panel on orders: station=o_custkey, date=o_orderdate, tie-break o_orderkey.
ORD_KEYS = ["o_custkey"]
ORD_ORDER = ["o_orderdate", "o_orderkey"]
ORD_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
MI_SQL = "(year(o_orderdate) * 12 + month(o_orderdate))"


def _orders_series(spark, sf_dir, lookback):
    df = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return W.series(df, ORD_KEYS, ORD_ORDER, lookback=lookback, split_rows=split_rows(spark))


@query(
    "W8",
    f"""
SELECT o_orderkey, o_custkey,
  round(CASE WHEN {MI_SQL} - lag({MI_SQL}, 1) OVER w = 1 THEN lag(o_totalprice, 1) OVER w END, 4) AS price_lag1,
  CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
  CAST(dayofyear(o_orderdate) AS BIGINT) AS dayofyear
FROM orders WINDOW w AS ({ORD_W})
""",
)
def w8_monthly_lag(spark, sf_dir):
    """Lag 1 valid only when the previous row is the previous month."""
    s = _orders_series(spark, sf_dir, 1)
    out = s.frame.select(*s.frame.columns, W.monthly_lag(s, "o_totalprice", "o_orderdate").alias("price_lag1"))
    return s.finish(out).select(
        "o_orderkey",
        "o_custkey",
        r("price_lag1", 4),
        F.year("o_orderdate").cast("long").alias("year"),
        F.month("o_orderdate").cast("long").alias("month"),
        F.dayofyear("o_orderdate").cast("long").alias("dayofyear"),
    )


@query(
    "W9",
    f"""
SELECT o_orderkey, o_custkey,
  round(CASE WHEN ok1 THEN l1 END, 4) AS price_lag1,
  round(CASE WHEN ok2 THEN l2 END, 4) AS price_lag2,
  round(CASE WHEN ok1 THEN o_totalprice - l1 END, 4) AS price_delta1,
  round(CASE WHEN ok2 THEN m3 END, 4) AS price_roll3_mean,
  round(CASE WHEN ok2 THEN s3 END, 4) AS price_roll3_std
FROM (
  SELECT *, coalesce(mi - p1 = 1, false) AS ok1, coalesce(mi - p1 = 1 AND p1 - p2 = 1, false) AS ok2
  FROM (
    SELECT o_orderkey, o_custkey, o_totalprice, {MI_SQL} AS mi,
      lag({MI_SQL}, 1) OVER w AS p1, lag({MI_SQL}, 2) OVER w AS p2,
      lag(o_totalprice, 1) OVER w AS l1, lag(o_totalprice, 2) OVER w AS l2,
      avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
      stddev_samp(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3
    FROM orders WINDOW w AS ({ORD_W})))
""",
)
def w9_legacy_monthly(spark, sf_dir):
    """Legacy lag 2 / delta / 3-row mean and std guarded by continuous months."""
    s = _orders_series(spark, sf_dir, 2)
    pack = W.monthly_lag_pack(s, "o_totalprice", "o_orderdate", "price")
    out = s.frame.select(*s.frame.columns, *[v.alias(k) for k, v in pack.items()])
    return _finish_sel(s, out, ["o_orderkey", "o_custkey"], list(pack), 4)


@query(
    "W10",
    f"""
WITH b AS (
  SELECT event_id, user_id, rain, ts,
    sum(rain) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS r30,
    CASE WHEN count(rain) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) >= 5
         THEN avg(rain) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS base_value
  FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})),
c AS (
  SELECT *, CASE WHEN count(r30) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) >= 5
                 THEN avg(r30) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) END AS base30
  FROM b WINDOW w AS ({SQL_W})),
g AS (SELECT avg(coalesce(r30, 0)) AS gm FROM b)
SELECT event_id, user_id,
  round(coalesce(r30, 0) - coalesce(base30, gm), 9) AS rain_anomaly_30d,
  round(rain - base_value, 9) AS rain_anom_30
FROM c CROSS JOIN g
""",
)
def w10_rain_anomaly(spark, sf_dir):
    """30-sum minus prior-90 mean of it (>=5 values), global-mean
    fallback; variant value minus prior-30 mean (>=5 values)."""
    s = _events_series(spark, sf_dir, 120)
    f = s.frame.select(
        *s.frame.columns,
        W.prior_sum(s, "rain", 30).alias("r30"),
        W.prior_mean(s, "rain", 30, 5).alias("base_value"),
    )
    f = f.select(*f.columns, W.prior_mean(s, "r30", 90, 5).alias("base30"))
    f = s.finish(f)
    gm = f.agg(F.avg(F.coalesce("r30", F.lit(0.0))).alias("gm"))  # one-row scalar
    out = f.crossJoin(F.broadcast(gm))
    return out.select(
        "event_id",
        "user_id",
        r(F.coalesce("r30", F.lit(0.0)) - F.coalesce("base30", "gm"), 9).alias("rain_anomaly_30d"),
        r(F.col("rain") - F.col("base_value"), 9).alias("rain_anom_30"),
    )


@query(
    "W11",
    f"""
SELECT event_id, user_id,
  round(r30 / nullif(p30 + 1.0, 0), 6) AS rain_to_pet_30d,
  round(r60 / nullif(p60 + 1.0, 0), 6) AS rain_to_pet_60d,
  round(p30, 4) AS pet_30d_sum,
  round(r30 - p30, 4) AS deficit_30d,
  round(r30 / nullif(p30 + 1.0, 0), 6) AS humidity_proxy_30d,
  round(p30 / nullif(r30 + 1.0, 0), 6) AS dryness_index_30d
FROM (SELECT event_id, user_id,
  round(sum(rain) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 2) AS r30,
  round(sum(rain) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 2) AS r60,
  sum(pet) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS p30,
  sum(pet) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS p60
  FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W}))
""",
)
def w11_moisture(spark, sf_dir):
    """rain/PET ratios and the moisture package."""
    s = _events_series(spark, sf_dir, 60)
    f = s.frame.select(
        *s.frame.columns,
        F.round(W.prior_sum(s, "rain", 30), 2).alias("r30"),
        F.round(W.prior_sum(s, "rain", 60), 2).alias("r60"),
        W.prior_sum(s, "pet", 30).alias("p30"),
        W.prior_sum(s, "pet", 60).alias("p60"),
    )
    f = s.finish(f).withColumns(FX.moisture_pack("r30", "r60", "p30", "p60"))
    return f.select(
        "event_id",
        "user_id",
        r("rain_to_pet_30d"),
        r("rain_to_pet_60d"),
        r("pet_30d_sum", 4),
        r("deficit_30d", 4),
        r("humidity_proxy_30d"),
        r("dryness_index_30d"),
    )


@query(
    "W14",
    f"""
SELECT event_id, user_id,
  round(avg(rain) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rain_prior3_mean,
  round(lag(rain, 2) OVER w, 6) AS rain_lag_2
FROM {EVENTS_OBS_SQL} WINDOW w AS ({SQL_W})
""",
)
def w14_short_prior(spark, sf_dir):
    """Short prior mean of 3 observations and lag 2."""
    s = _events_series(spark, sf_dir, 3)
    out = s.frame.select(
        *s.frame.columns, W.prior_mean(s, "rain", 3).alias("rain_prior3_mean"), W.lag(s, "rain", 2).alias("rain_lag_2")
    )
    return _finish_sel(s, out, ["event_id", "user_id"], ["rain_prior3_mean", "rain_lag_2"])


@query(
    "F9",
    """
SELECT event_id,
  round(sin(2 * pi() * dayofyear(ts) / 365.0), 6) AS sin_doy,
  round(cos(2 * pi() * dayofyear(ts) / 365.0), 6) AS cos_doy,
  round(sin(2 * pi() * month(ts) / 12.0), 6) AS sin_month,
  round(cos(2 * pi() * month(ts) / 12.0), 6) AS cos_month
FROM events
""",
)
def f9_seasonal(spark, sf_dir):
    """seasonal cycle of the sample date."""
    df = t(spark, sf_dir, "events").select("event_id", "ts")
    return df.withColumns(FX.seasonal_cycle("ts")).select(
        "event_id", *[r(x) for x in ("sin_doy", "cos_doy", "sin_month", "cos_month")]
    )
