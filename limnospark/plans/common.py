"""Shared pieces of the registered queries: driver-table loading and the
fixture mapping of the inventory's concepts onto driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# Dry threshold used on the events table (its smallest value is 0.01, so the
# 0.1 threshold of the reference would never fire).
EVENTS_DRY = 5.0

# Rows per station above which a station series is cut into pieces.
SPLIT_ROWS_CONF = "limnospark.window.splitRows"
DEFAULT_SPLIT_ROWS = 4_000_000


def split_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SPLIT_ROWS_CONF, str(DEFAULT_SPLIT_ROWS)))


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def pet_expr() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


PET_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def events_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station series view of ``events``: station=user_id, rain=value,
    pet=props.k, date=ts."""
    return t(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("value").alias("rain"), pet_expr().alias("pet"), "event_type"
    )


EVENTS_OBS_SQL = f"(SELECT event_id, user_id, ts, value AS rain, {PET_SQL} AS pet, event_type FROM events)"


def r(col: Column | str, d: int = 6) -> Column:
    """Round to ``d`` decimals exactly as the oracle engine does it
    (``round(x * 10^d) / 10^d``, half away from zero on the scaled double,
    sign of zero kept), so equal doubles give equal results on both sides.
    A named column keeps its name."""
    x = F.col(col) if isinstance(col, str) else col
    m = float(10 ** d)
    scaled = F.round(x * m, 0)
    out = F.when(scaled == 0, x * 0.0).otherwise(scaled) / m
    return out.alias(col) if isinstance(col, str) else out


# --------------------------------------------------------------------------
# Fixture mapping: static place attributes derived from ``customer`` (one row
# per place, keyed by c_custkey) and satellite bands derived from ``events``.
# Exact arithmetic on both engines (every term cast to double the same way).
# --------------------------------------------------------------------------

def _d(x):
    return x.cast("double")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return cu.select(
        k.alias("station_id"),
        (F.lit(-35.0) + _d((k * 37) % 1000) / 100.0).alias("lat"),
        (F.lit(20.0) + _d((k * 91) % 1000) / 100.0).alias("lon"),
        F.col("c_acctbal").alias("elevation"),
        _d(k % 45).alias("slope"),
        _d(k % 50).alias("soil_clay_0_5"),
        (F.lit(4.0) + _d(k % 40) / 10.0).alias("soil_ph_0_5"),
        (_d(k % 30) * 2.0).alias("soil_soc_0_5"),
        ((k % 10) * 10).cast("int").alias("landcover"),
        F.col("c_nationkey").alias("basin_id"),
        (F.abs(F.col("c_acctbal")) / 5.0 + 1.0).alias("basin_area_km2"),
        (F.abs(F.col("c_acctbal")) / 10.0).alias("upstream_area_km2"),
        (_d(k % 100) / 10.0).alias("river_discharge_cms"),
        _d((k * 37) % 5000).alias("dist_to_river_m"),
        (F.abs(F.col("c_acctbal")) / 8.0).alias("river_catch_skm"),
        ((k % 5) + 1).cast("int").alias("basin_order"),
        _d((k * 13) % 1000).alias("dist_main_km"),
    )


PLACES_SQL = """(SELECT c_custkey AS station_id,
  -35.0::DOUBLE + CAST((c_custkey * 37) % 1000 AS DOUBLE) / 100.0 AS lat,
  20.0::DOUBLE + CAST((c_custkey * 91) % 1000 AS DOUBLE) / 100.0 AS lon,
  c_acctbal AS elevation,
  CAST(c_custkey % 45 AS DOUBLE) AS slope,
  CAST(c_custkey % 50 AS DOUBLE) AS soil_clay_0_5,
  4.0::DOUBLE + CAST(c_custkey % 40 AS DOUBLE) / 10.0 AS soil_ph_0_5,
  CAST(c_custkey % 30 AS DOUBLE) * 2.0 AS soil_soc_0_5,
  CAST((c_custkey % 10) * 10 AS INTEGER) AS landcover,
  c_nationkey AS basin_id,
  abs(c_acctbal) / 5.0 + 1.0 AS basin_area_km2,
  abs(c_acctbal) / 10.0 AS upstream_area_km2,
  CAST(c_custkey % 100 AS DOUBLE) / 10.0 AS river_discharge_cms,
  CAST((c_custkey * 37) % 5000 AS DOUBLE) AS dist_to_river_m,
  abs(c_acctbal) / 8.0 AS river_catch_skm,
  CAST(c_custkey % 5 + 1 AS INTEGER) AS basin_order,
  CAST((c_custkey * 13) % 1000 AS DOUBLE) AS dist_main_km
FROM customer)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation fact: one sample per event, satellite bands, rain, PET."""
    ev = t(spark, sf_dir, "events")
    v, k = F.col("value"), pet_expr()
    return ev.select(
        "event_id",
        F.col("user_id").alias("station_id"),
        "ts",
        v.alias("chirps_ppt"),
        k.alias("pet"),
        v.alias("nir"),
        k.alias("green"),
        (v / 2.0 + 1.0).alias("swir16"),
        (k / 3.0 + 1.0).alias("swir22"),
        F.try_divide(v - k, v + k + 1.0).alias("NDMI"),
        F.try_divide(k - v / 2.0, k + v / 2.0 + 1.0).alias("MNDWI"),
        (v / 4.0).alias("red"),
    )


OBS_SQL = f"""(SELECT event_id, user_id AS station_id, ts, value AS chirps_ppt, {PET_SQL} AS pet,
  value AS nir, {PET_SQL} AS green, value / 2.0 + 1.0 AS swir16, {PET_SQL} / 3.0 + 1.0 AS swir22,
  (value - {PET_SQL}) / nullif(value + {PET_SQL} + 1.0, 0) AS NDMI,
  ({PET_SQL} - value / 2.0) / nullif({PET_SQL} + value / 2.0 + 1.0, 0) AS MNDWI,
  value / 4.0 AS red
FROM events)"""


def obs_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations left-joined to their place attributes (J1 shape)."""
    return observations(spark, sf_dir).join(places(spark, sf_dir), "station_id", "left")


MART_SQL = f"(SELECT * FROM {OBS_SQL} o LEFT JOIN {PLACES_SQL} p USING (station_id))"
