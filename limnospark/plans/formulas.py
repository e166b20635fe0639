"""Formula pack queries (F1-F8, F10-F23) over the fixture observation mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as FX
from ..functions.common import nan_to_null
from ..operators import aggregates as AG
from ..operators import ranking as RK
from ..operators import spatial as SP
from ..operators import windows as W
from .catalog import query
from .common import MART_SQL, PLACES_SQL, obs_mart, places, r, split_rows, t


def _pack(df, pack: dict, keep=("event_id",), digits=6):
    out = df.withColumns(pack)
    return out.select(*keep, *[r(k, digits) for k in sorted(pack)])


def _sql(cols: dict, src: str = MART_SQL, keep: str = "event_id", digits: int = 6, extra_from: str = "") -> str:
    body = ",\n  ".join(f"round({e}, {digits}) AS {k}" for k, e in sorted(cols.items()))
    return f"SELECT {keep},\n  {body}\nFROM {src} {extra_from}"


def nz(den: str) -> str:
    return f"nullif({den}, 0)"


def gz(x: str) -> str:
    """max(x, 0) keeping NULL (DuckDB greatest skips NULL)."""
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest({x}, 0) END)"


F1_COLS = {
    "NDMI_x_pet": "NDMI * pet",
    "MNDWI_x_pet": "MNDWI * pet",
    "swir_ratio_16_22": f"swir16 / {nz('swir22 + 1e-6')}",
    "nir_ratio_swir22": f"nir / {nz('swir22 + 1e-6')}",
    "nir_minus_swir22": "nir - swir22",
    "green_ratio_swir16": f"green / {nz('swir16 + 1e-6')}",
    "green_minus_swir16": "green - swir16",
    **{f"log_{b}": f"ln(1 + abs({b}))" for b in ("pet", "nir", "green", "swir16", "swir22")},
    "lat2": "lat * lat",
    "lon2": "lon * lon",
    "lat_lon": "lat * lon",
}


@query("F1", _sql(F1_COLS))
def f1_spectral(spark, sf_dir):
    """spectral products, ratios, differences, logs, coordinate terms."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.spectral(m.columns))


F2_COLS = {"runoff_index": f"chirps_ppt / {nz('pet + 1e-6')}", "wetness_index": f"chirps_ppt / {nz('pet + 1e-6')}"}


@query("F2", _sql(F2_COLS))
def f2_wetness(spark, sf_dir):
    """rain over PET (twice, two names)."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.wetness(m.columns))


F3_COLS = {
    "NDMI_x_dist_to_river_m": "NDMI * dist_to_river_m",
    "MNDWI_x_dist_to_river_m": "MNDWI * dist_to_river_m",
    "NDMI_x_upstream_area_km2": "NDMI * upstream_area_km2",
    "MNDWI_x_upstream_area_km2": "MNDWI * upstream_area_km2",
    "pet_x_dist_to_river_m": "pet * dist_to_river_m",
    "pet_x_basin_area_km2": "pet * basin_area_km2",
    "pet_x_upstream_area_km2": "pet * upstream_area_km2",
    "log_dist_to_river_m": "ln(1 + dist_to_river_m)",
    "log_basin_area_km2": "ln(1 + basin_area_km2)",
    "log_upstream_area_km2": "ln(1 + upstream_area_km2)",
    "wetness_hydro_proxy": f"MNDWI / {nz('ln(1 + dist_to_river_m) + 1')}",
    "moisture_hydro_proxy": f"NDMI / {nz('ln(1 + dist_to_river_m) + 1')}",
}


@query("F3", _sql(F3_COLS))
def f3_drp_focused(spark, sf_dir):
    """DRP-focused interactions, log hydrology and proxies."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.drp_focused(m.columns))


F4_COLS = {
    "lat3": "pow(lat, 3)",
    "lon3": "pow(lon, 3)",
    "sin_lat": "sin(lat * pi() / 180)",
    "cos_lat": "cos(lat * pi() / 180)",
    "sin_lon": "sin(lon * pi() / 180)",
    "cos_lon": "cos(lon * pi() / 180)",
    "dist_center": "sqrt(pow(lat - c_lat, 2) + pow(lon - c_lon, 2))",
}


@query(
    "F4",
    _sql(
        F4_COLS,
        extra_from=f", (SELECT quantile_cont(lat, 0.5) AS c_lat, quantile_cont(lon, 0.5) AS c_lon FROM {MART_SQL}) c",
    ),
)
def f4_spatial_encoding(spark, sf_dir):
    """coordinate cubes, sin/cos and distance to the median centre."""
    m = obs_mart(spark, sf_dir)
    centre = RK.quantiles(m, "lat", [0.5], ["c_lat"]).crossJoin(RK.quantiles(m, "lon", [0.5], ["c_lon"]))
    j = m.crossJoin(F.broadcast(centre))
    return _pack(j, FX.spatial_encoding("lat", "lon", F.col("c_lat"), F.col("c_lon")))


F5_COLS = {
    "soil_clay_slope": "soil_clay_0_5 * slope",
    "soil_clay_elevation": "soil_clay_0_5 * elevation",
    "slope_landcover": "slope * CAST(landcover = 40 AS INTEGER)",
    "soil_ph_landcover": "soil_ph_0_5 * CAST(landcover = 40 AS INTEGER)",
}


@query("F5", _sql(F5_COLS))
def f5_hydro_interactions(spark, sf_dir):
    """clay/slope/elevation/landcover interactions (landcover one-hot for
    code 40 stands in for the first landcover column)."""
    m = obs_mart(spark, sf_dir).withColumn("landcover_40", (F.col("landcover") == 40).cast("int"))
    return _pack(m, FX.hydro_interactions(m.columns, "landcover_40"))


def _mart_with_windows(spark, sf_dir, lookback=109):
    """Mart plus W5 offset windows, W2 30/60 prior sums and basin means (G1)."""
    m = obs_mart(spark, sf_dir)
    s = W.series(m, ["station_id"], ["ts", "event_id"], lookback=lookback, split_rows=split_rows(spark))
    cols = {
        "precip_sum_15_to_45_days_prior": W.offset_sum(s, "chirps_ppt", 30, 30),
        "precip_sum_7_to_14_days_prior": W.offset_sum(s, "chirps_ppt", 14, 7),
        "precip_sum_25_to_55_days_prior": W.offset_sum(s, "chirps_ppt", 50, 60),
        "rain_30d_sum": F.round(W.prior_sum(s, "chirps_ppt", 30), 2),
        "rain_60d_sum": F.round(W.prior_sum(s, "chirps_ppt", 60), 2),
    }
    out = s.finish(s.frame.select(*s.frame.columns, *[v.alias(k) for k, v in cols.items()]))
    out = AG.group_mean_transform(out, ["basin_id"], {"soil_clay_0_5": "basin_avg_soil_clay", "soil_ph_0_5": "basin_avg_soil_ph"})
    # Group means snapped to 9 decimals (same in the oracle): they scale
    # values up to 1e10 below, where summation-order noise would show.
    return out.withColumns({c: r(c, 9) for c in ("basin_avg_soil_clay", "basin_avg_soil_ph")})


MART_W_SQL = f"""(SELECT *,
  round(avg(soil_clay_0_5) OVER (PARTITION BY basin_id), 9) AS basin_avg_soil_clay,
  round(avg(soil_ph_0_5) OVER (PARTITION BY basin_id), 9) AS basin_avg_soil_ph
FROM (SELECT *,
  sum(chirps_ppt) OVER (w ROWS BETWEEN 59 PRECEDING AND 30 PRECEDING) AS precip_sum_15_to_45_days_prior,
  sum(chirps_ppt) OVER (w ROWS BETWEEN 20 PRECEDING AND 14 PRECEDING) AS precip_sum_7_to_14_days_prior,
  sum(chirps_ppt) OVER (w ROWS BETWEEN 109 PRECEDING AND 50 PRECEDING) AS precip_sum_25_to_55_days_prior,
  round(sum(chirps_ppt) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 2) AS rain_30d_sum,
  round(sum(chirps_ppt) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 2) AS rain_60d_sum
FROM {MART_SQL} WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)))"""

#: Observations in the rolled rain mean of F17 (rolling_window_obs of config_exp_hydro_regime_signal_v1.yml).
ROLL = 30


def _whole_mart(spark, sf_dir):
    """Mart with every input of the packs: G2 fractions of the place (1 / 5 /
    10 km), W4 means, rolled rain, W2 prior sums and organic carbon."""
    p = places(spark, sf_dir)
    lu = SP.landuse_fractions(p, "lat", "lon", "landcover")
    m = obs_mart(spark, sf_dir).join(lu, ["lat", "lon"], "left").withColumns({
        "cropland_fraction": F.col("cropland_fraction_5km"),
        "urban_fraction": F.col("urban_fraction_5km"),
        "soil_organic_carbon_0_5": F.col("soil_soc_0_5"),
    })
    s = W.series(m, ["station_id"], ["ts", "event_id"], lookback=89, split_rows=split_rows(spark))
    cols = {
        **{f"ppt_obs{n}_mean": W.rolling_mean(s, "chirps_ppt", n, digits=2) for n in (30, 60, 90)},
        "chirps_ppt_roll": W.rolling_mean(s, "chirps_ppt", ROLL, digits=2),
        **{f"rain_{n}d_sum": F.round(W.prior_sum(s, "chirps_ppt", n), 2) for n in (30, 60)},
    }
    out = s.finish(s.frame.select(*s.frame.columns, *[v.alias(k) for k, v in cols.items()]))
    return out.withColumns({"rain_roll_30": F.col("rain_30d_sum"), "rain_roll_60": F.col("rain_60d_sum")})


def _whole_mart_sql() -> str:
    hav = ("2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(p.lat) - radians(q.lat)) / 2), 2) + "
           "cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(q.lon)) / 2), 2))))")
    pts = f"""(SELECT lat, lon, count(*) AS n, sum(CASE WHEN landcover = 40 THEN 1 ELSE 0 END) AS nc,
  sum(CASE WHEN landcover = 50 THEN 1 ELSE 0 END) AS nu FROM {PLACES_SQL} GROUP BY lat, lon)"""
    fr = ", ".join(f"sum(CASE WHEN d <= {k} THEN {c} END) / sum(CASE WHEN d <= {k} THEN n END) AS {name}_fraction_{k}km"
                   for k in SP.LANDUSE_RADII for c, name in (("nc", "cropland"), ("nu", "urban")))
    lu = f"(SELECT lat, lon, {fr} FROM (SELECT q.lat, q.lon, p.n, p.nc, p.nu, {hav} AS d FROM {pts} q, {pts} p) GROUP BY lat, lon)"
    mean = lambda n: (f"round(sum(chirps_ppt) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 2) / "  # noqa: E731
                      f"count(chirps_ppt) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    win = ", ".join([*(f"{mean(n)} AS ppt_obs{n}_mean" for n in (30, 60, 90)), f"{mean(ROLL)} AS chirps_ppt_roll",
                     *(f"round(sum(chirps_ppt) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 2) AS rain_{n}d_sum" for n in (30, 60))])
    return f"""(SELECT m.*, lu.* EXCLUDE (lat, lon), lu.cropland_fraction_5km AS cropland_fraction, lu.urban_fraction_5km AS urban_fraction,
  m.soil_soc_0_5 AS soil_organic_carbon_0_5
FROM (SELECT *, {win} FROM {MART_SQL} WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)) m
LEFT JOIN {lu} lu ON m.lat = lu.lat AND m.lon = lu.lon)"""


WHOLE_MART_SQL = _whole_mart_sql()

F6_COLS = {
    "rain_lag_squared": "round(precip_sum_15_to_45_days_prior, 2) * round(precip_sum_15_to_45_days_prior, 2)",
    "rain_ratio": f"round(precip_sum_15_to_45_days_prior, 2) / {nz('basin_avg_soil_clay + 1e-6')}",
    "hydro_chem_mobility": f"round(precip_sum_15_to_45_days_prior, 2) / {nz('basin_avg_soil_clay + 1e-6')} * slope * soil_ph_0_5",
    "clay_saturation": f"round(precip_sum_15_to_45_days_prior, 2) * round(precip_sum_15_to_45_days_prior, 2) / {nz('soil_clay_0_5 + 1e-6')}",
    "rain_interaction": "round(precip_sum_7_to_14_days_prior, 2) * round(precip_sum_25_to_55_days_prior, 2)",
    "mineral_concentration_index": f"basin_avg_soil_ph * elevation / {nz('pet + 1e-6')}",
    "contact_time_proxy": f"upstream_area_km2 / {nz('slope + 1e-6')}",
}


@query("F6_F7", _sql(F6_COLS, src=MART_W_SQL, digits=4))
def f6_f7_nonlinear_mineral(spark, sf_dir):
    """F6 + F7: non-linear hydrology on the offset windows, mineral loading on
    basin means (G1)."""
    m = _mart_with_windows(spark, sf_dir)
    for c in ("precip_sum_15_to_45_days_prior", "precip_sum_7_to_14_days_prior", "precip_sum_25_to_55_days_prior"):
        m = m.withColumn(c, F.round(c, 2))
    pack = {**FX.nonlinear_hydrology(m.columns), **FX.mineral_loading(m.columns)}
    return _pack(m, pack, digits=4)


F8_COLS = {
    "landcover_urban": "CAST(landcover = 50 AS INTEGER)",
    "landcover_cropland": "CAST(landcover = 40 AS INTEGER)",
    "log_basin_area_km2": "ln(1 + greatest(basin_area_km2, 0))",
    "log_upstream_area_km2": "ln(1 + greatest(upstream_area_km2, 0))",
    "log_dist_to_river_m": "ln(1 + greatest(dist_to_river_m, 0))",
    "basin_slope_loading": "upstream_area_km2 * slope",
    "basin_clay_pressure": "upstream_area_km2 * soil_clay_0_5",
    "basin_ph_buffer": "upstream_area_km2 * soil_ph_0_5",
    "discharge_contact_proxy": f"upstream_area_km2 / {nz('river_discharge_cms + 1.0')}",
    "connectivity_proxy": f"upstream_area_km2 / {nz('dist_to_river_m + 1.0')}",
    "landuse_pressure_proxy": "upstream_area_km2 * (CAST(landcover = 50 AS INTEGER) + CAST(landcover = 40 AS INTEGER))",
}


@query("F8", _sql(F8_COLS))
def f8_basin_context(spark, sf_dir):
    """F8: basin context proxies."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.basin_context(m.columns))


PPT_MEANS = tuple(f"ppt_obs{n}_mean" for n in (30, 60, 90))

F10_COLS = {
    "upstream_stream_power": "upstream_area_km2 * slope",
    "upstream_discharge_contact": f"upstream_area_km2 / {nz('river_discharge_cms + 1.0')}",
    "upstream_connectivity": f"upstream_area_km2 / {nz('dist_to_river_m + 1.0')}",
    "upstream_river_decay": "upstream_area_km2 * exp(-dist_to_river_m / 5000.0)",
    "upstream_soil_clay_pressure": "upstream_area_km2 * soil_clay_0_5",
    "upstream_soc_pressure": "upstream_area_km2 * soil_soc_0_5",
    "upstream_chirps_ppt_pressure": "upstream_area_km2 * chirps_ppt",
    "upstream_chirps_ppt_transport": f"upstream_area_km2 * chirps_ppt / {nz('river_discharge_cms + 1.0')}",
}


@query("F10", _sql(F10_COLS))
def f10_upstream_context(spark, sf_dir):
    """upstream context (rain pressure and transport per rain column)."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.upstream_context(m.columns))


F10_WHOLE_COLS = {
    **F10_COLS,
    **{f"upstream_{c}_pressure": f"upstream_area_km2 * {c}" for c in PPT_MEANS},
    **{f"upstream_{c}_transport": f"upstream_area_km2 * {c} / {nz('river_discharge_cms + 1.0')}" for c in PPT_MEANS},
}


@query("F10_whole", _sql(F10_WHOLE_COLS, src=WHOLE_MART_SQL, digits=4))
def f10_upstream_context_whole(spark, sf_dir):
    """F10 with all four rain columns (instant rain and the W4 means)."""
    m = _whole_mart(spark, sf_dir)
    return _pack(m, FX.upstream_context(m.columns), digits=4)


F11_COLS = {
    "upstream_cropland_pressure": "upstream_area_km2 * 0.0",
    "upstream_urban_pressure": "upstream_area_km2 * 0.0",
    "upstream_soil_clay_pressure": "upstream_area_km2 * coalesce(soil_clay_0_5, 0)",
    "upstream_soc_pressure": "upstream_area_km2 * coalesce(soil_soc_0_5, 0)",
    "upstream_rain_30d_pressure": "upstream_area_km2 * coalesce(rain_30d_sum, 0)",
    "upstream_rain_60d_pressure": "upstream_area_km2 * coalesce(rain_60d_sum, 0)",
    "nutrient_transport_proxy": f"upstream_area_km2 * coalesce(rain_30d_sum, 0) / {nz('coalesce(river_discharge_cms, 0) + 1.0')}",
    "runoff_transfer_index": "coalesce(rain_30d_sum, 0) * coalesce(slope, 0) * exp(-coalesce(dist_to_river_m, 0) / 5000.0)",
    "connectivity_proxy": f"upstream_area_km2 / {nz('coalesce(dist_to_river_m, 0) + 1.0')}",
    "stream_power_proxy": "upstream_area_km2 * coalesce(slope, 0)",
}


@query("F11", _sql(F11_COLS, src=MART_W_SQL, digits=4))
def f11_upstream_pressure_sql(spark, sf_dir):
    """warehouse upstream pressure (NULL inputs as 0). The land-use
    fractions are not part of the mart here, so they are added as NULL (P11)
    and read as 0."""
    m = _mart_with_windows(spark, sf_dir, 60)
    m = m.withColumns(
        {
            "rain_roll_30": F.col("rain_30d_sum"),
            "rain_roll_60": F.col("rain_60d_sum"),
            "cropland_fraction_5km": F.lit(None).cast("double"),
            "urban_fraction_5km": F.lit(None).cast("double"),
        }
    )
    return _pack(m, FX.upstream_pressure_sql(m.columns), digits=4)


F11_WHOLE_COLS = {
    **F11_COLS,
    "upstream_cropland_pressure": "upstream_area_km2 * coalesce(cropland_fraction_5km, 0)",
    "upstream_urban_pressure": "upstream_area_km2 * coalesce(urban_fraction_5km, 0)",
}


@query("F11_whole", _sql(F11_WHOLE_COLS, src=WHOLE_MART_SQL, digits=4))
def f11_upstream_pressure_sql_whole(spark, sf_dir):
    """F11 with the G2 land-use fractions within 5 km."""
    m = _whole_mart(spark, sf_dir)
    return _pack(m, FX.upstream_pressure_sql(m.columns), digits=4)


F12_COLS = {
    "area_x_slope": "upstream_area_km2 * slope",
    "ph_x_area": "soil_ph_0_5 * upstream_area_km2",
    "clay_x_area": "soil_clay_0_5 * upstream_area_km2",
    "discharge_contact_proxy": f"upstream_area_km2 / {nz('river_discharge_cms + 1.0')}",
}


@query("F12", _sql(F12_COLS, src=PLACES_SQL, keep="station_id"))
def f12_station_context(spark, sf_dir):
    """station context table."""
    p = places(spark, sf_dir)
    return _pack(p, FX.station_context(p.columns), keep=("station_id",))


F13_COLS = {
    "upstream_cropland_pressure": "CAST(NULL AS DOUBLE)",
    "upstream_urban_pressure": "CAST(NULL AS DOUBLE)",
    "upstream_soil_clay_pressure": "soil_clay_0_5 * upstream_area_km2",
    "upstream_soc_pressure": "soil_soc_0_5 * upstream_area_km2",
    "upstream_rain_30d_pressure": "rain_30d_sum * upstream_area_km2",
    "upstream_rain_60d_pressure": "rain_60d_sum * upstream_area_km2",
    "flow_contact_proxy": f"upstream_area_km2 / {nz('river_discharge_cms + 1.0')}",
}


@query("F13", _sql(F13_COLS, src=MART_W_SQL, digits=4))
def f13_upstream_pressure(spark, sf_dir):
    """python-form upstream pressure (missing inputs give NULL)."""
    m = _mart_with_windows(spark, sf_dir, 60)
    return _pack(m, FX.upstream_pressure(m.columns), digits=4)


F13_WHOLE_COLS = {
    **F13_COLS,
    "upstream_cropland_pressure": "cropland_fraction_5km * upstream_area_km2",
    "upstream_urban_pressure": "urban_fraction_5km * upstream_area_km2",
}


@query("F13_whole", _sql(F13_WHOLE_COLS, src=WHOLE_MART_SQL, digits=4))
def f13_upstream_pressure_whole(spark, sf_dir):
    """F13 with the G2 land-use fractions within 5 km."""
    m = _whole_mart(spark, sf_dir)
    return _pack(m, FX.upstream_pressure(m.columns), digits=4)


F14_COLS = {
    "log_dist_to_river": "ln(1 + greatest(dist_to_river_m, 0))",
    "river_influence_decay_1": "exp(-greatest(dist_to_river_m, 0) / 1000.0)",
    "river_influence_decay_5": "exp(-greatest(dist_to_river_m, 0) / 5000.0)",
    "river_influence_decay_10": "exp(-greatest(dist_to_river_m, 0) / 10000.0)",
    "stream_power_proxy": "greatest(slope, 0) * greatest(upstream_area_km2, 0)",
    "connectivity_proxy": f"greatest(upstream_area_km2, 0) / {nz('greatest(dist_to_river_m, 0) + 1.0')}",
    "discharge_contact_proxy": f"greatest(upstream_area_km2, 0) / {nz('greatest(river_discharge_cms, 0) + 1.0')}",
    "basin_compaction_proxy": f"river_catch_skm / {nz('basin_area_km2 + 1e-6')}",
    "runoff_transfer_index": f"{gz('rain_30d_sum')} * greatest(slope, 0) * exp(-greatest(dist_to_river_m, 0) / 5000.0)",
    "nutrient_transport_proxy": f"greatest(upstream_area_km2, 0) * {gz('rain_30d_sum')} / {nz('greatest(river_discharge_cms, 0) + 1.0')}",
}


@query("F14", _sql(F14_COLS, src=MART_W_SQL, digits=4))
def f14_connectivity(spark, sf_dir):
    """connectivity proxies; inputs clipped at 0; a proxy is skipped when
    an input column is entirely NULL (one aggregate decides)."""
    m = _mart_with_windows(spark, sf_dir, 60)
    m = m.withColumn("catch_to_basin_ratio", FX.hydro_engineered(m.columns)["catch_to_basin_ratio"])
    inputs = ["dist_to_river_m", "upstream_area_km2", "slope", "river_discharge_cms", "rain_30d_sum", "catch_to_basin_ratio"]
    present = AG.non_null_flags(m, inputs)
    return _pack(m, FX.connectivity(m.columns, present), digits=4)


F14_WHOLE_COLS = {
    **F14_COLS,
    "upstream_pressure_index": f"{gz('upstream_area_km2')} * (coalesce({gz('cropland_fraction_5km')}, 0) + coalesce({gz('urban_fraction_5km')}, 0))",
}


@query("F14_whole", _sql(F14_WHOLE_COLS, src=WHOLE_MART_SQL, digits=4))
def f14_connectivity_whole(spark, sf_dir):
    """F14 with the pressure index of the G2 fractions within 5 km."""
    m = _whole_mart(spark, sf_dir)
    m = m.withColumn("catch_to_basin_ratio", FX.hydro_engineered(m.columns)["catch_to_basin_ratio"])
    inputs = ["dist_to_river_m", "upstream_area_km2", "slope", "river_discharge_cms", "rain_30d_sum", "catch_to_basin_ratio",
              "cropland_fraction_5km", "urban_fraction_5km"]
    present = AG.non_null_flags(m, inputs)
    return _pack(m, FX.connectivity(m.columns, present), digits=4)


F15_COLS = {
    "soil_clay_flow": "soil_clay_0_5 * upstream_area_km2",
    "urban_flow": "CAST(CAST(landcover AS DOUBLE) = 50.0 AS DOUBLE) * upstream_area_km2",
    "soil_ph_buffer": "soil_ph_0_5 * ln(1 + greatest(upstream_area_km2, 0.0))",
    "flow_contact_time": "upstream_area_km2 / (greatest(river_discharge_cms, 0.0) + 1.0)",
    "chemical_accumulation_index": "ln(1 + greatest(upstream_area_km2, 0.0)) * soil_soc_0_5 / (greatest(river_discharge_cms, 0.0) + 1.0)",
    "river_decay_5km": "exp(-greatest(dist_to_river_m, 0.0) / 5000.0)",
    "river_decay_10km": "exp(-greatest(dist_to_river_m, 0.0) / 10000.0)",
    "river_influence": "exp(-greatest(dist_to_river_m, 0.0) / 5000.0) * ln(1 + greatest(upstream_area_km2, 0.0))",
    "NDMI_upstream": "NDMI * upstream_area_km2",
    "slope_runoff": "slope * chirps_ppt",
    "soil_precip_interaction": "soil_clay_0_5 * chirps_ppt",
    "ph_runoff_proxy": "soil_ph_0_5 * slope",
    "mineral_contact_time": "ln(1 + greatest(upstream_area_km2, 0.0)) * elevation / (greatest(river_discharge_cms, 0.0) + 1.0)",
    "mineral_gradient": "elevation * exp(-greatest(dist_to_river_m, 0.0) / 5000.0)",
}


@query("F15", _sql(F15_COLS, digits=4))
def f15_hydro_process(spark, sf_dir):
    """14 hydro-process formulas (missing inputs read as 0)."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.hydro_process(m.columns), digits=4)


F16_COLS = {
    "log_basin_area_km2": "ln(1 + greatest(basin_area_km2, 0))",
    "log_dist_to_river_m": "ln(1 + greatest(dist_to_river_m, 0))",
    "log_upstream_area_km2": "ln(1 + greatest(upstream_area_km2, 0))",
    "log_river_discharge_cms": "ln(1 + greatest(river_discharge_cms, 0))",
    "catch_to_basin_ratio": f"river_catch_skm / {nz('basin_area_km2 + 1e-6')}",
    "twi_proxy": "ln(1 + upstream_area_km2 * 1e6 / greatest(tan(greatest(radians(slope), 1e-6)), 1e-6))",
    "upslope_flow_proxy": "upstream_area_km2 * basin_order",
}


@query("F16", _sql(F16_COLS, src=PLACES_SQL, keep="station_id"))
def f16_hydro_engineered(spark, sf_dir):
    """F16: hydrology engineered at build time."""
    p = places(spark, sf_dir)
    return _pack(p, FX.hydro_engineered(p.columns), keep=("station_id",))


_NDVI = f"(nir - red) / {nz('nir + red + 1e-6')}"
F17_COLS = {
    "NDVI_proxy": _NDVI,
    "A_precip_over_pet": f"chirps_ppt / {nz('pet + 1e-6')}",
    "A_ndvi_x_precip": f"{_NDVI} * chirps_ppt",
    "A_soil_clay_x_precip": "soil_clay_0_5 * chirps_ppt",
    "A_slope_x_precip": "slope * chirps_ppt",
    "A_ndvi_x_soil_clay": f"{_NDVI} * soil_clay_0_5",
    "C_runoff_proxy": "chirps_ppt * slope",
    "C_nutrient_transport": "chirps_ppt * soil_clay_0_5",
    "C_wetness_index": f"chirps_ppt / {nz('pet + 1e-6')}",
    "C_vegetation_runoff": f"{_NDVI} * chirps_ppt",
    "C_soil_retention": f"soil_clay_0_5 * {_NDVI}",
}


@query("F17", _sql(F17_COLS, digits=4))
def f17_research_candidates(spark, sf_dir):
    """research candidate families A and C, NDVI from nir/red."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, FX.research_candidates(m.columns), digits=4)


F17_WHOLE_COLS = {**F17_COLS, "A_roll_precip_over_pet": f"chirps_ppt_roll / {nz('pet + 1e-6')}"}


@query("F17_whole", _sql(F17_WHOLE_COLS, src=WHOLE_MART_SQL, digits=4))
def f17_research_candidates_whole(spark, sf_dir):
    """F17 with the rolled rain over PET (6 + 5 columns)."""
    m = _whole_mart(spark, sf_dir)
    return _pack(m, FX.research_candidates(m.columns), digits=4)


@query(
    "F18",
    f"""
SELECT event_id,
  CAST(coalesce(month(ts) = 12, false) AS INTEGER) AS is_m12,
  CAST(coalesce(pet > 198.8, false) AS INTEGER) AS is_pet_high,
  CAST(coalesce(dist_main_km > 498.1, false) AS INTEGER) AS is_dist_high,
  CAST(coalesce(pet > 198.8, false) AS INTEGER) * CAST(coalesce(month(ts) = 12, false) AS INTEGER) AS is_pet_high_x_m12,
  CAST(coalesce(dist_main_km > 498.1, false) AS INTEGER) * CAST(coalesce(month(ts) = 12, false) AS INTEGER) AS is_dist_high_x_m12,
  coalesce(pet > 198.8, false) AS pet_high, NOT coalesce(pet > 198.8, false) AS pet_low
FROM {MART_SQL}
""",
)
def f18_regime_flags(spark, sf_dir):
    """regime flags (month 12, PET > 198.8, distance > 498.1), S16 nulls."""
    m = obs_mart(spark, sf_dir).withColumn("month", F.month("ts"))
    flags = FX.regime_flags("month", "pet", "dist_main_km")
    return m.select("event_id", *[v.alias(k) for k, v in flags.items()])


F19_COLS = {
    "clay_x_elevation": "soil_clay_0_5 * elevation",
    "ph_x_area": "soil_ph_0_5 * upstream_area_km2",
    "area_x_slope": "upstream_area_km2 * slope",
    "sin_doy_x_ppt": "sin(2 * pi() * dayofyear(ts) / 365.0) * chirps_ppt",
    "sin_doy_x_area": "sin(2 * pi() * dayofyear(ts) / 365.0) * upstream_area_km2",
}


@query("F19", _sql(F19_COLS, digits=4))
def f19_extra_interactions(spark, sf_dir):
    """extra interaction patch (terms whose inputs exist)."""
    m = obs_mart(spark, sf_dir)
    m = m.withColumn("sin_doy", FX.seasonal_cycle("ts")["sin_doy"])
    return _pack(m, FX.extra_interactions(m.columns), digits=4)


F19_WHOLE_COLS = {
    **F19_COLS,
    "cropland_x_ppt": "cropland_fraction * chirps_ppt",
    "cropland_x_area": "cropland_fraction * upstream_area_km2",
    "cropland_x_slope": "cropland_fraction * slope",
    "urban_x_area": "urban_fraction * upstream_area_km2",
    "organic_x_clay": "soil_organic_carbon_0_5 * soil_clay_0_5",
}


@query("F19_whole", _sql(F19_WHOLE_COLS, src=WHOLE_MART_SQL, digits=4))
def f19_extra_interactions_whole(spark, sf_dir):
    """F19 with all 10 interactions."""
    m = _whole_mart(spark, sf_dir)
    m = m.withColumn("sin_doy", FX.seasonal_cycle("ts")["sin_doy"])
    return _pack(m, FX.extra_interactions(m.columns), digits=4)


F20_COLS = {
    "lat2": "lat * lat",
    "lon2": "lon * lon",
    "lat_lon": "lat * lon",
    "distance_to_center": "sqrt(pow(lat - c_lat, 2) + pow(lon - c_lon, 2))",
}


@query("F20", _sql(F20_COLS, extra_from=f", (SELECT avg(lat) AS c_lat, avg(lon) AS c_lon FROM {MART_SQL}) c"))
def f20_residual_basis(spark, sf_dir):
    """residual spatial basis around the mean centre."""
    m = obs_mart(spark, sf_dir)
    c = m.agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    j = m.crossJoin(F.broadcast(c))
    return _pack(j, FX.residual_basis("lat", "lon", F.col("c_lat"), F.col("c_lon")))


@query(
    "F21",
    """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 3) THEN NULL ELSE o_totalprice - 150000 END AS y FROM orders),
m AS (SELECT quantile_cont(y, 0.5) AS med FROM b)
SELECT o_orderkey, round(greatest(coalesce(y, med), 0), 4) AS y_safe FROM b, m
""",
)
def f21_finite_guard(spark, sf_dir):
    """missing / non-finite -> median, then clip at 0."""
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderkey") % 11 == 1, float("nan"))
        .when(F.col("o_orderkey") % 11 == 2, float("inf")).when(F.col("o_orderkey") % 11 == 3, float("-inf"))
        .otherwise(F.col("o_totalprice") - 150000).alias("y"),
    )
    med = RK.quantiles(o.select(nan_to_null("y").alias("y")), "y", [0.5], ["_med"])
    j = o.crossJoin(F.broadcast(med))
    return j.select("o_orderkey", r(FX.finite_guard("y", F.col("_med"), 0.0), 4).alias("y_safe"))


@query(
    "F22",
    """
WITH b AS (SELECT o_orderkey, ln(1 + o_totalprice) / 2 AS y_log, o_totalprice AS y_raw FROM orders),
m AS (SELECT max(y_log) AS mx_log, max(y_raw) AS mx_raw FROM b)
SELECT o_orderkey,
  round(CASE WHEN mx_log < 10 THEN exp(y_log) - 1 ELSE y_log END, 4) AS y_log_repaired,
  round(CASE WHEN mx_raw < 10 THEN exp(y_raw) - 1 ELSE y_raw END, 4) AS y_raw_repaired
FROM b, m
""",
)
def f22_scale_repair(spark, sf_dir):
    """expm1 when the column maximum is below 10."""
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey", (F.log1p("o_totalprice") / 2).alias("y_log"), F.col("o_totalprice").alias("y_raw")
    )
    mx = o.agg(F.max("y_log").alias("_mx_log"), F.max("y_raw").alias("_mx_raw"))
    j = o.crossJoin(F.broadcast(mx))
    return j.select(
        "o_orderkey",
        r(FX.scale_repair("y_log", F.col("_mx_log")), 4).alias("y_log_repaired"),
        r(FX.scale_repair("y_raw", F.col("_mx_raw")), 4).alias("y_raw_repaired"),
    )


@query("F23", _sql({"rain_over_pet": f"chirps_ppt / {nz('pet + 1.0')}"}))
def f23_audit_ratio(spark, sf_dir):
    """instant rain over (PET + 1)."""
    m = obs_mart(spark, sf_dir)
    return _pack(m, {"rain_over_pet": FX.audit_ratio("chirps_ppt", "pet")})
