"""Row-level formula packs.

Each pack returns ``{output name: Column}`` for the inputs present in the
DataFrame's columns (a pack adds only what its inputs allow, like the
reference). Apply with ``df.withColumns(pack(df.columns))``. Arithmetic is
null-propagating; every ratio goes through ``try_divide`` so a zero
denominator gives NULL rather than an ANSI error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import c, clip_lower, ratio

# Fixed values used by the formulas.
EPS = 1e-6
DECAY_M = {"1": 1000.0, "5": 5000.0, "10": 10000.0}
CROPLAND_CODE = 40
URBAN_CODE = 50


def _has(cols, *names) -> bool:
    s = set(cols)
    return all(n in s for n in names)


def col(n) -> Column:
    return F.col(n)


def log1p_clip(n) -> Column:
    return F.log1p(clip_lower(n, 0.0))


def seasonal_cycle(date) -> dict[str, Column]:
    """sin/cos of 2*pi*doy/365 and 2*pi*month/12."""
    d = F.col(date) if isinstance(date, str) else date
    doy = F.dayofyear(d)
    mon = F.month(d)
    return {
        "sin_doy": F.sin(F.lit(2 * math.pi) * doy / 365.0),
        "cos_doy": F.cos(F.lit(2 * math.pi) * doy / 365.0),
        "sin_month": F.sin(F.lit(2 * math.pi) * mon / 12.0),
        "cos_month": F.cos(F.lit(2 * math.pi) * mon / 12.0),
    }


def moisture_pack(r30, r60, p30, p60) -> dict[str, Column]:
    """W11 ratios: rain over PET (+1) and the dryness package."""
    return {
        "rain_to_pet_30d": ratio(r30, p30, 1.0),
        "rain_to_pet_60d": ratio(r60, p60, 1.0),
        "pet_30d_sum": col(p30),
        "deficit_30d": col(r30) - col(p30),
        "humidity_proxy_30d": ratio(r30, p30, 1.0),
        "dryness_index_30d": ratio(p30, r30, 1.0),
    }


def spectral(cols, lat="lat", lon="lon") -> dict[str, Column]:
    """spectral products, ratios, differences, logs and coordinate terms."""
    o = {}
    if _has(cols, "NDMI", "pet"):
        o["NDMI_x_pet"] = col("NDMI") * col("pet")
    if _has(cols, "MNDWI", "pet"):
        o["MNDWI_x_pet"] = col("MNDWI") * col("pet")
    if _has(cols, "swir16", "swir22"):
        o["swir_ratio_16_22"] = ratio("swir16", "swir22", EPS)
    if _has(cols, "nir", "swir22"):
        o["nir_ratio_swir22"] = ratio("nir", "swir22", EPS)
        o["nir_minus_swir22"] = col("nir") - col("swir22")
    if _has(cols, "green", "swir16"):
        o["green_ratio_swir16"] = ratio("green", "swir16", EPS)
        o["green_minus_swir16"] = col("green") - col("swir16")
    for b in ("pet", "nir", "green", "swir16", "swir22"):
        if b in cols:
            o[f"log_{b}"] = F.log1p(F.abs(col(b)))
    o["lat2"] = col(lat) * col(lat)
    o["lon2"] = col(lon) * col(lon)
    o["lat_lon"] = col(lat) * col(lon)
    return o


def wetness(cols) -> dict[str, Column]:
    """rain over PET, twice (the reference keeps both names)."""
    if not _has(cols, "chirps_ppt", "pet"):
        return {}
    return {"runoff_index": ratio("chirps_ppt", "pet", EPS), "wetness_index": ratio("chirps_ppt", "pet", EPS)}


def drp_focused(cols) -> dict[str, Column]:
    """hydrology x moisture interactions, log hydrology, two proxies."""
    o = {}
    pairs = [
        ("NDMI", "dist_to_river_m"),
        ("MNDWI", "dist_to_river_m"),
        ("NDMI", "upstream_area_km2"),
        ("MNDWI", "upstream_area_km2"),
        ("pet", "dist_to_river_m"),
        ("pet", "basin_area_km2"),
        ("pet", "upstream_area_km2"),
    ]
    for a, b in pairs:
        if _has(cols, a, b):
            o[f"{a}_x_{b}"] = col(a) * col(b)
    for h in ("dist_to_river_m", "basin_area_km2", "upstream_area_km2"):
        if h in cols:
            o[f"log_{h}"] = F.log1p(col(h))
    if _has(cols, "MNDWI", "dist_to_river_m"):
        o["wetness_hydro_proxy"] = F.try_divide(col("MNDWI"), F.log1p(col("dist_to_river_m")) + 1)
    if _has(cols, "NDMI", "dist_to_river_m"):
        o["moisture_hydro_proxy"] = F.try_divide(col("NDMI"), F.log1p(col("dist_to_river_m")) + 1)
    return o


def spatial_encoding(lat="lat", lon="lon", center_lat=None, center_lon=None) -> dict[str, Column]:
    """cubes, sin/cos of the coordinates and the distance to a centre
    (pass the median centre, G19; it is the final definition, S15)."""
    rad = math.pi / 180.0
    o = {
        "lat3": F.pow(col(lat), 3),
        "lon3": F.pow(col(lon), 3),
        "sin_lat": F.sin(col(lat) * rad),
        "cos_lat": F.cos(col(lat) * rad),
        "sin_lon": F.sin(col(lon) * rad),
        "cos_lon": F.cos(col(lon) * rad),
    }
    if center_lat is not None:
        o["dist_center"] = F.sqrt(F.pow(col(lat) - center_lat, 2) + F.pow(col(lon) - center_lon, 2))
    return o


def hydro_interactions(cols, landcover_col: str | None = None) -> dict[str, Column]:
    """clay*slope, clay*elevation, slope*landcover, pH*landcover (the
    first one-hot landcover column stands in for landcover)."""
    o = {}
    if _has(cols, "soil_clay_0_5", "slope"):
        o["soil_clay_slope"] = col("soil_clay_0_5") * col("slope")
    if _has(cols, "soil_clay_0_5", "elevation"):
        o["soil_clay_elevation"] = col("soil_clay_0_5") * col("elevation")
    if landcover_col is None:
        lc = [c for c in cols if c.startswith("landcover_")]
        landcover_col = lc[0] if lc else None
    if landcover_col is not None:
        if "slope" in cols:
            o["slope_landcover"] = col("slope") * col(landcover_col)
        if "soil_ph_0_5" in cols:
            o["soil_ph_landcover"] = col("soil_ph_0_5") * col(landcover_col)
    return o


def nonlinear_hydrology(cols) -> dict[str, Column]:
    """squared lagged rain, rain over basin clay, mobility, clay
    saturation, dual-window product. Later terms read earlier outputs."""
    o = {}
    if "precip_sum_15_to_45_days_prior" not in cols:
        return o
    p = col("precip_sum_15_to_45_days_prior")
    o["rain_lag_squared"] = p * p
    if "basin_avg_soil_clay" in cols:
        o["rain_ratio"] = ratio("precip_sum_15_to_45_days_prior", "basin_avg_soil_clay", EPS)
        if _has(cols, "slope", "soil_ph_0_5"):
            o["hydro_chem_mobility"] = o["rain_ratio"] * col("slope") * col("soil_ph_0_5")
    if "soil_clay_0_5" in cols:
        o["clay_saturation"] = F.try_divide(o["rain_lag_squared"], col("soil_clay_0_5") + EPS)
    if _has(cols, "precip_sum_7_to_14_days_prior", "precip_sum_25_to_55_days_prior"):
        o["rain_interaction"] = col("precip_sum_7_to_14_days_prior") * col("precip_sum_25_to_55_days_prior")
    return o


def mineral_loading(cols) -> dict[str, Column]:
    """basin pH x elevation over PET, upstream area over slope. The
    basin mean (G1) must already be a column."""
    o = {}
    if _has(cols, "basin_avg_soil_ph", "elevation", "pet"):
        o["mineral_concentration_index"] = F.try_divide(col("basin_avg_soil_ph") * col("elevation"), col("pet") + EPS)
    if _has(cols, "upstream_area_km2", "slope"):
        o["contact_time_proxy"] = ratio("upstream_area_km2", "slope", EPS)
    return o


def basin_context(cols) -> dict[str, Column]:
    """F8: land-use flags, clipped logs and basin loading/pressure proxies."""
    o = {}
    if "landcover" in cols:
        o["landcover_urban"] = (col("landcover") == URBAN_CODE).cast("int")
        o["landcover_cropland"] = (col("landcover") == CROPLAND_CODE).cast("int")
    for h in ("basin_area_km2", "upstream_area_km2", "dist_to_river_m"):
        if h in cols:
            o[f"log_{h}"] = log1p_clip(h)
    up = col("upstream_area_km2")
    if "upstream_area_km2" in cols:
        if "slope" in cols:
            o["basin_slope_loading"] = up * col("slope")
        if "soil_clay_0_5" in cols:
            o["basin_clay_pressure"] = up * col("soil_clay_0_5")
        if "soil_ph_0_5" in cols:
            o["basin_ph_buffer"] = up * col("soil_ph_0_5")
        if "river_discharge_cms" in cols:
            o["discharge_contact_proxy"] = ratio("upstream_area_km2", "river_discharge_cms", 1.0)
        if "dist_to_river_m" in cols:
            o["connectivity_proxy"] = ratio("upstream_area_km2", "dist_to_river_m", 1.0)
        if "landcover" in cols:
            o["landuse_pressure_proxy"] = up * (o["landcover_urban"] + o["landcover_cropland"])
    return o


def upstream_context(cols, rain_cols=("chirps_ppt", "ppt_obs30_mean", "ppt_obs60_mean", "ppt_obs90_mean")):
    """stream power, discharge contact, connectivity, exp(-d/5000)
    decay, soil pressures, rain pressure and transport per rain column."""
    o = {}
    if "upstream_area_km2" not in cols:
        return o
    up = col("upstream_area_km2")
    if "slope" in cols:
        o["upstream_stream_power"] = up * col("slope")
    if "river_discharge_cms" in cols:
        o["upstream_discharge_contact"] = ratio("upstream_area_km2", "river_discharge_cms", 1.0)
    if "dist_to_river_m" in cols:
        o["upstream_connectivity"] = ratio("upstream_area_km2", "dist_to_river_m", 1.0)
        o["upstream_river_decay"] = up * F.exp(-col("dist_to_river_m") / DECAY_M["5"])
    if "soil_clay_0_5" in cols:
        o["upstream_soil_clay_pressure"] = up * col("soil_clay_0_5")
    if "soil_soc_0_5" in cols:
        o["upstream_soc_pressure"] = up * col("soil_soc_0_5")
    for rc in rain_cols:
        if rc in cols:
            o[f"upstream_{rc}_pressure"] = up * col(rc)
            if "river_discharge_cms" in cols:
                o[f"upstream_{rc}_transport"] = F.try_divide(up * col(rc), col("river_discharge_cms") + 1.0)
    return o


def upstream_pressure_sql(cols) -> dict[str, Column]:
    """warehouse form, NULL inputs read as 0 (except the area)."""
    z = lambda n: F.coalesce(col(n), F.lit(0.0))
    up = col("upstream_area_km2")
    return {
        "upstream_cropland_pressure": up * z("cropland_fraction_5km"),
        "upstream_urban_pressure": up * z("urban_fraction_5km"),
        "upstream_soil_clay_pressure": up * z("soil_clay_0_5"),
        "upstream_soc_pressure": up * z("soil_soc_0_5"),
        "upstream_rain_30d_pressure": up * z("rain_roll_30"),
        "upstream_rain_60d_pressure": up * z("rain_roll_60"),
        "nutrient_transport_proxy": F.try_divide(up * z("rain_roll_30"), z("river_discharge_cms") + 1.0),
        "runoff_transfer_index": z("rain_roll_30") * z("slope") * F.exp(-z("dist_to_river_m") / DECAY_M["5"]),
        "connectivity_proxy": F.try_divide(up, z("dist_to_river_m") + 1.0),
        "stream_power_proxy": up * z("slope"),
    }


def station_context(cols) -> dict[str, Column]:
    """station context products and the discharge contact ratio."""
    up = col("upstream_area_km2")
    return {
        "area_x_slope": up * col("slope"),
        "ph_x_area": col("soil_ph_0_5") * up,
        "clay_x_area": col("soil_clay_0_5") * up,
        "discharge_contact_proxy": ratio("upstream_area_km2", "river_discharge_cms", 1.0),
    }


def upstream_pressure(cols) -> dict[str, Column]:
    """python form (NULL-propagating) of the upstream pressures."""
    g = lambda n: col(n) if n in cols else F.lit(None).cast("double")
    up = g("upstream_area_km2")
    return {
        "upstream_cropland_pressure": g("cropland_fraction_5km") * up,
        "upstream_urban_pressure": g("urban_fraction_5km") * up,
        "upstream_soil_clay_pressure": g("soil_clay_0_5") * up,
        "upstream_soc_pressure": g("soil_soc_0_5") * up,
        "upstream_rain_30d_pressure": g("rain_30d_sum") * up,
        "upstream_rain_60d_pressure": g("rain_60d_sum") * up,
        "flow_contact_proxy": F.try_divide(up, g("river_discharge_cms") + 1.0),
    }


def connectivity(cols, present: dict[str, bool] | None = None) -> dict[str, Column]:
    """connectivity proxies with inputs clipped at 0. ``present`` maps an
    input to "has at least one non-NULL value" (one aggregate over the table,
    see ``operators.aggregates.non_null_flags``); a proxy is skipped when an
    input is entirely missing."""
    present = present or {}
    has = lambda n: n in cols and present.get(n, True)
    cl = lambda n: clip_lower(n, 0.0)
    o = {}
    if has("dist_to_river_m"):
        d = cl("dist_to_river_m")
        o["log_dist_to_river"] = F.log1p(d)
        for k, m in DECAY_M.items():
            o[f"river_influence_decay_{k}"] = F.exp(-d / m)
    if has("upstream_area_km2") and has("slope"):
        o["stream_power_proxy"] = cl("slope") * cl("upstream_area_km2")
    if has("upstream_area_km2") and has("dist_to_river_m"):
        o["connectivity_proxy"] = F.try_divide(cl("upstream_area_km2"), cl("dist_to_river_m") + 1.0)
    if has("upstream_area_km2") and has("river_discharge_cms"):
        o["discharge_contact_proxy"] = F.try_divide(cl("upstream_area_km2"), cl("river_discharge_cms") + 1.0)
    if has("catch_to_basin_ratio"):
        o["basin_compaction_proxy"] = col("catch_to_basin_ratio")
    if has("upstream_area_km2") and (has("cropland_fraction_5km") or has("urban_fraction_5km")):
        z = lambda n: F.coalesce(cl(n), F.lit(0.0)) if n in cols else F.lit(0.0)
        o["upstream_pressure_index"] = cl("upstream_area_km2") * (z("cropland_fraction_5km") + z("urban_fraction_5km"))
    if has("rain_30d_sum") and has("slope") and "river_influence_decay_5" in o:
        o["runoff_transfer_index"] = cl("rain_30d_sum") * cl("slope") * o["river_influence_decay_5"]
    if has("upstream_area_km2") and has("rain_30d_sum") and has("river_discharge_cms"):
        o["nutrient_transport_proxy"] = F.try_divide(
            cl("upstream_area_km2") * cl("rain_30d_sum"), cl("river_discharge_cms") + 1.0
        )
    return o


def hydro_process(cols) -> dict[str, Column]:
    """14 hydro-process formulas; a missing input reads as 0."""
    g = lambda n: col(n).cast("double") if n in cols else F.lit(0.0)
    if "landcover_urban" in cols:
        urban = g("landcover_urban")
    elif "landcover" in cols:
        urban = (col("landcover").cast("double") == float(URBAN_CODE)).cast("double")
    else:
        urban = F.lit(0.0)
    up, clay, ph, soc = g("upstream_area_km2"), g("soil_clay_0_5"), g("soil_ph_0_5"), g("soil_soc_0_5")
    slope, elev, q, dist = g("slope"), g("elevation"), g("river_discharge_cms"), g("dist_to_river_m")
    ndmi, precip = g("NDMI"), g("chirps_ppt")
    lup = F.log1p(F.greatest(up, F.lit(0.0)))
    q1 = F.greatest(q, F.lit(0.0)) + 1.0
    decay5 = F.exp(-F.greatest(dist, F.lit(0.0)) / DECAY_M["5"])
    return {
        "soil_clay_flow": clay * up,
        "urban_flow": urban * up,
        "soil_ph_buffer": ph * lup,
        "flow_contact_time": up / q1,
        "chemical_accumulation_index": lup * soc / q1,
        "river_decay_5km": decay5,
        "river_decay_10km": F.exp(-F.greatest(dist, F.lit(0.0)) / DECAY_M["10"]),
        "river_influence": decay5 * lup,
        "NDMI_upstream": ndmi * up,
        "slope_runoff": slope * precip,
        "soil_precip_interaction": clay * precip,
        "ph_runoff_proxy": ph * slope,
        "mineral_contact_time": lup * elev / q1,
        "mineral_gradient": elev * decay5,
    }


ORDER_COLUMNS = ("basin_order", "river_order_flow", "river_order_stra", "river_order_clas")


def hydro_engineered(cols) -> dict[str, Column]:
    """F16: logs, catchment ratio, TWI proxy and flow proxy (first order
    column present, in the fixed preference order above)."""
    o = {}
    if _has(cols, "basin_area_km2", "dist_to_river_m"):
        o["log_basin_area_km2"] = log1p_clip("basin_area_km2")
        o["log_dist_to_river_m"] = log1p_clip("dist_to_river_m")
    if "upstream_area_km2" in cols:
        o["log_upstream_area_km2"] = log1p_clip("upstream_area_km2")
    if "river_discharge_cms" in cols:
        o["log_river_discharge_cms"] = log1p_clip("river_discharge_cms")
    if _has(cols, "river_catch_skm", "basin_area_km2"):
        o["catch_to_basin_ratio"] = ratio("river_catch_skm", "basin_area_km2", EPS)
    if _has(cols, "upstream_area_km2", "slope"):
        slope_rad = F.greatest(F.radians(col("slope")), F.lit(EPS))
        tan_slope = F.greatest(F.tan(slope_rad), F.lit(EPS))
        o["twi_proxy"] = F.log1p(col("upstream_area_km2") * 1e6 / tan_slope)
    oc = next((c for c in ORDER_COLUMNS if c in cols), None)
    if "upstream_area_km2" in cols and oc is not None:
        o["upslope_flow_proxy"] = col("upstream_area_km2") * col(oc)
    return o


def research_candidates(cols) -> dict[str, Column]:
    """families A and C; NDVI from nir/red when no NDVI column."""
    o = {}
    ndvi = None
    if "NDVI" in cols:
        ndvi = col("NDVI").cast("double")
    elif _has(cols, "nir", "red"):
        ndvi = F.try_divide(col("nir") - col("red"), col("nir") + col("red") + EPS)
    if ndvi is not None:
        o["NDVI_proxy"] = ndvi
    if _has(cols, "chirps_ppt", "pet"):
        o["A_precip_over_pet"] = ratio("chirps_ppt", "pet", EPS)
    if _has(cols, "chirps_ppt_roll", "pet"):
        o["A_roll_precip_over_pet"] = ratio("chirps_ppt_roll", "pet", EPS)
    if ndvi is not None and "chirps_ppt" in cols:
        o["A_ndvi_x_precip"] = ndvi * col("chirps_ppt")
    if _has(cols, "soil_clay_0_5", "chirps_ppt"):
        o["A_soil_clay_x_precip"] = col("soil_clay_0_5") * col("chirps_ppt")
    if _has(cols, "slope", "chirps_ppt"):
        o["A_slope_x_precip"] = col("slope") * col("chirps_ppt")
    if ndvi is not None and "soil_clay_0_5" in cols:
        o["A_ndvi_x_soil_clay"] = ndvi * col("soil_clay_0_5")
    if _has(cols, "chirps_ppt", "slope"):
        o["C_runoff_proxy"] = col("chirps_ppt") * col("slope")
    if _has(cols, "chirps_ppt", "soil_clay_0_5"):
        o["C_nutrient_transport"] = col("chirps_ppt") * col("soil_clay_0_5")
    if _has(cols, "chirps_ppt", "pet"):
        o["C_wetness_index"] = ratio("chirps_ppt", "pet", EPS)
    if ndvi is not None and "chirps_ppt" in cols:
        o["C_vegetation_runoff"] = ndvi * col("chirps_ppt")
    if ndvi is not None and "soil_clay_0_5" in cols:
        o["C_soil_retention"] = col("soil_clay_0_5") * ndvi
    return o


# Regime thresholds.
REGIME_MONTH = 12
PET_HIGH = 198.8
DIST_MAIN_HIGH = 498.1


def regime_flags(month="month", pet="pet", dist="dist_main_km", m=REGIME_MONTH, pet_t=PET_HIGH, dist_t=DIST_MAIN_HIGH):
    """regime flags and pair interactions; a NULL comparison is false
    (S16), and ``pet_low`` is the negation of ``pet_high``."""
    is_m12 = F.coalesce(c(month) == m, F.lit(False)).cast("int")
    pet_high = F.coalesce(c(pet) > pet_t, F.lit(False))
    is_dist = F.coalesce(c(dist) > dist_t, F.lit(False)).cast("int")
    return {
        "is_m12": is_m12,
        "is_pet_high": pet_high.cast("int"),
        "is_dist_high": is_dist,
        "is_pet_high_x_m12": pet_high.cast("int") * is_m12,
        "is_dist_high_x_m12": is_dist * is_m12,
        "pet_high": pet_high,
        "pet_low": ~pet_high,
    }


def extra_interactions(cols) -> dict[str, Column]:
    """crop, urban, geology, organic and season x rain interactions."""
    o = {}
    spec = [
        ("cropland_x_ppt", "cropland_fraction", "chirps_ppt"),
        ("cropland_x_area", "cropland_fraction", "upstream_area_km2"),
        ("cropland_x_slope", "cropland_fraction", "slope"),
        ("urban_x_area", "urban_fraction", "upstream_area_km2"),
        ("clay_x_elevation", "soil_clay_0_5", "elevation"),
        ("ph_x_area", "soil_ph_0_5", "upstream_area_km2"),
        ("area_x_slope", "upstream_area_km2", "slope"),
        ("organic_x_clay", "soil_organic_carbon_0_5", "soil_clay_0_5"),
        ("sin_doy_x_ppt", "sin_doy", "chirps_ppt"),
        ("sin_doy_x_area", "sin_doy", "upstream_area_km2"),
    ]
    for name, a, b in spec:
        if _has(cols, a, b):
            o[name] = col(a) * col(b)
    return o


def residual_basis(lat="lat", lon="lon", center_lat=None, center_lon=None) -> dict[str, Column]:
    """residual spatial basis (centre = mean centre of the train side)."""
    return {
        "lat2": col(lat) * col(lat),
        "lon2": col(lon) * col(lon),
        "lat_lon": col(lat) * col(lon),
        "distance_to_center": F.sqrt(F.pow(col(lat) - center_lat, 2) + F.pow(col(lon) - center_lon, 2)),
    }


def finite_guard(x, fill, lower: float | None = 0.0) -> Column:
    """NaN / +-inf / NULL -> ``fill`` (a median column or literal), then
    clip at ``lower``."""
    v = F.col(x) if isinstance(x, str) else x
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    out = F.when(bad, fill).otherwise(v)
    return F.greatest(out, F.lit(lower)) if lower is not None else out


def scale_repair(x, col_max, limit: float = 10.0) -> Column:
    """undo a log1p scale (expm1) when the column maximum is < limit."""
    v = F.col(x) if isinstance(x, str) else x
    return F.when(col_max < limit, F.expm1(v)).otherwise(v)


def audit_ratio(rain, pet) -> Column:
    """instant rain over (PET + 1)."""
    return ratio(rain, pet, 1.0)
