"""Distances and synthetic coordinates.

Two distances exist and are kept apart (S12): the pipeline's "haversine" is a
plain Euclidean distance in degrees, the radius query uses the true great
circle on a sphere of 6371 km.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import c

# Fixed values.
EARTH_RADIUS_KM = 6371.0
WEB_MERCATOR_RADIUS_M = 6378137.0


def deg_euclid(lat1, lon1, lat2, lon2) -> Column:
    return F.sqrt(F.pow(c(lat1) - c(lat2), 2) + F.pow(c(lon1) - c(lon2), 2))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def mercator_x(lon) -> Column:
    return F.lit(WEB_MERCATOR_RADIUS_M) * F.radians(c(lon))


def mercator_y(lat) -> Column:
    return F.lit(WEB_MERCATOR_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(c(lat)) / 2))


def synth_lat(key) -> Column:
    """Deterministic latitude for an integer key (fixture mapping, exact)."""
    return F.lit(-35.0) + F.pmod(c(key) * 37, F.lit(1000)).cast("double") / 100.0


def synth_lon(key) -> Column:
    return F.lit(20.0) + F.pmod(c(key) * 91, F.lit(1000)).cast("double") / 100.0


def synth_lat_sql(k: str) -> str:
    return f"(-35.0 + (({k} * 37) % 1000) / 100.0)"


def synth_lon_sql(k: str) -> str:
    return f"(20.0 + (({k} * 91) % 1000) / 100.0)"
