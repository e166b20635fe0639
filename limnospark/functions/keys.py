"""Key normalisation.

Observation keys are (latitude, longitude, sample date). Inputs arrive as text
with two date layouts; casts are lenient: a value that does not parse becomes
NULL instead of failing the job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import c

# The two accepted date layouts, ISO tried first.
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}"
ISO_DATE_FORMAT = "yyyy-MM-dd"
DAY_FIRST_FORMAT = "dd-MM-yyyy"


def parse_date(x) -> Column:
    """ISO ``yyyy-MM-dd`` (optionally followed by a time) when the text starts
    like one, else ``dd-MM-yyyy``; anything else is NULL (S1)."""
    s = F.trim(c(x).cast("string"))
    iso = F.try_to_timestamp(F.substring(s, 1, 10), F.lit(ISO_DATE_FORMAT))
    dmy = F.try_to_timestamp(F.substring(s, 1, 10), F.lit(DAY_FIRST_FORMAT))
    return F.to_date(F.when(s.rlike(ISO_DATE_PATTERN), iso).otherwise(dmy))


def lenient_double(x) -> Column:
    """Text or number -> double; unparsable -> NULL."""
    return c(x).cast("string").try_cast("double")


def normalize_keys(df: DataFrame, lat: str, lon: str, date: str | None = None, digits: int = 8) -> DataFrame:
    """Lenient numeric casts rounded to ``digits`` and a parsed date."""
    cols = {
        lat: F.round(lenient_double(lat), digits),
        lon: F.round(lenient_double(lon), digits),
    }
    if date is not None:
        cols[date] = parse_date(date)
    return df.withColumns(cols)


def normalize_name(name: str) -> str:
    """Strip, upper-case, replace space, '-' and '/' by '_'."""
    return re.sub(r"[ \-/]", "_", name.strip().upper())


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(n) for n in df.columns])


def group_key(basin=None, lat=None, lon=None, grid: float = 0.1) -> Column:
    """K1: basin id as text, NULL basin -> 'unknown'; without a basin column the
    grid cell ``floor(lat/g)_floor(lon/g)`` is the group."""
    if basin is not None:
        return F.coalesce(c(basin).cast("string"), F.lit("unknown"))
    return F.concat_ws(
        "_",
        F.floor(c(lat) / F.lit(grid)).cast("string"),
        F.floor(c(lon) / F.lit(grid)).cast("string"),
    )
