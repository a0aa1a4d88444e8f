"""Distances and frames on the earth, as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Mean earth radius, and the reference ellipsoid.
EARTH_RADIUS_M = 6371008.8
ELLIPSOID_A, ELLIPSOID_F = 6378137.0, 1 / 298.257223563


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres; null where a coordinate is. The guard matters: ``least(1, null)`` is 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def trig(angle: Column) -> Column:
    """(sin, cos, sin2) of radians."""
    return F.struct(F.sin(angle).alias("sin"), F.cos(angle).alias("cos"), F.pow(F.sin(angle), 2).alias("sin2"))


def c_trig(angle: Column) -> Column:
    """The same by the C library, in Arrow batches; a tenth of a percent of the JVM's values differ from it in their last bit."""

    @pandas_udf("sin double, cos double, sin2 double")
    def run(radians: pd.Series) -> pd.DataFrame:
        known = [x if math.isfinite(x) else math.nan for x in radians]
        sin = [math.sin(x) for x in known]
        return pd.DataFrame({"sin": sin, "cos": [math.cos(x) for x in known], "sin2": [math.pow(x, 2) for x in sin]})

    return run(angle)


def ecef(phi: Column, lam: Column, height: Column) -> tuple[Column, Column, Column]:
    """Of the ``trig`` of latitude and longitude."""
    e2 = ELLIPSOID_F * (2 - ELLIPSOID_F)
    n = ELLIPSOID_A / F.sqrt(1 - e2 * phi["sin2"])
    return (n + height) * phi["cos"] * lam["cos"], (n + height) * phi["cos"] * lam["sin"], (n * (1 - e2) + height) * phi["sin"]


def enu(phi: Column, lam: Column, phi0: Column, lam0: Column) -> tuple[Column, Column]:
    """East and north in metres of a point on the ellipsoid about an origin on it, by the ``trig`` of their latitudes and longitudes."""
    zero = F.lit(0.0)
    x, y, z = ecef(phi, lam, zero)
    x0, y0, z0 = ecef(phi0, lam0, zero)
    dx, dy, dz = x - x0, y - y0, z - z0
    return -lam0["sin"] * dx + lam0["cos"] * dy, -phi0["sin"] * lam0["cos"] * dx - phi0["sin"] * lam0["sin"] * dy + phi0["cos"] * dz


def local_en(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres about a point."""
    return F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS_M
