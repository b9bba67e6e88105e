"""Geometry on a sphere, speeds and bearings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_NM, METRES_PER_NM = 3440.065, 1852.0


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2.0), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2.0), F.lit(2.0))
    return F.lit(2.0 * EARTH_NM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_nm(lat1, lon1, lat2, lon2) * METRES_PER_NM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_nm(lat1, lon1, lat2, lon2) * (METRES_PER_NM / 1000.0)


def _per(distance: Column, seconds: Column, unit: float) -> Column:
    return F.when(seconds > 0, F.try_divide(distance, seconds / F.lit(unit))).otherwise(F.lit(float("inf")))


def implied_speed_kn(lat1: Column, lon1: Column, ts1: Column, lat2: Column, lon2: Column, ts2: Column) -> Column:
    """Knots between two positions; infinite where no time has passed."""
    return _per(haversine_nm(lat1, lon1, lat2, lon2), ts2 - ts1, 3600.0)


def implied_speed_ms(lat1: Column, lon1: Column, ts1: Column, lat2: Column, lon2: Column, ts2: Column) -> Column:
    return _per(haversine_m(lat1, lon1, lat2, lon2), ts2 - ts1, 1.0)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 up to but not including 360."""
    a, b, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def longitude_cells(lat: Column, metres: float, reach: float) -> Column:
    """How many cells to cut a parallel into, so that two points ``metres`` apart, within ``reach``
    degrees of ``lat``, lie in the same or in neighbouring ones; 1 where fewer than four would do."""
    shrink = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + reach)))
    n = F.floor(F.greatest(F.lit(1.0), shrink * (360.0 / metres_to_latitude(metres) / 1.001)))
    return F.when(n < 4, F.lit(1)).otherwise(n).cast("long")


def metres_to_latitude(metres: float) -> float:
    """Degrees of latitude that cover ``metres``, a little more to be safe."""
    import math

    return metres / (math.radians(1.0) * EARTH_NM * METRES_PER_NM) * (1 + 1e-6)
