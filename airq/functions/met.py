"""Wind and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction_from(u: Column, v: Column) -> Column:
    """Meteorological direction the wind blows FROM, degrees in [0, 360)."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def wind_u(speed: Column, direction: Column) -> Column:
    return -speed * F.sin(F.radians(direction))


def wind_v(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def temporal_features(date: Column) -> dict[str, Column]:
    """Calendar features of the row's own date; an invalid date gives NULL."""
    doy = F.dayofyear(date).cast("double")
    angle = doy * F.lit(2.0 * math.pi) / F.lit(365.25)
    return {
        "month": F.month(date).cast("double"),
        "day_of_year": doy,
        "sin_day_of_year": F.sin(angle),
        "cos_day_of_year": F.cos(angle),
    }
