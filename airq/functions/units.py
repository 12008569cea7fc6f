"""Unit normalisation and conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Factor to ug/m3 per normalised unit. ppm and unknown units have
# no factor and give NULL.
UNIT_FACTORS = {"ug/m3": 1.0, "mg/m3": 1000.0, "g/m3": 1_000_000.0, "ng/m3": 0.001}

# Typographic replacements, applied in this order.
UNIT_REPLACEMENTS = [
    (" ", ""), ("^", ""), ("³", "3"), ("²", "2"),
    ("μ", "µ"), ("µg", "ug"), ("microgramsper", "ug"),
]


def normalize_unit(unit: Column) -> Column:
    """Collapse typographic variants of a unit string; NULL becomes ''."""
    out = F.lower(F.trim(unit))
    for old, new in UNIT_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(out, F.lit(""))


def unit_factor(unit: Column) -> Column:
    """Conversion factor to ug/m3, NULL when the unit is not convertible."""
    pairs = [F.lit(part) for pair in UNIT_FACTORS.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), normalize_unit(unit))


def to_ug_m3(value: Column, unit: Column) -> Column:
    """Concentration in ug/m3; NULL for unknown units, never guessed."""
    return value * unit_factor(unit)


def null_if_nan(value: Column) -> Column:
    """Turn NaN into NULL so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def null_if_nodata(value: Column, nodata: float) -> Column:
    """Turn NaN and the nodata marker into NULL."""
    return F.when(~F.isnan(value) & (value != F.lit(float(nodata))), value)


# Unit names of temperatures, without separators.
KELVIN_NAMES = ("k", "kelvin", "degreesk", "degreekelvin")
CELSIUS_NAMES = ("degc", "celsius", "degreescelsius", "degreecelsius")


def kelvin_to_celsius(value: Column, units: Column) -> Column:
    """Celsius from kelvin; Celsius passes through; other units raise."""
    name = F.regexp_replace(F.lower(units), r"[ _.\-]", "")
    failure = F.raise_error(F.concat(F.lit("cannot determine temperature units from: "),
                                     F.coalesce(units, F.lit("null"))))
    return (F.when(name.isin(*KELVIN_NAMES), value - F.lit(273.15))
            .when(name.isin(*CELSIUS_NAMES), value)
            .otherwise(failure.cast("double")))
