"""Quality masks of the gridded products: raw value and QA code -> value or NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airq.functions.units import null_if_nodata

# Scale factors, fill markers and valid ranges of the products.
AOD_SCALE, AOD_MAX = 0.001, 3.0
NDVI_SCALE, NDVI_FILL, NDVI_RAW_RANGE, NDVI_RANGE = 0.0001, -3000, (-2000, 10000), (-0.2, 1.0)
NDVI_GOOD = (0, 1)
VIIRS_FILL, VIIRS_FILL_TOLERANCE, VIIRS_GOOD = -999.9, 0.01, (0,)
DEM_NODATA, DEM_RANGE = -32768, (-500.0, 9000.0)

# Names of the QA codes.
NDVI_QA_LABELS = {-1: "fill / not produced", 0: "good data", 1: "marginal data",
                  2: "snow / ice", 3: "cloudy"}
VIIRS_QA_LABELS = {0: "high quality", 1: "poor quality",
                   2: "solar zenith 102-108 deg / poor", 3: "lunar eclipse",
                   4: "aurora", 5: "glint", 255: "fill"}


def mask_aod(raw: Column, qa: Column) -> Column:
    """Scaled optical depth; needs both low QA bits clear and 0 < v <= 3."""
    value = raw * F.lit(AOD_SCALE)
    return F.when((qa.bitwiseAND(3) == 0) & (value > 0.0) & (value <= AOD_MAX), value)


def mask_ndvi(raw: Column, reliability: Column) -> Column:
    value = raw * F.lit(NDVI_SCALE)
    keep = ((raw != NDVI_FILL) & raw.between(*NDVI_RAW_RANGE)
            & reliability.isin(*NDVI_GOOD) & value.between(*NDVI_RANGE))
    return F.when(keep, value)


def mask_viirs(raw: Column, quality: Column, scale: float = 1.0) -> Column:
    value = raw * F.lit(scale)
    keep = ((F.abs(raw - F.lit(VIIRS_FILL)) >= VIIRS_FILL_TOLERANCE)
            & quality.isin(*VIIRS_GOOD) & (value >= 0.0))
    return F.when(keep, value)


def mask_dem(raw: Column) -> Column:
    return null_if_nodata(raw.cast("double"), DEM_NODATA)


def dem_suspicious(elevation: Column) -> Column:
    """Flag only: elevations outside the plausible range stay in the data."""
    return F.coalesce(~elevation.between(*DEM_RANGE), F.lit(False))


def qa_label(code: Column, labels: dict[int, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")),
                      F.concat(F.lit("unknown_code_"), code.cast("string")))
