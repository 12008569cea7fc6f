"""Coordinates: UTM as column expressions, distances, tiles, scopes, regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# WGS 84 ellipsoid, UTM scale and false origin.
_A, _F = 6378137.0, 1.0 / 298.257223563
_K0, _FALSE_EASTING, _FALSE_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0
EARTH_RADIUS_KM = 6371.0

_N = _F / (2.0 - _F)
_RECT = _A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
_ECC = 2.0 * math.sqrt(_N) / (1.0 + _N)
# Coefficients of the published third-order series of the transverse Mercator projection.
_FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
            13 * _N**2 / 48 - 3 * _N**3 / 5,
            61 * _N**3 / 240]
_INVERSE = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
            _N**2 / 48 + _N**3 / 15,
            17 * _N**3 / 480]
_LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
             7 * _N**2 / 3 - 8 * _N**3 / 5,
             56 * _N**3 / 15]

# Acquisition scopes, smallest first: west, south, east, north.
SCOPES = {
    "delhi": (77.0, 28.4, 77.4, 28.8),
    "pune": (73.7, 18.4, 74.1, 18.7),
    "mumbai": (72.7, 18.8, 73.0, 19.3),
    "india": (65.0, 5.0, 100.0, 40.0),
    "global": (-180.0, -90.0, 180.0, 90.0),
}

# World region of a country.
REGION_OF_COUNTRY = {
    "India": "South Asia",
    "Pakistan": "South Asia",
    "Bangladesh": "South Asia",
    "Nepal": "South Asia",
    "Sri Lanka": "South Asia",
    "Afghanistan": "South Asia",
    "China": "East Asia",
    "Japan": "East Asia",
    "South Korea": "East Asia",
    "Mongolia": "East Asia",
    "Taiwan": "East Asia",
    "Hong Kong": "East Asia",
    "Vietnam": "Southeast Asia",
    "Thailand": "Southeast Asia",
    "Indonesia": "Southeast Asia",
    "Malaysia": "Southeast Asia",
    "Philippines": "Southeast Asia",
    "Singapore": "Southeast Asia",
    "Myanmar": "Southeast Asia",
    "Cambodia": "Southeast Asia",
    "Laos": "Southeast Asia",
    "United States": "North America",
    "United States of America": "North America",
    "Canada": "North America",
    "Mexico": "North America",
    "Brazil": "South America",
    "Argentina": "South America",
    "Colombia": "South America",
    "Chile": "South America",
    "Peru": "South America",
    "Germany": "Europe",
    "France": "Europe",
    "United Kingdom": "Europe",
    "UK": "Europe",
    "Italy": "Europe",
    "Spain": "Europe",
    "Netherlands": "Europe",
    "Poland": "Europe",
    "Turkey": "Europe",
    "Russia": "Europe",
    "Egypt": "Middle East & North Africa",
    "Saudi Arabia": "Middle East & North Africa",
    "United Arab Emirates": "Middle East & North Africa",
    "South Africa": "Sub-Saharan Africa",
    "Nigeria": "Sub-Saharan Africa",
    "Kenya": "Sub-Saharan Africa",
    "Ghana": "Sub-Saharan Africa",
    "Australia": "Oceania",
    "New Zealand": "Oceania",
}


def utm_zone(lon: Column) -> Column:
    """UTM zone 1..60; longitude 180 belongs to the last zone."""
    return F.least(F.greatest(F.floor((lon + F.lit(180.0)) / F.lit(6.0)) + 1, F.lit(1)),
                   F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    return F.when(lat >= 0.0, F.lit(32600) + utm_zone(lon)).otherwise(F.lit(32700) + utm_zone(lon))


def metric_epsg_for_bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    """UTM code at the box centre; NULL for boxes too wide or tall for one zone."""
    fits = (F.abs(east - west) < 180.0) & (F.abs(north - south) < 160.0)
    return F.when(fits, utm_epsg((west + east) / 2.0, (south + north) / 2.0))


def with_utm(df: DataFrame, lon: str, lat: str, epsg: Column,
             x: str = "x", y: str = "y") -> DataFrame:
    """Add UTM easting and northing. Helper terms are columns, not nested text."""
    zone = F.pmod(epsg, F.lit(100))
    south = epsg >= 32700
    sin_lat = F.sin(F.radians(F.col(lat)))
    keep = df.columns
    step = df.select(
        "*",
        F.radians(F.col(lon) - (zone * 6.0 - 183.0)).alias("_dl"),
        F.sinh(F.atanh(sin_lat) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * sin_lat)).alias("_t"),
        F.when(south, F.lit(_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0)).alias("_n0"),
    ).select(
        "*",
        F.atan2(F.col("_t"), F.cos("_dl")).alias("_xi"),
        F.atanh(F.sin("_dl") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))).alias("_eta"),
    )
    east, north = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(_FORWARD, start=1):
        east = east + F.lit(a) * F.cos(F.col("_xi") * (2.0 * j)) * F.sinh(F.col("_eta") * (2.0 * j))
        north = north + F.lit(a) * F.sin(F.col("_xi") * (2.0 * j)) * F.cosh(F.col("_eta") * (2.0 * j))
    return step.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.lit(_FALSE_EASTING) + F.lit(_K0 * _RECT) * east).alias(x),
        (F.col("_n0") + F.lit(_K0 * _RECT) * north).alias(y),
    )


def with_lonlat(df: DataFrame, x: str, y: str, epsg: Column,
                lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add longitude and latitude of UTM coordinates."""
    zone = F.pmod(epsg, F.lit(100))
    n0 = F.when(epsg >= 32700, F.lit(_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    keep = df.columns
    step = df.select(
        "*",
        ((F.col(y) - n0) / F.lit(_K0 * _RECT)).alias("_xi"),
        ((F.col(x) - F.lit(_FALSE_EASTING)) / F.lit(_K0 * _RECT)).alias("_eta"),
        (zone * 6.0 - 183.0).alias("_lon0"),
    )
    xi, eta = F.col("_xi"), F.col("_eta")
    for j, b in enumerate(_INVERSE, start=1):
        xi = xi - F.lit(b) * F.sin(F.col("_xi") * (2.0 * j)) * F.cosh(F.col("_eta") * (2.0 * j))
        eta = eta - F.lit(b) * F.cos(F.col("_xi") * (2.0 * j)) * F.sinh(F.col("_eta") * (2.0 * j))
    step = step.select("*", xi.alias("_xi1"), eta.alias("_eta1"))
    step = step.select("*", F.asin(F.sin("_xi1") / F.cosh("_eta1")).alias("_chi"))
    phi = F.col("_chi")
    for j, d in enumerate(_LATITUDE, start=1):
        phi = phi + F.lit(d) * F.sin(F.col("_chi") * (2.0 * j))
    return step.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.col("_lon0") + F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1")))).alias(lon),
        F.degrees(phi).alias(lat),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the mean sphere."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def tile_id(lon: Column, lat: Column, size_deg: float = 10.0,
            west: float = -180.0, south: float = -90.0,
            east: float = 180.0, north: float = 90.0) -> Column:
    """Tile name by floor division; the closing edge belongs to the last tile."""
    nx = math.ceil((east - west) / size_deg - 1e-9)
    ny = math.ceil((north - south) / size_deg - 1e-9)
    ix = F.least(F.floor((lon - F.lit(west)) / F.lit(size_deg)), F.lit(nx - 1))
    iy = F.least(F.floor((lat - F.lit(south)) / F.lit(size_deg)), F.lit(ny - 1))
    return F.when(lon.isNotNull() & lat.isNotNull(),
                  F.format_string("tile_%03d_%03d", ix, iy))


def srtm_tile_name(lon: Column, lat: Column) -> Column:
    """Elevation tile name such as N28E077 (floor of both coordinates)."""
    la, lo = F.floor(lat), F.floor(lon)
    return F.format_string(
        "%s%02d%s%03d",
        F.when(la >= 0, F.lit("N")).otherwise(F.lit("S")), F.abs(la),
        F.when(lo >= 0, F.lit("E")).otherwise(F.lit("W")), F.abs(lo))


def srtm_tile_corner(name: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of the south-west corner named by a tile."""
    pattern = r"(?i)([NS])(\d{2})([EW])(\d{3})"
    lat = F.regexp_extract(name, pattern, 2).try_cast("double")
    lon = F.regexp_extract(name, pattern, 4).try_cast("double")
    lat = F.when(F.upper(F.regexp_extract(name, pattern, 1)) == "S", -lat).otherwise(lat)
    lon = F.when(F.upper(F.regexp_extract(name, pattern, 3)) == "W", -lon).otherwise(lon)
    return lon, lat


def region_of_country(country: Column) -> Column:
    pairs = [F.lit(x) for pair in REGION_OF_COUNTRY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), country), F.lit("Unclassified"))


def infer_scope(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Smallest scope that contains the box (tolerance 1e-9)."""
    eps = 1e-9
    chain = None
    for name, (w, s, e, n) in SCOPES.items():
        test = (west >= w - eps) & (south >= s - eps) & (east <= e + eps) & (north <= n + eps)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit("outside_all_scopes"))


def scope_isolated(requested: Column, inferred: Column) -> Column:
    """True when an artifact's scope is the requested one; global takes all."""
    return (requested == "global") | (requested == inferred)


def spherical_rectangle_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area of a lon/lat box on the authalic sphere."""
    radius = 6371.0072
    return (F.lit(radius * radius) * F.radians(east - west)
            * (F.sin(F.radians(north)) - F.sin(F.radians(south))))


def in_bbox(lon: Column, lat: Column, bounds: tuple[float, float, float, float]) -> Column:
    west, south, east, north = bounds
    return lon.between(west, east) & lat.between(south, north)


def point_in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Strictly inside a ring given at plan time (even-odd rule, no boundary).

    An axis-parallel rectangle becomes four comparisons. A point that differs from
    an edge by no more than the rounding of coordinates lies on it.
    """
    points = ring[:-1] if ring[0] == ring[-1] else ring
    xs, ys = sorted({p[0] for p in points}), sorted({p[1] for p in points})
    if len(points) == 4 and len(xs) == 2 and len(ys) == 2:
        return (x > xs[0]) & (x < xs[1]) & (y > ys[0]) & (y < ys[1])
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        turn = (x - F.lit(x1)) * F.lit(y2 - y1) - (y - F.lit(y1)) * F.lit(x2 - x1)
        rounding = F.lit(2.0 ** -51) * ((F.abs(x) + F.lit(abs(x1))) * F.lit(abs(y2 - y1)) + (F.abs(y) + F.lit(abs(y1))) * F.lit(abs(x2 - x1)))
        on_edge = on_edge | ((F.abs(turn) <= rounding) & x.between(min(x1, x2), max(x1, x2))
                             & y.between(min(y1, y2), max(y1, y2)))
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
        at = F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(straddles & (x < at), 1).otherwise(0)
    return (F.pmod(crossings, F.lit(2)) == 1) & ~on_edge
