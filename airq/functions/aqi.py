"""Air-quality index: breakpoint interpolation, rounding and categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (concentration low, high, index low, high) per scheme.
BREAKPOINTS = {
    "india_cpcb": [
        (0.0, 30.0, 0.0, 50.0), (31.0, 60.0, 51.0, 100.0),
        (61.0, 90.0, 101.0, 200.0), (91.0, 120.0, 201.0, 300.0),
        (121.0, 250.0, 301.0, 400.0), (250.0, 350.0, 401.0, 500.0),
    ],
    "us_epa": [
        (0.0, 9.0, 0.0, 50.0), (9.1, 35.4, 51.0, 100.0),
        (35.5, 55.4, 101.0, 150.0), (55.5, 125.4, 151.0, 200.0),
        (125.5, 225.4, 201.0, 300.0), (225.5, 325.4, 301.0, 400.0),
        (325.5, 500.4, 401.0, 500.0),
    ],
}

# Fixed values: (label, lowest index, highest index) per scheme.
CATEGORIES = {
    "india_cpcb": [
        ("GOOD", 0, 50), ("SATISFACTORY", 51, 100),
        ("MODERATELY_POLLUTED", 101, 200), ("POOR", 201, 300),
        ("VERY_POOR", 301, 400), ("SEVERE", 401, 500),
    ],
    "us_epa": [
        ("GOOD", 0, 50), ("MODERATE", 51, 100),
        ("UNHEALTHY_SENSITIVE_GROUPS", 101, 150), ("UNHEALTHY", 151, 200),
        ("VERY_UNHEALTHY", 201, 300), ("HAZARDOUS", 301, 500),
    ],
}

# Region -> scheme. "none" means no index may be derived there.
REGION_SCHEMES = {
    "delhi": "india_cpcb", "pune": "india_cpcb", "mumbai": "india_cpcb",
    "india": "india_cpcb", "global": "none",
}
DEFAULT_SCHEME = "india_cpcb"


def pm25_to_aqi(conc: Column, scheme: str = DEFAULT_SCHEME) -> Column:
    """Unrounded index; NULL for missing, NaN, infinite or negative input.

    The first interval whose upper bound is not below the concentration
    applies, so values in a gap extrapolate below the next interval; above the
    table the last interval extends. The result is clamped to [0, 500].
    """
    rows = BREAKPOINTS[scheme]

    def line(c_lo: float, c_hi: float, i_lo: float, i_hi: float) -> Column:
        return F.lit((i_hi - i_lo) / (c_hi - c_lo)) * (conc - F.lit(c_lo)) + F.lit(i_lo)

    chain = None
    for row in rows[:-1]:
        test = conc <= F.lit(row[1])
        chain = F.when(test, line(*row)) if chain is None else chain.when(test, line(*row))
    index = chain.otherwise(line(*rows[-1]))
    usable = ~F.isnan(conc) & (conc >= 0.0) & (conc < F.lit(float("inf")))
    return F.when(usable, F.least(F.greatest(index, F.lit(0.0)), F.lit(500.0)))


def round_aqi(aqi: Column, mode: str = "nearest_integer") -> Column:
    """Integer index: half-to-even or floor."""
    if mode == "nearest_integer":
        return F.rint(aqi).cast("bigint")
    if mode == "floor":
        return F.floor(aqi).cast("bigint")
    raise ValueError(f"unknown rounding mode {mode!r}")


def aqi_category(aqi: Column, scheme: str = DEFAULT_SCHEME) -> Column:
    """Label by lower bound; the last label is open-ended."""
    chain = None
    for name, low, _ in reversed(CATEGORIES[scheme]):
        test = aqi >= F.lit(low)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def aqi_category_inclusive(aqi: Column, scheme: str = DEFAULT_SCHEME) -> Column:
    """Point-query variant: the integer must lie inside a label's bounds."""
    value = aqi.cast("int")
    chain = None
    for name, low, high in CATEGORIES[scheme]:
        test = value.between(low, high)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def category_rank(category: Column, scheme: str = DEFAULT_SCHEME) -> Column:
    """Position of a label in its scheme, 0 = cleanest; NULL for unknown."""
    pairs = [F.lit(x) for i, (name, _, _) in enumerate(CATEGORIES[scheme]) for x in (name, i)]
    return F.try_element_at(F.create_map(*pairs), category)


def aqi_scheme_for(region: Column) -> Column:
    """Scheme of a region; unlisted regions use the default."""
    pairs = [F.lit(x) for pair in REGION_SCHEMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(region)),
                      F.lit(DEFAULT_SCHEME))


def aqi_by_scheme(conc: Column, scheme: Column) -> Column:
    """Index under a per-row scheme; 'none' and unknown schemes give NULL."""
    chain = None
    for name in BREAKPOINTS:
        test = scheme == F.lit(name)
        value = pm25_to_aqi(conc, name)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def category_by_scheme(aqi: Column, scheme: Column) -> Column:
    chain = None
    for name in CATEGORIES:
        test = scheme == F.lit(name)
        value = aqi_category(aqi, name)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain
