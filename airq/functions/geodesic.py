"""Distances on the WGS 84 ellipsoid: the inverse geodesic problem in column expressions.

Both points are brought to one standing order (the southern, farther one first, the
other to the east). There the longitude that a geodesic has gained when it reaches
the second parallel grows with its first azimuth, so halving the azimuth's range
finds it for every pair, also for points that are nearly antipodal, where
iterations on the longitude do not settle. Series are of the sixth order, as
published for nanometre accuracy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Fixed values of WGS 84: equatorial radius in metres and flattening.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
POLAR, THIRD, SECOND = RADIUS * (1 - FLATTENING), FLATTENING / (2 - FLATTENING), FLATTENING * (2 - FLATTENING) / (1 - FLATTENING) ** 2
#: Halvings of the azimuth's range; the smallest sine that stands for a point on the equator or a pole.
HALVINGS, TINY = 54, 1e-15

#: Fixed values of the published series in powers of the expansion parameter, from the first power on.
LENGTH_SERIES = [
    [-1 / 2, 0, 3 / 16, 0, -1 / 32, 0], [0, -1 / 16, 0, 1 / 32, 0, -9 / 2048], [0, 0, -1 / 48, 0, 3 / 256, 0],
    [0, 0, 0, -5 / 512, 0, 3 / 512], [0, 0, 0, 0, -7 / 1280, 0], [0, 0, 0, 0, 0, -7 / 2048]]


def longitude_series(n: float) -> tuple[list[float], list[list[float]]]:
    """Fixed values of the published series of the longitude for the third flattening ``n``."""
    scale = [1, -(1 / 2 - n / 2), -(1 / 4 + n / 8 - 3 * n**2 / 8), -(1 / 16 + 3 * n / 16 + n**2 / 16), -(3 / 64 + n / 32), -3 / 128]
    sines = [
        [1 / 4 - n / 4, 1 / 8 - n**2 / 8, 3 / 64 + 3 * n / 64 - n**2 / 64, 5 / 128 + n / 64, 3 / 128],
        [0, 1 / 16 - 3 * n / 32 + n**2 / 32, 3 / 64 - n / 32 - 3 * n**2 / 64, 3 / 128 + n / 128, 5 / 256],
        [0, 0, 5 / 192 - 3 * n / 64 + 5 * n**2 / 192, 3 / 128 - 5 * n / 192, 7 / 512],
        [0, 0, 0, 7 / 512 - 7 * n / 256, 7 / 512], [0, 0, 0, 0, 21 / 2560]]
    return scale, sines


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _powers(coefficients: list[float], x: Column, constant: float = 0.0) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = (out + F.lit(float(c))) * x
    return out + F.lit(constant)


def _arc(p: Column, azimuth: Column) -> Column:
    """The auxiliary sphere's arc for a first azimuth: struct (s1, s2, w, a0, e)."""
    def on_sphere(q: Column) -> Column:
        s1, s2 = F.atan2(p["sin1"], q["c1"] * p["cos1"]), F.atan2(p["sin2"], q["c2"] * p["cos2"])
        w1, w2 = F.atan2(q["a0"] * p["sin1"], q["c1"] * p["cos1"]), F.atan2(q["a0"] * p["sin2"], q["c2"] * p["cos2"])
        return F.struct(s1.alias("s1"), s2.alias("s2"), (w2 - w1).alias("w"), q["a0"].alias("a0"), (q["k"] / (2 * (1 + F.sqrt(1 + q["k"])) + q["k"])).alias("e"))

    def azimuths(a: Column) -> Column:
        a0, c1 = F.sin(a) * p["cos1"], F.cos(a)
        c2 = F.sqrt(F.greatest(c1 * c1 * p["cos1"] * p["cos1"] + (p["sin1"] - p["sin2"]) * (p["sin1"] + p["sin2"]), F.lit(0.0))) / p["cos2"]
        return F.struct(a0.alias("a0"), c1.alias("c1"), c2.alias("c2"), (F.lit(SECOND) * (1 - a0 * a0)).alias("k"))

    return _let(_let(azimuth, azimuths), on_sphere)


def _gain(p: Column, azimuth: Column) -> Column:
    """Longitude gained on the way to the second parallel."""
    scale, sines = longitude_series(THIRD)

    def longitude(q: Column) -> Column:
        total = q["s2"] - q["s1"]
        for l, c in enumerate(sines, start=1):
            total = total + _powers(c, q["e"]) * (F.sin(q["s2"] * (2 * l)) - F.sin(q["s1"] * (2 * l)))
        return q["w"] - F.lit(FLATTENING) * q["a0"] * _powers(scale[1:], q["e"], 1.0) * total

    return _let(_arc(p, azimuth), longitude)


def _length(p: Column, azimuth: Column) -> Column:
    def metres(q: Column) -> Column:
        total = q["s2"] - q["s1"]
        for l, c in enumerate(LENGTH_SERIES, start=1):
            total = total + _powers(c, q["e"]) * (F.sin(q["s2"] * (2 * l)) - F.sin(q["s1"] * (2 * l)))
        square = q["e"] * q["e"]
        return F.lit(POLAR) * (1 + square * (F.lit(1 / 4) + square * (F.lit(1 / 64) + square / 256))) / (1 - q["e"]) * total

    return _let(_arc(p, azimuth), metres)


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the shortest path on the ellipsoid, in km; NULL where a coordinate is.

    Latitudes lie between -90 and 90; longitudes count modulo 360.
    """
    turn = F.abs(F.pmod(lon2 - lon1 + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))
    swap = F.abs(lat1) < F.abs(lat2)
    far, near = F.when(swap, lat2).otherwise(lat1), F.when(swap, lat1).otherwise(lat2)
    sign = F.when(far > 0, -1.0).otherwise(1.0)

    def reduced(q: Column) -> Column:
        u1, u2 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(q["far"]))), F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(q["near"])))
        # A point on the equator counts as just south of it, so that every azimuth leads away from it.
        return F.struct(F.least(F.sin(u1), F.lit(-TINY)).alias("sin1"), F.greatest(F.cos(u1), F.lit(TINY)).alias("cos1"),
                        F.sin(u2).alias("sin2"), F.greatest(F.cos(u2), F.lit(TINY)).alias("cos2"), F.radians(q["turn"]).alias("turn"))

    def halved(p: Column) -> Column:
        low_high = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi).alias("high"))

        def half(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            return _let(F.struct(middle.alias("m"), (_gain(p, middle) < p["turn"]).alias("short"), s["low"].alias("low"), s["high"].alias("high")),
                        lambda x: F.struct(F.when(x["short"], x["m"]).otherwise(x["low"]).alias("low"), F.when(x["short"], x["high"]).otherwise(x["m"]).alias("high")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), low_high, half, lambda s: _length(p, (s["low"] + s["high"]) / 2))

    metres = _let(_let(F.struct((sign * far).alias("far"), (sign * near).alias("near"), turn.alias("turn")), reduced), halved)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    # On the equator itself a path along it is shortest up to where it ceases to be a geodesic between its ends.
    along = (lat1 == 0) & (lat2 == 0) & (turn <= 180.0 * (1 - FLATTENING))
    return F.when(known, F.when(along, F.radians(turn) * F.lit(RADIUS)).otherwise(metres) / 1000.0)
