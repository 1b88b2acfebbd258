"""Distances and arcs on the globe."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from waymark.functions.arrays import let

EARTH_M = 6_371_008.8
#: A rule takes the distance it measures by as an argument.
Distance = Callable[[Column, Column, Column, Column], Column]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; stays in generated code."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a flat earth of decision tables: 0.001 degrees are 100 m."""
    return F.greatest(F.abs(lat2 - lat1), F.abs(lon2 - lon1)) * F.lit(100_000.0)


def sphere_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres on a sphere; arrays of degrees."""
    a1, o1, a2, o2 = (np.radians(np.asarray(x, np.float64)) for x in (lat1, lon1, lat2, lon2))
    a = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(a))


def ellipsoid_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres on the WGS84 ellipsoid by Vincenty's inverse formula, as float32; arrays of degrees."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, np.float64)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, far = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    turn = far
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(20):
            sin_s = np.hypot(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn))
            cos_s = s1 * s2 + c1 * c2 * np.cos(turn)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * np.sin(turn) / sin_s)
            cos2a = 1 - sin_a**2
            mid = np.where(cos2a == 0, 0.0, cos_s - 2 * s1 * s2 / cos2a)
            c = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
            turn = far + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
    k = cos2a * (a**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    bend = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return np.where(sin_s == 0, 0.0, b * big * (sigma - bend)).astype(np.float32)


def single(x: float) -> float:
    """A number as single precision holds it."""
    return struct.unpack("f", struct.pack("f", x))[0]


def one_ellipsoid_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """ellipsoid_m of two points, for walks in which one follows from the other; ends when longitudes settle."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = math.radians(lat1), math.radians(lon1), math.radians(lat2), math.radians(lon2)
    u1, u2, far = math.atan((1 - f) * math.tan(lat1)), math.atan((1 - f) * math.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    turn = far
    for _ in range(20):
        st, ct = math.sin(turn), math.cos(turn)
        sin_s = math.hypot(c2 * st, c1 * s2 - s1 * c2 * ct)
        if sin_s == 0:
            return 0.0
        cos_s = s1 * s2 + c1 * c2 * ct
        sigma = math.atan2(sin_s, cos_s)
        sin_a = c1 * c2 * st / sin_s
        cos2a = 1 - sin_a * sin_a
        mid = cos_s - 2 * s1 * s2 / cos2a if cos2a else 0.0
        c = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
        last, turn = turn, far + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        if abs(turn - last) < 1e-15:
            break
    k = cos2a * (a * a - b * b) / (b * b)
    big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    bend = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))
    return single(b * big * (sigma - bend))


def one_sphere_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Metres on a sphere between two points."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(a))


@F.pandas_udf(FloatType())
def geo_distance_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """The ellipsoid's distance for queries; null where a coordinate is."""
    out = pd.Series(ellipsoid_m(lat1.fillna(0), lon1.fillna(0), lat2.fillna(0), lon2.fillna(0)))
    return out.where(lat1.notna() & lon1.notna() & lat2.notna() & lon2.notna())


def cell(degrees: Column, size: float) -> Column:
    """The number of a grid's row or column; neighbours differ by 1."""
    return F.floor(degrees / F.lit(size)).cast("long")


def on_globe(lat: float, lon: float) -> tuple[float, float]:
    """The same point with a latitude from -90 to 90: beyond a pole it lies on the other side. Others stay as they are."""
    if abs(lat) <= 90:
        return lat, lon
    lat = (lat + 180) % 360 - 180
    if abs(lat) > 90:
        lat, lon = math.copysign(180, lat) - lat, lon + 180
    return lat, (lon + 180) % 360 - 180


def reach_degrees(metres: float, lat: float = 0.0) -> tuple[float, float]:
    """Degrees of latitude and longitude that hold all points within some metres, a little more than needed."""
    lat_d = metres / 110_500 * 1.001
    return lat_d, lat_d / max(0.01, math.cos(math.radians(min(89.0, abs(lat)))))


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column, straight: float = 0.001) -> Column:
    """array<struct<lat, lon>> along the great circle: 48 steps a radian, 2 to 96; longitudes don't jump.

    Ends that are nearer than some radians to the same point, or to opposite ones, give the straight line of the two.
    """
    p1, l1, p2, l2 = F.radians(lat1), F.radians(lon1), F.radians(lat2), F.radians(lon2)
    cos_d = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(l2 - l1)
    ends = F.array(F.struct(lat1.alias("lat"), lon1.alias("lon")), F.struct(lat2.alias("lat"), lon2.alias("lon")))

    def at(g: Column, k: Column) -> Column:
        t = k / g["steps"]
        part = F.struct((F.sin((1 - t) * g["d"]) / g["sin_d"]).alias("a"), (F.sin(t * g["d"]) / g["sin_d"]).alias("b"))
        x = lambda s: s["a"] * g["cp1"] * g["cl1"] + s["b"] * g["cp2"] * g["cl2"]
        y = lambda s: s["a"] * g["cp1"] * g["sl1"] + s["b"] * g["cp2"] * g["sl2"]
        z = lambda s: s["a"] * g["sp1"] + s["b"] * g["sp2"]
        spot = let(part, lambda s: F.struct(x(s).alias("x"), y(s).alias("y"), z(s).alias("z")))
        place = let(spot, lambda s: F.struct(F.degrees(F.atan2(s["z"], F.sqrt(s["x"] * s["x"] + s["y"] * s["y"]))).alias("lat"), F.degrees(F.atan2(s["y"], s["x"])).alias("lon")))
        # the turn nearest to the start's longitude
        return let(place, lambda s: F.struct(s["lat"].alias("lat"), (s["lon"] + F.lit(360.0) * F.floor((lon1 - s["lon"] + 180) / 360)).alias("lon")))

    def along(d: Column) -> Column:
        steps = F.greatest(F.lit(2), F.least(F.lit(96), F.ceil(d * 48).cast("int")))
        flat = (d == 0) | (d < straight) | (F.lit(math.pi) - d < straight)
        sides = [f(angle).alias(name + angle_name) for angle, angle_name in ((p1, "p1"), (l1, "l1"), (p2, "p2"), (l2, "l2")) for f, name in ((F.sin, "s"), (F.cos, "c"))]
        known = F.struct(d.alias("d"), F.sin(d).alias("sin_d"), steps.alias("steps"), *sides)
        return F.when(flat, ends).otherwise(let(known, lambda g: F.transform(F.sequence(F.lit(0), g["steps"]), lambda k: at(g, k))))

    # each value is bound once: what a step names twice would be worked out twice, and what that names again
    return let(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_d))), along)


def circle(lat: Column, lon: Column, radius_m: Column, corners: int = 72) -> Column:
    """array<struct<lat, lon>>: a closed polygon around a point."""
    north = F.degrees(radius_m / F.lit(EARTH_M))
    east = north / F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    turn = lambda k: F.lit(2 * math.pi) * (k % corners) / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: F.struct((lat + north * F.cos(turn(k))).alias("lat"), (lon + east * F.sin(turn(k))).alias("lon")))
