"""Plane geometry, intervals and map projection as column expressions (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two numbers closer than this count as equal.
TOLERANCE = 1e-6


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return length(bx - ax, by - ay)


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """The direction of a vector; null for the zero vector."""
    n = length(x, y)
    return F.when(n > 0, x / n), F.when(n > 0, y / n)


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on segment a-b the point nearest to p lies, from 0 to 1 (0 for a point-like segment)."""
    size = dot(bx - ax, by - ay, bx - ax, by - ay)
    along = dot(px - ax, py - ay, bx - ax, by - ay)
    return F.when(size > 0, F.least(F.greatest(along / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def nearest_on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """x and y of the nearest point of the segment, and its offset from a."""
    f = segment_fraction(px, py, ax, ay, bx, by)
    return ax + f * (bx - ax), ay + f * (by - ay), f * distance(ax, ay, bx, by)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    x, y, _ = nearest_on_segment(px, py, ax, ay, bx, by)
    return distance(px, py, x, y)


# --- intervals: closed, struct<min, max>, empty if max < min ------------------------


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("min"), hi.cast("double").alias("max"))


def is_empty(i: Column) -> Column:
    return i["max"] < i["min"]


def contains(i: Column, x: Column) -> Column:
    return (i["min"] <= x) & (x <= i["max"])


def contains_approx(i: Column, x: Column, tolerance: float = TOLERANCE) -> Column:
    return (i["min"] - tolerance <= x) & (x <= i["max"] + tolerance)


def intersection(i: Column, j: Column) -> Column:
    return interval(F.greatest(i["min"], j["min"]), F.least(i["max"], j["max"]))


def intersects(i: Column, j: Column) -> Column:
    return ~is_empty(intersection(i, j))


def scale(i: Column, factor: Column) -> Column:
    return interval(i["min"] * factor, i["max"] * factor)


def offset(i: Column, by: Column) -> Column:
    return interval(i["min"] + by, i["max"] + by)


def make_positive(i: Column) -> Column:
    return interval(F.greatest(i["min"], F.lit(0.0)), i["max"])


def free_space(px, py, ax, ay, bx, by, radius: Column) -> Column:
    """The part of segment a-b (as an interval of 0..1) within ``radius`` of p; empty is (1, 0).

    Solves |a + f (b - a) - p| = radius and clamps; a segment shorter than 1e-4 is judged
    by its first end alone.
    """
    dx, dy = bx - ax, by - ay
    ex, ey = ax - px, ay - py
    a = dot(dx, dy, dx, dy)
    b = 2 * dot(ex, ey, dx, dy)
    c = dot(ex, ey, ex, ey) - radius * radius
    d = b * b - 4 * a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    lo = F.greatest((-b - root) / (2 * a), F.lit(0.0))
    hi = F.least((-b + root) / (2 * a), F.lit(1.0))
    none = interval(F.lit(1.0), F.lit(0.0))
    point = F.when(c <= 0, interval(F.lit(0.0), F.lit(1.0))).otherwise(none)
    whole = F.when((d < 0) | (hi < lo), none).otherwise(interval(lo, hi))
    return F.when(a < 1e-8, point).otherwise(whole)


# --- WGS84 longitude and latitude to UTM metres and back: Krueger's series -------------

#: WGS84 ellipsoid and UTM constants (fixed values).
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def utm_zone(lon: Column) -> Column:
    """The standard zone number, 1 to 60."""
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; southern latitudes get the false northing."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    shift = F.when(lat < 0, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))
    return FALSE_EASTING + SCALE * _RADIUS * east, shift + SCALE * _RADIUS * north


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = (north - F.when(south, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))) / (SCALE * _RADIUS)
    eta = (east - FALSE_EASTING) / (SCALE * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)
