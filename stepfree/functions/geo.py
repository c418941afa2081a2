"""Geometry on WGS84 degrees as column expressions; latitude comes first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
M_PER_LAT, M_PER_LNG = 110540.0, 111320.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def turn_angle(before: Column, after: Column) -> Column:
    """Signed change of bearing, -180 to 180."""
    return F.pmod(after - before + 540, F.lit(360.0)) - 180


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, unlike greatest and least."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def segment_projection(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column, lat0: Column | None = None) -> tuple[Column, Column]:
    """(t, distance in metres) of the closest point of a segment in the plane at latitude lat0 (the segment's middle)."""
    kx = M_PER_LNG * F.cos(F.radians((lat1 + lat2) / 2 if lat0 is None else lat0))
    ax, ay = (lng1 - lng) * kx, (lat1 - lat) * M_PER_LAT
    dx, dy = (lng2 - lng1) * kx, (lat2 - lat1) * M_PER_LAT
    square = dx * dx + dy * dy
    t = F.when(square > 0, clamp(-(ax * dx + ay * dy) / F.when(square > 0, square))).otherwise(F.lit(0.0))
    return t, F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def segment_distance(lat, lng, lat1, lng1, lat2, lng2, lat0=None) -> Column:
    return segment_projection(lat, lng, lat1, lng1, lat2, lng2, lat0)[1]


def polyline_length(points: Column) -> Column:
    """Metres along an array of structs (lat, lng)."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def polyline_distance(lat: Column, lng: Column, points: Column) -> Column:
    """Distance to a polyline: null for none, the point's distance for one point."""
    rest = F.greatest(F.size(points) - 1, F.lit(0))
    legs = F.zip_with(F.slice(points, 1, rest), F.slice(points, 2, rest), lambda a, b: segment_distance(lat, lng, a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.when(F.size(points) == 1, haversine(lat, lng, points[0]["lat"], points[0]["lng"])).otherwise(F.array_min(legs))


def drop_repeats(points: Column) -> Column:
    """A polyline without points equal to the one before, after rounding to 7 places."""
    rounded = F.transform(points, lambda p: F.struct(F.round(p["lat"], 7).alias("lat"), F.round(p["lng"], 7).alias("lng")))
    return F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Whether a point is in a closed ring of structs (lat, lng), by the parity of crossings."""
    n = F.size(ring)
    ends = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crosses(a, b):
        up = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(up & (lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(up, b["lat"] - a["lat"]) + a["lng"]), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, ends, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether two segments cross; touching is not crossing. Points are (x, y) columns."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile numbers (x, y)."""
    n = float(1 << zoom)
    return F.floor((lng + 180) / 360 * n), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n)


def slope_degrees(rise: Column, run: Column) -> Column:
    return F.degrees(F.atan(F.abs(rise) / run))


def transverse_mercator(lat: Column, lng: Column, lat0: float = 38.0, lng0: float = 127.0, false_e: float = 200_000.0, false_n: float = 600_000.0, scale: float = 1.0) -> tuple[Column, Column]:
    """Easting and northing on GRS80 by the series of Krueger to the third order."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)

    def series(la: Column, dl: Column):
        s = F.sin(la)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, k in enumerate(alpha, 1):
            x, y = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return x, y

    x, y = series(F.radians(lat), F.radians(lng - lng0))
    _, y0 = series(F.lit(lat0 * 3.141592653589793 / 180), F.lit(0.0))
    return false_e + scale * radius * x, false_n + scale * radius * (y - y0)
