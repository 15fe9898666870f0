"""Spatial formulas as Column expressions: all built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Radii in metres: authalic for the projection, mean for great circles.
AUTHALIC_RADIUS = 6371007.181
MEAN_RADIUS = 6371008.8
DISTORTION_LIMIT = 0.02
CROP_MARGIN_DEG = 5.0
AUTO_PAD_DEG = 5.0
NO_CENTER_RESULTANT = 0.5
CIRCUMPOLAR_GAP_DEG = 1.0
REACH_SAFETY = 0.95
METRES_PER_DEGREE = MEAN_RADIUS * math.pi / 180.0

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def laea_forward(lon: Num, lat: Num, lon0: Num, lat0: Num) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area: metres east and north of the centre."""
    p, p0, dl = F.radians(col(lat)), F.radians(col(lat0)), F.radians(col(lon) - col(lon0))
    denom = 1.0 + F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl)
    k = F.when(denom > 0, F.sqrt(2.0 / F.when(denom > 0, denom))).otherwise(0.0)
    x = AUTHALIC_RADIUS * k * F.cos(p) * F.sin(dl)
    y = AUTHALIC_RADIUS * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))
    return x, y


def laea_inverse(x: Column, y: Column, lon0: Num, lat0: Num) -> tuple[Column, Column]:
    rho = F.sqrt(x * x + y * y)
    safe = F.when(rho < 1e-9, 1.0).otherwise(rho)
    c = 2.0 * F.asin(F.least(F.lit(1.0), rho / (2.0 * AUTHALIC_RADIUS)))
    p0 = F.radians(col(lat0))
    lat = F.degrees(F.asin(F.cos(c) * F.sin(p0) + y * F.sin(c) * F.cos(p0) / safe))
    lon = col(lon0) + F.degrees(F.atan2(x * F.sin(c), safe * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c)))
    near = rho < 1e-9
    return F.when(near, col(lon0)).otherwise(lon), F.when(near, col(lat0)).otherwise(lat)


def unit_sphere(lon: Num, lat: Num) -> tuple[Column, Column, Column]:
    p, l = F.radians(col(lat)), F.radians(col(lon))  # noqa: E741
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def chord_metres(chord2: Column) -> Column:
    """Great-circle metres of a squared chord of the unit sphere."""
    return 2.0 * MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), chord2)) / 2.0))


def haversine(lon1: Num, lat1: Num, lon2: Num, lat2: Num) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = F.radians(col(lat2) - col(lat1)), F.radians(col(lon2) - col(lon1))
    a = F.sin(dp / 2.0) * F.sin(dp / 2.0) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2.0) * F.sin(dl / 2.0)
    return 2.0 * MEAN_RADIUS * F.asin(F.sqrt(a))


def laea_error(c: Column) -> Column:
    """Signed fractional radial error at the angle ``c`` (radians) from the centre."""
    return F.sqrt((1.0 + F.cos(c)) / 2.0) - 1.0


def laea_error_at(metres: Column) -> Column:
    return laea_error(metres / MEAN_RADIUS)


def laea_radius(tolerance: Num) -> Column:
    """Metres from the centre within which the error stays under ``tolerance``."""
    t = 1.0 - col(tolerance)
    return MEAN_RADIUS * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * t * t - 1.0)))


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment; a segment of no length is its end."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(len2 > 0, len2)))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def edge_crosses(lon: Column, lat: Column, xi: Column, yi: Column, xj: Column, yj: Column) -> Column:
    """Whether the even-odd ray of a point crosses the edge from vertex j to vertex i."""
    dy = F.when(yj != yi, yj - yi)
    return F.when((yi > lat) != (yj > lat), lon < (xj - xi) * (lat - yi) / dy + xi).otherwise(F.lit(False))


def norm360(lon: Num) -> Column:
    return F.pmod(col(lon), F.lit(360.0))


def to180(lon: Column) -> Column:
    """0..360 to -180..180; 180 stays."""
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def normalize_lon(lon: Num) -> Column:
    """Wrapped to [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def edge_interval(lon_a: Num, lon_b: Num) -> tuple[Column, Column]:
    """(start, length) of the edge's longitudes in 0..360, the short way round."""
    a, b = norm360(lon_a), norm360(lon_b)
    east = F.pmod(b - a, F.lit(360.0))
    return F.when(east <= 180.0, a).otherwise(b), F.when(east <= 180.0, east).otherwise(360.0 - east)


def axis_index(q: Column, origin: float, step: float, length: int) -> Column:
    """Nearest index on a regular axis, null where the point is off it by more than half a step."""
    if step == 0 or length < 1:
        return F.lit(None).cast("int")
    f = (q - F.lit(float(origin))) / F.lit(float(step))
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(length - 1)), F.round(f, 0)))
    return F.when((f >= -0.5) & (f <= length - 0.5), at).cast("int")


#: Rows and columns of a grid's tile, as a power of two: a world grid of 15 arc seconds has some 14,000.
TILE_BITS = 9


def tile(i: Column, j: Column) -> Column:
    """The tile that a grid cell belongs to, as one number."""
    return F.shiftleft(F.shiftright(i, TILE_BITS), 16).bitwiseOR(F.shiftright(j, TILE_BITS))


def crop_fraction(min_lon: Num, max_lon: Num, min_lat: Num, max_lat: Num, margin: float = CROP_MARGIN_DEG) -> Column:
    """Share of the globe's surface in a region's crop, which is the box and a margin, clipped to the globe."""
    lo, hi = F.radians(F.greatest(F.lit(-90.0), col(min_lat) - margin)), F.radians(F.least(F.lit(90.0), col(max_lat) + margin))
    dlon = F.radians(F.greatest(F.lit(0.0), F.least(F.lit(180.0), col(max_lon) + margin) - F.greatest(F.lit(-180.0), col(min_lon) - margin)))
    return dlon * F.greatest(F.lit(0.0), F.sin(hi) - F.sin(lo)) / (4.0 * math.pi)


def crop_reach(lon: Column, lat: Column, min_lon: Num, max_lon: Num, min_lat: Num, max_lat: Num) -> Column:
    """A lower bound of the metres from a point to what lies outside a crop box; 0 for a point outside."""
    west, east, south, north = col(min_lon), col(max_lon), col(min_lat), col(max_lat)
    ns = F.least(lat - south, north - lat) * METRES_PER_DEGREE
    ew = F.least(lon - west, east - lon) * METRES_PER_DEGREE * F.cos(F.radians(F.least(F.abs(lat), F.lit(89.9))))
    inside = (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)
    return F.when(inside, F.greatest(F.lit(0.0), F.least(ns, ew)) * REACH_SAFETY).otherwise(0.0)


def in_box(lon: Column, lat: Column, box) -> Column:
    """Closed on all sides, without wrapping."""
    return (lon >= box.min_lon) & (lon <= box.max_lon) & (lat >= box.min_lat) & (lat <= box.max_lat)
