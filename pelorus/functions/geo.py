"""Great-circle, bearing and grid arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_NM = 3440.065
KM_PER_NM = 1.852
METRES_PER_NM = 1852.0
KM_PER_DEGREE = 111.0
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def nm_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Nautical miles by the spherical law of cosines, the short way round; equal points are 0 apart."""
    a, b = F.radians(lat1), F.radians(lat2)
    return F.acos(_clamped(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1)))) * F.lit(EARTH_NM)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Nautical miles by the haversine formula."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * F.lit(EARTH_NM)


def flat_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees on the plane that touches the middle latitude."""
    return F.hypot(lat2 - lat1, (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    a, b = F.radians(lat1), F.radians(lat2)
    return bearing_of((F.sin(a), F.cos(a)), (F.sin(b), F.cos(b)), lon2 - lon1)


def bearing_of(a: tuple[Column, Column], b: tuple[Column, Column], degrees: Column) -> Column:
    """Initial bearing between places of which the sine and cosine of the latitude are known, so many degrees of longitude apart."""
    d = F.radians(degrees)
    y, x = F.sin(d) * b[1], a[1] * b[0] - a[0] * b[1] * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    """Name of the 16-point sector; 0 and 360 are N; null outside 0..360."""
    sector = F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16)).cast("int")
    return F.when(degrees.between(0, 360), F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1))


def sectors_around(degrees: Column) -> Column:
    """The sector of a heading and its two neighbours: array<struct<rank, name>>, the heading's own first."""
    sector = F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16)).cast("int")
    names = F.array(*map(F.lit, COMPASS))
    at = lambda k: F.element_at(names, F.pmod(sector + k, F.lit(16)).cast("int") + 1)
    own = F.array(*[F.struct(F.lit(r).alias("rank"), at(k).alias("name")) for r, k in enumerate((0, -1, 1))])
    return F.when(degrees.between(0, 360), own)


def aligned(a: Column, b: Column, tolerance: float) -> Column:
    """Bearings no more than ``tolerance`` apart; false if either is null."""
    apart = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.coalesce(F.least(apart, 360 - apart) <= tolerance, F.lit(False))


def mean_bearing(a: Column, b: Column) -> Column:
    """Direction of the sum of two unit vectors."""
    y = F.sin(F.radians(a)) + F.sin(F.radians(b))
    x = F.cos(F.radians(a)) + F.cos(F.radians(b))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def mean_bearing_agg(b: Column) -> Column:
    """Aggregate: direction of the sum of unit vectors."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(b))), F.sum(F.cos(F.radians(b))))) + 360, F.lit(360.0))


def delta_x(x0: Column, x1: Column, width: int, wraps: bool) -> Column:
    """Columns from x0 to x1, the short way where the grid wraps."""
    d, half = x1 - x0, width // 2
    return F.when(d > half, d - width).when(d < -half, d + width).otherwise(d) if wraps else d


def wrap_x(x: Column, width: int, wraps: bool) -> Column:
    return F.pmod(x, F.lit(width)) if wraps else x


def bearing_bias(dx: Column, dy: Column, gdx: Column, gdy: Column) -> Column:
    """Tie-breaker for steps that point away from the goal: up to 0.002."""
    size = F.hypot(dx, dy) * F.hypot(gdx, gdy)
    return F.when(size > 0, (1 - _clamped((dx * gdx + dy * gdy) / size)) * 1e-3).otherwise(F.lit(0.0))


def lane_factor(alignment: Column, from_lane: Column, factor: float) -> Column:
    """Cost factor of a step onto a lane cell with a direction, by how well step and goal agree with it."""
    along = (
        F.when(alignment > 0.9, F.lit(factor * 0.6)).when(alignment > 0.5, F.lit(factor * 0.7)).when(alignment > 0, F.lit(factor * 0.85)).when(alignment == 0, F.lit(0.9))
    )
    against = F.when(alignment > -0.2, F.lit(1.0)).when(alignment > -0.5, F.lit(1.5)).otherwise(F.lit(10.0))
    return F.when(from_lane & (alignment >= 0), along).otherwise(against)


def ring(radius: int, directions: int | None) -> list[tuple[int, int]]:
    """Rounded points of a circle, each once, in the order of the angle."""
    n = directions or int(2 * math.pi * radius)
    turns = (2 * math.pi * i / n for i in range(n))
    points = ((round(radius * math.cos(t)), round(radius * math.sin(t))) for t in turns)
    return [p for p in dict.fromkeys(points) if p != (0, 0)]


def content_key(*parts: Column, length: int = 16) -> Column:
    """Leading hex digits of the MD5 of the parts, joined by a bar."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, length)
