"""The pixel grid over a geographic window, as a value that is passed on."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelorus.functions.geo import bearing, bearing_of

LEAST_SIDE, MOST_SIDE = 100, 50_000
PADDING_DEG = 10.0


@dataclass(frozen=True)
class GridSpec:
    """A window in degrees and its size in pixels; x grows east, y grows south."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    width: int
    height: int

    @classmethod
    def globe(cls, width: int = 21_600, height: int = 10_800) -> GridSpec:
        return cls(-90.0, 90.0, -180.0, 180.0, width, height)

    @classmethod
    def around(cls, points: list[tuple[float, float]], pixels_per_nm: float = 2.0, padding: float = PADDING_DEG) -> GridSpec:
        """The window of (lat, lon) points, padded and clamped to the globe, at a resolution."""
        lats, lons = [p[0] for p in points], [p[1] for p in points]
        s, n = max(-90.0, min(lats) - padding), min(90.0, max(lats) + padding)
        w, e = max(-180.0, min(lons) - padding), min(180.0, max(lons) + padding)
        width, height = target_size(s, n, w, e, pixels_per_nm)
        return cls(s, n, w, e, width, height)

    def scaled(self, factor: int) -> GridSpec:
        return replace(self, width=self.width * factor, height=self.height * factor)

    @property
    def wraps(self) -> bool:
        """Whether the window goes all the way round, so that x may wrap."""
        return self.lon_max - self.lon_min >= 359.0

    def contains(self, lat: Column, lon: Column) -> Column:
        """In the window; the edges count."""
        return lat.between(self.lat_min, self.lat_max) & lon.between(self.lon_min, self.lon_max)

    def pixel_x(self, lon: Column) -> Column:
        """Column of a longitude; whole degrees of overrun are taken back first, fractions are cut off."""
        lon = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
        return ((lon - F.lit(self.lon_min)) / F.lit(self.lon_max - self.lon_min) * F.lit(float(self.width))).cast("int")

    def pixel_y(self, lat: Column) -> Column:
        return ((F.lit(self.lat_max) - lat) / F.lit(self.lat_max - self.lat_min) * F.lit(float(self.height))).cast("int")

    def to_pixel(self, lat: Column, lon: Column) -> Column:
        """struct(x, y); null outside the window."""
        return F.when(self.contains(lat, lon), F.struct(self.pixel_x(lon).alias("x"), self.pixel_y(lat).alias("y")))

    def lon_at(self, x: Column, centre: bool = False) -> Column:
        """Longitude of a pixel's left edge or centre."""
        at = x.cast("double") + (0.5 if centre else 0.0)
        lon = F.lit(self.lon_min) + at / F.lit(float(self.width)) * F.lit(self.lon_max - self.lon_min)
        return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)

    def lat_at(self, y: Column, centre: bool = False) -> Column:
        """Latitude of a pixel's upper edge or centre."""
        at = y.cast("double") + (0.5 if centre else 0.0)
        return F.lit(self.lat_max) - at / F.lit(float(self.height)) * F.lit(self.lat_max - self.lat_min)

    def pixel_bearing(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """Bearing from one pixel to another; null if they are one or either lies off the grid.

        Between antipodes the last bits of sines and cosines decide. Where the
        window holds such, those of its rows come from the C library, as they
        do in SQL, and not from the JVM's own.
        """
        there = self.holds(x0, y0) & self.holds(x1, y1) & ((x0 != x1) | (y0 != y1))
        if self.lon_max - self.lon_min < 180:
            return F.when(there, bearing(self.lat_at(y0), self.lon_at(x0), self.lat_at(y1), self.lon_at(x1)))
        at = [math.radians(self.lat_max - y / float(self.height) * (self.lat_max - self.lat_min)) for y in range(self.height)]
        # one literal that is folded into an array, whatever the height
        sines, cosines = (F.split(F.lit(",".join(repr(f(a)) for a in at)), ",").cast("array<double>") for f in (math.sin, math.cos))
        row = lambda y: (F.get(sines, y), F.get(cosines, y))
        return F.when(there, bearing_of(row(y0), row(y1), self.lon_at(x1) - self.lon_at(x0)))

    def to_latlon(self, x: Column, y: Column) -> Column:
        return F.struct(self.lat_at(y).alias("lat"), self.lon_at(x).alias("lon"))

    def holds(self, x: Column, y: Column) -> Column:
        """The cell lies on the grid."""
        return x.between(0, self.width - 1) & y.between(0, self.height - 1)

    def buffer_pixels(self, nm: float) -> int:
        """Whole pixels in a distance, by the grid's pixels per degree of longitude."""
        return round(nm * (self.width / (self.lon_max - self.lon_min)) / 60.0)

    def search_radius(self, nm: float = 5.0) -> int:
        """Pixels of a search step: the window is taken 10 degrees taller on both sides."""
        degrees = abs((self.lat_max + PADDING_DEG) - (self.lat_min - PADDING_DEG)) / self.height
        return int(nm * 1852 / ((40_075_000 / 360) * degrees))

    def cropped_radius(self, radius: float, full_width: int = 21_600) -> float:
        """A radius meant for the full globe, for this window's pixels."""
        return radius * (self.width / (self.lon_max - self.lon_min)) / (full_width / 360.0)


def target_size(lat_min: float, lat_max: float, lon_min: float, lon_max: float, pixels_per_nm: float = 2.0) -> tuple[int, int]:
    """(width, height) for a resolution, each between 100 and 50,000."""
    height = min(MOST_SIDE, max(LEAST_SIDE, round((lat_max - lat_min) * 60 * pixels_per_nm)))
    width = min(MOST_SIDE, max(LEAST_SIDE, round((lon_max - lon_min) * height / (lat_max - lat_min))))
    return width, height


def target_size_columns(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, pixels_per_nm: float = 2.0) -> Column:
    """struct(width, height) as ``target_size``, for windows in rows."""
    clamp = lambda c: F.least(F.lit(MOST_SIDE), F.greatest(F.lit(LEAST_SIDE), F.rint(c).cast("int")))
    height = clamp((lat_max - lat_min) * 60 * F.lit(float(pixels_per_nm)))
    return F.struct(clamp((lon_max - lon_min) * height / (lat_max - lat_min)).alias("width"), height.alias("height"))


def pixel_scales(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, width: Column, height: Column, buffer_nm: float, step_nm: float = 5.0, radius: float = 1.0, full_width: int = 21_600) -> Column:
    """struct(buffer, step, radius) of windows in rows: what ``buffer_pixels``, ``search_radius`` and ``cropped_radius`` give for one."""
    per_degree = width / (lon_max - lon_min)
    degrees = F.abs((lat_max + PADDING_DEG) - (lat_min - PADDING_DEG)) / height
    return F.struct(
        F.rint(buffer_nm * per_degree / 60.0).cast("int").alias("buffer"),
        (F.lit(step_nm * 1852) / (F.lit(40_075_000 / 360) * degrees)).cast("int").alias("step"),
        (radius * per_degree / (full_width / 360.0)).alias("radius"),
    )


def crop_window(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, mosaic: GridSpec) -> Column:
    """struct(x_min, x_max, y_min, y_max), upper ends excluded: the pixels of windows in rows, cut at the mosaic's edges; null if none is left."""
    x = lambda lon: ((lon - mosaic.lon_min) / (mosaic.lon_max - mosaic.lon_min) * mosaic.width).cast("int")
    y = lambda lat: ((mosaic.lat_max - lat) / (mosaic.lat_max - mosaic.lat_min) * mosaic.height).cast("int")
    cut = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c))
    x0, x1, y0, y1 = cut(x(lon_min), mosaic.width), cut(x(lon_max), mosaic.width), cut(y(lat_max), mosaic.height), cut(y(lat_min), mosaic.height)
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x_min"), x1.alias("x_max"), y0.alias("y_min"), y1.alias("y_max")))
