"""Lane, no-go and water masks out of features and land."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions import tags
from pelorus.grid import GridSpec
from pelorus.operators import raster
from pelorus.sources import geojson

LAND_TYPES = ("area_to_avoid", "separation_zone", "inshore_traffic_zone")
WATER_TYPES = (tags.LANE,)


@dataclass
class LaneMasks:
    """lanes: x, y, u, v; no_go: x, y."""

    lanes: DataFrame
    no_go: DataFrame


def pixel_lines(lines: DataFrame, grid: GridSpec) -> DataFrame:
    """Replace points by the pixels of those in the window; the others are left out and their neighbours joined."""
    inside = F.filter("points", lambda p: grid.contains(p["lat"], p["lon"]))
    pixels = F.transform(inside, lambda p: F.struct(grid.pixel_x(p["lon"]).alias("x"), grid.pixel_y(p["lat"]).alias("y")))
    return lines.withColumn("points", pixels).where(F.size("points") > 0)


def is_closed(points: Column, tolerance: int) -> Column:
    """Three points or more, the ends within ``tolerance`` pixels each way."""
    a, b = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return (F.size(points) >= 3) & (F.abs(a["x"] - b["x"]) <= tolerance) & (F.abs(a["y"] - b["y"]) <= tolerance)


def combined(features: DataFrame, grid: GridSpec, dilation: int = 2, no_go_dilation: int = 3, supersample: int = 1, extend: int = 0) -> LaneMasks:
    """Lanes with directions, and no-go areas: all that is no lane, closed lines filled, others as lines.

    Drawn on a grid ``supersample`` times as fine, widened, then pooled.
    """
    fine = grid.scaled(supersample)
    lines = geojson.lines(features).withColumn("kind", tags.type_for_mask(*geojson.tag_columns()))
    lines = pixel_lines(lines, fine).withColumn("line_id", F.struct("feature_id", "part", "ring"))
    lane_lines = lines.where(F.col("kind") == tags.LANE).withColumn("points", raster.extend_polyline(F.col("points"), extend * supersample))
    other = lines.where(F.col("kind") != tags.LANE)
    closed = is_closed(F.col("points"), 2 * supersample)
    lanes = raster.dilate_lanes(raster.rasterize(lane_lines, fine), dilation, fine)
    areas = raster.fill_rings(other.where(closed), fine, "line_id").select("x", "y")
    no_go = raster.dilate(raster.union(areas, raster.rasterize(other.where(~closed), fine)), no_go_dilation, fine)
    if supersample > 1:
        cells = raster.max_pool(lanes, supersample, fine)
        lanes = cells.join(raster.mean_pool(lanes, supersample, fine), ["x", "y"], "left").fillna(0.0, ["u", "v"])
        no_go = raster.max_pool(no_go, supersample, fine)
    return LaneMasks(lanes, no_go)


def simple(features: DataFrame, grid: GridSpec, dilation: int = 2, extend: int = 0) -> DataFrame:
    """Lanes of LineStrings alone, whatever their type: x, y, u, v."""
    lines = pixel_lines(geojson.lines(features, ("LineString",)), grid).withColumn("line_id", F.col("feature_id"))
    lines = lines.withColumn("points", raster.extend_polyline(F.col("points"), extend))
    return raster.dilate_lanes(raster.rasterize(lines, grid), dilation, grid)


def overlay(land: DataFrame, features: DataFrame, grid: GridSpec, land_types: tuple[str, ...] = LAND_TYPES, water_types: tuple[str, ...] = WATER_TYPES, width: int = 10) -> DataFrame:
    """Land with features drawn over it: land types first, then water types, which reopen it."""
    lines = geojson.lines(features)
    direct, parsed, raw = geojson.tag_columns()
    lines = lines.withColumn("kind", tags.type_for_overlay(direct, parsed, raw, geojson.prop("seamark_type")))
    a, b = F.try_element_at(F.col("points"), F.lit(1)), F.try_element_at(F.col("points"), F.lit(-1))
    loop = (F.size("points") >= 4) & (F.abs(a["lat"] - b["lat"]) < 1e-6) & (F.abs(a["lon"] - b["lon"]) < 1e-6)
    shape = F.col("geometry.type")
    lines = lines.withColumn("filled", shape.isin("Polygon", "MultiPolygon") | ((shape == "LineString") & loop))
    lines = lines.withColumn("points", F.transform("points", lambda p: F.struct(grid.pixel_x(p["lon"]).alias("x"), grid.pixel_y(p["lat"]).alias("y"))))

    def drawn(types: tuple[str, ...]) -> DataFrame:
        own = lines.where(F.col("kind").isin(*types))
        areas = raster.fill_polygons(own.where("filled").withColumn("polygon_id", F.struct("feature_id", "part")), grid)
        return raster.union(areas, raster.brushed_lines(own.where("not filled"), grid, width))

    return raster.minus(raster.union(land, drawn(land_types)), drawn(water_types))


def buffered_land(land: DataFrame, grid: GridSpec, buffer_nm: float, lanes: DataFrame | None = None, features: DataFrame | None = None, width: int = 10, features_first: bool = True) -> DataFrame:
    """Land, without lanes, widened by the coastal buffer; features are drawn before or after the widening."""
    if lanes is not None:
        land = raster.minus(land.select("x", "y"), lanes)
    if features is not None and features_first:
        land = overlay(land, features, grid, width=width)
    land = raster.dilate(land, grid.buffer_pixels(buffer_nm), grid)
    if features is not None and not features_first:
        land = overlay(land, features, grid, width=width)
    return land
