"""From route requests to simplified routes with distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.grid import GridSpec
from pelorus.operators import paths, raster, search, spatial
from pelorus.plans.masks import LaneMasks


@dataclass
class Routes:
    """path: route_id, seq, x, y, in_lane; totals: route_id, nm, legs; legs: what the search says of each leg."""

    path: DataFrame
    totals: DataFrame
    legs: DataFrame


def requests_to_legs(requests: DataFrame, land: DataFrame, grid: GridSpec, reach: int = 200) -> DataFrame:
    """Legs between the requests' points (route_id, seq, lat, lon), moved to water; points off the window fail the job."""
    outside = F.raise_error(F.lit("a waypoint lies outside the window")).cast("struct<x:int,y:int>")
    pixel = F.coalesce(grid.to_pixel(F.col("lat"), F.col("lon")), outside)
    points = requests.select(F.struct("route_id", "seq").alias("point_id"), pixel.alias("p")).select("point_id", "p.x", "p.y")
    wet = spatial.to_water(points, land, grid, reach).select("point_id.*", "x", "y")
    w = Window.partitionBy("route_id").orderBy("seq")
    legs = wet.select("route_id", (F.row_number().over(w) - 1).alias("leg"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return legs.where("x1 is not null")


def lane_catalogue(lanes: DataFrame, grid: GridSpec) -> DataFrame:
    """Lanes of an index as the search wants them: lane_id, x, y, lat, lon, bearing, cells."""
    inside = F.filter("points", lambda p: grid.contains(p["lat"], p["lon"]))
    cells = F.transform(inside, lambda p: F.struct(grid.pixel_x(p["lon"]).alias("x"), grid.pixel_y(p["lat"]).alias("y")))
    known = lanes.where(grid.contains(F.col("entry.lat"), F.col("entry.lon"))).withColumn("cells", cells)
    return known.select("lane_id", F.col("cells")[0]["x"].alias("x"), F.col("cells")[0]["y"].alias("y"), F.col("entry.lat").alias("lat"), F.col("entry.lon").alias("lon"), "bearing", "cells")


def plan(requests: DataFrame, land: DataFrame, grid: GridSpec, masks: LaneMasks | None = None, lanes: DataFrame | None = None, config: search.SearchConfig | None = None, margin: int = 50) -> Routes:
    """Search, simplify, flag and shorten the routes.

    ``land`` is buffered land. A route with a leg that cannot be found has no
    path; its legs say why.
    """
    config = config or search.SearchConfig(radius=5 * max(1, grid.search_radius()), snap_km=10.0)
    legs = requests_to_legs(requests, land, grid)
    cells = window_cells(legs, land, grid, masks, margin)
    found = search.guided(legs, cells, grid, config, lane_catalogue(lanes, grid) if lanes is not None else None, margin)
    found = found.persist()
    joined = paths.concat_legs(search.routes_of_legs(found))
    lane_cells = masks.lanes if masks else None
    path = paths.lane_flags(paths.ranked(paths.simplify(joined)), lane_cells)
    path = paths.lane_flags(paths.cut_lane_gaps(path, land, grid).drop("in_lane"), lane_cells)
    path = paths.lane_flags(paths.skip_ahead(path, land, grid).drop("in_lane"), lane_cells)
    totals = paths.totals(paths.with_latlon(path, grid))
    return Routes(path, totals, found.select("route_id", "leg", "reason", "goal_cost", "expansions", "pushes", "pops", "max_open").distinct())


def window_cells(legs: DataFrame, land: DataFrame, grid: GridSpec, masks: LaneMasks | None, margin: int) -> DataFrame:
    """Flags and directions of the cells in the legs' windows: water is what land lacks there."""
    lo = lambda a, b: F.greatest(F.least(a, b) - margin, F.lit(0))
    hi = lambda a, b, n: F.least(F.greatest(a, b) + margin, F.lit(n - 1))
    boxes = legs.select(lo("x0", "x1").alias("ax"), hi("x0", "x1", grid.width).alias("bx"), lo("y0", "y1").alias("ay"), hi("y0", "y1", grid.height).alias("by"))
    runs = boxes.select(F.explode(F.sequence("ay", "by")).alias("y"), F.col("ax").alias("lo"), F.col("bx").alias("hi"))
    every = raster.merged_runs(runs).select(F.explode(F.sequence("lo", "hi")).alias("x"), "y")
    water = raster.minus(every, land)
    out = raster.flags(water, masks.lanes if masks else None, masks.no_go if masks else None)
    if masks is None:
        return out
    return out.join(masks.lanes.select("x", "y", "u", "v"), ["x", "y"], "left").fillna(0.0, ["u", "v"])
