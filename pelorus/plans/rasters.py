"""Land out of a stored gray raster, for the window of a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.grid import GridSpec
from pelorus.operators import raster
from pelorus.sources import files

#: The mosaic of eight tiles, in pixels over the globe.
MOSAIC = GridSpec.globe(4 * files.TILE_SIDE, 2 * files.TILE_SIDE)


def store_tiles(spark: SparkSession, images: str, decode, target: str, below: int = 20) -> None:
    """Decode tile images once and store their light cells with their gray, by rows of tiles: x, y, gray.

    Dark cells, which are water, are left out: most cells are water.
    """
    gray = files.read_gray(spark, images, decode).withColumn("name", F.regexp_extract("file", "([A-D][12])\\.png$", 1))
    placed = gray.where(F.col("gray") >= below).join(F.broadcast(files.tiles(spark).select("name", "x0", "y0")), "name")
    cells = placed.select((F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "gray")
    cells.withColumn("band", F.floor(F.col("y") / 1024).cast("int")).write.mode("overwrite").partitionBy("band").parquet(target)


def window_land(spark: SparkSession, stored: str, grid: GridSpec, mosaic: GridSpec = MOSAIC, below: int = 20) -> DataFrame:
    """Land cells of a grid: those whose stored cells, others counting as black, are ``below`` or lighter on average."""
    x0, x1, y0, y1 = files.window_of(grid, mosaic)
    cells = files.read_cells(spark, stored, x0, x1, y0, y1)
    if "band" in cells.columns:
        cells = cells.where(F.col("band").between(y0 // 1024, (y1 - 1) // 1024))
    local = raster.crop(cells.select("x", "y", "gray"), x0, y0, x1 - x0, y1 - y0)
    per_cell = ((x1 - x0) / grid.width) * ((y1 - y0) / grid.height)
    x = F.floor((F.col("x") + 0.5) * grid.width / (x1 - x0)).cast("int").alias("x")
    y = F.floor((F.col("y") + 0.5) * grid.height / (y1 - y0)).cast("int").alias("y")
    return local.groupBy(x, y).agg((F.sum("gray") / F.lit(per_cell)).alias("gray")).where(F.col("gray") >= below).select("x", "y")


def image_water(spark: SparkSession, image: str, decode, whole: GridSpec, lat_min: float, lat_max: float, lon_min: float, lon_max: float, width: int, height: int, below: int = 20) -> tuple[DataFrame, GridSpec]:
    """Water cells, and their grid, of a window of one image of the world, brought to a size by a triangle filter."""
    cut = GridSpec(max(lat_min, whole.lat_min), min(lat_max, whole.lat_max), max(lon_min, whole.lon_min), min(lon_max, whole.lon_max), width, height)
    x0, x1, y0, y1 = files.window_of(cut, whole)
    part = raster.crop(files.read_gray(spark, image, decode).select("x", "y", "gray"), x0, y0, x1 - x0, y1 - y0)
    source = GridSpec(cut.lat_min, cut.lat_max, cut.lon_min, cut.lon_max, x1 - x0, y1 - y0)
    return raster.water_of_gray(raster.resample_bilinear(part, source, cut), below), cut


def route_land(spark: SparkSession, stored: str, points: list[tuple[float, float]], pixels_per_nm: float = 2.0, padding: float = 10.0, mosaic: GridSpec = MOSAIC) -> tuple[DataFrame, GridSpec]:
    """Land and grid for a request's (lat, lon) points."""
    grid = GridSpec.around(points, pixels_per_nm, padding)
    return window_land(spark, stored, grid, mosaic), grid
