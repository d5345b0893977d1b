"""Waypoint CSV files, rasters and path exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions import geo
from pelorus.grid import GridSpec


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """lat and lon of a CSV with such headers, in any case; rows that lack a number are left out. seq keeps the order."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    if not {"lat", "lon"} <= set(names):
        raise ValueError(f"LAT and LON are needed, found {raw.columns}")
    number = lambda c: F.trim(F.col(f"`{names[c]}`")).try_cast("double")
    rows = raw.select(F.monotonically_increasing_id().alias("seq"), number("lat").alias("lat"), number("lon").alias("lon"))
    return rows.where("lat is not null and lon is not null")


def linestring_feature(points: DataFrame, osm_id: str = "12", z_order: int = 0, other_tags: str = r"\"seamark:type\"=>\"area_to_avoid\"", allow_single_point: bool = True, close: bool = True) -> DataFrame:
    """One GeoJSON feature out of waypoints: a single point is doubled, the line is closed.

    Without points, or with one that may not be doubled, the row's job fails.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    c = points.agg(ordered.alias("c"))
    none = F.raise_error(F.lit("no valid coordinates")).cast("array<array<double>>")
    one = F.concat("c", "c") if allow_single_point else F.raise_error(F.lit("a line needs two points")).cast("array<array<double>>")
    c = c.select(F.when(F.size("c") == 0, none).when(F.size("c") == 1, one).otherwise(F.col("c")).alias("c"))
    ends_differ = F.element_at("c", 1) != F.element_at("c", -1)
    c = c.select(F.when(F.lit(close) & ends_differ, F.concat("c", F.array(F.element_at("c", 1)))).otherwise(F.col("c")).alias("c"))
    properties = F.struct(F.lit(osm_id).alias("osm_id"), F.lit(z_order).alias("z_order"), F.lit(other_tags).alias("other_tags"))
    return c.select(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"))


def literal_route(spark: SparkSession, points: list[tuple[float, float]], route_id: int = 0) -> DataFrame:
    """A request out of (lat, lon) points."""
    return spark.createDataFrame([(route_id, i, float(a), float(b)) for i, (a, b) in enumerate(points)], "route_id long, seq int, lat double, lon double")


# The mosaic's columns and rows, and the side of a tile.
TILE_COLUMNS, TILE_ROWS, TILE_SIDE = "ABCD", "12", 21_600


def tiles(spark: SparkSession, names: list[str] | None = None, side: int = TILE_SIDE) -> DataFrame:
    """Tiles of the world mosaic with their pixel extents, out of names that end in column and row."""
    names = names or [f"{c}{r}" for r in TILE_ROWS for c in TILE_COLUMNS]
    return tile_extents(spark.createDataFrame([(n,) for n in names], "name string"), side)


def tile_extents(names: DataFrame, side: int = TILE_SIDE) -> DataFrame:
    """name, x0, x1, y0, y1 of the names that end in a column and a row of the mosaic; others are left out."""
    code = F.regexp_extract("name", "([A-D])([12])(?:\\.png)?$", 0)
    column = F.ascii(F.substring(code, 1, 1)) - ord("A")
    row = F.substring(code, 2, 1).try_cast("int") - 1
    return names.where(code != "").select("name", (column * side).alias("x0"), ((column + 1) * side).alias("x1"), (row * side).alias("y0"), ((row + 1) * side).alias("y1"))


def read_gray(spark: SparkSession, path: str, decode) -> DataFrame:
    """Gray cells (file, x, y, gray) of image files; ``decode`` turns a file's bytes into a 2-D array.

    Decoding needs an image library, which is the caller's choice. Cells that
    are white are water's opposite and most of a tile, so a row of a file comes
    at a time.
    """
    import numpy as np
    import pandas as pd

    def cells(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                image = np.asarray(decode(content))
                for y in range(image.shape[0]):
                    yield pd.DataFrame({"file": file, "x": np.arange(image.shape[1], dtype=np.int32), "y": np.int32(y), "gray": image[y].astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "file string, x int, y int, gray int")


def read_cells(spark: SparkSession, path: str, x_min: int, x_max: int, y_min: int, y_max: int) -> DataFrame:
    """Cells of a stored raster (x, y and more) in a window, upper ends excluded; the filter reaches the files."""
    return spark.read.parquet(path).where((F.col("x") >= x_min) & (F.col("x") < x_max) & (F.col("y") >= y_min) & (F.col("y") < y_max))


def window_of(grid: GridSpec, mosaic: GridSpec) -> tuple[int, int, int, int]:
    """Pixel window (x_min, x_max, y_min, y_max) of a grid's bounds in a mosaic; fails if empty."""
    x = lambda lon: int((lon - mosaic.lon_min) / (mosaic.lon_max - mosaic.lon_min) * mosaic.width)
    y = lambda lat: int((mosaic.lat_max - lat) / (mosaic.lat_max - mosaic.lat_min) * mosaic.height)
    clamp = lambda v, top: max(0, min(top, v))
    out = clamp(x(grid.lon_min), mosaic.width), clamp(x(grid.lon_max), mosaic.width), clamp(y(grid.lat_max), mosaic.height), clamp(y(grid.lat_min), mosaic.height)
    if out[0] >= out[1] or out[2] >= out[3]:
        raise ValueError("the window lies outside the mosaic")
    return out


def write_path_csv(path: DataFrame, grid: GridSpec, target: str) -> None:
    """A path's points as lat,lon with a header, in order, in one file."""
    rows = path.orderBy("seq").select(grid.lat_at(F.col("y")).alias("lat"), grid.lon_at(F.col("x")).alias("lon"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(target)


class ResultCache:
    """Stored results by a key of their inputs, under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def key(*parts: object) -> str:
        """Name of a result: a digest of all that it depends on."""
        import hashlib

        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16]

    def _path(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self, key: str, make, refresh: bool = False) -> DataFrame:
        """The stored result, made and stored first if it is not there."""
        path, fs = self._path(key)
        if refresh or not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}/_SUCCESS")):
            make().write.mode("overwrite").parquet(str(path))
        return self.spark.read.parquet(str(path))

    def clear(self, prefix: str = "") -> int:
        """Delete the results whose key starts with ``prefix``; how many there were."""
        path, fs = self._path("")
        if not fs.exists(path):
            return 0
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix)]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def content_keys(files: DataFrame) -> DataFrame:
    """Key of each file's content (path, content)."""
    return files.select("path", geo.content_key(F.md5("content")).alias("key")).orderBy("path")
