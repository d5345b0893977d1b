"""Settings of the route engine as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Way points (lat, lon) of the segments that are laid down beforehand.
SEGMENTS = {
    "channel_w_to_e": [
        (49.7500, -5.0000),
        (49.8333, -4.0000),
        (49.9167, -2.5000),
        (49.8333, -1.5000),
        (50.0000, 0.5000),
        (50.9167, 1.1667),
        (51.0000, 1.7500),
        (51.0833, 2.5000),
    ],
    "channel_e_to_w": [
        (51.0833, 2.5000),
        (51.0000, 1.7500),
        (50.9167, 1.1667),
        (50.8333, 0.5000),
        (50.5000, -1.5000),
        (49.7500, -2.5000),
        (49.7500, -4.0000),
        (49.7500, -5.0000),
    ],
}

# The corners (lon, lat) of the area in which those segments hold.
SEGMENT_AREA = [(-5.5, 50.0), (1.0, 51.0), (1.5, 52.0), (3.5, 51.5), (-0.5, 49.0), (-5.0, 48.5)]


def segments(spark: SparkSession, known: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """route_id (the name), seq, lat, lon of every segment."""
    rows = [(name, i, float(lat), float(lon)) for name, points in (known or SEGMENTS).items() for i, (lat, lon) in enumerate(points)]
    return spark.createDataFrame(rows, "route_id string, seq int, lat double, lon double")


def segment_area(spark: SparkSession) -> DataFrame:
    """ring_id and points (lat, lon) of the area, closed."""
    ring = [*SEGMENT_AREA, SEGMENT_AREA[0]]
    return spark.createDataFrame([(0, [(lat, lon) for lon, lat in ring])], "ring_id long, points array<struct<lat:double,lon:double>>")


def regions(spark: SparkSession, rectangles: list[tuple[int, int, int, int]]) -> DataFrame:
    """x_min, x_max, y_min, y_max of the pixel rectangles that a buffer must not close, as ``carve`` wants them."""
    return spark.createDataFrame(rectangles, "x_min int, x_max int, y_min int, y_max int")


def in_area(spark: SparkSession, points: DataFrame) -> DataFrame:
    """Points (lat, lon) that lie in the area, by crossing number."""
    area = segment_area(spark).select(F.col("points").alias("__area"))
    p = F.col("__area")
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b"))

    def crosses(e):
        a, b = e["a"], e["b"]
        at = (b["lon"] - a["lon"]) * (F.col("lat") - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.coalesce(((a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))) & (F.col("lon") < at), F.lit(False))

    # one row, of fixed size
    met = points.withColumn("__one", F.lit(0)).join(F.broadcast(area.withColumn("__one", F.lit(0))), "__one")
    return met.where(F.size(F.filter(pairs, crosses)) % 2 == 1).drop("__area", "__one")
