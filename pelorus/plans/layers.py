"""What a chart of routes shows, as rows; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions import tags
from pelorus.sources import geojson


def arrow(points: Column) -> Column:
    """struct(from, to): the middle point of a line and the one after it; null for a line of one point."""
    middle = F.floor(F.size(points) / 2).cast("int")
    start = F.when(middle + 1 < F.size(points), middle).otherwise(middle - 1)
    return F.when(F.size(points) >= 2, F.struct(F.get(points, start).alias("from"), F.get(points, start + 1).alias("to")))


def lane_layer(features: DataFrame) -> DataFrame:
    """Lines of the features in reach of a chart: kind, layer (lane, boundary, other), points, arrow."""
    lines = geojson.lines(features).withColumn("kind", tags.type_for_mask(*geojson.tag_columns()))
    return lines.select("feature_id", "kind", tags.layer_colour(F.col("kind")).alias("layer"), "points", arrow(F.col("points")).alias("arrow"))


def path_layer(path: DataFrame) -> DataFrame:
    """Legs of paths (route_id, seq, x, y, in_lane) with whether both ends are in lanes."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id").orderBy("seq")
    legs = path.select("route_id", "seq", "x", "y", "in_lane", F.lead("x").over(w).alias("to_x"), F.lead("y").over(w).alias("to_y"), F.lead("in_lane").over(w).alias("to_lane"))
    return legs.where("to_x is not null").select("route_id", "seq", "x", "y", "to_x", "to_y", (F.col("in_lane") & F.col("to_lane")).alias("lane_leg"))


def layer_counts(layer: DataFrame) -> DataFrame:
    """Lines of each layer."""
    return layer.groupBy("layer").agg(F.count("*").alias("lines"))
