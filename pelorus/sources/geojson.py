"""GeoJSON features as rows, whatever the container and the geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions import geo, tags

_GEOMETRY = "geometry struct<type:string,coordinates:string>"
_FEATURE = f"struct<type:string,properties:map<string,string>,{_GEOMETRY.replace(' ', ':', 1)}>"
POINT, LINE = "array<double>", "array<array<double>>"


def read_features(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Features of FeatureCollections and of bare arrays: feature_id, type, properties, geometry, file.

    Property values are kept as text (nested ones as JSON), coordinates as JSON
    text that ``lines`` parses by geometry type. feature_id follows the order
    in the files.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    whole = F.from_json("value", f"struct<features:array<{_FEATURE}>>")["features"]
    bare = F.from_json("value", f"array<{_FEATURE}>")
    is_array = F.ltrim("value").startswith("[")
    rows = text.select("file", F.posexplode(F.when(is_array, bare).otherwise(whole)).alias("place", "f"))
    number = F.struct("file", "place")
    return rows.select(number.alias("feature_id"), "f.type", "f.properties", "f.geometry", "file")


# Fixed value: how lane files are named, a file for each compass direction.
LANE_FILES = "TSS_Lanes_*.geojson"


def read_lane_files(spark: SparkSession, folder: str, glob: str = LANE_FILES) -> DataFrame:
    """Features of the lane files of a folder."""
    return read_features(spark, folder, glob)


def prop(name: str) -> Column:
    return F.try_element_at(F.col("properties"), F.lit(name))


def tag_columns() -> tuple[Column, Column, Column]:
    """direct, parsed and raw tags of a feature."""
    parsed = F.from_json(prop("parsed_other_tags"), "map<string,string>")
    return prop(tags.KEY), parsed, prop("other_tags")


def lines(features: DataFrame, types: tuple[str, ...] = ("LineString", "MultiLineString", "Polygon", "MultiPolygon")) -> DataFrame:
    """A row for each line or ring: the feature's columns with part, ring (0 unless a polygon's hole) and points (lat, lon).

    All rings of polygons count, holes with a ring number above 0.
    """
    kind, c = F.col("geometry.type"), F.col("geometry.coordinates")
    nested = (
        F.when(kind == "LineString", F.array(F.array(F.from_json(c, LINE))))
        .when(kind == "MultiLineString", F.transform(F.from_json(c, f"array<{LINE}>"), lambda line: F.array(line)))
        .when(kind == "Polygon", F.array(F.from_json(c, f"array<{LINE}>")))
        .when(kind == "MultiPolygon", F.from_json(c, f"array<array<{LINE}>>"))
    )
    parts = features.where(kind.isin(*types)).select("*", F.posexplode(nested).alias("part", "__rings"))
    rings = parts.select("*", F.posexplode("__rings").alias("ring", "__line")).drop("__rings")
    swapped = F.transform("__line", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    return rings.withColumn("points", swapped).drop("__line")


def lane_index(features: DataFrame) -> DataFrame:
    """Lanes: lane_id, entry, exit, points, bearing (first to last), flow, properties, num_points.

    LineStrings of two points or more that the index reading calls a lane.
    """
    found = lines(features, ("LineString",)).where(F.size("points") >= 2).where(tags.type_for_index(*tag_columns()) == tags.LANE)
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    return found.select(
        F.col("feature_id").alias("lane_id"), a.alias("entry"), b.alias("exit"), "points",
        geo.bearing(a["lat"], a["lon"], b["lat"], b["lon"]).alias("bearing"), prop("tss_flow_cardinal").alias("flow"), "properties", F.size("points").alias("num_points"),
    )


def lane_starts(features: DataFrame) -> DataFrame:
    """What ``nearest_lane_start`` needs, of every LineString: lane_id, flow, start_lat, start_lon, points."""
    found = lines(features, ("LineString",)).where(F.size("points") > 0)
    first = F.element_at("points", 1)
    return found.select(F.col("feature_id").alias("lane_id"), prop("tss_flow_cardinal").alias("flow"), first["lat"].alias("start_lat"), first["lon"].alias("start_lon"), "points", "properties")


def type_counts(features: DataFrame) -> DataFrame:
    """Features of each type, by the overlay's reading."""
    direct, parsed, raw = tag_columns()
    return features.groupBy(tags.type_for_overlay(direct, parsed, raw, prop("seamark_type")).alias("kind")).agg(F.count("*").alias("features")).orderBy("kind")


def write_by_direction(features: DataFrame, path: str) -> None:
    """Split features by compass direction into folders; those without one are left out."""
    rows = features.withColumn("flow", prop("tss_flow_cardinal")).where("flow is not null")
    rows.select("flow", "type", "properties", "geometry").write.mode("overwrite").partitionBy("flow").json(path)


def read_by_direction(spark: SparkSession, path: str, *flows: str) -> DataFrame:
    """Features of some directions; only their folders are read."""
    return spark.read.schema(f"type string, properties map<string,string>, {_GEOMETRY}, flow string").json(path).where(F.col("flow").isin(*flows))
