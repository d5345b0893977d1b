"""Queries that write files to the shared folder and read them back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.grid import GridSpec
from pelorus.operators import paths, raster
from pelorus.plans import rasters
from pelorus.plans.queries import _nm, _LAND, _TRACK, GRID, _bearing, _COMPASS, _lat, _lon, _x, _y, cells_of, lat_of, lon_of, query, table, track, x_of, y_of
from pelorus.plans.queries_masks import _shape_sql, supplier_features
from pelorus.session import shared_folder
from pelorus.sources import files, geojson, settings


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pelorus-{name}-{uuid.uuid4().hex}"


# ---- waypoints and paths ----------------------------------------------------


@query(f"""SELECT 'Feature' AS type, '12' AS osm_id, 'LineString' AS shape, CAST(count(*) + 1 AS INTEGER) AS points, arg_min(lon, n_nationkey) AS first_lon, arg_min(lat, n_nationkey) AS first_lat, arg_min(lon, n_nationkey) AS last_lon, round(sum(lon) + arg_min(lon, n_nationkey), 6) AS sum_lon
  FROM (SELECT n_nationkey, {_lat('n_nationkey')} AS lat, {_lon('n_nationkey')} AS lon FROM nation WHERE n_nationkey % 5 <> 3)""")
def waypoint_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed line out of a CSV of waypoints, some of whose rows lack a number."""
    k = F.col("n_nationkey")
    lat = F.when(k % 10 == 3, F.lit("n/a")).when(k % 5 == 3, F.lit("")).otherwise(lat_of(k).cast("string"))
    rows = table(spark, sf_dir, "nation").orderBy(k).select(k.alias("WP"), lat.alias(" Lat"), lon_of(k).cast("string").alias("LON "))
    path = new_folder(spark, "waypoints")
    rows.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    f = files.linestring_feature(files.read_waypoints(spark, path))
    c = F.col("geometry.coordinates")
    total = F.aggregate(c, F.lit(0.0), lambda a, p: a + p[0])
    first, last = F.element_at(c, 1), F.element_at(c, -1)
    return f.select("type", "properties.osm_id", F.col("geometry.type").alias("shape"), F.size(c).alias("points"), first[0].alias("first_lon"), first[1].alias("first_lat"), last[0].alias("last_lon"), F.round(total, 6).alias("sum_lon"))


@query(f"""WITH {_TRACK} SELECT CAST(row_number() OVER (ORDER BY seq) - 1 AS INTEGER) AS seq, round(60.0 - y / 100.0 * 120.0, 9) AS lat, round(-180.0 + x / 200.0 * 360.0, 9) AS lon FROM track WHERE route_id = (SELECT min(user_id) FROM events)""")
def path_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user's track, exported as a CSV and read again."""
    from pyspark.sql import Window

    t = track(spark, sf_dir)
    first = table(spark, sf_dir, "events").agg(F.min("user_id").alias("route_id"))
    path = new_folder(spark, "path")
    files.write_path_csv(t.join(first, "route_id", "left_semi"), GRID, path)
    rows = files.read_waypoints(spark, path)
    # one route's points, as the file has them
    return rows.select((F.row_number().over(Window.orderBy("seq")) - 1).alias("seq"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


# ---- features ---------------------------------------------------------------


def write_collection(features: DataFrame, path: str) -> None:
    """Feature collections as text, a file a task, properties with their nested tags as the lane files have them."""
    f = F.struct("type", "properties", F.struct(F.col("geometry.type").alias("type"), F.from_json("geometry.coordinates", "variant").alias("coordinates")).alias("geometry"))
    lines = features.select(F.to_json(f).alias("f")).groupBy(F.spark_partition_id()).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.array_sort(F.collect_list("f")), ","), F.lit("]}")).alias("value"))
    lines.select("value").write.text(path)


_LANE_LINES = "SELECT fid, arg_min(lat, j) AS entry_lat, arg_min(lon, j) AS entry_lon, arg_max(lat, j) AS exit_lat, arg_max(lon, j) AS exit_lon, CAST(count(*) AS INTEGER) AS num_points FROM points WHERE k IN (0, 2) GROUP BY fid"


@query(f"""WITH {_shape_sql()}, lane AS ({_LANE_LINES}) SELECT entry_lat, entry_lon, exit_lat, exit_lon, round({_bearing('entry_lat', 'entry_lon', 'exit_lat', 'exit_lon')}, 6) AS bearing,
  CASE WHEN fid % 4 <> 0 THEN {_COMPASS}[CAST(floor((fid * 41 % 360 + 11.25) / 22.5) AS INTEGER) % 16 + 1] END AS flow, num_points FROM lane""")
def lane_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the lanes in feature collections that were written as text."""
    path = new_folder(spark, "features")
    write_collection(supplier_features(spark, sf_dir), path)
    i = geojson.lane_index(geojson.read_features(spark, path, "part-*"))
    return i.select(*[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("entry", "exit") for c in ("lat", "lon")], F.round("bearing", 6).alias("bearing"), "flow", "num_points")


@query(f"""WITH {_shape_sql()}, lane AS (SELECT fid, {_COMPASS}[CAST(floor((fid * 41 % 360 + 11.25) / 22.5) AS INTEGER) % 16 + 1] AS flow, arg_min(lat, j) AS start_lat, arg_min(lon, j) AS start_lon FROM points WHERE k IN (0, 1, 2) AND fid % 4 <> 0 GROUP BY fid)
  SELECT flow, count(*) AS lanes, round(sum(start_lat), 6) AS lat, round(sum(start_lon), 6) AS lon FROM lane WHERE flow IN ('N', 'ENE', 'SW', 'W') GROUP BY flow""")
def direction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features split by direction into folders, of which four are read."""
    path = new_folder(spark, "directions")
    geojson.write_by_direction(supplier_features(spark, sf_dir), path)
    starts = geojson.lane_starts(geojson.read_by_direction(spark, path, "N", "ENE", "SW", "W").withColumn("feature_id", F.monotonically_increasing_id()))
    return starts.groupBy("flow").agg(F.count("*").alias("lanes"), F.round(F.sum("start_lat"), 6).alias("lat"), F.round(F.sum("start_lon"), 6).alias("lon"))


@query(f"""WITH {_shape_sql()}, f AS (SELECT DISTINCT fid, k FROM points) SELECT CASE k WHEN 1 THEN 'area_to_avoid' WHEN 3 THEN 'separation_boundary' WHEN 4 THEN 'separation_zone' ELSE 'separation_lane' END AS kind, count(*) AS features FROM f GROUP BY 1""")
def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "features")
    write_collection(supplier_features(spark, sf_dir), path)
    return geojson.type_counts(geojson.read_features(spark, path))


@query(f"""WITH {_shape_sql()}, line AS (SELECT fid, k, part, count(*) AS points, sum(lat) AS lat FROM points GROUP BY ALL)
  SELECT CASE k WHEN 3 THEN 'MultiLineString' WHEN 4 THEN 'Polygon' ELSE 'LineString' END AS shape, CAST(part AS INTEGER) AS part, count(*) AS lines, CAST(sum(points) AS BIGINT) AS points, round(sum(lat), 6) AS lat FROM line GROUP BY ALL""")
def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all geometries in feature collections that were written as text."""
    path = new_folder(spark, "features")
    write_collection(supplier_features(spark, sf_dir), path)
    rows = geojson.lines(geojson.read_features(spark, path))
    lat = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"])
    return rows.groupBy(F.col("geometry.type").alias("shape"), "part").agg(F.count("*").alias("lines"), F.sum(F.size("points")).alias("points"), F.round(F.sum(lat), 6).alias("lat"))


# ---- settings ----------------------------------------------------------------

_SEGMENTS = ", ".join(f"('{n}', {i}, {lat}::DOUBLE, {lon}::DOUBLE)" for n, points in settings.SEGMENTS.items() for i, (lat, lon) in enumerate(points))


@query(f"""WITH p AS (SELECT * FROM (VALUES {_SEGMENTS}) AS v(route_id, seq, lat, lon)), l AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seq))
  SELECT route_id, round(sum({_nm('lat', 'lon', 'lat2', 'lon2')}), 4) AS nm, count(*) AS legs FROM l WHERE lat2 IS NOT NULL GROUP BY route_id""")
def segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.totals(settings.segments(spark)).select("route_id", F.round("nm", 4).alias("nm"), "legs")


_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(settings.SEGMENT_AREA, [*settings.SEGMENT_AREA[1:], settings.SEGMENT_AREA[0]], strict=True))


@query(f"""WITH e AS (SELECT * FROM (VALUES {_EDGES}) AS v(x0, y0, x1, y1)), p AS (SELECT c_custkey, 48.0::DOUBLE + c_custkey % 41 * 0.11::DOUBLE AS lat, -6.0::DOUBLE + c_custkey % 97 * 0.1::DOUBLE AS lon FROM customer)
  SELECT c_custkey FROM (SELECT c_custkey, count(*) AS n FROM p, e WHERE (y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 GROUP BY c_custkey) WHERE n % 2 = 1""")
def points_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (F.lit(48.0) + k % 41 * 0.11).alias("lat"), (F.lit(-6.0) + k % 97 * 0.1).alias("lon"))
    return settings.in_area(spark, p).select("c_custkey")


# ---- rasters and stored results ---------------------------------------------

def _triangle_sql(name: str, table_: str, a: str, b: str, source: int, target: int) -> str:
    """One axis of a triangle filter: ``a`` goes from ``source`` to ``target`` pixels."""
    scale = source / target
    reach = max(scale, 1.0)
    weight = f"greatest(0.0, 1 - abs({a}s + 0.5 - (i + 0.5) * {scale!r}) / {reach!r})"
    return f"""{name}_w AS (SELECT i, {b}, gray, {weight} AS w FROM (SELECT {a} AS {a}s, {b}, gray FROM {table_}), range({target}) t(i) WHERE abs({a}s + 0.5 - (i + 0.5) * {scale!r}) < {reach!r}),
  {name} AS (SELECT CAST(i AS INTEGER) AS {a}, {b}, CAST(floor(sum(w * gray) / sum(w) + 0.5) AS INTEGER) AS gray FROM {name}_w GROUP BY ALL)"""


@query(f"""WITH g AS (SELECT {_x('event_id')} AS x, {_y('event_id')} AS y, min(event_id % 64) AS gray FROM events GROUP BY ALL), {_triangle_sql('h', 'g', 'x', 'y', 200, 64)}, {_triangle_sql('v', 'h', 'y', 'x', 100, 160)}
  SELECT x, y, gray, gray < 20 AS water FROM v""")
def bilinear_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grays brought to fewer columns and more rows by a triangle filter."""
    k = F.col("event_id")
    g = table(spark, sf_dir, "events").groupBy(x_of(k).alias("x"), y_of(k).alias("y")).agg(F.min(k % 64).alias("gray"))
    r = raster.resample_bilinear(g, GRID, GridSpec(-60.0, 60.0, -180.0, 180.0, 64, 160))
    return r.select("x", "y", "gray", (F.col("gray") < 20).alias("water"))


_MOSAIC = GridSpec(-60.0, 60.0, -180.0, 180.0, 200, 100)


@query(f"""WITH g AS (SELECT {_x('event_id')} AS x, {_y('event_id')} AS y, max(event_id % 250) AS gray FROM events GROUP BY ALL),
  r AS (SELECT CAST(floor((x - 50 + 0.5) * 30 / 100.0) AS INTEGER) AS x, CAST(floor((y - 25 + 0.5) * 20 / 50.0) AS INTEGER) AS y, sum(gray) / ((100 / 30.0) * (50 / 20.0)) AS gray FROM g WHERE gray >= 20 AND x BETWEEN 50 AND 149 AND y BETWEEN 25 AND 74 GROUP BY ALL)
  SELECT x, y FROM r WHERE gray >= 20""")
def stored_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land of a window out of light cells stored by bands of rows."""
    k = F.col("event_id")
    cells = table(spark, sf_dir, "events").groupBy(x_of(k).alias("x"), y_of(k).alias("y")).agg(F.max(k % 250).alias("gray")).where("gray >= 20")
    path = new_folder(spark, "raster")
    cells.withColumn("band", F.floor(F.col("y") / 1024).cast("int")).write.partitionBy("band").parquet(path)
    return rasters.window_land(spark, path, GridSpec(-30.0, 30.0, -90.0, 90.0, 30, 20), _MOSAIC)


@query(f"WITH {_LAND} SELECT x, y, CAST(2 AS BIGINT) AS reads FROM land")
def stored_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask out of a result cache: made by the first call, read by the second."""
    cache = files.ResultCache(spark, new_folder(spark, "cache"))
    key = cache.key("land", sf_dir, 0.0)
    both = [cache.get(key, lambda: cells_of(spark, sf_dir, "error")) for _ in range(2)]
    return both[0].unionByName(both[1]).groupBy("x", "y").agg(F.count("*").alias("reads"))


@query("SELECT r_regionkey, substr(md5(md5(r_name)), 1, 16) AS key FROM region ORDER BY r_regionkey")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("path"), F.col("r_name").cast("binary").alias("content"))
    return files.content_keys(rows).select(F.col("path").alias("r_regionkey"), "key")
