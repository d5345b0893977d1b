"""Queries over masks made of features, and over small scalar rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions import geo, tags
from pelorus.grid import GridSpec, crop_window, pixel_scales
from pelorus.operators import raster, spatial
from pelorus.plans import layers, masks
from pelorus.plans.queries import _LAND, _LANES, _LEGS, _TRACK, GRID, _lat, _lon, _x, _y, cells_of, lat_of, lon_of, query, table, track, track_lines, x_of, y_of

# ---- set operations on masks ------------------------------------------------


@query(f"WITH {_LAND}, {_LANES} SELECT x, y FROM land UNION SELECT x, y FROM lanes")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.union(cells_of(spark, sf_dir, "error"), cells_of(spark, sf_dir, "purchase"))


@query(f"WITH {_LAND} SELECT CAST((x + 100) % 200 AS INTEGER) AS x, y FROM land")
def swapped_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cut into two halves, put together the other way round."""
    land = cells_of(spark, sf_dir, "error")
    return raster.stitch([(raster.crop(land, 0, 0, 100, 100), 100, 0), (raster.crop(land, 100, 0, 100, 100), 0, 0)])


@query(f"""WITH {_LAND}, {_LANES}, dry AS (SELECT * FROM land ANTI JOIN lanes USING (x, y))
  SELECT DISTINCT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM dry, range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE dx * dx + dy * dy <= 9 AND x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 99""")
def buffered_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land without lanes, widened by 324 nautical miles: three pixels here."""
    return masks.buffered_land(cells_of(spark, sf_dir, "error"), GRID, 324.0, cells_of(spark, sf_dir, "purchase"))


@query(f"""WITH {_LEGS}, p AS (SELECT x, y FROM track UNION SELECT CAST(x + CASE WHEN n = 0 THEN 0 ELSE round_even((x2 - x) * i / CAST(n AS DOUBLE), 0) END AS INTEGER), CAST(y + CASE WHEN n = 0 THEN 0 ELSE round_even((y2 - y) * i / CAST(n AS DOUBLE), 0) END AS INTEGER)
    FROM (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(x2 - x), abs(y2 - y)) AS n FROM legs)))
  SELECT DISTINCT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM p, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 99""")
def brushed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.brushed_lines(track_lines(spark, sf_dir), GRID, 1)


# ---- features out of suppliers ----------------------------------------------

# a supplier's figure begins at (lon, lat) and has these corners, in degrees east and north; the last closes areas
_SHAPE = ((0.0, 0.0), (21.0, 3.0), (27.0, -15.0), (6.0, -18.0), (0.0, 0.0))
_KINDS = (tags.LANE, "area_to_avoid", tags.LANE, "separation_boundary", "separation_zone")


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features: lanes of three points, boundaries as two lines, areas as closed lines or polygons."""
    k = F.col("s_suppkey")
    lon, lat = (k * 53 % 330).cast("double") - 179.0, (k * 31 % 110).cast("double") - 40.0
    at = [F.array(lon + dx, lat + dy) for dx, dy in _SHAPE]
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 5 + 1).cast("int"))
    line, ring, pair = F.array(*at[:3]), F.array(F.array(*at)), F.array(F.array(*at[:2]), F.array(*at[2:4]))
    shape = F.when(k % 5 == 3, F.lit("MultiLineString")).when(k % 5 == 4, F.lit("Polygon")).otherwise(F.lit("LineString"))
    text = F.when(k % 5 == 3, F.to_json(pair)).when(k % 5 == 4, F.to_json(ring)).when(k % 5 == 1, F.to_json(F.array(*at))).otherwise(F.to_json(line))
    flow = F.when(k % 4 != 0, geo.compass((k * 41 % 360).cast("double")))
    parsed = F.to_json(F.create_map(F.lit(tags.KEY), kind))
    properties = F.map_filter(F.create_map(F.lit("parsed_other_tags"), parsed, F.lit("tss_flow_cardinal"), flow), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "supplier").select(k.alias("feature_id"), F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(shape.alias("type"), text.alias("coordinates")).alias("geometry"))


def _shape_sql() -> str:
    corners = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(_SHAPE))
    return f"""base AS (SELECT s_suppkey AS fid, s_suppkey % 5 AS k, CAST(s_suppkey * 53 % 330 AS DOUBLE) - 179.0 AS lon, CAST(s_suppkey * 31 % 110 AS DOUBLE) - 40.0 AS lat FROM supplier),
  corner AS (SELECT * FROM (VALUES {corners}) AS v(j, dx, dy)),
  points AS (SELECT fid, k, CASE WHEN k = 3 THEN j // 2 ELSE 0 END AS part, j, lon + dx AS lon, lat + dy AS lat FROM base, corner WHERE CASE WHEN k IN (0, 2) THEN j < 3 WHEN k = 3 THEN j < 4 ELSE true END)"""


_PX = "CAST(trunc(((CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) - (-180.0)) / 360.0 * 200.0) AS INTEGER)"
_PY = "CAST(trunc((60.0 - lat) / 120.0 * 100.0) AS INTEGER)"


def _filled(ring: str, name: str) -> str:
    """Cells of the closed lines in ``ring`` (fid, j, x, y): outline and inside."""
    return f"""{name}_e AS (SELECT * FROM (SELECT fid, x AS x0, y AS y0, coalesce(lead(x) OVER w, first(x) OVER w) AS x1, coalesce(lead(y) OVER w, first(y) OVER w) AS y1, count(*) OVER (PARTITION BY fid) AS pts FROM {ring} WINDOW w AS (PARTITION BY fid ORDER BY j)) WHERE pts >= 3),
  {name}_b AS (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, least(abs(x1 - x0), abs(y1 - y0)) AS s FROM {name}_e)),
  {name}_o AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor((2 * s * i + n) / (2.0 * n)) END AS m FROM {name}_b),
  {name}_line AS (SELECT fid, CAST(x0 + sign(x1 - x0) * CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN m ELSE i END AS INTEGER) AS x, CAST(y0 + sign(y1 - y0) * CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN i ELSE m END AS INTEGER) AS y FROM {name}_o),
  {name}_k AS (SELECT fid, y, x0 + (y - y0) * (x1 - x0) / CAST(y1 - y0 AS DOUBLE) AS cx FROM (SELECT *, unnest(range(least(y0, y1), greatest(y0, y1))) AS y FROM {name}_e WHERE y0 <> y1)),
  {name}_j AS (SELECT *, row_number() OVER w AS r, lead(cx) OVER w AS tx FROM {name}_k WINDOW w AS (PARTITION BY fid, y ORDER BY cx)),
  {name}_i AS (SELECT fid, CAST(unnest(range(CAST(ceil(cx) AS BIGINT), CAST(floor(tx) AS BIGINT) + 1)) AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM {name}_j WHERE r % 2 = 1),
  {name} AS (SELECT fid, x, y FROM (SELECT * FROM {name}_i UNION SELECT * FROM {name}_line) WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 99)"""


def _written(segments: str, name: str) -> str:
    """Cells of ``segments`` (fid, part, seg, x, y, x2, y2) with the direction written last."""
    return f"""{name}_s AS (SELECT *, x2 - x AS dx, y2 - y AS dy, greatest(abs(x2 - x), abs(y2 - y)) AS n FROM {segments}),
  {name}_w AS (SELECT CAST(CASE WHEN n = 0 THEN x ELSE round_even(x + dx * i / CAST(n AS DOUBLE), 0) END AS INTEGER) AS x, CAST(CASE WHEN n = 0 THEN y ELSE round_even(y + dy * i / CAST(n AS DOUBLE), 0) END AS INTEGER) AS y,
    CASE WHEN n > 0 THEN dx / sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) END AS u, CASE WHEN n > 0 THEN dy / sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) END AS v, ((fid * 10 + part) * 100 + seg) * 10000 + i AS w FROM (SELECT *, unnest(range(n + 1)) AS i FROM {name}_s)),
  {name} AS (SELECT x, y, coalesce(arg_max(u, w) FILTER (u IS NOT NULL), 0.0) AS u, coalesce(arg_max(v, w) FILTER (u IS NOT NULL), 0.0) AS v FROM {name}_w WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 99 GROUP BY x, y)"""


def _widened(cells: str, name: str, radius: int) -> str:
    """Dilation of x, y, u, v: own direction first, then that of the first source, row by row."""
    return f"""{name}_t AS (SELECT s.x + dx AS x, s.y + dy AS y, u, v, (CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END * 1000 + s.y) * 1000 + s.x AS t FROM {cells} s, range(-{radius}, {radius + 1}) a(dx), range(-{radius}, {radius + 1}) b(dy) WHERE dx * dx + dy * dy <= {radius * radius}),
  {name} AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, coalesce(arg_min(u, t) FILTER (u <> 0 OR v <> 0), 0.0) AS u, coalesce(arg_min(v, t) FILTER (u <> 0 OR v <> 0), 0.0) AS v FROM {name}_t WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 99 GROUP BY x, y)"""


_PIXELS = f"""{_shape_sql()}, inside AS (SELECT fid, k, part, j, {_PX} AS x, {_PY} AS y FROM points WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -180 AND 180),
  steps AS (SELECT * FROM (SELECT fid, k, part, j, row_number() OVER w - 1 AS seg, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM inside WINDOW w AS (PARTITION BY fid, part ORDER BY j)) WHERE x2 IS NOT NULL)"""


@query(f"WITH {_shape_sql()} SELECT fid AS feature_id, CAST(part AS INTEGER) AS part, count(*) AS points, CAST(sum({_PX}) AS BIGINT) AS sum_x, CAST(sum({_PY}) AS BIGINT) AS sum_y FROM points WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -180 AND 180 GROUP BY ALL")
def window_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the features' lines that lie in the window, as pixels."""
    from pelorus.sources import geojson

    p = masks.pixel_lines(geojson.lines(supplier_features(spark, sf_dir)), GRID)
    total = lambda c: F.aggregate(F.col(f"points.{c}"), F.lit(0).cast("long"), lambda a, b: a + b)
    return p.select("feature_id", "part", F.size("points").cast("long").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(f"""WITH {_PIXELS}, {_written('(SELECT fid, part, seg, x, y, x2, y2 FROM steps WHERE k IN (0, 1, 2))', 'field')}, {_widened('field', 'wide', 1)} SELECT x, y, round(u, 9) AS u, round(v, 9) AS v FROM wide""")
def simple_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.simple(supplier_features(spark, sf_dir), GRID, dilation=1).select("x", "y", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


_COMBINED = f"""{_PIXELS}, {_written('(SELECT fid, part, seg, x, y, x2, y2 FROM steps WHERE k IN (0, 2))', 'field')}, {_widened('field', 'lanes', 1)},
  size AS (SELECT fid, part, count(*) >= 3 AND abs(arg_min(x, j) - arg_max(x, j)) <= 2 AND abs(arg_min(y, j) - arg_max(y, j)) <= 2 AS closed FROM inside WHERE k IN (1, 3, 4) GROUP BY ALL),
  ring AS (SELECT fid, j, x, y FROM inside JOIN size USING (fid, part) WHERE closed), {_filled('ring', 'area')},
  {_written('(SELECT fid, part, seg, x, y, x2, y2 FROM steps JOIN size USING (fid, part) WHERE NOT closed)', 'open')},
  blocked AS (SELECT x, y FROM area UNION SELECT x, y FROM open),
  no_go AS (SELECT DISTINCT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM blocked, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4 AND x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 99)"""


@query(f"WITH {_COMBINED} SELECT 'lane' AS layer, x, y, round(u, 9) AS u, round(v, 9) AS v FROM lanes UNION ALL SELECT 'no_go', x, y, NULL, NULL FROM no_go")
def combined_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks.combined(supplier_features(spark, sf_dir), GRID, dilation=1, no_go_dilation=2)
    lanes = m.lanes.select(F.lit("lane").alias("layer"), "x", "y", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))
    none = F.lit(None).cast("double")
    return lanes.unionByName(m.no_go.select(F.lit("no_go").alias("layer"), "x", "y", none.alias("u"), none.alias("v")))


_BRUSH = """SELECT DISTINCT CAST(p.x + dx AS INTEGER) AS x, CAST(p.y + dy AS INTEGER) AS y FROM (SELECT x, y FROM {0} UNION SELECT CAST(x + CASE WHEN n = 0 THEN 0 ELSE round_even((x2 - x) * i / CAST(n AS DOUBLE), 0) END AS INTEGER), CAST(y + CASE WHEN n = 0 THEN 0 ELSE round_even((y2 - y) * i / CAST(n AS DOUBLE), 0) END AS INTEGER)
    FROM (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(x2 - x), abs(y2 - y)) AS n FROM {1}))) p, range(-1, 2) a(dx), range(-1, 2) b(dy)
  WHERE p.x BETWEEN 0 AND 199 AND p.y BETWEEN 0 AND 99 AND p.x + dx BETWEEN 0 AND 199 AND p.y + dy BETWEEN 0 AND 99"""


@query(f"""WITH {_LAND}, {_shape_sql()}, px AS (SELECT fid, k, part, j, {_PX} AS x, {_PY} AS y FROM points),
  st AS (SELECT * FROM (SELECT fid, k, part, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM px WINDOW w AS (PARTITION BY fid, part ORDER BY j)) WHERE x2 IS NOT NULL),
  ring AS (SELECT fid, j, x, y FROM px WHERE k IN (1, 4)), {_filled('ring', 'area')}, lane AS ({_BRUSH.format('(SELECT x, y FROM px WHERE k IN (0, 2))', '(SELECT x, y, x2, y2 FROM st WHERE k IN (0, 2))')})
  SELECT x, y FROM (SELECT x, y FROM land UNION SELECT x, y FROM area) ANTI JOIN lane USING (x, y)""")
def overlaid_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land with areas drawn over it, then lanes, which open it again."""
    return masks.overlay(cells_of(spark, sf_dir, "error"), supplier_features(spark, sf_dir), GRID, width=1)


@query(f"""WITH {_shape_sql()}, outer_ring AS (SELECT fid, j, {_PX} AS x, {_PY} AS y FROM points WHERE k = 4), inner_ring AS (SELECT fid, j, CAST(40 + (x + 40 * (j % 4 IN (1, 2))::INTEGER) // 4 AS INTEGER) AS x, CAST(20 + (y + 40 * (j % 4 IN (2, 3))::INTEGER) // 4 AS INTEGER) AS y FROM (SELECT fid, j, 100 AS x, 60 AS y FROM outer_ring)),
  {_filled('outer_ring', 'whole')}, {_filled('inner_ring', 'hole')} SELECT DISTINCT x, y FROM (SELECT fid, x, y FROM whole ANTI JOIN hole USING (fid, x, y))""")
def polygon_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons among the features, each with a square hole at one place."""
    from pelorus.sources import geojson

    outer = geojson.lines(supplier_features(spark, sf_dir).where(F.col("feature_id") % 5 == 4))
    pixels = F.transform("points", lambda p: F.struct(GRID.pixel_x(p["lon"]).alias("x"), GRID.pixel_y(p["lat"]).alias("y")))
    corner = lambda j: F.struct(F.lit(40 + (100 + 40 * (j % 4 in (1, 2))) // 4).alias("x"), F.lit(20 + (60 + 40 * (j % 4 in (2, 3))) // 4).alias("y"))
    outer = outer.select(F.col("feature_id").alias("polygon_id"), F.lit(0).alias("ring"), pixels.alias("points"))
    hole = outer.select("polygon_id", F.lit(1).alias("ring"), F.array(*map(corner, range(5))).alias("points"))
    return raster.fill_polygons(outer.unionByName(hole), GRID)


@query(f"""WITH {_shape_sql()} SELECT feature_id, layer, CAST(points AS INTEGER) AS points, from_lon, from_lat FROM (SELECT fid AS feature_id, part, CASE WHEN k IN (0, 2) THEN 'lane' WHEN k = 3 THEN 'boundary' ELSE 'other' END AS layer, count(*) AS points,
    list(lon ORDER BY j)[CASE WHEN count(*) // 2 + 1 < count(*) THEN count(*) // 2 ELSE count(*) // 2 - 1 END + 1] AS from_lon, list(lat ORDER BY j)[CASE WHEN count(*) // 2 + 1 < count(*) THEN count(*) // 2 ELSE count(*) // 2 - 1 END + 1] AS from_lat FROM points GROUP BY fid, part, k)""")
def chart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = layers.lane_layer(supplier_features(spark, sf_dir))
    return layer.select("feature_id", "layer", F.size("points").alias("points"), F.col("arrow.from.lon").alias("from_lon"), F.col("arrow.from.lat").alias("from_lat"))


# ---- scalar rules -----------------------------------------------------------

_WINDOWS = "w AS (SELECT n_nationkey AS k, -50.0 + n_nationkey AS s, -30.0 + n_nationkey * 2 AS n, -150.0 + n_nationkey * 5 AS w, -120.0 + n_nationkey * 7 AS e, 1000 + n_nationkey * 37 AS width, 800 + n_nationkey * 11 AS height FROM nation)"


def nation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k, (F.lit(-50.0) + k).alias("s"), (F.lit(-30.0) + k * 2).alias("n"), (F.lit(-150.0) + k * 5).alias("w"), (F.lit(-120.0) + k * 7).alias("e"), (k * 37 + 1000).alias("width"), (k * 11 + 800).alias("height"))


@query(f"""WITH {_WINDOWS} SELECT k AS n_nationkey, CAST(round_even(12.0 * (width / (e - w)) / 60.0, 0) AS INTEGER) AS buffer, CAST(trunc(5.0 * 1852 / ((40075000 / 360.0) * (abs((n + 10.0) - (s - 10.0)) / height))) AS INTEGER) AS step,
  round(1.0 * (width / (e - w)) / (21600 / 360.0), 9) AS radius FROM w""")
def pixel_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of 12 miles, a search step and a radius in the pixels of each window."""
    scales = pixel_scales(*map(F.col, ("s", "n", "w", "e", "width", "height")), buffer_nm=12.0)
    return nation_windows(spark, sf_dir).withColumn("p", scales).select("n_nationkey", "p.buffer", "p.step", F.round("p.radius", 9).alias("radius"))


@query(f"""WITH {_WINDOWS}, c AS (SELECT k, greatest(0, least(8640, CAST(trunc((w + 180.0) / 360.0 * 8640) AS INTEGER))) AS x_min, greatest(0, least(8640, CAST(trunc((e + 180.0) / 360.0 * 8640) AS INTEGER))) AS x_max,
    greatest(0, least(4320, CAST(trunc((90.0 - n) / 180.0 * 4320) AS INTEGER))) AS y_min, greatest(0, least(4320, CAST(trunc((90.0 - s) / 180.0 * 4320) AS INTEGER))) AS y_max FROM w) SELECT k AS n_nationkey, x_min, x_max, y_min, y_max FROM c WHERE x_min < x_max AND y_min < y_max""")
def mosaic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nation_windows(spark, sf_dir).withColumn("c", crop_window(F.col("s"), F.col("n"), F.col("w"), F.col("e"), GridSpec.globe(8640, 4320)))
    return c.where("c is not null").select("n_nationkey", "c.*")


_SCALARS = f"SELECT o_orderkey, {_x('o_orderkey')} AS x0, {_y('o_orderkey')} AS y0, {_x('o_custkey')} AS x1, {_y('o_custkey')} AS y1 FROM orders"


@query(f"""SELECT o_orderkey, CAST(CASE WHEN x1 - x0 > 100 THEN x1 - x0 - 200 WHEN x1 - x0 < -100 THEN x1 - x0 + 200 ELSE x1 - x0 END AS INTEGER) AS dx, CAST((x0 + x1 * 3) % 200 AS INTEGER) AS wrapped,
  round(CASE WHEN (x0 = x1 AND y0 = y1) OR (x0 = 100 AND y0 = 50) THEN 0 ELSE (1 - greatest(-1.0, least(1.0, ((x1 - x0) * (100 - x0) + (y1 - y0) * (50 - y0)) / (sqrt(CAST(pow(x1 - x0, 2) + pow(y1 - y0, 2) AS DOUBLE)) * sqrt(CAST(pow(100 - x0, 2) + pow(50 - y0, 2) AS DOUBLE)))))) * 0.001 END, 9) AS bias FROM ({_SCALARS})""")
def wrapped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps on a grid that goes round, and what they lose by pointing away from a goal."""
    o = order_cells(spark, sf_dir)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    d = [c.cast("double") for c in (x1 - x0, y1 - y0, 100 - x0, 50 - y0)]
    return o.select("o_orderkey", geo.delta_x(x0, x1, 200, True).alias("dx"), geo.wrap_x(x0 + x1 * 3, 200, True).alias("wrapped"), F.round(geo.bearing_bias(*d), 9).alias("bias"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", x_of(k).alias("x0"), y_of(k).alias("y0"), x_of(c).alias("x1"), y_of(c).alias("y1"))


def _pixel_bearing_sql() -> str:
    a, b, c, d = "(60.0 - y0 / 100.0 * 120.0)", "(-180.0 + x0 / 200.0 * 360.0)", "(60.0 - y1 / 100.0 * 120.0)", "(-180.0 + x1 / 200.0 * 360.0)"
    from pelorus.plans.queries import _bearing

    return f"SELECT o_orderkey, round(CASE WHEN x1 < 200 AND (x0 <> x1 OR y0 <> y1) THEN {_bearing(a, b, c, d)} END, 6) AS bearing FROM (SELECT o_orderkey, x0, y0, x1 + o_orderkey % 2 * 100 AS x1, y1 FROM ({_SCALARS}))"


@query(_pixel_bearing_sql())
def pixel_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings between cells; some ends lie off the grid."""
    o = order_cells(spark, sf_dir)
    x1 = F.col("x1") + F.col("o_orderkey") % 2 * 100
    return o.select("o_orderkey", F.round(GRID.pixel_bearing(F.col("x0"), F.col("y0"), x1, F.col("y1")), 6).alias("bearing"))


@query(f"""SELECT c_custkey AS point_id, CASE WHEN lat IS NULL OR lat NOT BETWEEN -90 AND 90 THEN 'latitude' WHEN lon IS NULL OR lon NOT BETWEEN -180 AND 180 THEN 'longitude' ELSE 'heading' END AS reason FROM
  (SELECT c_custkey, {_lat('c_custkey')} * 1.7 AS lat, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {_lon('c_custkey')} * 1.1 END AS lon, CAST(c_custkey * 37 % 400 AS DOUBLE) AS heading FROM customer)
  WHERE lat NOT BETWEEN -90 AND 90 OR lon IS NULL OR lon NOT BETWEEN -180 AND 180 OR heading NOT BETWEEN 0 AND 360""")
def invalid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("point_id"), (lat_of(k) * 1.7).alias("lat"), F.when(k % 7 != 0, lon_of(k) * 1.1).alias("lon"), (k * 37 % 400).cast("double").alias("heading"))
    return spatial.invalid_points(p)


def _tile_name(k: Column) -> Column:
    return F.concat(F.chr((k % 6 + 65).cast("long")), (k % 3).cast("string"), F.when(k % 2 == 0, F.lit(".png")).otherwise(F.lit("")))


@query("""SELECT name, CAST(c * 100 AS INTEGER) AS x0, CAST(c * 100 + 100 AS INTEGER) AS x1, CAST(r * 100 AS INTEGER) AS y0, CAST(r * 100 + 100 AS INTEGER) AS y1 FROM
  (SELECT DISTINCT chr(CAST(n_nationkey % 6 + 65 AS INTEGER)) || CAST(n_nationkey % 3 AS VARCHAR) || CASE WHEN n_nationkey % 2 = 0 THEN '.png' ELSE '' END AS name, n_nationkey % 6 AS c, n_nationkey % 3 - 1 AS r FROM nation) WHERE c < 4 AND r >= 0""")
def tile_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel extents of tiles by name; names that name no tile are left out."""
    from pelorus.sources import files

    names = table(spark, sf_dir, "nation").select(_tile_name(F.col("n_nationkey")).alias("name")).distinct()
    return files.tile_extents(names, 100)
