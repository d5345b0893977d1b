"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

The tables hold no geography, so places are derived from keys by arithmetic,
the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions import geo, tags
from pelorus.grid import GridSpec, target_size_columns
from pelorus.operators import paths, raster, search, spatial
from pelorus.sources import files

GRID = GridSpec(-60.0, 60.0, -180.0, 180.0, 200, 100)
WORLD = GridSpec(-60.0, 60.0, -180.0, 180.0, 3600, 1200)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- derived places --------------------------------------------------------


def lat_of(k: Column, m: int = 7919) -> Column:
    return (k.cast("long") * m % 12000) / F.lit(100.0) - F.lit(60.0)


def lon_of(k: Column, m: int = 104729) -> Column:
    return (k.cast("long") * m % 36000) / F.lit(100.0) - F.lit(180.0)


def x_of(k: Column) -> Column:
    return (k.cast("long") * 7919 % 200).cast("int")


def y_of(k: Column) -> Column:
    return (F.floor(k / 200) * 37 % 100).cast("int")


def _lat(k: str, m: int = 7919) -> str:
    return f"((CAST({k} AS BIGINT) * {m} % 12000) / CAST(100 AS DOUBLE) - CAST(60 AS DOUBLE))"


def _lon(k: str, m: int = 104729) -> str:
    return f"((CAST({k} AS BIGINT) * {m} % 36000) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE))"


def _x(k: str) -> str:
    return f"CAST(CAST({k} AS BIGINT) * 7919 % 200 AS INTEGER)"


def _y(k: str) -> str:
    return f"CAST(CAST(floor({k} / 200) AS BIGINT) * 37 % 100 AS INTEGER)"


def _nm(a: str, b: str, c: str, d: str) -> str:
    return f"acos(greatest(-1.0, least(1.0, sin(radians({a})) * sin(radians({c})) + cos(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))) * 3440.065"


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"2 * atan2(sqrt(greatest(0.0, least(1.0, {h}))), sqrt(1 - greatest(0.0, least(1.0, {h})))) * 3440.065"


def _bearing(a: str, b: str, c: str, d: str) -> str:
    p, q, r = f"radians({a})", f"radians({c})", f"radians({d} - {b})"
    return f"((degrees(atan2(sin({r}) * cos({q}), cos({p}) * sin({q}) - sin({p}) * cos({q}) * cos({r}))) + 360.0) % 360.0)"


_COMPASS = "[" + ", ".join(f"'{c}'" for c in geo.COMPASS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events in order as a path: route_id, seq, x, y, lat, lon."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("route_id"), (F.row_number().over(w) - 1).alias("seq"), "event_id", x_of(k).alias("x"), y_of(k).alias("y"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


_TRACK = f"""track AS (SELECT user_id AS route_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq, event_id,
  {_x('event_id')} AS x, {_y('event_id')} AS y, {_lat('event_id')} AS lat, {_lon('event_id')} AS lon FROM events)"""


def cells_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(x_of(F.col("event_id")).alias("x"), y_of(F.col("event_id")).alias("y")).distinct()


def _cells(name: str, kind: str) -> str:
    return f"{name} AS (SELECT DISTINCT {_x('event_id')} AS x, {_y('event_id')} AS y FROM events WHERE event_type = '{kind}')"


_LAND, _LANES = _cells("land", "error"), _cells("lanes", "purchase")

# ---- legs, distances, bearings ---------------------------------------------

_LEGS = f"""{_TRACK}, legs AS (SELECT * FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM track WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE lat2 IS NOT NULL)"""


@query(f"WITH {_LEGS} SELECT route_id, seq, round({_nm('lat', 'lon', 'lat2', 'lon2')}, 6) AS nm FROM legs")
def leg_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.legs(track(spark, sf_dir)).select("route_id", "seq", F.round("nm", 6).alias("nm"))


@query(f"WITH {_LEGS} SELECT route_id, round(sum({_nm('lat', 'lon', 'lat2', 'lon2')}), 4) AS nm, count(*) AS legs FROM legs GROUP BY route_id")
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.totals(track(spark, sf_dir)).select("route_id", F.round("nm", 4).alias("nm"), "legs")


@query(f"""SELECT c_custkey, round({_nm('a', 'b', 'c', 'd')}, 6) AS cosines, round({_hav('a', 'b', 'c', 'd')}, 6) AS haversine,
  round(sqrt(pow(c - a, 2) + pow((d - b) * cos(radians((a + c) / 2)), 2)), 6) AS flat
  FROM (SELECT c_custkey, {_lat('c_custkey')} AS a, {_lon('c_custkey')} AS b, {_lat('c_nationkey', 15485863)} AS c, {_lon('c_nationkey', 32452843)} AS d FROM customer)""")
def distance_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", lat_of(k).alias("a"), lon_of(k).alias("b"), lat_of(n, 15485863).alias("c"), lon_of(n, 32452843).alias("d"))
    at = [F.col(c) for c in "abcd"]
    return p.select("c_custkey", F.round(geo.nm_distance(*at), 6).alias("cosines"), F.round(geo.haversine_nm(*at), 6).alias("haversine"), F.round(geo.flat_degrees(*at), 6).alias("flat"))


_ORDER_POINTS = f"(SELECT o_orderkey, o_custkey, {_lat('o_orderkey')} AS a, {_lon('o_orderkey')} AS b, {_lat('o_custkey')} AS c, {_lon('o_custkey')} AS d FROM orders)"


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", lat_of(k).alias("a"), lon_of(k).alias("b"), lat_of(c).alias("c"), lon_of(c).alias("d"))


@query(f"""SELECT o_orderkey, round(t, 6) AS bearing, {_COMPASS}[CAST(floor((t + 11.25) / 22.5) AS INTEGER) % 16 + 1] AS sector
  FROM (SELECT o_orderkey, {_bearing('a', 'b', 'c', 'd')} AS t FROM {_ORDER_POINTS})""")
def bearing_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_points(spark, sf_dir).withColumn("t", geo.bearing(*[F.col(c) for c in "abcd"]))
    return t.select("o_orderkey", F.round("t", 6).alias("bearing"), geo.compass(F.col("t")).alias("sector"))


@query(f"""SELECT o_custkey, round(((degrees(atan2(sum(sin(radians(t))), sum(cos(radians(t))))) + 360.0) % 360.0), 4) AS mean, count(*) AS orders
  FROM (SELECT o_custkey, {_bearing('a', 'b', 'c', 'd')} AS t FROM {_ORDER_POINTS}) GROUP BY o_custkey""")
def mean_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_points(spark, sf_dir).withColumn("t", geo.bearing(*[F.col(c) for c in "abcd"]))
    return t.groupBy("o_custkey").agg(F.round(geo.mean_bearing_agg(F.col("t")), 4).alias("mean"), F.count("*").alias("orders"))


@query(f"""SELECT c_custkey, x, y, round(60.0 - y / 1200.0 * 120.0, 9) AS lat, round(-180.0 + x / 3600.0 * 360.0, 9) AS lon FROM
  (SELECT c_custkey, CAST(trunc((b - (-180.0)) / 360.0 * 3600.0) AS INTEGER) AS x, CAST(trunc((60.0 - a) / 120.0 * 1200.0) AS INTEGER) AS y
   FROM (SELECT c_custkey, {_lat('c_custkey')} AS a, {_lon('c_custkey')} AS b FROM customer) WHERE a BETWEEN -60 AND 60 AND b BETWEEN -180 AND 180)""")
def pixel_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", WORLD.to_pixel(lat_of(k), lon_of(k)).alias("p")).where("p is not null")
    return p.select("c_custkey", "p.x", "p.y", F.round(WORLD.lat_at(F.col("p.y")), 9).alias("lat"), F.round(WORLD.lon_at(F.col("p.x")), 9).alias("lon"))


@query(f"""WITH {_TRACK}, b AS (SELECT route_id, greatest(-90.0, min(lat) - 10) AS s, least(90.0, max(lat) + 10) AS n, greatest(-180.0, min(lon) - 10) AS w, least(180.0, max(lon) + 10) AS e FROM track GROUP BY route_id),
  h AS (SELECT *, least(50000, greatest(100, CAST(round_even((n - s) * 60 * 2.0, 0) AS INTEGER))) AS height FROM b)
  SELECT route_id, round(s, 6) AS lat_min, round(n, 6) AS lat_max, round(w, 6) AS lon_min, round(e, 6) AS lon_max,
    least(50000, greatest(100, CAST(round_even((e - w) * height / (n - s), 0) AS INTEGER))) AS width, height FROM h""")
def route_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = paths.bounds(track(spark, sf_dir))
    size = target_size_columns(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"), 2.0)
    return b.withColumn("s", size).select("route_id", *[F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")], "s.width", "s.height")


# ---- lookups ---------------------------------------------------------------


def lane_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    flow = geo.compass((k * 41 % 360).cast("double"))
    return table(spark, sf_dir, "supplier").select(k.alias("lane_id"), flow.alias("flow"), lat_of(k, 15485863).alias("start_lat"), lon_of(k, 32452843).alias("start_lon"), (k * 41 % 360).cast("double").alias("lane_bearing"))


_STARTS = f"""starts AS (SELECT s_suppkey AS lane_id, CAST(s_suppkey * 41 % 360 AS DOUBLE) AS lane_bearing, {_COMPASS}[CAST(floor((s_suppkey * 41 % 360 + 11.25) / 22.5) AS INTEGER) % 16 + 1] AS flow,
  {_lat('s_suppkey', 15485863)} AS start_lat, {_lon('s_suppkey', 32452843)} AS start_lon FROM supplier)"""


@query(f"""WITH {_STARTS}, p AS (SELECT c_custkey, CAST(c_custkey * 37 % 361 AS DOUBLE) AS heading, {_lat('c_custkey')} AS lat, {_lon('c_custkey')} AS lon FROM customer),
  f AS (SELECT *, CAST(floor((heading + 11.25) / 22.5) AS INTEGER) % 16 AS i FROM p),
  m AS (SELECT c_custkey, lane_id, {_nm('lat', 'lon', 'start_lat', 'start_lon')} AS nm,
          CASE flow WHEN {_COMPASS}[i + 1] THEN 0 WHEN {_COMPASS}[(i + 15) % 16 + 1] THEN 1 WHEN {_COMPASS}[(i + 1) % 16 + 1] THEN 2 END AS r
        FROM f CROSS JOIN starts)
  SELECT c_custkey, lane_id, round(nm, 6) AS nm FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY nm, r, lane_id) AS n FROM m WHERE r IS NOT NULL AND nm <= 2000000 / 1852.0) WHERE n = 1""")
def nearest_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("point_id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), (k * 37 % 361).cast("double").alias("heading"))
    found = spatial.nearest_lane_start(p, lane_starts(spark, sf_dir), 2_000_000.0)
    return found.select(F.col("point_id").alias("c_custkey"), "lane_id", F.round("distance_nm", 6).alias("nm"))


@query(f"""WITH {_STARTS}, p AS (SELECT c_custkey, CAST(c_custkey * 37 % 361 AS DOUBLE) AS heading, {_lat('c_custkey')} AS lat, {_lon('c_custkey')} AS lon FROM customer),
  m AS (SELECT c_custkey, lane_id, {_nm('lat', 'lon', 'start_lat', 'start_lon')} * 1.852 AS km, abs(heading - lane_bearing) % 360 AS t FROM p CROSS JOIN starts
        WHERE sqrt(pow(lat - start_lat, 2) + pow(lon - start_lon, 2)) <= 500 / 111.0)
  SELECT c_custkey, lane_id, round(km, 6) AS km FROM m WHERE least(t, 360 - t) <= 60 AND km <= 500""")
def entries_in_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", lat_of(k).alias("lat"), lon_of(k).alias("lon"), (k * 37 % 361).cast("double").alias("heading"))
    entries = lane_starts(spark, sf_dir).select("lane_id", F.col("start_lat").alias("entry_lat"), F.col("start_lon").alias("entry_lon"), "lane_bearing")
    met = spatial.entries_in_reach(p, entries, 500.0, F.col("heading"), F.col("lane_bearing"), 60.0)
    return met.select("c_custkey", "lane_id", F.round("km", 6).alias("km"))


@query(f"""SELECT p_partkey, r AS rank, {_COMPASS}[(i + d) % 16 + 1] AS name FROM (SELECT p_partkey, CAST(floor((p_size * 7 % 361 + 11.25) / 22.5) AS INTEGER) % 16 AS i FROM part)
  CROSS JOIN (VALUES (0, 0), (1, 15), (2, 1)) AS v(r, d)""")
def heading_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.col("p_size") * 7 % 361).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(geo.sectors_around(h)).alias("s")).select("p_partkey", "s.rank", "s.name")


@query("""WITH n AS (SELECT n_nationkey, n_nationkey * 3200 AS x_min, n_nationkey * 3200 + 9000 AS x_max, n_nationkey * 1500 AS y_min, n_nationkey * 1500 + 7000 AS y_max FROM nation),
  t AS (SELECT chr(65 + CAST(c AS INTEGER)) || CAST(r + 1 AS VARCHAR) AS name, c * 21600 AS x0, (c + 1) * 21600 AS x1, r * 21600 AS y0, (r + 1) * 21600 AS y1 FROM range(4) a(c), range(2) b(r))
  SELECT n_nationkey, name, CAST(greatest(x0, x_min) AS BIGINT) AS from_x, CAST(least(x1, x_max) AS BIGINT) AS to_x, CAST(greatest(y0, y_min) AS BIGINT) AS from_y, CAST(least(y1, y_max) AS BIGINT) AS to_y
  FROM n, t WHERE greatest(x0, x_min) < least(x1, x_max) AND greatest(y0, y_min) < least(y1, y_max)""")
def tile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    n = table(spark, sf_dir, "nation").select("n_nationkey", (k * 3200).alias("x_min"), (k * 3200 + 9000).alias("x_max"), (k * 1500).alias("y_min"), (k * 1500 + 7000).alias("y_max"))
    # eight tiles: each window looks up the tiles of its corner columns and rows by key
    side = files.TILE_SIDE
    n = n.withColumn("c", F.explode(F.sequence(F.floor(F.col("x_min") / side), F.floor((F.col("x_max") - 1) / side)))).withColumn("r", F.explode(F.sequence(F.floor(F.col("y_min") / side), F.floor((F.col("y_max") - 1) / side))))
    t = files.tiles(spark).withColumns({"c": F.floor(F.col("x0") / side), "r": F.floor(F.col("y0") / side)})
    out = n.join(F.broadcast(t), ["c", "r"])
    cut = {"from_x": F.greatest("x0", "x_min"), "to_x": F.least("x1", "x_max"), "from_y": F.greatest("y0", "y_min"), "to_y": F.least("y1", "y_max")}
    return out.select("n_nationkey", "name", *[c.cast("long").alias(a) for a, c in cut.items()])


@query("""SELECT for_mask, for_index, for_overlay, count(*) AS n FROM (SELECT
    coalesce(nullif(d, ''), CASE WHEN has THEN p END, t, 'unknown') AS for_mask,
    coalesce(CASE WHEN d IS NOT NULL THEN d WHEN parsed THEN CASE WHEN has THEN p END ELSE t END, '-') AS for_index,
    coalesce(CASE WHEN has THEN p END, nullif(d, ''), CASE WHEN contains(raw, 'seamark:type') THEN event_type END, '-') AS for_overlay
  FROM (SELECT event_type, '"seamark:type"=>"' || event_type || '"' AS raw, event_type AS t, CASE WHEN event_id % 3 = 0 THEN 'separation_lane' END AS d,
          event_id % 2 = 0 AS parsed, event_id % 4 = 0 AS has, 'area_to_avoid' AS p FROM events)) GROUP BY ALL""")
def tag_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    direct = F.when(k % 3 == 0, F.lit(tags.LANE))
    parsed = F.when(k % 4 == 0, F.create_map(F.lit(tags.KEY), F.lit("area_to_avoid"))).when(k % 2 == 0, F.create_map(F.lit("name"), F.lit("x")))
    raw = F.concat(F.lit('"seamark:type"=>"'), F.col("event_type"), F.lit('"'))
    e = table(spark, sf_dir, "events").select(
        tags.type_for_mask(direct, parsed, raw).alias("for_mask"), F.coalesce(tags.type_for_index(direct, parsed, raw), F.lit("-")).alias("for_index"), F.coalesce(tags.type_for_overlay(direct, parsed, raw), F.lit("-")).alias("for_overlay")
    )
    return e.groupBy("for_mask", "for_index", "for_overlay").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, substr(md5(c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR)), 1, 16) AS key FROM customer")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", geo.content_key(F.col("c_mktsegment"), F.col("c_nationkey")).alias("key"))


# ---- masks -----------------------------------------------------------------


@query(f"WITH {_LAND} SELECT x, y FROM land")
def land_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir, "error")


@query(f"""WITH {_LAND} SELECT DISTINCT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM land, range(-3, 4) a(dx), range(-3, 4) b(dy)
  WHERE dx * dx + dy * dy <= 9 AND x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 99""")
def buffer_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(cells_of(spark, sf_dir, "error"), 3, GRID)


@query(f"""WITH f AS (SELECT {_x('event_id')} AS x, {_y('event_id')} AS y, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 4 END AS flag FROM events WHERE event_type IN ('view', 'purchase', 'error')),
  g AS (SELECT x, y, CAST(bit_or(flag) AS TINYINT) AS flags FROM f GROUP BY x, y)
  SELECT x, y, flags, ((flags & 4) = 0 OR (flags & 2) <> 0) AND (flags & 3) <> 0 AS open FROM g""")
def mask_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = raster.flags(cells_of(spark, sf_dir, "view"), cells_of(spark, sf_dir, "purchase"), cells_of(spark, sf_dir, "error"))
    return f.withColumn("open", raster.navigable(F.col("flags")))


@query(f"WITH {_LAND} SELECT DISTINCT x // 7 AS x, y // 7 AS y FROM land WHERE x < 196 AND y < 98")
def max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.max_pool(cells_of(spark, sf_dir, "error"), 7, GRID)


def track_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir)
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return t.groupBy(F.col("route_id").alias("line_id")).agg(points.alias("points"))


_FIELD = f"""{_LEGS}, steps AS (SELECT route_id, seq, x, y, x2 - x AS dx, y2 - y AS dy, unnest(range(greatest(abs(x2 - x), abs(y2 - y), 0) + 1)) AS i, greatest(abs(x2 - x), abs(y2 - y)) AS n FROM legs),
  written AS (SELECT CAST(CASE WHEN n = 0 THEN x ELSE round_even(x + dx * i / CAST(n AS DOUBLE), 0) END AS INTEGER) AS x, CAST(CASE WHEN n = 0 THEN y ELSE round_even(y + dy * i / CAST(n AS DOUBLE), 0) END AS INTEGER) AS y,
    CASE WHEN n > 0 THEN dx / sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) END AS u, CASE WHEN n > 0 THEN dy / sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) END AS v, (route_id * 1000000 + seq) * 1000 + i AS w FROM steps),
  field AS (SELECT x, y, coalesce(arg_max(u, w) FILTER (u IS NOT NULL), 0.0) AS u, coalesce(arg_max(v, w) FILTER (u IS NOT NULL), 0.0) AS v FROM written WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 99 GROUP BY x, y)"""


@query(f"WITH {_FIELD} SELECT x, y, round(u, 9) AS u, round(v, 9) AS v FROM field")
def lane_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = raster.rasterize(track_lines(spark, sf_dir), GRID)
    return f.select("x", "y", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@query(f"""WITH {_FIELD}, m AS (SELECT x // 8 AS x, y // 8 AS y, sum(u) / 64 AS u, sum(v) / 64 AS v FROM field WHERE x < 200 AND y < 96 GROUP BY ALL)
  SELECT x, y, round(u / sqrt(u * u + v * v), 6) AS u, round(v / sqrt(u * u + v * v), 6) AS v FROM m WHERE sqrt(u * u + v * v) > 1e-6""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raster.mean_pool(raster.rasterize(track_lines(spark, sf_dir), GRID), 8, GRID)
    return m.where("u <> 0 or v <> 0").select("x", "y", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


_SHORT = f"SELECT {_x('event_id')} AS x, {_y('event_id')} AS y, max(event_id) AS k FROM events WHERE event_type = 'purchase' GROUP BY ALL"


@query(f"""WITH s AS (SELECT x AS sx, y AS sy, CASE WHEN k % 5 = 0 THEN 0.0 ELSE cos(radians(k % 360)) END AS u, CASE WHEN k % 5 = 0 THEN 0.0 ELSE sin(radians(k % 360)) END AS v FROM ({_SHORT})),
  t AS (SELECT sx + dx AS x, sy + dy AS y, u, v, sx, sy, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END AS away FROM s, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4)
  SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(coalesce(arg_min(u, (away * 1000 + sy) * 1000 + sx) FILTER (u <> 0 OR v <> 0), 0.0), 9) AS u, round(coalesce(arg_min(v, (away * 1000 + sy) * 1000 + sx) FILTER (u <> 0 OR v <> 0), 0.0), 9) AS v
  FROM t WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 99 GROUP BY x, y""")
def lane_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    s = e.groupBy(x_of(F.col("event_id")).alias("x"), y_of(F.col("event_id")).alias("y")).agg(F.max("event_id").alias("k"))
    turn = F.radians((F.col("k") % 360).cast("double"))
    none = F.col("k") % 5 == 0
    s = s.select("x", "y", F.when(none, 0.0).otherwise(F.cos(turn)).alias("u"), F.when(none, 0.0).otherwise(F.sin(turn)).alias("v"))
    return raster.dilate_lanes(s, 2, GRID).select("x", "y", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


def _line_sql(ties: str) -> str:
    m = "floor((2 * s * i + n) / (2.0 * n))" if ties == "up" else "(ceil((2 * s * i + n) / (2.0 * n)) - 1)"
    return f"""{_LEGS}, l AS (SELECT route_id, seq, x, y, x2 - x AS dx, y2 - y AS dy, greatest(abs(x2 - x), abs(y2 - y)) AS n, least(abs(x2 - x), abs(y2 - y)) AS s FROM legs),
  q AS (SELECT *, unnest(range(n + 1)) AS i FROM l), o AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE {m} END AS minor FROM q),
  cells AS (SELECT route_id, seq, CAST(x + sign(dx) * CASE WHEN abs(dy) > abs(dx) THEN minor ELSE i END AS INTEGER) AS x, CAST(y + sign(dy) * CASE WHEN abs(dy) > abs(dx) THEN i ELSE minor END AS INTEGER) AS y FROM o)"""


def leg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("route_id").orderBy("seq")
    t = track(spark, sf_dir).select("route_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    return t.withColumn("line_id", F.struct("route_id", "seq"))


@query(f"WITH {_line_sql('up')} SELECT x, y, count(DISTINCT route_id) AS routes, count(*) AS visits FROM cells GROUP BY x, y")
def raster_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.line_cells(leg_lines(spark, sf_dir).select("route_id", "x0", "y0", "x1", "y1"), "up")
    each = cells.groupBy("route_id", "x", "y").agg(F.count("*").alias("n"))
    return each.groupBy("x", "y").agg(F.count("*").alias("routes"), F.sum("n").alias("visits"))


def _clear_sql(ties: str) -> str:
    return f"WITH {_line_sql(ties)}, {_LAND} SELECT c.route_id, c.seq, bool_and(land.x IS NULL) AS clear FROM cells c LEFT JOIN land ON land.x = c.x AND land.y = c.y GROUP BY ALL"


@query(_clear_sql("up"))
def sight_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.blocked_lines(leg_lines(spark, sf_dir), cells_of(spark, sf_dir, "error"), GRID, "up").select("line_id.*", "clear")


@query(_clear_sql("down"))
def sight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.blocked_lines(leg_lines(spark, sf_dir), cells_of(spark, sf_dir, "error"), GRID, "down").select("line_id.*", "clear")


@query(f"""WITH {_LANES}, r AS (SELECT DISTINCT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM lanes, range(-2, 3) a(dx), range(-2, 3) b(dy))
  SELECT x, y FROM r WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 99""")
def square_brush(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cells_of(spark, sf_dir, "purchase").select(F.array(F.struct("x", "y")).alias("points"))
    return raster.brushed_lines(points, GRID, 2)


_RING = "x0 + (l_linenumber * l_linenumber * 13 + l_orderkey) % 24 AS x, y0 + (l_linenumber * 29 + l_orderkey * 3) % 24 AS y"


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey AS ring_id, l_linenumber AS i, {_RING} FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 31 % 170 AS x0, l_orderkey * 17 % 70 AS y0 FROM lineitem)),
  c AS (SELECT *, count(*) OVER (PARTITION BY ring_id) AS n, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first(x) OVER w AS fx, first(y) OVER w AS fy FROM p WINDOW w AS (PARTITION BY ring_id ORDER BY i)),
  e AS (SELECT ring_id, x AS x0, y AS y0, coalesce(nx, fx) AS x1, coalesce(ny, fy) AS y1 FROM c WHERE n >= 3),
  b AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, least(abs(x1 - x0), abs(y1 - y0)) AS s, unnest(range(greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) AS i FROM e),
  o AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor((2 * s * i + n) / (2.0 * n)) END AS m FROM b),
  line AS (SELECT ring_id, CAST(x0 + sign(x1 - x0) * CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN m ELSE i END AS BIGINT) AS x, CAST(y0 + sign(y1 - y0) * CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN i ELSE m END AS BIGINT) AS y FROM o),
  k AS (SELECT ring_id, y, x0 + (y - y0) * (x1 - x0) / CAST(y1 - y0 AS DOUBLE) AS cx FROM (SELECT *, unnest(range(least(y0, y1), greatest(y0, y1))) AS y FROM e WHERE y0 <> y1)),
  j AS (SELECT *, row_number() OVER w AS r, lead(cx) OVER w AS tx FROM k WINDOW w AS (PARTITION BY ring_id, y ORDER BY cx)),
  i AS (SELECT ring_id, unnest(range(CAST(ceil(cx) AS BIGINT), CAST(floor(tx) AS BIGINT) + 1)) AS x, y FROM j WHERE r % 2 = 1)
  SELECT ring_id, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM (SELECT ring_id, x, y FROM i UNION SELECT ring_id, x, y FROM line) GROUP BY ring_id""")
def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = F.col("l_orderkey"), F.col("l_linenumber")
    x = (o * 31 % 170 + (i * i * 13 + o) % 24).cast("int")
    y = (o * 17 % 70 + (i * 29 + o * 3) % 24).cast("int")
    p = table(spark, sf_dir, "lineitem").select(o.alias("ring_id"), F.struct(i.alias("i"), x.alias("x"), y.alias("y")).alias("p")).distinct()
    rings = p.groupBy("ring_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
    return raster.fill_rings(rings, GRID).groupBy("ring_id").agg(F.count("*").alias("cells"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query(f"WITH {_LAND} SELECT x, y FROM land WHERE NOT EXISTS (SELECT 1 FROM nation WHERE x >= n_nationkey * 8 AND x < n_nationkey * 8 + 5 AND y >= n_nationkey * 4 AND y < n_nationkey * 4 + 30)")
def critical_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("int")
    boxes = table(spark, sf_dir, "nation").select((k * 8).alias("x_min"), (k * 8 + 5).alias("x_max"), (k * 4).alias("y_min"), (k * 4 + 30).alias("y_max"))
    return raster.carve(cells_of(spark, sf_dir, "error"), boxes)


@query(f"WITH {_LAND} SELECT round((1 - count(*) / 20000.0) * 100, 6) AS water_percent FROM land")
def water_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.water_share(cells_of(spark, sf_dir, "error"), GRID).select(F.round("water_percent", 6).alias("water_percent"))


# ---- places ----------------------------------------------------------------

_POINTS = f"p AS (SELECT c_custkey AS point_id, {_x('c_custkey * 3')} AS x, {_y('c_custkey * 3')} AS y FROM customer)"


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") * 3
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), x_of(k).alias("x"), y_of(k).alias("y"))


@query(f"""WITH {_LAND}, {_POINTS}, dry AS (SELECT p.* FROM p JOIN land USING (x, y)),
  c AS (SELECT point_id, x + dx AS nx, y + dy AS ny, greatest(abs(dx), abs(dy)) AS r, CASE WHEN abs(dy) = greatest(abs(dx), abs(dy)) THEN 0 ELSE 1 END AS ph, dx, dy
    FROM dry, range(-200, 201) a(dx), range(-200, 201) b(dy) WHERE x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 99),
  o AS (SELECT *, CASE ph WHEN 0 THEN dx ELSE dy END AS major, CASE WHEN CASE ph WHEN 0 THEN dy ELSE dx END >= 0 THEN 0 ELSE 1 END AS sg FROM c),
  f AS (SELECT point_id, arg_min(struct_pack(nx := nx, ny := ny), ((r * 2 + ph) * 1000 + major + 400) * 2 + sg) AS n FROM o ANTI JOIN land ON land.x = o.nx AND land.y = o.ny GROUP BY point_id)
  SELECT p.point_id, CAST(coalesce(n.nx, p.x) AS INTEGER) AS x, CAST(coalesce(n.ny, p.y) AS INTEGER) AS y FROM p LEFT JOIN f USING (point_id)""")
def nudge_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.to_water(customer_cells(spark, sf_dir), cells_of(spark, sf_dir, "error"), GRID)


@query(f"""WITH {_LAND}, {_POINTS}, d AS (SELECT point_id, min(sqrt(CAST((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) AS DOUBLE))) AS d FROM p JOIN land l ON abs(p.x - l.x) <= 20 AND abs(p.y - l.y) <= 20 GROUP BY point_id)
  SELECT p.point_id, d IS NOT NULL AS close, CAST(floor(d) AS INTEGER) AS distance FROM p LEFT JOIN d USING (point_id)""")
def nearest_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_cell(customer_cells(spark, sf_dir), cells_of(spark, sf_dir, "error"))


_RING_VALUES = ", ".join(f"({dx}, {dy})" for dx, dy in geo.ring(3, 30))


@query(f"""WITH {_LAND}, {_POINTS}, o AS (SELECT * FROM (VALUES {_RING_VALUES}) AS v(dx, dy)), n AS (SELECT point_id, x + dx AS nx, y + dy AS ny FROM p, o WHERE x + dx BETWEEN 0 AND 199 AND y + dy BETWEEN 0 AND 99)
  SELECT point_id, count(*) AS neighbours FROM n ANTI JOIN land ON land.x = nx AND land.y = ny GROUP BY point_id""")
def ring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in geo.ring(3, 30)])
    n = customer_cells(spark, sf_dir).withColumn("o", F.explode(offsets)).select("point_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    free = raster.minus(n.where(GRID.holds(F.col("x"), F.col("y"))), cells_of(spark, sf_dir, "error"))
    return free.groupBy("point_id").agg(F.count("*").alias("neighbours"))


_LISTS = f"{_TRACK}, lines AS (SELECT route_id, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys, count(*) AS n FROM track GROUP BY route_id)"


@query(f"""WITH {_LISTS}, e AS (SELECT route_id, xs[1] AS x0, ys[1] AS y0, xs[1] - xs[2] AS dx0, ys[1] - ys[2] AS dy0, xs[-1] AS x1, ys[-1] AS y1, xs[-1] - xs[-2] AS dx1, ys[-1] - ys[-2] AS dy1, n FROM lines WHERE n >= 2)
  SELECT route_id, CAST(CASE WHEN dx0 = 0 AND dy0 = 0 THEN x0 ELSE round_even(x0 + dx0 / sqrt(CAST(dx0 * dx0 + dy0 * dy0 AS DOUBLE)) * 4, 0) END AS INTEGER) AS x_first,
    CAST(CASE WHEN dx0 = 0 AND dy0 = 0 THEN y0 ELSE round_even(y0 + dy0 / sqrt(CAST(dx0 * dx0 + dy0 * dy0 AS DOUBLE)) * 4, 0) END AS INTEGER) AS y_first,
    CAST(CASE WHEN dx1 = 0 AND dy1 = 0 THEN x1 ELSE round_even(x1 + dx1 / sqrt(CAST(dx1 * dx1 + dy1 * dy1 AS DOUBLE)) * 4, 0) END AS INTEGER) AS x_last,
    CAST(CASE WHEN dx1 = 0 AND dy1 = 0 THEN y1 ELSE round_even(y1 + dy1 / sqrt(CAST(dx1 * dx1 + dy1 * dy1 AS DOUBLE)) * 4, 0) END AS INTEGER) AS y_last, n + 2 AS points,
    n >= 3 AND abs(x0 - x1) <= 40 AND abs(y0 - y1) <= 40 AS closed FROM e""")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelorus.plans.masks import is_closed

    lines = track_lines(spark, sf_dir).where(F.size("points") >= 2).withColumn("e", raster.extend_polyline(F.col("points"), 4))
    first, last = F.col("e")[0], F.element_at("e", -1)
    return lines.select(F.col("line_id").alias("route_id"), first["x"].alias("x_first"), first["y"].alias("y_first"), last["x"].alias("x_last"), last["y"].alias("y_last"), F.size("e").cast("long").alias("points"), is_closed(F.col("points"), 40).alias("closed"))


@query(f"""WITH {_LISTS}, a AS (SELECT route_id, n, CASE WHEN n // 2 + 1 < n THEN n // 2 ELSE n // 2 - 1 END AS i, xs, ys FROM lines WHERE n >= 2)
  SELECT route_id, xs[i + 1] AS x, ys[i + 1] AS y, xs[i + 2] AS to_x, ys[i + 2] AS to_y FROM a""")
def track_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelorus.plans.layers import arrow

    a = track_lines(spark, sf_dir).select(F.col("line_id").alias("route_id"), arrow(F.col("points")).alias("a")).where("a is not null")
    return a.select("route_id", "a.from.x", "a.from.y", F.col("a.to.x").alias("to_x"), F.col("a.to.y").alias("to_y"))


@query(f"""WITH {_TRACK}, w AS (SELECT route_id, seq, lag(x) OVER o AS x1, lag(y) OVER o AS y1, x AS x2, y AS y2, lead(x) OVER o AS x3, lead(y) OVER o AS y3 FROM track WINDOW o AS (PARTITION BY route_id ORDER BY seq))
  SELECT route_id, seq, round(CASE WHEN x1 = x3 AND y1 = y3 THEN sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))
    ELSE abs((y3 - y1) * x2 - (x3 - x1) * y2 + (x3 - x1) * y1 - (y3 - y1) * x1) / sqrt(CAST((y3 - y1) * (y3 - y1) + (x3 - x1) * (x3 - x1) AS DOUBLE)) END, 6) AS off FROM w WHERE x1 IS NOT NULL AND x3 IS NOT NULL""")
def off_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = Window.partitionBy("route_id").orderBy("seq")
    w = track(spark, sf_dir).select("route_id", "seq", *[f(c).over(o).alias(f"{c}{i}") for i, f in ((1, F.lag), (3, F.lead)) for c in "xy"], F.col("x").alias("x2"), F.col("y").alias("y2"))
    w = w.where("x1 is not null and x3 is not null")
    return w.select("route_id", "seq", F.round(paths.off_line(*[F.col(f"{c}{i}") for i in (1, 2, 3) for c in "xy"]), 6).alias("off"))


@query(f"""WITH b AS (SELECT n_nationkey AS ring_id, -50.0 + n_nationkey * 2 AS s, -150.0 + n_nationkey * 9 AS w FROM nation), {_POINTS.replace('p AS', 'c AS')},
  q AS (SELECT b.ring_id, c.x, c.y, -180.0 + (c.x + 0.5) / 200.0 * 360.0 AS lon, 60.0 - (c.y + 0.5) / 100.0 * 120.0 AS lat, b.s, b.w FROM c JOIN b ON b.ring_id = c.point_id % 25)
  SELECT ring_id, x, y FROM q WHERE lat > s AND lat < s + 30 AND lon - w > (lat - s) * 2 AND lon - w < (lat - s) * 2 + 40""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    s, w = F.lit(-50.0) + k * 2, F.lit(-150.0) + k * 9
    corner = lambda up, right: F.struct((s + up).alias("lat"), (w + right).alias("lon"))
    rings = table(spark, sf_dir, "nation").select(k.cast("long").alias("ring_id"), F.array(corner(0.0, 0.0), corner(30.0, 60.0), corner(30.0, 100.0), corner(0.0, 40.0), corner(0.0, 0.0)).alias("points"))
    c = customer_cells(spark, sf_dir).select((F.col("point_id") % 25).cast("long").alias("ring_id"), "x", "y")
    return raster.inside_polygon(c, rings, GRID)


@query(f"""WITH g AS (SELECT {_x('event_id')} AS x, {_y('event_id')} AS y, min(event_id % 64) AS gray FROM events GROUP BY ALL),
  r AS (SELECT CAST(floor((x + 0.5) * 60 / 200.0) AS INTEGER) AS x, CAST(floor((y + 0.5) * 30 / 100.0) AS INTEGER) AS y, avg(gray) AS gray FROM g GROUP BY ALL) SELECT x, y, round(gray, 6) AS gray, gray < 20 AS water FROM r""")
def resampled_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    g = table(spark, sf_dir, "events").groupBy(x_of(k).alias("x"), y_of(k).alias("y")).agg(F.min(k % 64).alias("gray"))
    r = raster.resample(g, GRID, GridSpec(-60.0, 60.0, -180.0, 180.0, 60, 30))
    return r.select("x", "y", F.round("gray", 6).alias("gray"), (F.col("gray") < 20).alias("water"))


# ---- paths -----------------------------------------------------------------

_FLAGGED = f"""{_TRACK}, {_LANES}, flagged AS (SELECT t.route_id, t.seq, t.x, t.y, lanes.x IS NOT NULL OR t.seq = min(t.seq) OVER r OR t.seq = max(t.seq) OVER r AS in_lane
  FROM track t LEFT JOIN lanes ON lanes.x = t.x AND lanes.y = t.y WINDOW r AS (PARTITION BY t.route_id))"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.lane_flags(track(spark, sf_dir).select("route_id", "seq", "x", "y"), cells_of(spark, sf_dir, "purchase"))


@query(f"WITH {_FLAGGED} SELECT route_id, seq, in_lane FROM flagged")
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("route_id", "seq", "in_lane")


@query(f"WITH {_FLAGGED} SELECT route_id, count(*) AS points, count(*) FILTER (in_lane) AS in_lane, round(avg(CAST(in_lane AS INTEGER)) * 100, 6) AS percent FROM flagged GROUP BY route_id")
def lane_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.lane_usage(flagged(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {_FLAGGED}, r AS (SELECT *, sum(CAST(in_lane AS INTEGER)) OVER (PARTITION BY route_id ORDER BY seq) AS run FROM flagged)
  SELECT route_id, CAST(run AS BIGINT) AS run, min(seq) AS first, max(seq) AS last FROM r WHERE NOT in_lane GROUP BY route_id, run HAVING count(*) >= 2""")
def free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.free_runs(flagged(spark, sf_dir)).groupBy("route_id", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))


@query(f"""WITH {_FLAGGED} SELECT route_id, seq, next_seq FROM (SELECT route_id, seq, lead(seq) OVER (PARTITION BY route_id ORDER BY seq) AS next_seq FROM flagged WHERE in_lane) WHERE next_seq - seq > 1""")
def lane_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.lane_gaps(flagged(spark, sf_dir)).select("route_id", "seq", "next_seq")


def _cells_of_lines(source: str, keys: str) -> str:
    """``cells``: keys, x, y of the lines x, y, x2, y2 of a table; ties step."""
    m = "floor((2 * s * i + n) / (2.0 * n))"
    return f"""l AS (SELECT {keys}, x, y, x2 - x AS dx, y2 - y AS dy, greatest(abs(x2 - x), abs(y2 - y)) AS n, least(abs(x2 - x), abs(y2 - y)) AS s FROM {source}),
  q AS (SELECT *, unnest(range(n + 1)) AS i FROM l), o AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE {m} END AS minor FROM q),
  cells AS (SELECT {keys}, CAST(x + sign(dx) * CASE WHEN abs(dy) > abs(dx) THEN minor ELSE i END AS INTEGER) AS x, CAST(y + sign(dy) * CASE WHEN abs(dy) > abs(dx) THEN i ELSE minor END AS INTEGER) AS y FROM o),
  hit AS (SELECT DISTINCT {keys} FROM cells JOIN land USING (x, y))"""


@query(f"""WITH {_FLAGGED}, {_LAND}, gaps AS (SELECT * FROM (SELECT route_id, seq, x, y, lead(seq) OVER w AS next_seq, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM flagged WHERE in_lane WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE next_seq - seq > 1),
  {_cells_of_lines('gaps', 'route_id, seq')}, d AS (SELECT route_id, unnest(range(seq + 1, next_seq)) AS seq FROM gaps ANTI JOIN hit USING (route_id, seq))
  SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS INTEGER) AS seq, x, y FROM flagged ANTI JOIN d USING (route_id, seq)""")
def cut_lane_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cut_lane_gaps(flagged(spark, sf_dir), cells_of(spark, sf_dir, "error"), GRID).select("route_id", "seq", "x", "y")


@query(f"""WITH RECURSIVE {_FLAGGED}, {_LAND}, r AS (SELECT *, sum(CAST(in_lane AS INTEGER)) OVER (PARTITION BY route_id ORDER BY seq) AS run FROM flagged),
  f AS (SELECT * FROM (SELECT route_id, run, seq, x, y, count(*) OVER (PARTITION BY route_id, run) AS n FROM r WHERE NOT in_lane) WHERE n >= 2),
  pairs AS (SELECT a.route_id, a.run, a.seq, b.seq AS next, a.x, a.y, b.x AS x2, b.y AS y2 FROM f a JOIN f b ON a.route_id = b.route_id AND a.run = b.run AND b.seq BETWEEN a.seq + 2 AND a.seq + 25),
  {_cells_of_lines('pairs', 'route_id, seq, next')},
  far AS (SELECT f.route_id, f.run, f.seq, coalesce(max(p.next), f.seq + 1) AS far FROM f LEFT JOIN (SELECT * FROM pairs ANTI JOIN hit USING (route_id, seq, next)) p USING (route_id, run, seq) GROUP BY f.route_id, f.run, f.seq),
  stays AS (SELECT route_id, run, min(seq) AS seq FROM f GROUP BY ALL UNION SELECT far.route_id, far.run, far.far FROM stays JOIN far USING (route_id, run, seq))
  SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS INTEGER) AS seq, x, y FROM flagged ANTI JOIN (SELECT route_id, seq FROM f ANTI JOIN stays USING (route_id, run, seq)) g USING (route_id, seq)""")
def skip_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.skip_ahead(flagged(spark, sf_dir), cells_of(spark, sf_dir, "error"), GRID).select("route_id", "seq", "x", "y")


_OFF = """CASE WHEN xs[j + 1] = xs[i + 1] AND ys[j + 1] = ys[i + 1] THEN sqrt(CAST(pow(xs[k + 1] - xs[i + 1], 2) + pow(ys[k + 1] - ys[i + 1], 2) AS DOUBLE))
  ELSE abs((xs[j + 1] - xs[i + 1]) * (ys[k + 1] - ys[i + 1]) - (ys[j + 1] - ys[i + 1]) * (xs[k + 1] - xs[i + 1])) / sqrt(CAST(pow(xs[j + 1] - xs[i + 1], 2) + pow(ys[j + 1] - ys[i + 1], 2) AS DOUBLE)) END"""


@query(f"""WITH RECURSIVE {_LISTS}, line AS (SELECT route_id, xs, ys, CAST(n AS BIGINT) AS n FROM lines),
  run AS (SELECT route_id, unnest(range(n - 2)) AS i, unnest(range(n - 2)) + 2 AS j FROM line
    UNION ALL SELECT route_id, i, j + 1 FROM run JOIN line USING (route_id) WHERE j < n AND len(list_filter(range(i + 1, j), lambda k: {_OFF} > 2)) = 0),
  ends AS (SELECT route_id, i, max(j) AS j FROM run GROUP BY ALL),
  kept AS (SELECT route_id, CAST(0 AS BIGINT) AS i FROM line UNION SELECT kept.route_id, greatest(kept.i + 1, ends.j - 2) FROM kept JOIN ends USING (route_id, i)),
  whole AS (SELECT route_id, i FROM kept UNION SELECT route_id, n - 1 FROM line JOIN (SELECT route_id, max(i) AS last FROM kept GROUP BY route_id) USING (route_id) WHERE n <= 2 OR xs[last + 1] <> xs[n] OR ys[last + 1] <> ys[n])
  SELECT route_id, CAST(i AS INTEGER) AS seq, xs[i + 1] AS x, ys[i + 1] AS y FROM whole JOIN line USING (route_id)""")
def collinear_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.simplify(track(spark, sf_dir))


_SPLIT = f"{_TRACK}, legs AS (SELECT route_id, CAST(floor(seq / 10) AS INTEGER) AS leg, CAST(seq % 10 AS INTEGER) AS seq, x, y FROM track)"


@query(f"""WITH {_SPLIT} SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY leg, seq) - 1 AS INTEGER) AS seq, x, y FROM legs WHERE leg = 0 OR seq > 0""")
def joined_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = track(spark, sf_dir).select("route_id", F.floor(F.col("seq") / 10).cast("int").alias("leg"), (F.col("seq") % 10).alias("seq"), "x", "y")
    return paths.concat_legs(legs)


# ---- search ----------------------------------------------------------------

SMALL = GridSpec(-20.0, 20.0, -40.0, 40.0, 40, 20)


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("int")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("route_id"), F.lit(0).alias("leg"), (k * 7 % 40).alias("x0"), (k * 3 % 20).alias("y0"), (k * 11 % 40).alias("x1"), (k * 13 % 20).alias("y1"))


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the small grid that suppliers stand on."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k * 17 % 40).cast("int").alias("x"), (k * 5 % 20).cast("int").alias("y")).distinct()


def small_water(spark: SparkSession, land: DataFrame) -> DataFrame:
    """The small grid without ``land``."""
    every = spark.range(800).select((F.col("id") % 40).cast("int").alias("x"), F.floor(F.col("id") / 40).cast("int").alias("y"))
    return raster.minus(every, land)


def supplier_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane of five cells to the east for every tenth supplier: x0, y0 and its number."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 10 == 0).select(k.alias("lane_id"), (k * 23 % 36).cast("int").alias("x0"), (k * 7 % 20).cast("int").alias("y0"))


@query()
def guided_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches between the nations' cells, with lanes that lead east and may be snapped to."""
    ways = supplier_ways(spark, sf_dir)
    lane = F.transform(F.sequence(F.col("x0"), F.col("x0") + 4), lambda x: F.struct(x.alias("x"), F.col("y0").alias("y")))
    lanes = ways.select("lane_id", F.col("x0").alias("x"), F.col("y0").alias("y"), SMALL.lat_at(F.col("y0")).alias("lat"), SMALL.lon_at(F.col("x0")).alias("lon"), F.lit(90.0).alias("bearing"), lane.alias("cells"))
    on_lane = ways.select(F.explode(lane).alias("c")).select("c.x", "c.y").distinct()
    cells = raster.flags(small_water(spark, supplier_cells(spark, sf_dir)), on_lane).withColumns({"u": F.when(F.col("flags").cast("int").bitwiseAND(raster.LANE) != 0, 1.0).otherwise(0.0), "v": F.lit(0.0)})
    return search.guided(search_requests(spark, sf_dir), cells, SMALL, search.SearchConfig(radius=1, directions=8, snap_km=300.0), lanes)


_SMALL_WATER = """land AS (SELECT DISTINCT s_suppkey * 17 % 40 AS x, s_suppkey * 5 % 20 AS y FROM supplier), water AS (SELECT i % 40 AS x, i // 40 AS y FROM range(800) r(i) ANTI JOIN land ON land.x = i % 40 AND land.y = i // 40)"""


@query(f"""WITH RECURSIVE {_SMALL_WATER}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS route_id, n_nationkey * 7 % 40 AS x0, n_nationkey * 3 % 20 AS y0, n_nationkey * 11 % 40 AS x1, n_nationkey * 13 % 20 AS y1 FROM nation),
  reach AS (SELECT route_id, x, y FROM q JOIN water ON x = x0 AND y = y0 UNION SELECT reach.route_id, water.x, water.y FROM reach, range(-1, 2) a(dx), range(-1, 2) b(dy) JOIN water ON water.x = reach.x + dx AND water.y = reach.y + dy)
  SELECT q.route_id, CASE WHEN s.x IS NULL THEN 'invalid_start' WHEN g.x IS NULL THEN 'invalid_goal' WHEN r.x IS NULL THEN 'exhausted' ELSE 'goal' END AS reason
  FROM q LEFT JOIN water s ON s.x = x0 AND s.y = y0 LEFT JOIN water g ON g.x = x1 AND g.y = y1 LEFT JOIN reach r ON r.route_id = q.route_id AND r.x = x1 AND r.y = y1""")
def leg_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.flags(small_water(spark, supplier_cells(spark, sf_dir)))
    return search.guided(search_requests(spark, sf_dir), cells, SMALL, search.SearchConfig(radius=1, directions=8)).select("route_id", "reason").distinct()


def _exact_sql() -> str:
    lat, lon = "(20.0 - ({0} + 0.5) / 20.0 * 40.0)", "(-40.0 + ({0} + 0.5) / 40.0 * 80.0)"
    nm = _hav(lat.format("b.y"), lon.format("b.x"), lat.format("(b.y + dy)"), lon.format("(b.x + dx)"))
    return f"""WITH RECURSIVE {_SMALL_WATER},
  b(route_id, x, y, cost) USING KEY (route_id, x, y) AS (SELECT CAST(n_nationkey AS BIGINT), water.x, water.y, CAST(0 AS DOUBLE) FROM nation JOIN water ON water.x = n_nationkey * 7 % 40 AND water.y = n_nationkey * 3 % 20
    UNION SELECT n.route_id, n.x, n.y, min(n.cost) FROM (SELECT b.route_id, water.x, water.y, b.cost + {nm} AS cost FROM b, range(-1, 2) q(dx), range(-1, 2) s(dy) JOIN water ON water.x = b.x + dx AND water.y = b.y + dy WHERE dx <> 0 OR dy <> 0) n
      LEFT JOIN recurring.b k ON k.route_id = n.route_id AND k.x = n.x AND k.y = n.y WHERE k.cost IS NULL OR n.cost < k.cost - 1e-9 GROUP BY n.route_id, n.x, n.y)
  SELECT route_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(cost, 6) AS cost FROM b"""


@query(_exact_sql())
def exact_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(search_requests(spark, sf_dir), small_water(spark, supplier_cells(spark, sf_dir)), SMALL).withColumn("cost", F.round("cost", 6))


def _lane_cost_sql() -> str:
    lat, lon = "(60.0 - ({0} + 0.5) / 100.0 * 120.0)", "(-180.0 + ({0} + 0.5) / 200.0 * 360.0)"
    nm = _hav(lat.format("y"), lon.format("x"), lat.format("y2"), lon.format("x2"))
    agrees = "CASE WHEN sqrt(CAST({0} * {0} + {1} * {1} AS DOUBLE)) * sqrt(u * u + v * v) > 0 THEN ({0} * u + {1} * v) / (sqrt(CAST({0} * {0} + {1} * {1} AS DOUBLE)) * sqrt(u * u + v * v)) ELSE 0 END"
    return f"""WITH {_FIELD}, {_LANES}, goal AS (SELECT route_id, arg_max(x, seq) AS gx, arg_max(y, seq) AS gy FROM track GROUP BY route_id),
  s AS (SELECT legs.route_id, legs.seq, {nm} AS base, ({agrees.format('(x2 - legs.x)', '(y2 - legs.y)')} + {agrees.format('(gx - legs.x)', '(gy - legs.y)')}) / 2 AS a, p.x IS NOT NULL AS off_lane, q.x IS NOT NULL AND sqrt(u * u + v * v) > 0 AS to_lane
    FROM (SELECT * FROM legs) legs JOIN goal USING (route_id) LEFT JOIN (SELECT x AS fx, y AS fy, u, v FROM field) f ON fx = x2 AND fy = y2 LEFT JOIN lanes p ON p.x = legs.x AND p.y = legs.y LEFT JOIN lanes q ON q.x = x2 AND q.y = y2)
  SELECT route_id, seq, round(base * CASE WHEN NOT coalesce(to_lane, false) THEN 1.0 WHEN off_lane AND a > 0.9 THEN 0.95 * 0.6 WHEN off_lane AND a > 0.5 THEN 0.95 * 0.7 WHEN off_lane AND a > 0 THEN 0.95 * 0.85 WHEN off_lane AND a = 0 THEN 0.9
    WHEN a > -0.2 THEN 1.0 WHEN a > -0.5 THEN 1.5 ELSE 10.0 END, 6) AS cost FROM s""".replace(nm, nm.replace("(y +", "(legs.y +").replace("(x +", "(legs.x +"))


@query(_lane_cost_sql())
def lane_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mask makes of the legs' lengths: lanes are the purchases' cells, with the tracks' directions."""
    from pyspark.sql import Window

    lines = leg_lines(spark, sf_dir).select("route_id", "seq", "x0", "y0", "x1", "y1")
    w = Window.partitionBy("route_id")
    lines = lines.withColumns({"gx": F.max_by("x1", "seq").over(w), "gy": F.max_by("y1", "seq").over(w)})
    field = raster.rasterize(track_lines(spark, sf_dir), GRID).select(F.col("x").alias("x1"), F.col("y").alias("y1"), "u", "v")
    lanes = raster.flags(raster.minus(cells_of(spark, sf_dir, "view"), cells_of(spark, sf_dir, "error")), cells_of(spark, sf_dir, "purchase"))
    at = lambda i: lanes.select(F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("flags").alias(f"f{i}"))
    s = lines.join(field, ["x1", "y1"], "left").join(at(0), ["x0", "y0"], "left").join(at(1), ["x1", "y1"], "left")
    base = geo.haversine_nm(*[f(F.col(c), True) for c, f in (("y0", GRID.lat_at), ("x0", GRID.lon_at), ("y1", GRID.lat_at), ("x1", GRID.lon_at))])
    way = lambda x, y: (F.col(x) - F.col("x0"), F.col(y) - F.col("y0"))
    cost = search.step_cost(base, F.col("f0"), F.col("f1"), F.col("u"), F.col("v"), way("x1", "y1"), way("gx", "gy"))
    return s.select("route_id", "seq", F.round(cost, 6).alias("cost"))
