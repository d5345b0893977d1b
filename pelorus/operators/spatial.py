"""Range and nearest-neighbour joins without nested loops.

Both sides are put into square buckets as wide as the radius; a point meets the
nine buckets around it in an equi-join, and the exact test follows. Rows per
bucket, not rows in all, decide the cost. Nearest places are looked for in bands or
rounds of growing reach, so that a point meets what is near it and not all in reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions import geo
from pelorus.grid import GridSpec

#: Rounds in which the nearest lane is looked for, each with four times the radius of the one before.
LANE_ROUNDS = 4
#: Nautical miles that distances by cosines are less exact than, by far.
LEAST_NM = 0.01


def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def near_pairs(points: DataFrame, entries: DataFrame, size: float, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs whose coordinates may differ by ``size`` at most in both directions; column names must differ."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = points.withColumn("__o", F.explode(around))
    left = left.withColumn("__bx", _bucket(F.col(a[0]), size) + F.col("__o.i")).withColumn("__by", _bucket(F.col(a[1]), size) + F.col("__o.j")).drop("__o")
    right = entries.withColumn("__bx", _bucket(F.col(b[0]), size)).withColumn("__by", _bucket(F.col(b[1]), size))
    return left.join(right, ["__bx", "__by"]).drop("__bx", "__by")


def entries_in_reach(points: DataFrame, entries: DataFrame, radius_km: float, heading: Column | None = None, lane_bearing: Column | None = None, tolerance: float = 60.0) -> DataFrame:
    """Pairs of points (lat, lon) and lane entries (entry_lat, entry_lon) with their distance ``km``.

    In reach means within radius/111 in degrees, within the radius in
    kilometres and, if bearings are given, aligned.
    """
    degrees = radius_km / geo.KM_PER_DEGREE
    met = near_pairs(points, entries, degrees, ("lat", "lon"), ("entry_lat", "entry_lon"))
    met = met.where(F.sqrt(F.pow(F.col("lat") - F.col("entry_lat"), 2) + F.pow(F.col("lon") - F.col("entry_lon"), 2)) <= degrees)
    if heading is not None:
        met = met.where(geo.aligned(heading, lane_bearing, tolerance))
    met = met.withColumn("km", geo.nm_distance(F.col("lat"), F.col("lon"), F.col("entry_lat"), F.col("entry_lon")) * geo.KM_PER_NM)
    return met.where(F.col("km") <= radius_km)


def nearest(pairs: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first pair of each point in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _cube(lat: str, lon: str, side: float, off: float = 0.0) -> list[Column]:
    """The cube in space, of this side, in which a place of the unit sphere lies when ``off`` is added to its coordinates."""
    a, b = F.radians(lat), F.radians(lon)
    return [_bucket(c + F.lit(off), side) for c in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def nearest_lane_start(points: DataFrame, lanes: DataFrame, max_metres: float = 50_000.0) -> DataFrame:
    """The nearest lane start on the point's heading: all point columns, the lane's, distance_nm and distance_m.

    ``points``: point_id, lat, lon, heading; ``lanes``: lane_id, flow (compass
    name), start_lat, start_lon. Lanes of the heading's sector and its two
    neighbours count; ties go to the sector in that order, then to lane_id.
    Invalid points (null, off the globe, heading outside 0..360) find nothing.
    Equal places are looked up once, in rounds of a radius that grows four times
    until it is the whole: a place that has found a lane within the radius is done.
    """
    max_nm = max_metres / geo.METRES_PER_NM
    valid = points.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("heading").between(0, 360))
    valid = valid.withColumn("__s", F.array_position(F.array(*map(F.lit, geo.COMPASS)), geo.compass(F.col("heading"))).cast("int") - 1)
    # of lanes that begin at one place and go one way only the first can be chosen
    lanes = nearest(lanes.where("start_lat is not null and start_lon is not null"), ["flow", "start_lat", "start_lon"], ["lane_id"])
    f = F.array_position(F.array(*map(F.lit, geo.COMPASS)), F.col("flow")).cast("int") - 1
    ways = F.array(*[F.struct(F.pmod(f + k, F.lit(16)).cast("int").alias("s"), F.lit(r).alias("rank")) for r, k in enumerate((0, 1, -1))])
    starts = lanes.where(f >= 0).select("lane_id", "flow", "start_lat", "start_lon", F.explode(ways).alias("w"))
    starts = starts.select("lane_id", "flow", "start_lat", "start_lon", F.col("w.s").alias("__k"), F.col("w.rank").alias("__rank"))
    state = valid.select("lat", "lon", "__s").distinct()
    kinds = {c: starts.schema[c].dataType.simpleString() for c in ("lane_id", "flow", "start_lat", "start_lon")}
    state = state.withColumn("at", F.lit(None).cast("struct<nm:double,rank:int," + ",".join(f"{c}:{t}" for c, t in kinds.items()) + ">"))
    keys = ["__k", "__0", "__1", "__2"]
    for k in range(LANE_ROUNDS - 1, -1, -1):
        reach = max_nm / 4**k
        # coordinates of places so many miles apart differ by this much at most, at the poles as elsewhere, so a lane is met in two cubes in each direction
        apart = 2 * math.sin(min(math.pi, (reach + 2 * LEAST_NM) / geo.EARTH_NM) / 2) * (1 + 1e-9)
        side = 2 * apart
        todo = F.col("at").isNull()
        here = state.withColumns({"__k": F.when(todo, F.col("__s")).otherwise(F.lit(-1)), **{f"__{i}": F.when(todo, c).otherwise(F.xxhash64("lat", "lon")) for i, c in enumerate(_cube("lat", "lon", side))}})
        there = starts
        for i, ends in enumerate(zip(*(_cube("start_lat", "start_lon", side, off) for off in (-apart, apart)))):
            there = there.withColumn(f"__{i}", F.explode(F.sequence(*ends)))
        nm = geo.nm_distance(F.col("lat"), F.col("lon"), F.col("start_lat"), F.col("start_lon"))
        # what is farther may have been left out by the cubes, so the next round looks again
        near = [F.col(c) == F.col(f"{c}_") for c in keys] + [nm <= (reach - LEAST_NM if k else max_nm)]
        # the planner takes what is exploded for as small as it was before, and would broadcast it through the driver
        met = here.join(there.withColumnsRenamed({c: f"{c}_" for c in keys}).hint("merge"), near, "left")
        found = F.when(F.col("start_lat").isNotNull(), F.struct(nm.alias("nm"), F.col("__rank").alias("rank"), *kinds))
        state = met.groupBy("lat", "lon", "__s", *keys).agg(F.min(F.coalesce("at", found)).alias("at")).select("lat", "lon", "__s", "at")
    chosen = state.where("at is not null").select("lat", "lon", "__s", F.col("at.nm").alias("distance_nm"), F.col("at.rank").alias("__rank"), "at.flow", "at.start_lat", "at.start_lon")
    out = valid.join(chosen.hint("merge"), ["lat", "lon", "__s"]).join(lanes.hint("merge"), ["flow", "start_lat", "start_lon"])
    out = nearest(out, ["point_id"], ["distance_nm", "__rank", "lane_id"]).withColumn("distance_m", F.col("distance_nm") * geo.METRES_PER_NM)
    return out.select("flow", *points.columns, *[c for c in lanes.columns if c != "flow"], "distance_nm", "distance_m")


def invalid_points(points: DataFrame) -> DataFrame:
    """Points (point_id, lat, lon, heading) that ``nearest_lane_start`` leaves out, with the first reason."""
    reason = (
        F.when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "latitude")
        .when(~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "longitude")
        .when(~F.coalesce(F.col("heading").between(0, 360), F.lit(False)), "heading")
    )
    return points.select("point_id", reason.alias("reason")).where("reason is not null")


def overlapping_tiles(tiles: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int) -> DataFrame:
    """Tiles (x0, x1, y0, y1, upper ends excluded) that a pixel window meets, with the part that lies in it."""
    part = {"from_x": F.greatest("x0", F.lit(x_min)), "to_x": F.least("x1", F.lit(x_max)), "from_y": F.greatest("y0", F.lit(y_min)), "to_y": F.least("y1", F.lit(y_max))}
    return tiles.withColumns(part).where("from_x < to_x and from_y < to_y")


def _rows_between(low: Column, high: Column) -> Column:
    """The rows from ``low`` to ``high`` away, above and below; none if ``low`` exceeds ``high``."""
    below = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.transform(below, lambda r: -r), below))


def _bands(reach: int) -> list[tuple[int, int]]:
    """0..3, 4..15, 16..63 and so on up to ``reach``."""
    out, low = [], 0
    while low <= reach:
        out.append((low, min(reach, max(3, 4 * low - 1))))
        low = out[-1][1] + 1
    return out


def to_water(points: DataFrame, land: DataFrame, grid: GridSpec, reach: int = 200) -> DataFrame:
    """Move points (point_id, x, y) that lie on land or off the grid to the nearest water cell.

    Cells count on growing squares: first the rows above and below, by column,
    then the columns, by row, the positive side first. Points without water in
    reach stay. Equal points are looked up once. A land cell knows the ends of
    its row's run of land, so a point meets one cell of each row, not all cells
    around it; rows are met in bands of growing distance, and none that
    is farther than the best so far. A point that needs no more rows stands for
    one row in the later bands.
    """
    w = Window.partitionBy("y").orderBy("x")
    runs = land.where(grid.holds(F.col("x"), F.col("y"))).select("x", "y").distinct().withColumn("__run", F.col("x") - F.row_number().over(w))
    runs = runs.groupBy("y", "__run").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    dry = runs.select(F.explode(F.sequence("lo", "hi")).alias("cx"), F.col("y").alias("cy"), "lo", "hi")
    last, base = grid.width - 1, 4 * reach + 4
    onto = F.least(F.lit(last), F.greatest(F.lit(0), F.col("x")))

    # of a point: the least (ring, rows or columns, place on it, side), as one number
    code = lambda ring, phase, major, sign: ((ring.cast("long") * 2 + phase) * base + major + ring) * 2 + sign
    ring_of = lambda t: F.floor(F.col(t) / F.lit(4 * base))
    state = points.select("x", "y").where("x is not null and y is not null").distinct().withColumn("turn", F.lit(None).cast("long"))
    for low, high in _bands(reach):
        # rows at the distance of a place on a column still count, as rows go first
        top = F.least(F.lit(high), F.coalesce(ring_of("turn").cast("int"), F.lit(high)))
        rows = _rows_between(F.lit(low), top)
        tried = state.withColumn("dy", F.explode_outer(F.filter(rows, lambda r: (F.col("y") + r).between(0, grid.height - 1))))
        tried = tried.withColumns({"cx": onto, "cy": F.col("y") + F.col("dy")}).join(dry, ["cx", "cy"], "left")
        wet = F.col("lo").isNull()
        right = F.when(wet & (F.col("cx") >= F.col("x")), F.col("cx")).when(~wet & (F.col("hi") < last), F.col("hi") + 1) - F.col("x")
        left = F.col("x") - F.when(wet & (F.col("cx") <= F.col("x")), F.col("cx")).when(~wet & (F.col("lo") > 0), F.col("lo") - 1)
        across, away = F.least(right, left), F.abs("dy")
        side = F.when(right <= across, F.lit(0)).otherwise(F.lit(1))
        turn = F.when(F.col("dy").isNotNull() & (F.greatest(across, away) <= reach), F.when(across <= away, code(away, 0, F.lit(0), F.lit(0))).when(across > away, code(across, 1, F.col("dy"), side)))
        state = tried.groupBy("x", "y").agg(F.least(F.min("turn"), F.min(turn)).alias("turn"))

    # on a square's rows the first water from the left end is taken, on its columns the place is known
    ring, in_row = ring_of("turn").cast("int"), F.floor(F.col("turn") / (2 * base)) % 2 == 0
    major, sign = (F.floor(F.col("turn") / 2) % base).cast("int") - F.col("ring"), (F.col("turn") % 2).cast("int")
    ends = state.where("turn is not null").withColumn("ring", ring).withColumns({"major": major, "sign": sign, "in_row": in_row})
    ends = ends.withColumn("dy", F.explode(F.when(~F.col("in_row"), F.array("major")).otherwise(F.array_distinct(F.array(F.col("ring"), -F.col("ring"))))))
    start = F.greatest(F.lit(0), F.col("x") - F.col("ring"))
    ends = ends.withColumns({"cx": F.when(F.col("in_row"), start).otherwise(F.col("x") + F.when(F.col("sign") == 0, F.col("ring")).otherwise(-F.col("ring"))), "cy": F.col("y") + F.col("dy")})
    ends = ends.join(dry, ["cx", "cy"], "left").withColumn("nx", F.coalesce(F.col("hi") + 1, F.col("cx")))
    ends = ends.where((F.col("nx") <= F.least(F.lit(last), F.col("x") + F.col("ring"))) & F.col("cy").between(0, grid.height - 1))
    found = ends.groupBy("x", "y").agg(F.min(F.struct("nx", (-F.col("dy")).alias("up"))).alias("at"))
    found = found.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("at.nx").alias("nx"), (F.col("y") - F.col("at.up")).alias("ny"))
    moved = points.select("point_id", "x", "y").distinct().join(found, (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left")
    return moved.select("point_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))


def nearest_cell(points: DataFrame, cells: DataFrame, radius: int = 20) -> DataFrame:
    """Whether a cell lies in the square around each point, and the whole part of the least distance: point_id, close, distance.

    Equal points are looked up once. A cell tells the places of its row that
    are nearer to it than to its neighbours there, so a point meets one place
    of each row; rows are met in bands, and only those nearer than the best so far.
    """
    w = Window.partitionBy("y").orderBy("x")
    half = lambda gap: F.least(F.lit(radius), F.coalesce(F.floor(gap / 2).cast("int"), F.lit(radius)))
    row = cells.select("x", "y").distinct().withColumns({"lo": -half(F.col("x") - F.lag("x").over(w)), "hi": half(F.lead("x").over(w) - F.col("x"))})
    row = row.withColumn("dx", F.explode(F.sequence("lo", "hi")))
    row = row.groupBy((F.col("x") + F.col("dx")).alias("cx"), F.col("y").alias("cy")).agg(F.min(F.abs("dx")).cast("long").alias("dx"))
    state = points.select("x", "y").where("x is not null and y is not null").distinct().withColumn("d", F.lit(None).cast("long"))
    for low, high in _bands(radius):
        top = F.least(F.lit(high), F.coalesce(F.ceil(F.sqrt("d")).cast("int") - 1, F.lit(high)))
        tried = state.withColumn("dy", F.explode_outer(_rows_between(F.lit(low), top)))
        tried = tried.withColumns({"cx": F.col("x"), "cy": F.col("y") + F.col("dy")}).join(row, ["cx", "cy"], "left")
        state = tried.groupBy("x", "y").agg(F.least(F.min("d"), F.min(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("d"))
    state = state.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.sqrt(F.col("d").cast("double")).alias("d"))
    met = points.select("point_id", "x", "y").join(state, (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left")
    return met.select("point_id", F.col("d").isNotNull().alias("close"), F.floor("d").cast("int").alias("distance"))
