"""Ordered paths: legs, totals, flags, lines of sight and simplification.

A path is (route_id, seq, x, y); the order is always ``seq``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions import geo
from pelorus.grid import GridSpec
from pelorus.operators import raster


def legs(points: DataFrame, key: str = "route_id", seq: str = "seq") -> DataFrame:
    """Consecutive points (lat, lon) of each route with next_lat, next_lon and the leg's ``nm``; none for the last."""
    w = Window.partitionBy(key).orderBy(seq)
    out = points.withColumn("next_lat", F.lead("lat").over(w)).withColumn("next_lon", F.lead("lon").over(w))
    return out.where("next_lat is not null").withColumn("nm", geo.nm_distance(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")))


def totals(points: DataFrame, key: str = "route_id", seq: str = "seq") -> DataFrame:
    """Length of each route: key, nm and the number of legs."""
    return legs(points, key, seq).groupBy(key).agg(F.sum("nm").alias("nm"), F.count("*").alias("legs"))


def with_latlon(path: DataFrame, grid: GridSpec) -> DataFrame:
    return path.withColumns({"lat": grid.lat_at(F.col("y")), "lon": grid.lon_at(F.col("x"))})


def bounds(points: DataFrame, key: str = "route_id", padding: float = 10.0) -> DataFrame:
    """Padded window of each route, clamped to the globe."""
    return points.groupBy(key).agg(
        F.greatest(F.lit(-90.0), F.min("lat") - padding).alias("lat_min"), F.least(F.lit(90.0), F.max("lat") + padding).alias("lat_max"),
        F.greatest(F.lit(-180.0), F.min("lon") - padding).alias("lon_min"), F.least(F.lit(180.0), F.max("lon") + padding).alias("lon_max"),
    )


def lane_flags(path: DataFrame, lanes: DataFrame | None) -> DataFrame:
    """Add in_lane: the cell is a lane's; the first and last point of a route count as such. Without lanes all are false."""
    if lanes is None:
        return path.withColumn("in_lane", F.lit(False))
    cells = lanes.select("x", "y").distinct().withColumn("__lane", F.lit(True))
    w = Window.partitionBy("route_id")
    out = path.join(cells, ["x", "y"], "left").withColumns({"__lo": F.min("seq").over(w), "__hi": F.max("seq").over(w)})
    end = (F.col("seq") == F.col("__lo")) | (F.col("seq") == F.col("__hi"))
    return out.withColumn("in_lane", F.coalesce("__lane", F.lit(False)) | end).drop("__lane", "__lo", "__hi")


def lane_usage(path: DataFrame) -> DataFrame:
    """Points in lanes of each route, as number and per cent."""
    return path.groupBy("route_id").agg(F.count("*").alias("points"), F.count_if("in_lane").alias("in_lane"), (F.avg(F.col("in_lane").cast("double")) * 100).alias("percent"))


def blocked_lines(lines: DataFrame, blocked: DataFrame, grid: GridSpec, ties: str) -> DataFrame:
    """line_id and ``clear`` of each line (line_id, x0, y0, x1, y1): no blocked cell on it, none off the grid.

    Blocked cells are bits of square tiles. Lines are cut into pieces as long
    as a tile; a piece meets the tiles that it may touch and is opened into
    cells there. A line is off the grid if an end is.
    """
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    on_grid = grid.holds(ends[0], ends[1]) & grid.holds(ends[2], ends[3])
    bits, steps = raster.TILE_BITS, raster.line_steps(*ends)
    starts = F.when(on_grid, F.sequence(F.lit(0), steps, F.lit(1 << bits))).otherwise(F.array(F.lit(0)))
    pieces = raster.dealt_anew(lines.select("line_id", *ends, on_grid.alias("__on"))).withColumn("lo", F.explode(starts))
    pieces = pieces.withColumn("hi", F.when(F.col("__on"), F.least(steps, F.col("lo") + (1 << bits) - 1)).otherwise(F.lit(0)))
    (ax, ay), (bx, by) = (raster.line_cell(F.col(c), *ends, ties) for c in ("lo", "hi"))
    touched = lambda a, b: F.explode(F.sequence(F.shiftright(F.least(a, b), bits), F.shiftright(F.greatest(a, b), bits)))
    pieces = pieces.withColumn("tx", touched(ax, bx)).withColumn("ty", touched(ay, by))
    met = pieces.join(raster.bit_tiles(blocked.where(grid.holds(F.col("x"), F.col("y")))), ["tx", "ty"], "left")
    x, y = raster.line_cell(F.col("i"), *ends, ties)
    each = F.explode(F.when(F.col("rows").isNull(), F.array("lo")).otherwise(F.sequence("lo", "hi")))
    cells = met.withColumn("i", each).select("line_id", "__on", "tx", "ty", "rows", x.alias("x"), y.alias("y"))
    low = F.lit((1 << bits) - 1)
    bit = F.call_function("shiftright", F.get("rows", F.col("y").bitwiseAND(low)), F.col("x").bitwiseAND(low)).bitwiseAND(F.lit(1))
    hit = (F.shiftright("x", bits) == F.col("tx")) & (F.shiftright("y", bits) == F.col("ty")) & (bit == 1)
    return cells.groupBy("line_id").agg((F.bool_and("__on") & ~F.bool_or(F.coalesce(hit, F.lit(False)))).alias("clear"))


def off_line(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Distance of point 2 from the line through 1 and 3; from the point itself if they are one."""
    a, b = y3 - y1, x1 - x3
    c = (x3 - x1) * y1 - (y3 - y1) * x1
    size = F.sqrt((a * a + b * b).cast("double"))
    return F.when(size == 0, F.hypot((x2 - x1).cast("double"), (y2 - y1).cast("double"))).otherwise(F.abs(a * x2 + b * y2 + c) / size)


def straight_run(points: list[tuple[int, int]], i: int, tolerance: float) -> int:
    """First index after i + 1 to which the points from i no longer lie on one line; the length if they always do."""
    x1, y1 = points[i]
    for j in range(i + 2, len(points)):
        dx, dy = points[j][0] - x1, points[j][1] - y1
        size = (dx * dx + dy * dy) ** 0.5
        for x2, y2 in points[i + 1 : j]:
            off = abs(dx * (y2 - y1) - dy * (x2 - x1)) / size if size else ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
            if off > tolerance:
                return j
    return len(points)


def collinear_kept(points: list[tuple[int, int]], tolerance: float = 2.0, strict: bool = False) -> list[int]:
    """Indices of the points that stay when straight runs are thinned.

    The point taken before the one that leaves the line is the last but one of
    the run, as the results to match have it; ``strict`` takes the last.
    """
    n = len(points)
    if n <= 2:
        return list(range(n))
    kept, i, back = [0], 0, 1 if strict else 2
    while i < n - 2:
        j = straight_run(points, i, tolerance)
        i = max(i + 1, j - back)
        kept.append(i)
    if points[kept[-1]] != points[-1]:
        kept.append(n - 1)
    return kept


def simplify(path: DataFrame, tolerance: float = 2.0, strict: bool = False) -> DataFrame:
    """Thin straight runs of each route; ``seq`` stays that of the points kept.

    Which point is looked at next depends on the last one kept, so a route is
    one task's work; routes run side by side.
    """

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf.iloc[collinear_kept(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)), tolerance, strict)]

    own = path.select("route_id", "seq", "x", "y")
    return own.groupBy("route_id").applyInPandas(thin, own.schema)


def concat_legs(path: DataFrame) -> DataFrame:
    """One path out of the legs (route_id, leg, seq, x, y) of each route; the joint of two legs comes once."""
    kept = path.where((F.col("leg") == 0) | (F.col("seq") > 0))
    return kept.select("route_id", (F.row_number().over(Window.partitionBy("route_id").orderBy("leg", "seq")) - 1).alias("seq"), "x", "y")


def ranked(path: DataFrame) -> DataFrame:
    """Number the points of each route from 0 without gaps."""
    return path.withColumn("seq", F.row_number().over(Window.partitionBy("route_id").orderBy("seq")) - 1)


def lane_gaps(path: DataFrame) -> DataFrame:
    """Neighbouring lane points with others between them: route_id, seq, next_seq and both places."""
    w = Window.partitionBy("route_id").orderBy("seq")
    nxt = path.where("in_lane").withColumns({"next_seq": F.lead("seq").over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w)})
    return nxt.where("next_seq - seq > 1").select("route_id", "seq", "next_seq", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def free_runs(path: DataFrame, least: int = 2) -> DataFrame:
    """Add ``run`` to the points outside lanes that stand in a row of ``least`` or more."""
    w = Window.partitionBy("route_id").orderBy("seq")
    runs = path.withColumn("run", F.sum(F.col("in_lane").cast("int")).over(w)).where("not in_lane")
    return runs.withColumn("__n", F.count("*").over(Window.partitionBy("route_id", "run"))).where(F.col("__n") >= least).drop("__n")


def drop_between(path: DataFrame, gaps: DataFrame) -> DataFrame:
    """The path without the points between seq and next_seq of each gap."""
    inner = gaps.select("route_id", F.explode(F.sequence(F.col("seq") + 1, F.col("next_seq") - 1)).alias("seq"))
    return path.join(inner, ["route_id", "seq"], "left_anti")


def cut_lane_gaps(path: DataFrame, blocked: DataFrame, grid: GridSpec) -> DataFrame:
    """Go straight from lane to lane where nothing is in the way; seq is numbered anew."""
    gaps = lane_gaps(path).withColumn("line_id", F.struct("route_id", "seq"))
    clear = blocked_lines(gaps, blocked, grid, "up").where("clear").select("line_id")
    return ranked(drop_between(path, gaps.join(clear, "line_id", "left_semi")))


def skip_ahead(path: DataFrame, blocked: DataFrame, grid: GridSpec, look: int = 25) -> DataFrame:
    """Outside lanes, go on from each point kept to the farthest of the next ``look`` in sight; seq is numbered anew.

    All lines of sight are tested in one join; the farthest ones are followed
    from point to point, route by route.
    """
    runs = free_runs(path)
    ahead = runs.select("route_id", "run", F.col("seq").alias("to"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    here = runs.select("route_id", "run", "seq", F.col("x").alias("x0"), F.col("y").alias("y0")).withColumn("to", F.explode(F.sequence(F.col("seq") + 2, F.col("seq") + look)))
    lines = here.join(ahead, ["route_id", "run", "to"]).withColumn("line_id", F.struct("route_id", "run", "seq", "to"))
    clear = blocked_lines(lines, blocked, grid, "up").where("clear").select("line_id.*")
    far = clear.groupBy("route_id", "run", "seq").agg(F.max("to").alias("far"))
    steps = runs.select("route_id", "run", "seq").join(far, ["route_id", "run", "seq"], "left").select("route_id", "seq", F.coalesce("far", F.col("seq") + 1).alias("far"))

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        to, drop = -1, []
        for seq, far_ in zip(pdf["seq"].tolist(), pdf["far"].tolist(), strict=True):
            if seq >= to:
                to = far_
            else:
                drop.append(seq)
        return pd.DataFrame({"route_id": pdf["route_id"].iloc[0], "seq": drop})

    # a route at once: no step leads out of its run
    gone = steps.groupBy("route_id").applyInPandas(passed, path.select("route_id", "seq").schema)
    return ranked(path.join(gone, ["route_id", "seq"], "left_anti"))


def report(stats: DataFrame) -> DataFrame:
    """Search statistics for reading: infinite costs become null, seconds and miles are rounded."""
    cost = F.when(F.abs(F.col("goal_cost")) < float("inf"), F.round("goal_cost", 2))
    return stats.select("route_id", "leg", "reason", "expansions", "pushes", "pops", "max_open", cost.alias("goal_cost"))
