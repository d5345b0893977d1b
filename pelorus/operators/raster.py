"""Raster algebra on sparse cells.

A mask is a DataFrame of the cells (x, y) that are set; a direction field adds
unit vectors (u, v), null or zero where there is none. Nothing here makes a row
for every cell of a grid: work grows with what is set. Where the order of
writing decides, it is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.grid import GridSpec

WATER, LANE, FORBIDDEN = 1, 2, 4


# ---- lines -----------------------------------------------------------------


def line_cell(i: Column, x0: Column, y0: Column, x1: Column, y1: Column, ties: str) -> tuple[Column, Column]:
    """x and y of step ``i`` of a straight line.

    The longer axis takes a step each time; where the other axis is half way
    between two cells, ``ties`` says whether it has stepped ("up") or not
    ("down").
    """
    dx, dy = x1 - x0, y1 - y0
    long_, short = line_steps(x0, y0, x1, y1), F.least(F.abs(dx), F.abs(dy))
    twice = 2 * short * i
    minor = F.floor((twice + long_) / (2 * long_)) if ties == "up" else F.ceil((twice + long_) / (2 * long_)) - 1
    minor = F.when(long_ == 0, F.lit(0)).otherwise(minor)
    steep = F.abs(dy) > F.abs(dx)
    x = x0 + F.signum(dx.cast("double")) * F.when(steep, minor).otherwise(i)
    y = y0 + F.signum(dy.cast("double")) * F.when(steep, i).otherwise(minor)
    return x.cast("int"), y.cast("int")


def line_steps(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.abs(x1 - x0), F.abs(y1 - y0)).cast("int")


def line_cells(lines: DataFrame, ties: str) -> DataFrame:
    """``lines`` (x0, y0, x1, y1) with a row for each cell: i, x, y are added, both ends included."""
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    steps = dealt_anew(lines).withColumn("i", F.explode(F.sequence(F.lit(0), line_steps(*ends))))
    x, y = line_cell(F.col("i"), *ends, ties)
    return steps.withColumns({"x": x, "y": y})


def dealt_anew(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows anew, each of which will turn into many: they are few bytes, and would end up in few tasks."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by)


def sampled_steps(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.abs(x1 - x0), F.abs(y1 - y0), F.lit(1)).cast("int")


def sampled_cell(i: Column, x0: Column, y0: Column, x1: Column, y1: Column, of_delta: bool = False) -> tuple[Column, Column]:
    """x and y of step ``i`` of equal steps along the longer axis, halves rounded to even.

    ``of_delta`` rounds the distance from the start instead of the position.
    """
    steps = sampled_steps(x0, y0, x1, y1)

    def at(start: Column, d: Column) -> Column:
        moved = (d * i).cast("double") / steps
        return (start + F.rint(moved) if of_delta else F.rint(start + moved)).cast("int")

    return at(x0, x1 - x0), at(y0, y1 - y0)


def segments(points: Column) -> Column:
    """Consecutive pairs of an array of struct(x, y): array<struct<seg, a, b>>."""
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p, i: F.struct(i.alias("seg"), p["a"].alias("a"), p["b"].alias("b")))


def extend_polyline(points: Column, pixels: int) -> Column:
    """One more point beyond each end, ``pixels`` along the end segment; a zero-length end repeats its point."""
    if pixels <= 0:
        return points

    def beyond(end: Column, before: Column) -> Column:
        dx, dy = (end["x"] - before["x"]).cast("double"), (end["y"] - before["y"]).cast("double")
        size = F.hypot(dx, dy)
        move = lambda c, d: F.when(size == 0, end[c]).otherwise(F.rint(end[c] + d / size * pixels).cast("int"))
        return F.struct(move("x", dx).alias("x"), move("y", dy).alias("y"))

    first, second = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(2))
    last, before = F.try_element_at(points, F.lit(-1)), F.try_element_at(points, F.lit(-2))
    longer = F.concat(F.array(beyond(first, second)), points, F.array(beyond(last, before)))
    return F.when(F.size(points) >= 2, longer).otherwise(points)


def rasterize(lines: DataFrame, grid: GridSpec, line_id: str = "line_id", points: str = "points") -> DataFrame:
    """Cells of polylines with the direction of the segment that wrote last: x, y, u, v.

    Lines are written in the order of ``line_id``, segments and steps in theirs.
    A segment of no length sets its cell and leaves the direction as it was.
    """
    seg = lines.select(F.col(line_id).alias("line"), F.explode(segments(F.col(points))).alias("s")).select("line", "s.*")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    size = F.hypot(dx.cast("double"), dy.cast("double"))
    ends = [F.col(c) for c in ("a.x", "a.y", "b.x", "b.y")]
    seg = dealt_anew(seg.orderBy("line", "seg").withColumn("turn", F.monotonically_increasing_id()), "turn")
    steps = seg.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(size == 0, F.lit(0)).otherwise(sampled_steps(*ends)))))
    x, y = sampled_cell(F.col("i"), *ends)
    written = steps.select(x.alias("x"), y.alias("y"), F.when(size > 0, dx / size).alias("u"), F.when(size > 0, dy / size).alias("v"), _turn_and_step(F.col("turn"), F.col("i")).alias("w"))
    return last_write(written.where(grid.holds(F.col("x"), F.col("y"))))


def _turn_and_step(turn: Column, step: Column) -> Column:
    """One long that orders by turn, then step, so that it can be hash-aggregated.

    A turn is a partition (19 bits) and a row of it (27 bits); a step has 17
    bits, more than the side of any grid.
    """
    return F.shiftleft(F.shiftright(turn, 33), 44) + F.shiftleft(turn.bitwiseAND(F.lit((1 << 27) - 1)), 17) + step


def last_write(written: DataFrame) -> DataFrame:
    """Of several vectors for a cell the one with the largest ``w`` (a long); rows without a vector only set the cell."""
    w = F.when(F.col("u").isNotNull(), F.col("w"))
    return written.groupBy("x", "y").agg(*[F.coalesce(F.max_by(c, w), F.lit(0.0)).alias(c) for c in ("u", "v")])


def brushed_lines(lines: DataFrame, grid: GridSpec, width: int, points: str = "points", closed: bool = False) -> DataFrame:
    """Distinct cells of polylines drawn with a square brush that reaches ``width`` (1 at least) cells each way."""
    p = F.col(points)
    if closed:
        first, last = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(-1))
        p = F.when(first != last, F.concat(p, F.array(first))).otherwise(p)
    alone = lines.select(F.explode(p).alias("c")).select("c.x", "c.y")
    seg = dealt_anew(lines.select(F.explode(segments(p)).alias("s")).select("s.*"))
    ends = [F.col(c) for c in ("a.x", "a.y", "b.x", "b.y")]
    along = seg.withColumn("i", F.explode(F.sequence(F.lit(0), sampled_steps(*ends))))
    x, y = sampled_cell(F.col("i"), *ends, True)
    spine = alone.unionByName(along.select(x.alias("x"), y.alias("y"))).distinct().where(grid.holds(F.col("x"), F.col("y")))
    reach = max(1, width)
    return _spread(spine, [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)], grid)


# ---- morphology ------------------------------------------------------------


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets within a distance."""
    return [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def _spread(cells: DataFrame, offsets: list[tuple[int, int]], grid: GridSpec) -> DataFrame:
    o = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    moved = cells.select("x", "y", F.explode(o).alias("o")).select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return moved.where(grid.holds(F.col("x"), F.col("y"))).distinct()


def dilate(cells: DataFrame, radius: int, grid: GridSpec) -> DataFrame:
    """Cells within ``radius`` of a set cell; the coast by a buffer, for instance.

    Each row of a disk is one run, so a source gives 2r+1 runs rather than all
    of the disk's cells; runs of a row that touch are merged before they are
    opened up into cells.
    """
    if radius < 1:
        return cells.select("x", "y").distinct()
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(int((radius * radius - dy * dy) ** 0.5)).alias("half")) for dy in range(-radius, radius + 1)])
    runs = cells.select("x", "y", F.explode(rows).alias("r")).select(
        (F.col("y") + F.col("r.dy")).alias("y"), F.greatest(F.col("x") - F.col("r.half"), F.lit(0)).alias("lo"), F.least(F.col("x") + F.col("r.half"), F.lit(grid.width - 1)).alias("hi")
    )
    runs = runs.where(F.col("y").between(0, grid.height - 1) & (F.col("lo") <= F.col("hi")))
    return merged_runs(runs).select(F.explode(F.sequence("lo", "hi")).alias("x"), "y")


#: Columns of a strip in which a row's runs are merged.
STRIP = 4096


def merged_runs(runs: DataFrame) -> DataFrame:
    """Disjoint runs (y, lo, hi) that cover the same cells; rows are cut into strips so that none is too long."""
    strip = F.explode(F.sequence(F.floor(F.col("lo") / STRIP), F.floor(F.col("hi") / STRIP))).alias("strip")
    cut = runs.select("y", "lo", "hi", strip)
    cut = cut.select("y", "strip", F.greatest("lo", F.col("strip") * STRIP).cast("int").alias("lo"), F.least("hi", F.col("strip") * STRIP + STRIP - 1).cast("int").alias("hi"))
    cut = cut.groupBy("y", "strip", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("y", "strip").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("y", "strip").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("new", F.when(F.col("lo") <= F.max("hi").over(before) + 1, 0).otherwise(1))
    cut = cut.withColumn("island", F.sum("new").over(upto))
    return cut.groupBy("y", "strip", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("y", "lo", "hi")


def dilate_lanes(cells: DataFrame, radius: int, grid: GridSpec) -> DataFrame:
    """Dilation of x, y, u, v: a cell keeps its own direction; others take that of the first source, row by row, that has one."""
    if radius <= 0:
        return cells
    o = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disk(radius)])
    to = cells.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "u", "v", F.explode(o).alias("o"))
    to = to.select((F.col("sx") + F.col("o.dx")).alias("x"), (F.col("sy") + F.col("o.dy")).alias("y"), "sx", "sy", "u", "v", ((F.col("o.dx") != 0) | (F.col("o.dy") != 0)).cast("int").alias("away"))
    has = (F.col("u") != 0) | (F.col("v") != 0)
    # away, then row, then column of the source, in one long that can be hash-aggregated
    order = F.when(has, F.shiftleft(F.col("away").cast("long"), 60) + F.shiftleft(F.col("sy").cast("long"), 30) + F.col("sx"))
    return to.where(grid.holds(F.col("x"), F.col("y"))).groupBy("x", "y").agg(*[F.coalesce(F.min_by(c, order), F.lit(0.0)).alias(c) for c in ("u", "v")])


# ---- polygons --------------------------------------------------------------


def fill_rings(rings: DataFrame, grid: GridSpec, ring_id: str = "ring_id", points: str = "points") -> DataFrame:
    """Cells (ring_id, x, y) inside each closed ring, its outline included; rings with under 3 points give none.

    A row's crossings with the ring are sorted and taken in pairs; the cells
    between the two of a pair are inside.
    """
    p = F.col(points)
    ring = rings.where(F.size(p) >= 3).select(F.col(ring_id).alias("ring_id"), F.concat(p, F.array(F.element_at(p, 1))).alias("p"))
    edges = ring.select("ring_id", F.explode(segments(F.col("p"))).alias("s")).select("ring_id", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))
    edges = dealt_anew(edges, "ring_id")
    outline = line_cells(edges, "up").select("ring_id", "x", "y")
    low, high = F.greatest(F.least("y0", "y1"), F.lit(0)), F.least(F.greatest("y0", "y1") - 1, F.lit(grid.height - 1))
    crossings = edges.where((F.col("y0") != F.col("y1")) & (low <= high)).withColumn("y", F.explode(F.sequence(low, high)))
    crossings = crossings.select("ring_id", "y", (F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("cx"))
    order = Window.partitionBy("ring_id", "y").orderBy("cx")
    pairs = crossings.withColumn("n", F.row_number().over(order)).withColumn("to", F.lead("cx").over(order)).where("n % 2 = 1")
    lo, hi = F.greatest(F.ceil("cx"), F.lit(0)).cast("int"), F.least(F.floor("to"), F.lit(grid.width - 1)).cast("int")
    inside = pairs.where(lo <= hi).select("ring_id", F.explode(F.sequence(lo, hi)).alias("x"), "y")
    return inside.unionByName(outline.where(grid.holds(F.col("x"), F.col("y")))).distinct()


def fill_polygons(polygons: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells of polygons with holes. ``polygons``: polygon_id, ring (0 is the exterior), points.

    Holes are taken out with their outlines.
    """
    rings = polygons.withColumn("key", F.struct("polygon_id", "ring"))
    cells = fill_rings(rings, grid, "key").select("ring_id.*", "x", "y")
    holes = cells.where("ring > 0").select("polygon_id", "x", "y").distinct()
    return cells.where("ring = 0").join(holes, ["polygon_id", "x", "y"], "left_anti").select("x", "y").distinct()


def inside_polygon(cells: DataFrame, rings: DataFrame, grid: GridSpec) -> DataFrame:
    """Of ``cells`` (ring_id, x, y) those whose centre lies in their ring of (lat, lon) points, by crossing number."""
    p = F.col("points")
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b"))
    lat, lon = grid.lat_at(F.col("y"), centre=True), grid.lon_at(F.col("x"), centre=True)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        over = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.coalesce(over & (lon < at), F.lit(False))

    met = cells.join(rings, "ring_id")
    return met.where(F.size(F.filter(pairs, crosses)) % 2 == 1).select("ring_id", "x", "y")


# ---- masks -----------------------------------------------------------------


def union(*masks: DataFrame) -> DataFrame:
    """Cells set in any of the masks."""
    out = masks[0].select("x", "y")
    for m in masks[1:]:
        out = out.unionByName(m.select("x", "y"))
    return out.distinct()


def minus(mask: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of ``mask`` that ``other`` lacks; the complement is kept as what is set."""
    return mask.join(other.select("x", "y").distinct(), ["x", "y"], "left_anti")


def carve(land: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Land without the cells of rectangles (x_min, x_max, y_min, y_max), upper ends excluded."""
    cells = rectangles.where("x_min < x_max and y_min < y_max").select(F.explode(F.sequence(F.col("x_min"), F.col("x_max") - 1)).alias("x"), "y_min", "y_max")
    return minus(land, cells.select("x", F.explode(F.sequence(F.col("y_min"), F.col("y_max") - 1)).alias("y")))


def flags(water: DataFrame, lanes: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """Packed cells: x, y, flags, the bit-or of WATER, LANE and FORBIDDEN."""
    parts = [(water, WATER), (lanes, LANE), (forbidden, FORBIDDEN)]
    rows = [m.select("x", "y", F.lit(bit).alias("flag")) for m, bit in parts if m is not None]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("x", "y").agg(F.bit_or("flag").cast("tinyint").alias("flags"))


def navigable(flag: Column) -> Column:
    """Water or a lane, and not forbidden unless a lane."""
    f = flag.cast("int")
    return ((f.bitwiseAND(FORBIDDEN) == 0) | (f.bitwiseAND(LANE) != 0)) & (f.bitwiseAND(WATER | LANE) != 0)


#: Side of the squares of ``bit_tiles``, as a power of two; a row of one is a long.
TILE_BITS = 6


def bit_tiles(cells: DataFrame) -> DataFrame:
    """tx, ty, rows: for each square with a set cell its 64 rows, a bit for a cell. Coordinates must not be negative."""
    low = (1 << TILE_BITS) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(low)).cast("int"))
    tile = [F.shiftright(c, TILE_BITS).cast("int").alias(f"t{c}") for c in ("x", "y")]
    rows = cells.groupBy(*tile, F.col("y").bitwiseAND(F.lit(low)).cast("int").alias("r")).agg(F.bit_or(bit).alias("bits"))
    found = rows.groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("r", "bits"))).alias("m"))
    return found.select("tx", "ty", F.transform(F.sequence(F.lit(0), F.lit(low)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0).cast("long"))).alias("rows"))


def water_share(land: DataFrame, grid: GridSpec) -> DataFrame:
    """One row, ``water_percent``: share of the grid that is not land."""
    total = float(grid.width) * grid.height
    return land.select("x", "y").distinct().agg(((1 - F.count("*") / F.lit(total)) * 100).alias("water_percent"))


def max_pool(mask: DataFrame, factor: int, grid: GridSpec) -> DataFrame:
    """Blocks with a set cell; blocks that the grid cuts off are dropped."""
    kept = mask.where((F.col("x") < grid.width // factor * factor) & (F.col("y") < grid.height // factor * factor))
    return kept.select(F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).distinct()


def mean_pool(field: DataFrame, factor: int, grid: GridSpec) -> DataFrame:
    """Mean vector of each block with a set cell, over all its cells, set to length 1 unless it nearly vanishes."""
    kept = field.where((F.col("x") < grid.width // factor * factor) & (F.col("y") < grid.height // factor * factor))
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("x", "y")]
    out = kept.groupBy(*block).agg((F.sum("u") / factor**2).alias("u"), (F.sum("v") / factor**2).alias("v"))
    size = F.hypot("u", "v")
    return out.select("x", "y", *[F.when(size > 1e-6, F.col(c) / size).otherwise(F.col(c)).alias(c) for c in ("u", "v")])


def crop(mask: DataFrame, x_min: int, y_min: int, width: int, height: int) -> DataFrame:
    """The cells of a rectangle, counted from its corner; other columns stay."""
    inside = mask.where(F.col("x").between(x_min, x_min + width - 1) & F.col("y").between(y_min, y_min + height - 1))
    return inside.withColumns({"x": F.col("x") - x_min, "y": F.col("y") - y_min})


def stitch(tiles: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """Masks moved to their places (x, y) and put together."""
    moved = [m.select((F.col("x") + x).cast("int").alias("x"), (F.col("y") + y).cast("int").alias("y")) for m, x, y in tiles]
    return union(*moved)


def resample(gray: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """Mean gray of the source cells whose centre falls into each target cell: x, y, gray.

    A mean rather than a windowed sinc; ``gray`` must hold every source cell
    that counts.
    """
    x = F.floor((F.col("x") + 0.5) * target.width / source.width).cast("int").alias("x")
    y = F.floor((F.col("y") + 0.5) * target.height / source.height).cast("int").alias("y")
    return gray.groupBy(x, y).agg(F.avg("gray").alias("gray"))


def _triangle(gray: DataFrame, along: str, other: str, source: int, target: int) -> DataFrame:
    """One axis of ``resample_bilinear``: weights fall linearly from a target pixel's centre, over one target pixel or one source pixel, whichever is wider."""
    scale = source / target
    reach = max(scale, 1.0)
    centre = F.col(along) + 0.5
    first = F.greatest(F.floor((centre - reach) / scale - 0.5) + 1, F.lit(0))
    last = F.least(F.ceil((centre + reach) / scale - 0.5) - 1, F.lit(target - 1))
    met = gray.where(first <= last).select(F.col(other), "gray", centre.alias("__c"), F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias(along))
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("__c") - (F.col(along) + 0.5) * scale) / reach)
    return met.groupBy(along, other).agg(F.floor(F.sum(weight * F.col("gray")) / F.sum(weight) + 0.5).cast("int").alias("gray"))


def resample_bilinear(gray: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """x, y, gray by a triangle filter along the rows, then along the columns, each rounded to whole grays.

    ``gray`` must hold every source cell that counts.
    """
    return _triangle(_triangle(gray, "x", "y", source.width, target.width), "y", "x", source.height, target.height)


def water_of_gray(gray: DataFrame, below: int = 20) -> DataFrame:
    """Cells darker than ``below``."""
    return gray.where(F.col("gray") < below).select("x", "y")
