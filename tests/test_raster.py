"""Raster operators against step-by-step programs on small grids."""

import random

import pytest
from pyspark.sql import functions as F

from shared import write_lanes
from pelorus.grid import GridSpec
from pelorus.operators import raster
from pelorus.plans import masks
from pelorus.sources import geojson

GRID = GridSpec(-10.0, 10.0, -20.0, 20.0, 40, 20)


def cells(spark, xs):
    return spark.createDataFrame([(int(x), int(y)) for x, y in xs], "x int, y int")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*(cols or ("x", "y"))).collect()}


def walk(x0, y0, x1, y1, up):
    """The classic line: one error term, both axes tested."""
    dx, dy, sx, sy = abs(x1 - x0), -abs(y1 - y0), (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    err, out = dx + dy, [(x0, y0)]
    while (x0, y0) != (x1, y1):
        twice = 2 * err
        step_x, step_y = (twice >= dy, twice <= dx) if up else (twice > dy, twice < dx)
        if step_x:
            err, x0 = err + dy, x0 + sx
        if step_y:
            err, y0 = err + dx, y0 + sy
        out.append((x0, y0))
    return out


@pytest.mark.parametrize("ties", ["up", "down"])
def test_lines_equal_the_walk(spark, ties):
    ends = [(x, y) for x in range(-9, 10) for y in range(-9, 10)]
    df = spark.createDataFrame([(0, 0, x, y) for x, y in ends], "x0 int, y0 int, x1 int, y1 int")
    got = {}
    for r in raster.line_cells(df, ties).orderBy("x1", "y1", "i").collect():
        got.setdefault((r["x1"], r["y1"]), []).append((r["x"], r["y"]))
    assert got == {(x, y): walk(0, 0, x, y, ties == "up") for x, y in ends}


def test_golden_lines(spark):
    def line(x, y, ties):
        df = spark.createDataFrame([(0, 0, x, y)], "x0 int, y0 int, x1 int, y1 int")
        return [(r["x"], r["y"]) for r in raster.line_cells(df, ties).orderBy("i").collect()]

    assert line(1, 2, "down") == [(0, 0), (0, 1), (1, 2)] and line(2, 1, "down") == [(0, 0), (1, 0), (2, 1)]
    assert line(1, 2, "up") == [(0, 0), (1, 1), (1, 2)] and line(2, 1, "up") == [(0, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_dilation_equals_two_loops(spark, radius):
    rng = random.Random(radius)
    land = {(rng.randrange(40), rng.randrange(20)) for _ in range(25)}
    want = {(x + dx, y + dy) for x, y in land for dx, dy in raster.disk(radius) if 0 <= x + dx < 40 and 0 <= y + dy < 20}
    assert rows(raster.dilate(cells(spark, land), radius, GRID)) == want


def test_runs_are_merged_over_strips(spark):
    df = spark.createDataFrame([(0, 0, 9000), (0, 8000, 9500), (1, 5, 6), (1, 7, 8), (1, 10, 11)], "y int, lo int, hi int")
    got = [x for r in raster.merged_runs(df).collect() for x in [(r["y"], c) for c in range(r["lo"], r["hi"] + 1)]]
    assert len(got) == len(set(got)) and set(got) == {(0, c) for c in range(9501)} | {(1, c) for c in (5, 6, 7, 8, 10, 11)}


def test_dilated_directions_are_first_come(spark):
    rng = random.Random(7)
    field = {(rng.randrange(12), rng.randrange(12)): rng.choice([(0.0, 0.0), (1.0, 0.0), (0.0, -1.0), (0.6, 0.8)]) for _ in range(20)}
    want = {c: v for c, v in field.items()}
    for x, y in sorted(field, key=lambda c: (c[1], c[0])):
        for dx, dy in raster.disk(2):
            to = (x + dx, y + dy)
            if 0 <= to[0] < 40 and 0 <= to[1] < 20 and want.get(to, (0.0, 0.0)) == (0.0, 0.0):
                want[to] = field[(x, y)]
    df = spark.createDataFrame([(x, y, *v) for (x, y), v in field.items()], "x int, y int, u double, v double")
    assert {(r["x"], r["y"]): (r["u"], r["v"]) for r in raster.dilate_lanes(df, 2, GRID).collect()} == want


def test_last_segment_wins(spark):
    df = spark.createDataFrame([(1, [(0, 0), (4, 0)]), (2, [(2, 0), (2, 3)]), (3, [(9, 9), (9, 9)])], "line_id int, points array<struct<x:int,y:int>>")
    got = {(r["x"], r["y"]): (r["u"], r["v"]) for r in raster.rasterize(df, GRID).collect()}
    assert got[(2, 0)] == (0.0, 1.0) and got[(1, 0)] == (1.0, 0.0) and got[(9, 9)] == (0.0, 0.0)


def test_polygons_with_holes(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([(1, 0, square(1, 9)), (1, 1, square(4, 6)), (2, 0, [(12, 3), (14, 5)])], "polygon_id int, ring int, points array<struct<x:int,y:int>>")
    want = {(x, y) for x in range(1, 10) for y in range(1, 10)} - {(x, y) for x in range(4, 7) for y in range(4, 7)}
    assert rows(raster.fill_polygons(df, GRID)) == want


def test_pools_drop_cut_blocks(spark):
    got = raster.max_pool(cells(spark, [(0, 0), (38, 17), (39, 19)]), 3, GRID)
    assert rows(got) == {(0, 0), (12, 5)}
    f = spark.createDataFrame([(0, 0, 1.0, 0.0), (1, 1, 0.0, 1.0), (6, 6, 1.0, 0.0), (7, 7, -1.0, 0.0)], "x int, y int, u double, v double")
    got = {(r["x"], r["y"]): (round(r["u"], 6), round(r["v"], 6)) for r in raster.mean_pool(f, 2, GRID).collect()}
    assert got[(0, 0)] == (0.707107, 0.707107)


def test_masks_as_sets(spark):
    a, b = cells(spark, [(0, 0), (1, 1)]), cells(spark, [(1, 1), (2, 2)])
    assert rows(raster.union(a, b)) == {(0, 0), (1, 1), (2, 2)} and rows(raster.minus(a, b)) == {(0, 0)}
    f = raster.flags(a, b, cells(spark, [(0, 0), (1, 1), (3, 3)]))
    got = {(r["x"], r["y"]): (r["flags"], r["ok"]) for r in f.withColumn("ok", raster.navigable(F.col("flags"))).collect()}
    assert got == {(0, 0): (5, False), (1, 1): (7, True), (2, 2): (2, True), (3, 3): (4, False)}
    assert rows(raster.stitch([(a, 0, 0), (raster.crop(b, 1, 1, 2, 2), 10, 10)])) == {(0, 0), (1, 1), (10, 10), (11, 11)}


def test_resampling_is_a_mean(spark):
    gray = spark.createDataFrame([(x, y, float(10 * x)) for x in range(4) for y in range(2)], "x int, y int, gray double")
    small = raster.resample(gray, GridSpec(0, 1, 0, 1, 4, 2), GridSpec(0, 1, 0, 1, 2, 1))
    assert rows(small, "x", "y", "gray") == {(0, 0, 5.0), (1, 0, 25.0)}
    assert rows(raster.water_of_gray(small)) == {(0, 0)}


def test_points_in_polygons(spark):
    ring = spark.createDataFrame([(1, [(-5.0, -5.0), (-5.0, 5.0), (5.0, 5.0), (5.0, -5.0), (-5.0, -5.0)])], "ring_id int, points array<struct<lat:double,lon:double>>")
    every = spark.createDataFrame([(1, x, y) for x in range(40) for y in range(20)], "ring_id int, x int, y int")
    lat = lambda y: 10 - (y + 0.5) / 20 * 20
    lon = lambda x: -20 + (x + 0.5) / 40 * 40
    assert rows(raster.inside_polygon(every, ring, GRID)) == {(x, y) for x in range(40) for y in range(20) if abs(lat(y)) < 5 and abs(lon(x)) < 5}


WINDOW = GridSpec(-5.0, 5.0, -5.0, 5.0, 100, 100)


def pixel(lon, lat, factor=1):
    return int((lon + 5) / 10 * 100 * factor), int((5 - lat) / 10 * 100 * factor)


def sampled(points):
    out = set()
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        n = max(abs(bx - ax), abs(by - ay))
        out |= {(round(ax + (bx - ax) * i / n), round(ay + (by - ay) * i / n)) for i in range(n + 1)} if n else {(ax, ay)}
    return out


def longer(points, by):
    end = lambda p, q: tuple(round(a + (a - b) / ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 * by) for a, b in zip(p, q, strict=True))
    return [end(points[0], points[1]), *points, end(points[-1], points[-2])]


def spread(cells_, r, side=100):
    return {(x + dx, y + dy) for x, y in cells_ for dx, dy in raster.disk(r) if 0 <= x + dx < side and 0 <= y + dy < side}


LANES = [[(0.1, 2.2), (1.1, 2.2), (1.6, 1.7)], [(2.0, -2.0), (3.0, -2.5)], [(4.0, 4.0), (4.5, 4.0)]]


def test_lane_masks(spark, tmp_path):
    features = geojson.read_lane_files(spark, str(write_lanes(tmp_path / "f")))
    m = masks.combined(features, WINDOW, dilation=1, no_go_dilation=1, supersample=2, extend=2)
    fine = set().union(*(sampled(longer([pixel(*p, 2) for p in line], 4)) for line in LANES))
    assert rows(m.lanes) == {(x // 2, y // 2) for x, y in spread({c for c in fine if 0 <= c[0] < 200 and 0 <= c[1] < 200}, 1, 200)}
    x0, y1 = pixel(-3.0, 3.0, 2)
    x1, y0 = pixel(-1.0, 5.0, 2)
    area = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    lines = sampled([pixel(-4.0, -4.0, 2), pixel(-4.0, -3.0, 2)]) | sampled([pixel(-3.0, -4.0, 2), pixel(-3.0, -3.0, 2)])
    assert rows(m.no_go) == {(x // 2, y // 2) for x, y in spread(area | lines, 1, 200)}
    simple = masks.simple(features.where("size(properties) > 0"), WINDOW, dilation=0)
    outline = sampled([pixel(*p) for p in [(-3.0, 3.0), (-1.0, 3.0), (-1.0, 5.0), (-3.0, 5.0), (-3.0, 3.0)]])
    assert rows(simple) == set().union(*(sampled([pixel(*p) for p in line]) for line in LANES), outline)


def test_overlay_draws_land_first(spark, tmp_path):
    features = geojson.read_lane_files(spark, str(write_lanes(tmp_path / "f")))
    land = cells(spark, [pixel(0.6, 2.2), (1, 90)])
    got = rows(masks.overlay(land, features, WINDOW, width=1))
    x0, y1 = pixel(-3.0, 3.0)
    x1, y0 = pixel(-1.0, 5.0)
    assert got == {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} | {(1, 90)}


def test_buffered_land(spark):
    land = cells(spark, [(10, 10)])
    g = GridSpec(-10.0, 10.0, -20.0, 20.0, 2400, 1200)
    assert g.buffer_pixels(1.0) == 1
    assert rows(masks.buffered_land(land, g, 1.0)) == {(10, 10), (9, 10), (11, 10), (10, 9), (10, 11)}
    assert masks.buffered_land(land, g, 1.0, lanes=land).count() == 0
