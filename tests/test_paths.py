"""Lookups, paths, search and sources."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from shared import most_rows, write_lanes
from pelorus.functions import geo
from pelorus.grid import GridSpec
from pelorus.operators import paths, raster, search, spatial
from pelorus.plans import route
from pelorus.sources import files, geojson

GRID = GridSpec(-10.0, 10.0, -20.0, 20.0, 40, 20)


def path_of(spark, points, route_id=1):
    return spark.createDataFrame([(route_id, i, x, y) for i, (x, y) in enumerate(points)], "route_id long, seq int, x int, y int")


def test_simplification_goldens():
    keep = lambda p: [p[i] for i in paths.collinear_kept(p)]
    line = [(10 * i, 0) for i in range(5)]
    assert keep(line[:3]) == line[:3]
    assert keep(line) == [(0, 0), (30, 0), (40, 0)]
    bend = [(0, 0), (10, 0), (20, 0), (30, 0), (30, 10), (30, 20), (30, 30)]
    assert keep(bend) == [(0, 0), (20, 0), (30, 0), (30, 20), (30, 30)]
    assert [line[i] for i in paths.collinear_kept(line, strict=True)] == [(0, 0), (40, 0)]


def test_simplify_keeps_order_and_ends(spark):
    rng = random.Random(2)
    points = [(rng.randrange(40), rng.randrange(20)) for _ in range(60)]
    got = [(r["seq"], r["x"], r["y"]) for r in paths.simplify(path_of(spark, points)).orderBy("seq").collect()]
    assert got[0][0] == 0 and got[-1][0] == 59 and all(points[s] == (x, y) for s, x, y in got)


def test_flags_gaps_and_runs(spark):
    p = path_of(spark, [(i, 0) for i in range(8)])
    lanes = spark.createDataFrame([(3, 0)], "x int, y int")
    flagged = paths.lane_flags(p, lanes)
    assert [r["in_lane"] for r in flagged.orderBy("seq").collect()] == [True, False, False, True, False, False, False, True]
    assert not any(r["in_lane"] for r in paths.lane_flags(p, None).collect())
    assert [(r["seq"], r["next_seq"]) for r in paths.lane_gaps(flagged).orderBy("seq").collect()] == [(0, 3), (3, 7)]
    assert paths.free_runs(flagged).count() == 5
    land = spark.createDataFrame([(5, 0)], "x int, y int")
    cut = paths.cut_lane_gaps(flagged, land, GRID)
    assert [r["x"] for r in cut.orderBy("seq").collect()] == [0, 3, 4, 5, 6, 7]


def greedy(points, flags, blocked, look):
    keep, i, n = [True] * len(points), 0, len(points)
    clear = lambda a, b: not any(c in blocked for c in line_up(a, b))
    while i < n:
        if flags[i]:
            i += 1
            continue
        end = i
        while end + 1 < n and not flags[end + 1]:
            end += 1
        while i < end:
            far = next((j for j in range(min(end, i + look), i + 1, -1) if clear(points[i], points[j])), None)
            for k in range(i + 1, far or i + 1):
                keep[k] = False
            i = far or i + 1
        i = end + 1
    return [p for p, k in zip(points, keep, strict=True) if k]


def line_up(a, b):
    dx, dy = abs(b[0] - a[0]), abs(b[1] - a[1])
    n, m, sx, sy = max(dx, dy), min(dx, dy), (1 if b[0] >= a[0] else -1), (1 if b[1] >= a[1] else -1)
    for i in range(n + 1):
        j = (2 * m * i + n) // (2 * n) if n else 0
        yield (a[0] + sx * (i if dx >= dy else j), a[1] + sy * (j if dx >= dy else i))


@pytest.mark.parametrize("seed", range(3))
def test_skip_ahead_equals_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    points, flags = [(rng.randrange(40), rng.randrange(20)) for _ in range(40)], [rng.random() < 0.15 for _ in range(40)]
    blocked = {(rng.randrange(40), rng.randrange(20)) for _ in range(25)}
    df = spark.createDataFrame([(1, i, x, y, f) for i, ((x, y), f) in enumerate(zip(points, flags, strict=True))], "route_id long, seq int, x int, y int, in_lane boolean")
    got = paths.skip_ahead(df, spark.createDataFrame(list(blocked), "x int, y int"), GRID, 6)
    assert [(r["x"], r["y"]) for r in got.orderBy("seq").collect()] == greedy(points, flags, blocked, 6)


def test_legs_are_joined_once(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 1, 1, 1), (1, 1, 0, 1, 1), (1, 1, 1, 2, 2)], "route_id long, leg int, seq int, x int, y int")
    assert [(r["seq"], r["x"]) for r in paths.concat_legs(df).orderBy("seq").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_distance_to_a_line(spark):
    at = lambda *p: spark.range(1).select(paths.off_line(*map(F.lit, p)).alias("d")).first()["d"]
    assert at(0, 0, 5, 3, 10, 0) == pytest.approx(3.0) and at(2, 2, 5, 6, 2, 2) == pytest.approx(5.0)


@pytest.mark.parametrize("reach", [3, 20])
def test_nudging_scans_in_order(spark, reach):
    rng = random.Random(reach)
    land = {(x, y) for x in range(8, 20) for y in range(4, 16)} - {(11, 5), (18, 9)}
    points = [(i, rng.randrange(5, 25), rng.randrange(2, 18)) for i in range(15)] + [(99, 45, 3)]

    def scan(x0, y0):
        wet = lambda x, y: 0 <= x < 40 and 0 <= y < 20 and (x, y) not in land
        if wet(x0, y0):
            return x0, y0
        for r in range(1, reach + 1):
            ring = [(x0 + d, y0 + s) for d in range(-r, r + 1) for s in (r, -r)] + [(x0 + s, y0 + d) for d in range(-r + 1, r) for s in (r, -r)]
            for c in ring:
                if wet(*c):
                    return c
        return x0, y0

    got = spatial.to_water(spark.createDataFrame(points, "point_id int, x int, y int"), spark.createDataFrame(list(land), "x int, y int"), GRID, reach)
    assert {r["point_id"]: (r["x"], r["y"]) for r in got.collect()} == {i: scan(x, y) for i, x, y in points}


def test_lane_lookup(spark, tmp_path):
    starts = geojson.lane_starts(geojson.read_lane_files(spark, str(write_lanes(tmp_path / "f"))))
    p = spark.createDataFrame([(1, 2.0, 0.2, 110.0), (2, -2.1, 2.1, 130.0), (3, 40.0, 0.0, 110.0), (4, 2.0, 0.2, 300.0), (5, None, 8.5, 110.0), (6, 2.0, 0.2, 400.0)], "point_id int, lat double, lon double, heading double")
    got = {r["point_id"]: (r["properties"]["osm_id"], r["distance_nm"], r["distance_m"]) for r in spatial.nearest_lane_start(p, starts).collect()}
    assert set(got) == {1, 2} and got[1][0] == "1" and got[2][0] == "2"
    assert got[1][1] == pytest.approx(search.haversine(2.0, 0.2, 2.2, 0.1), abs=1e-6) and got[1][2] == pytest.approx(1852 * got[1][1])


def test_feature_files(spark, tmp_path):
    folder = write_lanes(tmp_path / "f")
    features = geojson.read_lane_files(spark, str(folder))
    index = geojson.lane_index(features).orderBy("lane_id").collect()
    assert [(r["num_points"], r["flow"]) for r in index] == [(3, "ESE"), (2, "ESE"), (3, None)]
    assert index[1]["bearing"] == pytest.approx(116.5, abs=0.3)
    counts = {r["kind"]: r["features"] for r in geojson.type_counts(features).collect()}
    assert counts == {"area_to_avoid": 1, "separation_boundary": 1, "separation_lane": 3}
    bare = geojson.read_features(spark, str(folder / "other.geojson"))
    assert bare.count() == 2 and geojson.lines(bare).count() == 3
    geojson.write_by_direction(features, str(tmp_path / "by"))
    assert geojson.read_by_direction(spark, str(tmp_path / "by"), "ESE", "E").count() == 2


def test_waypoints_to_feature(spark, tmp_path):
    (tmp_path / "w.csv").write_text("WP,LAT,LON\n1,1.5,2.5\n2,3,4\n3,5,6")
    f = files.linestring_feature(files.read_waypoints(spark, str(tmp_path / "w.csv"))).first()
    assert [list(c) for c in f["geometry"]["coordinates"]] == [[2.5, 1.5], [4, 3], [6, 5], [2.5, 1.5]] and f["properties"]["osm_id"] == "12"
    (tmp_path / "one.csv").write_text("lat,lon\n1,2\n")
    one = files.read_waypoints(spark, str(tmp_path / "one.csv"))
    assert len(files.linestring_feature(one).first()["geometry"]["coordinates"]) == 2
    for bad in (files.linestring_feature(one, allow_single_point=False), files.linestring_feature(one.where("lat > 9"))):
        with pytest.raises(Exception, match="point|coordinates"):
            bad.collect()


def test_totals_of_a_track(spark):
    points = [(54.1, 8.5), (51.0, 2.0), (48.0, -6.0), (36.0, -6.0)]
    got = paths.totals(files.literal_route(spark, points, 4)).first()
    want = sum(search.haversine(*a, *b) for a, b in zip(points, points[1:], strict=False))
    assert (got["route_id"], got["legs"]) == (4, 3) and got["nm"] == pytest.approx(want, abs=1e-6)


def test_bad_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("WP, Lat ,LON\n1,10,20\n2,,3\n3,x,4\n4, 11 , 21\n")
    assert [(r["lat"], r["lon"]) for r in files.read_waypoints(spark, str(tmp_path / "a.csv")).collect()] == [(10.0, 20.0), (11.0, 21.0)]
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="LAT"):
        files.read_waypoints(spark, str(tmp_path / "b.csv"))


def test_export_and_cache(spark, tmp_path):
    files.write_path_csv(path_of(spark, [(0, 0), (10, 5)]), GRID, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text().split()
    assert text[0] == "lat,lon" and len(text) == 3
    cache, made = files.ResultCache(spark, str(tmp_path / "cache")), []

    def make():
        made.append(1)
        return spark.range(3)

    key = cache.key("land", 1.0)
    assert cache.get(key, make).count() == cache.get(key, make).count() == 3 and made == [1]
    assert cache.clear() == 1 and cache.clear("x") == 0


def test_mosaic(spark):
    t = files.tiles(spark)
    assert t.count() == 8
    window = files.window_of(GridSpec(26.0, 64.1, -16.0, 18.5, 10, 10), GridSpec.globe(86_400, 43_200))
    assert {r["name"] for r in spatial.overlapping_tiles(t, *window).collect()} == {"B1", "C1"}
    with pytest.raises(ValueError, match="outside"):
        files.window_of(GridSpec(10, 10, 5, 5, 1, 1), GridSpec.globe())


def test_images_become_cells(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes([0, 30, 10, 200]))
    import numpy as np

    gray = files.read_gray(spark, str(tmp_path), lambda b: np.frombuffer(b, dtype=np.uint8).reshape(2, 2))
    assert {(r["x"], r["y"]) for r in raster.water_of_gray(gray).collect()} == {(0, 0), (0, 1)}


# ---- search ----------------------------------------------------------------


def requests(spark, *legs):
    return spark.createDataFrame([(i, 0, *leg) for i, leg in enumerate(legs)], "route_id long, leg int, x0 int, y0 int, x1 int, y1 int")


def water(spark, land=()):
    return spark.createDataFrame([(x, y) for x in range(40) for y in range(20) if (x, y) not in set(land)], "x int, y int")


WALL = [(20, y) for y in range(18)]


@pytest.mark.parametrize("radius", [1, 3])
def test_guided_paths_keep_to_water(spark, radius):
    cells = raster.flags(water(spark, WALL))
    got = search.guided(requests(spark, (2, 2, 37, 3), (20, 4, 3, 3), (2, 2, 20, 5)), cells, GRID, search.SearchConfig(radius=radius, directions=16)).collect()
    by = {i: sorted((r for r in got if r["route_id"] == i), key=lambda r: r["seq"] or 0) for i in range(3)}
    path = [(r["x"], r["y"]) for r in by[0]]
    assert path[0] == (2, 2) and path[-1] == (37, 3) and by[0][0]["reason"] == "goal" and by[0][0]["goal_cost"] > 0
    for a, b in zip(path, path[1:], strict=False):
        assert not set(line_up(a, b)) & set(WALL) or radius > 1
    assert by[1][0]["reason"] == "invalid_start" and by[1][0]["seq"] is None and by[2][0]["reason"] == "invalid_goal"


def test_exact_is_never_dearer_than_guided(spark):
    req, w = requests(spark, (2, 2, 9, 3), (30, 12, 36, 8)), water(spark, [(5, y) for y in range(4)])
    config = search.SearchConfig(radius=1, directions=8)
    guided = {r["route_id"]: r["goal_cost"] for r in search.guided(req, raster.flags(w), GRID, config).collect()}
    exact = search.exact(req, w, GRID)
    goal = {r["route_id"]: r["cost"] for r in exact.join(req.select("route_id", F.col("x1").alias("x"), F.col("y1").alias("y")), ["route_id", "x", "y"]).collect()}
    assert set(goal) == set(guided) and all(goal[i] <= guided[i] + 1e-9 for i in goal)


def dijkstra(water_cells, start, grid):
    def nm(a, b):
        la, lb = (math.radians(grid.lat_max - (y + 0.5) * (grid.lat_max - grid.lat_min) / grid.height) for _, y in (a, b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians((b[0] - a[0]) * (grid.lon_max - grid.lon_min) / grid.width) / 2) ** 2
        return 2 * 3440.065 * math.asin(math.sqrt(h))

    done, heap = {}, [(0.0, start)] if start in water_cells else []
    while heap:
        cost, (x, y) = heapq.heappop(heap)
        if (x, y) in done:
            continue
        done[x, y] = cost
        for c in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            if c in water_cells and c not in done:
                heapq.heappush(heap, (cost + nm((x, y), c), c))
    return done


def test_exact_relaxes_until_nothing_changes(spark):
    wall = [(5, y) for y in range(19)] + [(12, y) for y in range(1, 20)]
    cells = {(x, y) for x in range(40) for y in range(20)} - set(wall)
    got = {(r["route_id"], r["x"], r["y"]): r["cost"] for r in search.exact(requests(spark, (0, 0, 39, 0), (5, 3, 9, 9)), water(spark, wall), GRID).collect()}
    want = {(0, *c): cost for c, cost in dijkstra(cells, (0, 0), GRID).items()}
    assert set(got) == set(want) and (0, 39, 0) in got and all(got[c] == pytest.approx(want[c], rel=1e-4) for c in want)


def test_route_queries_reach_their_goals_on_all_supplier_cells(spark):
    from pelorus.plans import queries
    from shared import SF

    rows = [r["s_suppkey"] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()]
    land = {(k * 17 % 40, k * 5 % 20) for k in rows}
    cells = {(x, y) for x in range(40) for y in range(20)} - land
    got = {(r["route_id"], r["x"], r["y"]): r["cost"] for r in queries.QUERIES["exact_route"](spark, SF).collect()}
    for k in range(25):
        want = dijkstra(cells, (k * 7 % 40, k * 3 % 20), queries.SMALL)
        assert {c[1:]: v for c, v in got.items() if c[0] == k} == pytest.approx(want, rel=1e-4, abs=1e-6)
    guided = queries.QUERIES["guided_route"](spark, SF).where("seq is not null").collect()
    lanes = {(k * 23 % 36 + i, k * 7 % 20) for k in rows if k % 10 == 0 for i in range(5)}
    assert guided and not {(r["x"], r["y"]) for r in guided} & (land - lanes)


def test_a_step_onto_the_goal_counts_the_way_to_it(spark):
    lane = [(x, 10) for x in range(10, 14)]
    cells = raster.flags(water(spark), spark.createDataFrame(lane, "x int, y int")).withColumns({"u": F.when(F.col("flags").cast("int").bitwiseAND(2) != 0, 1.0).otherwise(0.0), "v": F.lit(0.0)})
    got = search.guided(requests(spark, (10, 10, 12, 10)), cells, GRID, search.SearchConfig(radius=1, directions=8)).first()
    step = search.Measure(GRID).nm((10, 10), (11, 10))
    assert got["goal_cost"] == pytest.approx(2 * step * 0.95 * 0.6, rel=1e-6)
    cost = search.step_cost(F.lit(step), F.lit(2), F.lit(2), F.lit(1.0), F.lit(0.0), (F.lit(1), F.lit(0)), (F.lit(1), F.lit(0)))
    assert spark.range(1).select(cost.alias("c")).first()["c"] == pytest.approx(step * 0.95 * 0.6)


def test_column_and_worker_agree_on_lane_factors(spark):
    turns = [(a / 20, f) for a in range(-20, 21) for f in (True, False)]
    df = spark.createDataFrame(turns, "a double, f boolean").withColumn("s", geo.lane_factor(F.col("a"), F.col("f"), 0.95))
    assert all(r["s"] == pytest.approx(search.along_factor(r["a"], r["f"], 0.95)) for r in df.collect())


def test_limits_and_lanes(spark):
    cells = raster.flags(water(spark))
    capped = search.guided(requests(spark, (2, 2, 37, 3)), cells, GRID, search.SearchConfig(radius=1, directions=8, max_expansions=3)).first()
    assert capped["reason"] == "max_expansions"
    lane_cells = [(x, 10) for x in range(5, 36)]
    m = GRID
    lat, lon = m.lat_max - 10 / 20 * 20, -20 + 5 / 40 * 40
    lanes = spark.createDataFrame([(1, 5, 10, lat, lon, 90.0, [{"x": x, "y": y} for x, y in lane_cells[::5]])], "lane_id int, x int, y int, lat double, lon double, bearing double, cells array<struct<x:int,y:int>>")
    got = search.guided(requests(spark, (4, 11, 37, 10)), cells, GRID, search.SearchConfig(radius=1, directions=8, snap_km=400.0), lanes).collect()
    assert {(r["x"], r["y"]) for r in got} >= {(5, 10), (35, 10)} and got[0]["reason"] == "goal"


def test_whole_plan(spark):
    land = spark.createDataFrame(WALL, "x int, y int")
    req = spark.createDataFrame([(1, 0, 7.5, -17.5), (1, 1, 6.5, 17.5), (2, 0, 5.0, 0.5), (2, 1, 5.0, 0.5)], "route_id long, seq int, lat double, lon double")
    out = route.plan(req, land, GRID, config=search.SearchConfig(radius=1, directions=8))
    path = [(r["x"], r["y"]) for r in out.path.where("route_id = 1").orderBy("seq").collect()]
    assert path[0] == (2, 2) and path[-1] == (37, 3) and any(y >= 18 for _, y in path)
    assert out.totals.where("route_id = 1").first()["nm"] > 0
    assert {r["reason"] for r in out.legs.collect()} == {"goal"}
    assert paths.report(out.legs).count() == out.legs.count()
    with pytest.raises(Exception, match="outside the window"):
        route.requests_to_legs(spark.createDataFrame([(1, 0, 80.0, 0.0)], "route_id long, seq int, lat double, lon double"), land, GRID).collect()


def test_streaming_lookups(spark, tmp_path):
    from pelorus.streaming import positions

    rows = spark.sql("select 1L as ship_id, timestamp'2024-01-01 00:10:00' as ts, 10.0D as lat, 20.0D as lon union all select 1L, timestamp'2024-01-01 00:40:00', 12.0D, 20.0D")
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([(7, 10.01, 20.0)], "lane_id int, entry_lat double, entry_lon double")
    for name, df, mode in (("near", positions.lanes_in_reach(live, entries), "append"), ("win", positions.counts_by_window(live), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("near").count() == 1 and spark.table("win").first()["positions"] == 2


@pytest.mark.parametrize(("reach", "share"), [(2, 0.5), (20, 0.97), (70, 0.999), (70, 1.0)])
def test_nudging_over_deep_land_and_off_the_grid(spark, reach, share):
    rng = random.Random(reach)
    land = {(x, y) for x in range(40) for y in range(20) if rng.random() < share} | {(-1, 3), (45, 3)}
    points = [(i, rng.randrange(-6, 46), rng.randrange(-6, 26)) for i in range(200)] + [(900, None, 3), (901, 2, None)]

    def scan(x0, y0):
        wet = lambda x, y: 0 <= x < 40 and 0 <= y < 20 and (x, y) not in land
        if x0 is None or y0 is None or wet(x0, y0):
            return x0, y0
        for r in range(1, reach + 1):
            ring = [(x0 + d, y0 + s) for d in range(-r, r + 1) for s in (r, -r)] + [(x0 + s, y0 + d) for d in range(-r + 1, r) for s in (r, -r)]
            for c in ring:
                if wet(*c):
                    return c
        return x0, y0

    got = spatial.to_water(spark.createDataFrame(points, "point_id int, x int, y int"), spark.createDataFrame(list(land), "x int, y int"), GRID, reach)
    assert {r["point_id"]: (r["x"], r["y"]) for r in got.collect()} == {i: scan(x, y) for i, x, y in points}


def test_nudging_meets_a_cell_of_each_row_once(spark):
    land = spark.range(800).selectExpr("cast(id % 40 as int) as x", "cast(id div 40 as int) as y")
    points = spark.range(3000).selectExpr("cast(id as int) as point_id", "cast(id % 3 as int) + 10 as x", "10 as y")
    assert most_rows(spatial.to_water(points, land, GRID, 30)) <= 3000


@pytest.mark.parametrize(("radius", "share"), [(1, 0.1), (7, 0.01), (20, 0.9)])
def test_nearest_cell_against_all_cells(spark, radius, share):
    rng = random.Random(radius)
    cells = [(x, y) for x in range(40) for y in range(20) if rng.random() < share] + [(-3, -2), (-3, -2)]
    points = [(i, rng.randrange(-6, 46), rng.randrange(-6, 26)) for i in range(200)] + [(900, None, 3)]

    def least(x0, y0):
        d = [(x - x0) ** 2 + (y - y0) ** 2 for x, y in cells if x0 is not None and abs(x - x0) <= radius and abs(y - y0) <= radius]
        return bool(d), math.isqrt(min(d)) if d else None

    got = spatial.nearest_cell(spark.createDataFrame(points, "point_id int, x int, y int"), spark.createDataFrame(cells, "x int, y int"), radius)
    assert {r["point_id"]: (r["close"], r["distance"]) for r in got.collect()} == {i: least(x, y) for i, x, y in points}


def test_nearest_cell_meets_a_place_of_each_row_once(spark):
    cells = spark.range(800).selectExpr("cast(id % 40 as int) as x", "cast(id div 40 as int) as y").where("x <> 11")
    points = spark.range(3000).selectExpr("cast(id as int) as point_id", "cast(id % 3 as int) + 10 as x", "10 as y")
    assert most_rows(spatial.nearest_cell(points, cells)) <= 3000


def test_lane_lookup_against_all_lanes(spark):
    """At the poles and the date line, over equal places and lanes, near and far."""
    rng = random.Random(4)
    place = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180)), (rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(178, 180)), (30.0, 40.0)])
    lanes = [(i, rng.choice(geo.COMPASS), *place()) for i in range(150)] + [(500, "N", None, 3.0), (501, None, 1.0, 3.0), (502, "north", 1.0, 3.0)]
    points = [(i, *place(), float(rng.randrange(0, 361))) for i in range(150)]

    def best(lat, lon, heading, most):
        own, out = int((heading + 11.25) // 22.5) % 16, []
        for i, flow, a, b in lanes:
            rank = next((r for r, k in enumerate((0, -1, 1)) if a is not None and flow == geo.COMPASS[(own + k) % 16]), None)
            nm = search.haversine(lat, lon, a, b) if rank is not None else math.inf
            if nm <= most:
                out.append((round(nm, 3), rank, i))
        return min(out, default=(None, None, None))[2]

    p, starts = spark.createDataFrame(points, "point_id int, lat double, lon double, heading double"), spark.createDataFrame(lanes, "lane_id int, flow string, start_lat double, start_lon double")
    for metres in (50_000.0, 2_000_000.0, 20_000_000.0):
        got = {r["point_id"]: r["lane_id"] for r in spatial.nearest_lane_start(p, starts, metres).collect()}
        expected = {i: best(lat, lon, heading, metres / 1852) for i, lat, lon, heading in points}
        assert got == {i: lane for i, lane in expected.items() if lane is not None}


def test_lane_lookup_meets_near_lanes_only(spark):
    lanes = spark.range(3000).selectExpr("cast(id as int) as lane_id", "'N' as flow", "(id % 60) * 2.0D - 60 as start_lat", "(id div 60) * 7.0D - 175 as start_lon")
    points = spark.range(2000).selectExpr("cast(id as int) as point_id", "(id % 40) * 3.0D - 59 as lat", "(id div 40) * 7.0D - 174 as lon", "0.0D as heading")
    assert most_rows(spatial.nearest_lane_start(points, lanes, 20_000_000.0)) < 500_000  # 81 rows a lane; 6,000,000 pairs are in reach
