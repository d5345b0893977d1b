"""Path search over packed cells.

``guided``: best-first search with lane preferences. One search is a chain of
dependent steps, so a request is one task's work and requests run side by
side; a task gets only the cells of its own window.

``exact``: least costs to all cells of a grid, relaxed until nothing changes,
for small grids and for checking.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.geo import EARTH_NM, KM_PER_DEGREE, KM_PER_NM, lane_factor, ring
from pelorus.grid import GridSpec
from pelorus.operators.raster import FORBIDDEN, LANE, WATER


@dataclass(frozen=True)
class SearchConfig:
    """Settings of a guided search."""

    radius: int = 1
    directions: int | None = 30
    heuristic_weight: float = 1.0
    lane_preference: bool = True
    lane_factor: float = 0.95
    snap_km: float = 0.0
    snap_tolerance: float = 60.0
    max_expansions: int | None = None
    prune: bool = False
    parity_f32: bool = False


# What a step costs, as a share of its length.
ONTO_ENTRY, ALONG_LANE, OFF_ENTRY = 0.1, 0.3, 0.5
RESULT = "route_id long, leg int, seq int, x int, y int, reason string, goal_cost double, expansions long, pushes long, pops long, max_open long"


@dataclass
class Lane:
    entry: tuple[int, int]
    lat: float
    lon: float
    bearing: float
    cells: list[tuple[int, int]]


@dataclass
class Area:
    """The cells a search may look at, as a window of flags and lane directions."""

    grid: GridSpec
    flags: np.ndarray
    u: np.ndarray
    v: np.ndarray
    x0: int = 0
    y0: int = 0
    lanes: list[Lane] = field(default_factory=list)
    #: degrees, the side of the buckets in which lanes are looked up
    side: float = 1.0

    def __post_init__(self) -> None:
        self.buckets: dict[tuple[int, int], list[int]] = {}
        for i, lane in enumerate(self.lanes):
            self.buckets.setdefault(self._bucket(lane.lat, lane.lon), []).append(i)

    def _bucket(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / self.side), math.floor(lon / self.side)

    def lanes_around(self, lat: float, lon: float) -> list[tuple[int, Lane]]:
        """Lanes that may enter within ``side`` degrees, with their numbers."""
        b, c = self._bucket(lat, lon)
        return [(i, self.lanes[i]) for db in (-1, 0, 1) for dc in (-1, 0, 1) for i in self.buckets.get((b + db, c + dc), ())]

    def flag(self, x: int, y: int) -> int:
        x, y = x - self.x0, y - self.y0
        return int(self.flags[y, x]) if 0 <= y < self.flags.shape[0] and 0 <= x < self.flags.shape[1] else 0

    def open(self, x: int, y: int) -> bool:
        f = self.flag(x, y)
        return bool(f & (WATER | LANE)) and (bool(f & LANE) or not f & FORBIDDEN)

    def direction(self, x: int, y: int) -> tuple[float, float]:
        return float(self.u[y - self.y0, x - self.x0]), float(self.v[y - self.y0, x - self.x0])

    def land_within(self, x: int, y: int, reach: int) -> int | None:
        """Whole part of the distance to the nearest cell that is no water, in a square; None if all is water."""
        top, left = max(0, y - self.y0 - reach), max(0, x - self.x0 - reach)
        part = self.flags[top : y - self.y0 + reach + 1, left : x - self.x0 + reach + 1]
        yy, xx = np.nonzero((part & WATER) == 0)
        if not len(yy):
            return None
        return int(math.sqrt(((yy + top + self.y0 - y) ** 2 + (xx + left + self.x0 - x) ** 2).min()))

    def in_sight(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Every cell of the line is open; ties of the line go to the cell not yet left."""
        (ax, ay), (bx, by) = a, b
        dx, dy = bx - ax, by - ay
        n, m = max(abs(dx), abs(dy)), min(abs(dx), abs(dy))
        for i in range(n + 1):
            j = -((-(2 * m * i + n)) // (2 * n)) - 1 if n else 0
            sx, sy = (i, j) if abs(dx) >= abs(dy) else (j, i)
            if not self.open(ax + (sx if dx >= 0 else -sx), ay + (sy if dy >= 0 else -sy)):
                return False
        return True


class Measure:
    """Distances and bearings between cell centres."""

    def __init__(self, grid: GridSpec):
        self.grid = grid

    def latlon(self, x: float, y: float, centre: bool = True) -> tuple[float, float]:
        g, half = self.grid, 0.5 if centre else 0.0
        return g.lat_max - (y + half) / g.height * (g.lat_max - g.lat_min), g.lon_min + (x + half) / g.width * (g.lon_max - g.lon_min)

    def nm(self, a: tuple[int, int], b: tuple[int, int]) -> float:
        (la, lo), (lb, lp) = self.latlon(*a), self.latlon(*b)
        return haversine(la, lo, lb, lp)

    def shift(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        dx, w = b[0] - a[0], self.grid.width
        if self.grid.wraps:
            dx = (dx + w // 2) % w - w // 2
        return dx, b[1] - a[1]

    def bearing(self, a: tuple[int, int], b: tuple[int, int]) -> float | None:
        if a == b:
            return None
        (la, lo), (lb, lp) = self.latlon(*a, centre=False), self.latlon(*b, centre=False)
        p, q, d = math.radians(la), math.radians(lb), math.radians(lp - lo)
        return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    d = (math.radians(lon2 - lon1) + math.pi) % (2 * math.pi) - math.pi
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return 2 * EARTH_NM * math.asin(math.sqrt(min(1.0, a)))


def cosine(ax: float, ay: float, bx: float, by: float) -> float:
    size = math.hypot(ax, ay) * math.hypot(bx, by)
    return max(-1.0, min(1.0, (ax * bx + ay * by) / size)) if size else 0.0


def along_factor(alignment: float, from_lane: bool, factor: float) -> float:
    """Cost factor of a step onto a lane cell, by its agreement with the lane's direction."""
    if from_lane and alignment >= 0:
        for least, share in ((0.9, 0.6), (0.5, 0.7), (0.0, 0.85)):
            if alignment > least:
                return factor * share
        return 0.9
    for least, share in ((-0.2, 1.0), (-0.5, 1.5)):
        if alignment > least:
            return share
    return 10.0


class Guided:
    """One search from start to goal."""

    def __init__(self, area: Area, config: SearchConfig):
        self.area, self.config, self.measure = area, config, Measure(area.grid)
        self.rings: dict[int, list[tuple[int, int]]] = {}
        self.entries: dict[tuple[int, int], Lane] = {}
        self.inside: set[tuple[int, int]] = set()

    def run(self, start: tuple[int, int], goal: tuple[int, int]) -> tuple[list[tuple[int, int]], dict]:
        self.start, self.goal = start, goal
        self.best: dict[tuple[int, int], float] = {start: 0.0}
        self.parent: dict[tuple[int, int], tuple[int, int]] = {}
        self.closed: set[tuple[int, int]] = set()
        self.heap: list[tuple[float, int, tuple[int, int], float]] = []
        self.stats = {"reason": "exhausted", "goal_cost": math.inf, "expansions": 0, "pushes": 0, "pops": 0, "max_open": 0}
        for name, cell in (("invalid_start", start), ("invalid_goal", goal)):
            if not self.area.open(*cell):
                self.stats["reason"] = name
                return [], self.stats
        self._push(start, start, 0.0)
        while self.heap:
            _, _, cell, g = heapq.heappop(self.heap)
            self.stats["pops"] += 1
            if cell in self.closed or g > self.best[cell] + 1e-6:
                continue
            if cell == goal:
                return self._end(cell, g, "goal")
            self.closed.add(cell)
            self.stats["expansions"] += 1
            if self.config.max_expansions and self.stats["expansions"] > self.config.max_expansions:
                return self._end(cell, g, "max_expansions")
            if cell in self.entries:
                self._enter(self.entries[cell], cell)
            for to in self._neighbours(cell):
                if to not in self.closed:
                    self._relax(cell, to, g + self._cost(cell, to))
        return [], self.stats

    def _end(self, cell: tuple[int, int], g: float, reason: str) -> tuple[list[tuple[int, int]], dict]:
        self.stats |= {"reason": reason, "goal_cost": g}
        path = [cell]
        while path[-1] in self.parent and path[-1] != self.start:
            path.append(self.parent[path[-1]])
        return path[::-1], self.stats

    def _push(self, a: tuple[int, int], to: tuple[int, int], g: float) -> None:
        rest = self.measure.shift(to, self.goal)
        step = self.measure.shift(a, to)
        bias = (1 - cosine(*step, *rest)) * 1e-3 if any(step) and any(rest) else 0.0
        self.stats["pushes"] += 1
        heapq.heappush(self.heap, (g + self.config.heuristic_weight * self.measure.nm(to, self.goal) + bias, self.stats["pushes"], to, g))
        self.stats["max_open"] = max(self.stats["max_open"], len(self.heap))

    def _relax(self, a: tuple[int, int], to: tuple[int, int], g: float) -> bool:
        if g >= self.best.get(to, math.inf):
            return False
        self.best[to] = float(np.float32(g)) if self.config.parity_f32 else g
        self.parent[to] = a
        self._push(a, to, g)
        return True

    def _cost(self, a: tuple[int, int], to: tuple[int, int]) -> float:
        base = self.measure.nm(a, to)
        if not self.config.lane_preference:
            return base
        for there, share in ((to in self.entries, ONTO_ENTRY), (to in self.inside, ALONG_LANE), (a in self.entries, OFF_ENTRY)):
            if there:
                return base * share
        if self.area.flag(*to) & LANE:
            u, v = self.area.direction(*to)
            if u or v:
                towards = (cosine(*self.measure.shift(a, to), u, v) + cosine(*self.measure.shift(a, self.goal), u, v)) / 2
                return base * along_factor(towards, bool(self.area.flag(*a) & LANE), self.config.lane_factor)
        return base

    def _enter(self, lane: Lane, cell: tuple[int, int]) -> None:
        """Offer a lane's points one after the other, each from the last one that was better than known."""
        at, g = cell, self.best[cell]
        for to in lane.cells[1:]:
            if self.area.open(*to):
                there = g + self.measure.nm(at, to) * ALONG_LANE
                if self._relax(at, to, there):
                    self.inside.add(to)
                    at, g = to, there

    def _snap(self, cell: tuple[int, int]) -> tuple[int, int] | None:
        """The nearest lane entry in reach on the way to the goal, if it can still be gone to."""
        heading = self.measure.bearing(cell, self.goal)
        if not self.config.snap_km or heading is None:
            return None
        before = self.measure.bearing(self.start, cell)
        if before is not None:
            a, b = math.radians(heading), math.radians(before)
            heading = math.degrees(math.atan2(math.sin(a) + math.sin(b), math.cos(a) + math.cos(b))) % 360
        lat, lon = self.measure.latlon(*cell, centre=False)
        best: tuple[float, int] | None = None
        for i, lane in self.area.lanes_around(lat, lon):
            turn = abs(heading - lane.bearing) % 360
            if math.hypot(lat - lane.lat, lon - lane.lon) <= self.config.snap_km / KM_PER_DEGREE and min(turn, 360 - turn) <= self.config.snap_tolerance:
                km = haversine(lat, lon, lane.lat, lane.lon) * KM_PER_NM
                if km <= self.config.snap_km and (best is None or (km, i) < best):
                    best = (km, i)
        if best is None:
            return None
        lane = self.area.lanes[best[1]]
        if lane.entry == cell or lane.entry in self.closed or not self.area.open(*lane.entry):
            return None
        self.entries[lane.entry] = lane
        return lane.entry

    def _neighbours(self, cell: tuple[int, int]) -> Iterator[tuple[int, int]]:
        snapped = self._snap(cell)
        if snapped is not None:
            yield snapped
            return
        radius = max(1, round(self.config.radius))
        land = self.area.land_within(*cell, radius)
        if land is not None and land < radius:
            radius = max(1, land - 1)
        if self.area.flag(*cell) & LANE:
            radius = min(2, radius)
        if radius not in self.rings:
            self.rings[radius] = ring(radius, self.config.directions)
        rest = self.measure.shift(cell, self.goal)
        least = math.cos(math.radians(120 if math.hypot(*rest) < 80 else 100)) if self.config.prune and any(rest) else -2.0
        for dx, dy in self.rings[radius]:
            if cosine(dx, dy, *rest) < least:
                continue
            x = (cell[0] + dx) % self.area.grid.width if self.area.grid.wraps else cell[0] + dx
            if self.area.open(x, cell[1] + dy) and self.area.in_sight(cell, (x, cell[1] + dy)):
                yield x, cell[1] + dy


#: Side of the square tiles in which cells are sent to the requests.
TILE_SIDE = 64


def packed_tiles(cells: DataFrame) -> DataFrame:
    """tx, ty, at, flags, vectors: a row for each tile of ``cells`` (x, y, flags and optionally u, v); ``at`` is y * side + x in the tile."""
    at = (F.pmod("y", F.lit(TILE_SIDE)) * TILE_SIDE + F.pmod("x", F.lit(TILE_SIDE))).cast("int")
    each = F.collect_list(F.struct(at.alias("at"), F.col("flags").cast("int").alias("flags"))).alias("c")
    has = (F.col("u") != 0) | (F.col("v") != 0) if "u" in cells.columns else F.lit(False)
    u, v = (F.col(c) if "u" in cells.columns else F.lit(0.0) for c in ("u", "v"))
    vectors = F.collect_list(F.when(has, F.struct(at.alias("at"), u.alias("u"), v.alias("v")))).alias("d")
    tiles = cells.groupBy(F.floor(F.col("x") / TILE_SIDE).alias("tx"), F.floor(F.col("y") / TILE_SIDE).alias("ty")).agg(each, vectors)
    return tiles.select("tx", "ty", F.col("c.at").alias("at"), F.col("c.flags").alias("flags"), F.col("d.at").alias("at_v"), F.col("d.u").alias("u"), F.col("d.v").alias("v"))


def guided(requests: DataFrame, cells: DataFrame, grid: GridSpec, config: SearchConfig, lanes: DataFrame | None = None, margin: int = 50) -> DataFrame:
    """Search all legs: rows of ``RESULT``, a row for each point; a failed leg has one row with seq null.

    ``requests``: route_id, leg, x0, y0, x1, y1; ``cells``: x, y, flags and
    optionally u, v; ``lanes``: lane_id, x, y, lat, lon, bearing, cells. A leg
    sees the cells and the lanes that begin in its own window, ``margin`` wider
    than its ends. Both meet it in equi-joins over square tiles; cells come
    packed, a row a tile.
    """
    side = TILE_SIDE
    lo = lambda a, b: F.greatest(F.least(a, b) - margin, F.lit(0))
    hi = lambda a, b, n: F.least(F.greatest(a, b) + margin, F.lit(n - 1))
    req = requests.withColumns({"ax": lo("x0", "x1"), "bx": hi("x0", "x1", grid.width), "ay": lo("y0", "y1"), "by": hi("y0", "y1", grid.height)})
    tiled = req.withColumn("tx", F.explode(F.sequence(F.floor(F.col("ax") / side), F.floor(F.col("bx") / side)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("ay") / side), F.floor(F.col("by") / side))))
    met = tiled.join(packed_tiles(cells), ["tx", "ty"], "left").select("route_id", "leg", "x0", "y0", "x1", "y1", "ax", "bx", "ay", "by", "tx", "ty", "at", "flags", "at_v", "u", "v")
    lane_columns = "lane_id long, x int, y int, lat double, lon double, bearing double, cells array<struct<x:int,y:int>>"
    known = lanes if lanes is not None else requests.sparkSession.createDataFrame([], lane_columns)
    own = known.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)}).join(tiled.select("route_id", "leg", "ax", "bx", "ay", "by", "tx", "ty"), ["tx", "ty"])
    own = own.where(F.col("x").between(F.col("ax"), F.col("bx")) & F.col("y").between(F.col("ay"), F.col("by")))
    turn = F.row_number().over(Window.partitionBy("route_id", "leg").orderBy("lane_id"))
    own = own.select(F.col("route_id").alias("of_route"), F.col("leg").alias("of_leg"), turn.alias("turn"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "lat", "lon", "bearing", F.col("cells.x").alias("xs"), F.col("cells.y").alias("ys"))

    def search(pdf: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        shape = (int(r["by"] - r["ay"]) + 1, int(r["bx"] - r["ax"]) + 1)
        lanes_ = [Lane((int(w.x), int(w.y)), w.lat, w.lon, w.bearing, list(zip(map(int, w.xs), map(int, w.ys), strict=True))) for w in ways.sort_values("turn").itertuples()]
        area = Area(grid, np.zeros(shape, dtype=np.uint8), np.zeros(shape), np.zeros(shape), int(r["ax"]), int(r["ay"]), lanes_, max(config.snap_km, 1.0) / KM_PER_DEGREE)

        def put(target: np.ndarray, tile, at, values) -> None:
            y, x = np.divmod(np.asarray(at, dtype=int), side)
            y, x = y + int(tile.ty) * side - area.y0, x + int(tile.tx) * side - area.x0
            inside = (y >= 0) & (y < shape[0]) & (x >= 0) & (x < shape[1])
            target[y[inside], x[inside]] = np.asarray(values)[inside]

        for tile in pdf[pdf["at"].notna()].itertuples():
            put(area.flags, tile, tile.at, tile.flags)
            put(area.u, tile, tile.at_v, tile.u)
            put(area.v, tile, tile.at_v, tile.v)
        path, stats = Guided(area, config).run((int(r["x0"]), int(r["y0"])), (int(r["x1"]), int(r["y1"])))
        rows = [(i, x, y) for i, (x, y) in enumerate(path)] or [(None, None, None)]
        out = pd.DataFrame(rows, columns=["seq", "x", "y"]).astype("Int32")
        return out.assign(route_id=int(r["route_id"]), leg=int(r["leg"]), **stats)[["route_id", "leg", "seq", "x", "y", *stats]]

    return met.groupBy("route_id", "leg").cogroup(own.groupBy("of_route", "of_leg")).applyInPandas(search, RESULT)


def routes_of_legs(found: DataFrame) -> DataFrame:
    """Legs of the routes whose every leg was found."""
    good = found.groupBy("route_id").agg(F.bool_and(F.col("reason") == "goal").alias("ok")).where("ok").select("route_id")
    return found.where("seq is not null").join(good, "route_id", "left_semi")


def step_cost(base: Column, from_flags: Column, to_flags: Column, u: Column, v: Column, step: tuple[Column, Column], goal: tuple[Column, Column], factor: float = 0.95) -> Column:
    """Cost of a step of length ``base`` by the lane mask: ``u``, ``v`` is the direction of the cell stepped on, ``goal`` the way to the goal from the cell left."""
    length = lambda a, b: F.sqrt((a * a + b * b).cast("double"))
    size = length(u, v)
    agrees = lambda d: F.when(length(*d) * size > 0, (d[0] * u + d[1] * v) / (length(*d) * size)).otherwise(F.lit(0.0))
    on_lane = lambda f: F.coalesce(f.cast("int"), F.lit(0)).bitwiseAND(LANE) != 0
    share = lane_factor((agrees(step) + agrees(goal)) / 2, on_lane(from_flags), factor)
    return base * F.when(on_lane(to_flags) & F.coalesce(size > 0, F.lit(False)), share).otherwise(F.lit(1.0))


def exact(requests: DataFrame, water: DataFrame, grid: GridSpec) -> DataFrame:
    """Least cost in steps of one cell, eight ways, until no cost changes: route_id, x, y, cost (nautical miles).

    A route is one task's work; its cells meet it in an equi-join over square tiles.
    """
    side = 256
    tiles = lambda n: F.sequence(F.lit(0), F.lit((n - 1) // side))
    tiled = requests.select("route_id", "x0", "y0").distinct().withColumn("tx", F.explode(tiles(grid.width))).withColumn("ty", F.explode(tiles(grid.height)))
    cells = water.select("x", "y").distinct().where(grid.holds(F.col("x"), F.col("y")))
    met = tiled.join(cells.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)}), ["tx", "ty"]).select("route_id", "x0", "y0", "x", "y")
    w, h = grid.width, grid.height
    lat = np.radians(grid.lat_max - (np.arange(h) + 0.5) / h * (grid.lat_max - grid.lat_min))
    wide = math.radians((grid.lon_max - grid.lon_min) / w)

    def nm(dx: int, dy: int) -> np.ndarray:
        """Nautical miles of the step from each row that has a row to step to."""
        lo, hi = max(0, -dy), h - max(0, dy)
        one, two = lat[lo:hi], lat[lo + dy : hi + dy]
        a = np.sin((two - one) / 2) ** 2 + np.cos(one) * np.cos(two) * math.sin(dx * wide / 2) ** 2
        return (2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) * EARTH_NM)[:, None]

    steps = [(dx, dy, nm(dx, dy)) for dx, dy in ring(1, 8)]

    def relax(pdf: pd.DataFrame) -> pd.DataFrame:
        free = np.zeros((h, w), dtype=bool)
        free[pdf["y"].to_numpy(dtype=int), pdf["x"].to_numpy(dtype=int)] = True
        cost = np.full((h, w), np.inf)
        starts = pdf[["x0", "y0"]].drop_duplicates().query(f"0 <= x0 < {w} and 0 <= y0 < {h}")
        cost[starts["y0"].to_numpy(dtype=int), starts["x0"].to_numpy(dtype=int)] = 0.0
        cost[~free] = np.inf
        while True:
            new = cost.copy()
            for dx, dy, miles in steps:
                y0, y1, x0, x1 = max(0, -dy), h - max(0, dy), max(0, -dx), w - max(0, dx)
                at = new[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
                np.minimum(at, cost[y0:y1, x0:x1] + miles, out=at)
            new[~free] = np.inf
            if (new == cost).all():
                break
            cost = new
        y, x = np.nonzero(np.isfinite(cost))
        return pd.DataFrame({"route_id": pdf["route_id"].iloc[0], "x": x, "y": y, "cost": cost[y, x]})

    return met.groupBy("route_id").applyInPandas(relax, "route_id long, x int, y int, cost double")
