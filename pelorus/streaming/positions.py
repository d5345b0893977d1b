"""Live positions: lane lookups and windowed distance sailed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators import spatial


def lanes_in_reach(positions: DataFrame, entries: DataFrame, radius_km: float = 10.0) -> DataFrame:
    """Stream-static join of positions (ship_id, ts, lat, lon) with lane entries in reach; stateless."""
    return spatial.entries_in_reach(positions, entries, radius_km)


def counts_by_window(positions: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Positions and mean place of each ship in event-time windows; later rows than ``late`` are dropped."""
    by = positions.withWatermark("ts", late).groupBy(F.window("ts", width), "ship_id")
    return by.agg(F.count("*").alias("positions"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
