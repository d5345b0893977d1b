"""Every driver query against DuckDB on the smallest tables, and its plan where it matters."""

import pytest

from shared import SF, against_duckdb
from pelorus.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, name):
    ours, theirs = against_duckdb(spark, QUERIES[name], ORACLE_SQL[name])
    assert ours == theirs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entries_in_reach", "nearest_lane", "nearest_land", "tile_overlap"])
def test_range_joins_have_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lane_lookup_sends_nothing_through_the_driver(spark):
    """Points and lanes are small files here, but each lane is in many cubes, and a broadcast of them grows with the table."""
    df = QUERIES["nearest_lane"](spark, SF)
    assert "Broadcast" not in plan_of(df)
    df.collect()
    assert "Broadcast" not in plan_of(df)


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["land_cells"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan and "EqualTo(event_type,error)" in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bearings_between_antipodes(spark, tmp_path):
    """Every cell and its antipode: the last bits of sines and cosines decide there."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    key = {(k * 7919 % 200, k // 200 * 37 % 100): k for k in range(20_000)}
    pairs = [(k + 20_000 * (k % 2), key[(x + 100 - k % 2 * 100) % 200, 100 - y]) for (x, y), k in key.items() if y]
    pq.write_table(pa.table({"o_orderkey": [a for a, _ in pairs], "o_custkey": [b for _, b in pairs]}), tmp_path / "orders.parquet")
    ours, theirs = against_duckdb(spark, QUERIES["pixel_bearings"], ORACLE_SQL["pixel_bearings"], tmp_path)
    assert ours == theirs and len(ours) == 19_800 and any(not r[0].startswith("null") for r in ours)
