"""Where the tables are, and comparison with DuckDB."""

from pathlib import Path

SF = "/root/testdata/sf0.001"


def same_rows(frame):
    """Rows as sorted tuples of text, columns by name, one form for every null and whole number."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) and abs(v) < 2**53 else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def against_duckdb(spark, query, sql, sf=SF):
    """Both sides' rows, sorted, with columns by name."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    return same_rows(ours), same_rows(theirs)


def write_lanes(folder, name="TSS_Lanes_ESE.geojson"):
    """A lane file with three lanes, one without a direction, and a closed area."""
    import json

    def feature(i, kind, points, flow=None, parsed=True, shape="LineString"):
        p = {"osm_id": str(i), "z_order": 0, "other_tags": f'"seamark:type"=>"{kind}"'}
        if parsed:
            p["parsed_other_tags"] = {"seamark:type": kind}
        if flow:
            p["tss_flow_cardinal"] = flow
        return {"type": "Feature", "properties": p, "geometry": {"type": shape, "coordinates": points}}

    box = [[-3.0, 3.0], [-1.0, 3.0], [-1.0, 5.0], [-3.0, 5.0], [-3.0, 3.0]]
    features = [
        feature(1, "separation_lane", [[0.1, 2.2], [1.1, 2.2], [1.6, 1.7]], "ESE"),
        feature(2, "separation_lane", [[2.0, -2.0], [3.0, -2.5]], "ESE"),
        feature(3, "separation_lane", [[30.0, 2.0], [4.0, 4.0], [4.5, 4.0]], None, parsed=False),
        feature(4, "area_to_avoid", box),
        feature(5, "separation_boundary", [[[-4.0, -4.0], [-4.0, -3.0]], [[-3.0, -4.0], [-3.0, -3.0]]], shape="MultiLineString"),
    ]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (folder / "other.geojson").write_text(json.dumps(features[3:]))
    return folder


def most_rows(df):
    """Run the frame; the most rows that any node of its plan gave."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *[walk(plan.children().apply(i)) for i in range(plan.children().size())]])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())
