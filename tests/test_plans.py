"""Stored rasters, layers and the command line."""

import numpy as np
import pytest

from pelorus.grid import GridSpec
from pelorus.plans import layers, rasters
from pelorus.sources import files, geojson


def test_land_of_a_window(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.tiles, "__defaults__", (None, 40))
    image = np.zeros((40, 40), dtype=np.uint8)
    image[10:20, 10:20] = 255
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "world.B1.png").write_bytes(image.tobytes())
    rasters.store_tiles(spark, str(tmp_path / "in"), lambda b: np.frombuffer(b, dtype=np.uint8).reshape(40, 40), str(tmp_path / "out"))
    mosaic = GridSpec.globe(160, 80)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    grid = GridSpec(0.0, 90.0, -90.0, 0.0, 20, 20)
    got = {(r["x"], r["y"]) for r in rasters.window_land(spark, str(tmp_path / "out"), grid, mosaic).collect()}
    assert got == {(x, y) for x in range(5, 10) for y in range(5, 10)}
    land, own = rasters.route_land(spark, str(tmp_path / "out"), [(60.0, -60.0), (50.0, -50.0)], 1.0, 10.0, mosaic)
    assert land.count() > 0 and own.width >= 100


def test_water_of_one_image(spark, tmp_path):
    image = np.zeros((40, 80), dtype=np.uint8)
    image[10:20, 40:60] = 255
    (tmp_path / "world.raw").write_bytes(image.tobytes())
    decode = lambda b: np.frombuffer(b, dtype=np.uint8).reshape(40, 80)
    water, grid = rasters.image_water(spark, str(tmp_path), decode, GridSpec.globe(80, 40), 0.0, 95.0, -90.0, 90.0, 40, 20)
    assert (grid.lat_max, grid.width, grid.height) == (90.0, 40, 20)
    land = {(x, y) for x in range(20, 40) for y in range(10, 20)}
    assert {(r["x"], r["y"]) for r in water.collect()} == {(x, y) for x in range(40) for y in range(20)} - land
    half, _ = rasters.image_water(spark, str(tmp_path), decode, GridSpec.globe(80, 40), 0.0, 90.0, -90.0, 90.0, 20, 10)
    assert half.count() == 200 - 10 * 5 - 15  # the cells around land are gray too


def test_layers(spark):
    f = spark.createDataFrame(
        [(1, "Feature", {"seamark:type": "separation_lane"}, ("LineString", "[[0,1],[2,3],[4,5],[6,7]]")), (2, "Feature", {"seamark:type": "separation_line"}, ("MultiLineString", "[[[0,1],[2,3]],[[9,9]]]")), (3, "Feature", {}, ("Point", "[0,0]"))],
        "feature_id int, type string, properties map<string,string>, geometry struct<type:string,coordinates:string>",
    )
    rows = layers.lane_layer(f).collect()
    assert {(r["feature_id"], r["layer"]) for r in rows} == {(1, "lane"), (2, "boundary")}
    lane = next(r for r in rows if r["feature_id"] == 1)
    assert tuple(lane["arrow"]["from"]) == (5.0, 4.0) and tuple(lane["arrow"]["to"]) == (7.0, 6.0)
    assert {r["layer"]: r["lines"] for r in layers.layer_counts(layers.lane_layer(f)).collect()} == {"lane": 1, "boundary": 2}
    path = spark.createDataFrame([(1, 0, 0, 0, True), (1, 1, 5, 5, True), (1, 2, 9, 9, False)], "route_id int, seq int, x int, y int, in_lane boolean")
    assert [r["lane_leg"] for r in layers.path_layer(path).orderBy("seq").collect()] == [True, False]
    assert geojson.lane_index(f).count() == 1


@pytest.mark.parametrize("args", [[], ["what", "x"], ["feature"]])
def test_wrong_calls(args, capsys):
    from pelorus.__main__ import main

    assert main(args) == 2 and "pelorus" in capsys.readouterr().out
