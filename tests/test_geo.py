"""Golden values of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from pelorus.functions import geo, tags
from pelorus.grid import GridSpec

ROUTE = [(54.1, 8.5), (36.0, -6.0)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


def test_grid_of_the_example_route(spark):
    g = GridSpec.around(ROUTE, 1.0)
    assert (g.lat_min, g.lat_max, g.lon_min, g.lon_max, g.width, g.height) == (26.0, 64.1, -16.0, 18.5, 2070, 2286)
    assert tuple(value(spark, g.to_pixel(*lits(54.1, 8.5)))) == (1470, 599)
    assert tuple(value(spark, g.to_pixel(*lits(36, -6)))) == (600, 1685)
    assert tuple(value(spark, g.to_latlon(F.lit(1470), F.lit(599)))) == pytest.approx((54.11666666666666, 8.5), abs=1e-12)
    assert value(spark, g.to_pixel(*lits(70, 0))) is None
    assert g.search_radius() == 3 and g.buffer_pixels(1.0) == 1


@pytest.mark.parametrize(("pair", "nm", "degrees"), [((54.1, 8.5, 36, -6), 1243.213019212149, 214.9521953196465), ((30, 170, 30, -170), 1038.5997157479082, 84.96163122670248)])
def test_distance_and_bearing(spark, pair, nm, degrees):
    assert value(spark, geo.nm_distance(*lits(*pair))) == pytest.approx(nm, abs=1e-6)
    assert value(spark, geo.haversine_nm(*lits(*pair))) == pytest.approx(nm, abs=1e-6)
    assert value(spark, geo.bearing(*lits(*pair))) == pytest.approx(degrees, abs=1e-9)


@pytest.mark.parametrize("lat", [-74.6, -66.2, -64.8, -26.3, -20.7, -2.5, 0.0, 90.0])
def test_equal_points_are_not_apart(spark, lat):
    assert value(spark, geo.nm_distance(*lits(lat, 12.3, lat, 12.3))) == pytest.approx(0.0, abs=1e-3)


def test_compass(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 11.25, 348.75, 360.0, 110.0, 120.0, 361.0)], "d double")
    assert [r[0] for r in d.select(geo.compass(F.col("d"))).collect()] == ["N", "NNE", "N", "N", "ESE", "ESE", None]
    around = value(spark, geo.sectors_around(F.lit(0.0)))
    assert [tuple(s) for s in around] == [(0, "N"), (1, "NNW"), (2, "NNE")]


def test_bearings_together(spark):
    assert value(spark, geo.mean_bearing(*lits(350, 20))) == pytest.approx(5.0)
    assert value(spark, geo.aligned(*lits(350, 20), 30)) and not value(spark, geo.aligned(*lits(350, 21), 30))
    assert value(spark, geo.aligned(F.lit(None).cast("double"), F.lit(3.0), 30)) is False


def test_rings():
    assert [len(geo.ring(r, 30)) for r in (1, 2, 3, 14, 15)] == [8, 16, 19, 30, 30]
    assert geo.ring(2, 30)[:5] == [(2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]


def test_wrapping(spark):
    assert value(spark, geo.delta_x(F.lit(3), F.lit(358), 360, True)) == -5
    assert value(spark, geo.delta_x(F.lit(3), F.lit(358), 360, False)) == 355
    assert value(spark, geo.wrap_x(F.lit(-2), 360, True)) == 358


@pytest.mark.parametrize(("alignment", "from_lane", "share"), [(0.95, True, 0.57), (0.8, True, 0.665), (0.6, True, 0.665), (0.3, True, 0.8075), (0.0, True, 0.9), (0.95, False, 1.0), (-0.1, True, 1.0), (-0.3, True, 1.5), (-0.7, False, 10.0)])
def test_lane_factor(spark, alignment, from_lane, share):
    from pelorus.operators.search import along_factor

    assert value(spark, geo.lane_factor(F.lit(alignment), F.lit(from_lane), 0.95)) == pytest.approx(share)
    assert along_factor(alignment, from_lane, 0.95) == pytest.approx(share)


def test_bias_is_zero_straight_ahead(spark):
    assert value(spark, geo.bearing_bias(*lits(1, 0, 5, 0))) == pytest.approx(0.0)
    assert value(spark, geo.bearing_bias(*lits(-1, 0, 5, 0))) == pytest.approx(2e-3)


def test_the_three_tag_readings_differ(spark):
    direct, parsed, raw = F.lit(None).cast("string"), F.create_map(F.lit("name"), F.lit("x")), F.lit('"seamark:type"=>"separation_lane"')
    assert value(spark, tags.type_for_mask(direct, parsed, raw)) == "separation_lane"
    assert value(spark, tags.type_for_index(direct, parsed, raw)) is None
    assert value(spark, tags.type_for_overlay(direct, parsed, raw)) == "separation_lane"
    none = F.lit(None)
    assert value(spark, tags.type_for_mask(direct, none.cast("map<string,string>"), none.cast("string"))) == "unknown"
    escaped = F.lit(r"\"seamark:type\"=>\"area_to_avoid\"")
    assert value(spark, tags.type_for_mask(direct, none.cast("map<string,string>"), escaped)) == "unknown"
    assert value(spark, tags.tags_of_text(F.lit('"a"=>"1","b"=>"2","a"=>"3"'))) == {"a": "3", "b": "2"}


def test_sizes_in_rows_match_sizes_of_values(spark):
    from pelorus.grid import target_size, target_size_columns

    got = value(spark, target_size_columns(*lits(26, 64.1, -16, 18.5), 1.0))
    assert tuple(got) == target_size(26, 64.1, -16, 18.5, 1.0)
    assert math.isclose(GridSpec.globe().cropped_radius(2.0), 2.0)
