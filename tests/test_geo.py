import math

import pytest
from pyspark.sql import functions as F

from atlaspark.functions import geo


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


PAIRS = [
    (-7.557155997491524, 110.77170252731288, -7.550209300671982, 110.78942094938256, 2.100301),
    (-7.546196863318374, 110.7775170972345, -7.550209300671982, 110.78942094938256, 1.385956),
    (-7.759889166547908, 110.36689459108496, -7.760335932763678, 110.37671195413539, 1.082784),
    (-7.700002453207869, 110.37712514761436, -7.760335932763678, 110.37671195413539, 6.708931),
]


@pytest.mark.parametrize("a,b,c,d,km", PAIRS)
def test_haversine(spark, a, b, c, d, km):
    assert one(spark, geo.haversine(a, b, c, d)) == pytest.approx(km, abs=1e-5)


def test_destination(spark):
    for bearing, lat, lon in ((45, -6.222145288, 106.825506896), (225, -6.226596703, 106.821029085)):
        got = geo.destination(-6.224371, 106.823268, bearing, 0.35)
        assert one(spark, got[0]) == pytest.approx(lat, abs=1e-8)
        assert one(spark, got[1]) == pytest.approx(lon, abs=1e-8)


def ring(*points):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])


@pytest.mark.parametrize("p,plain,boxed", [((2, 2), True, True), ((9, 9), False, True), ((11, 1), False, False)])
def test_point_in_triangle(spark, p, plain, boxed):
    triangle = ring((0, 0), (0, 10), (10, 0), (0, 0))
    assert one(spark, geo.point_in_polygon(*p, triangle)) is plain
    assert one(spark, geo.point_in_polygon(*p, triangle, True)) is boxed


def test_empty_ring(spark):
    empty = F.array().cast("array<struct<lat:double,lon:double>>")
    assert one(spark, geo.point_in_polygon(1, 1, empty)) is False
    assert one(spark, geo.nearest_on_ring(1, 1, empty)) is None


def test_line_crosses_circle(spark):
    assert one(spark, geo.line_crosses_circle(0.0, -0.1, 0.0, 0.1, 0.0, 0.0, 1.0)) is True
    assert one(spark, geo.line_crosses_circle(0.1, -0.1, 0.1, 0.1, 0.0, 0.0, 1.0)) is False
    assert one(spark, geo.line_crosses_circle(0.0, 0.0, 0.001, 0.0, 0.0, 0.0, 1.0)) is False  # inside all along
    assert one(spark, geo.line_crosses_circle(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)) is False  # no length


def test_projection(spark):
    a = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    b = F.struct(F.lit(0.0).alias("lat"), F.lit(1.0).alias("lon"))
    mid = one(spark, geo.project_to_segment(0.2, 0.4, a, b))
    assert (mid.lat, mid.lon) == pytest.approx((0.0, 0.4), abs=1e-9)
    assert tuple(one(spark, geo.project_to_segment(0.2, -0.4, a, b))) == (0.0, 0.0)
    assert tuple(one(spark, geo.project_to_segment(0.2, 5.0, a, b))) == (0.0, 1.0)
    assert tuple(one(spark, geo.project_to_segment(0.2, 5.0, a, a))) == (0.0, 0.0)


def test_strict_overlap(spark):
    box = lambda lo, hi: F.struct(F.lit(lo).alias("min_lat"), F.lit(lo).alias("min_lon"), F.lit(hi).alias("max_lat"), F.lit(hi).alias("max_lon"))
    assert one(spark, geo.boxes_overlap(box(0.0, 1.0), box(0.5, 2.0))) is True
    assert one(spark, geo.boxes_overlap(box(0.0, 1.0), box(1.0, 2.0))) is False
    assert one(spark, geo.box_distance(box(0.0, 1.0), 0.5, 0.5)) == 0.0
    assert one(spark, geo.box_distance(box(0.0, 1.0), 2.0, 0.5)) == pytest.approx(6371 * math.pi / 180, rel=1e-9)


def test_upper_median(spark):
    assert one(spark, geo.upper_median(F.array(*map(F.lit, [4.0, 1.0, 3.0, 2.0])))) == 3.0
    assert one(spark, geo.upper_median(F.array().cast("array<double>"))) is None
