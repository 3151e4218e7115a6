"""What spatial queries meet follows from their results, and work is dealt out though a table is read by one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from atlaspark.operators import spatial
from test_spatial import frame, km


@pytest.fixture
def met(monkeypatch):
    """Rows that met by cell, and the parts that they were in, of each join."""
    seen, join = [], spatial.met_by_cell

    def counted(a, b):
        rows = join(a, b)
        seen.append((rows.count(), rows.select(F.spark_partition_id()).distinct().count()))
        return rows

    monkeypatch.setattr(spatial, "met_by_cell", counted)
    return seen


def crowd(spark, n, seed, key="doc_id", spread=0.1):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, spread), r.uniform(0, spread)) for i in range(n)]
    return rows, frame(spark, rows, key)


def test_nearest_meets_few_in_a_crowd(spark, met):
    rows, objects = crowd(spark, 4000, 1)
    asked, points = crowd(spark, 200, 2, "query_id")
    got = {(x.query_id, x["rank"]): x.doc_id for x in spatial.nearest(points, objects, 3).collect()}
    for q, lat, lon in asked[:20]:
        want = sorted((km(lat, lon, b, c), i) for i, b, c in rows)[:3]
        assert [got[q, n + 1] for n in range(3)] == [i for _, i in want]
    assert len(got) == 600 and sum(n for n, _ in met) < 200 * 300
    assert max(parts for _, parts in met) > 1


def test_nearby_meets_few_in_a_crowd(spark, met):
    rows, objects = crowd(spark, 4000, 3)
    asked, points = crowd(spark, 200, 4, "query_id")
    objects = objects.withColumn("features", F.array(F.concat(F.lit("k="), F.col("doc_id") % 2)))
    got = {(x.query_id, x["rank"]): x.doc_id for x in spatial.nearby(points, objects, "k=1", 2, 8.0, 1).collect()}
    for q, lat, lon in asked[:20]:
        want = sorted((d, i) for i, b, c in rows if i % 2 and (d := km(lat, lon, b, c)) <= 8.0)[1:3]
        assert [got.get((q, n + 2)) for n in range(len(want))] == [i for _, i in want]
    assert sum(n for n, _ in met) < 200 * 300


def test_range_is_dealt_out(spark, met):
    rows, objects = crowd(spark, 2000, 5)
    asked, points = crowd(spark, 100, 6, "query_id")
    got = {(x.query_id, x.doc_id) for x in spatial.within_radius(points, objects.coalesce(1), 2.0).collect()}
    assert got == {(q, i) for q, a, b in asked for i, c, d in rows if km(a, b, c, d) <= 2.0}
    assert met[0][0] < 3 * len(got) and met[0][1] > 1


def test_overlaps_of_all_sizes(spark):
    r = random.Random(7)
    box = lambda n: (n, lat := r.uniform(-80, 80), lon := r.uniform(-170, 170), lat + (s := 10 ** r.uniform(-3, 1.5)), lon + s * r.random())
    a, b = [box(n) for n in range(200)], [box(n) for n in range(200)]
    schema = "id long, min_lat double, min_lon double, max_lat double, max_lon double"
    found = spatial.overlapping(spark.createDataFrame(a, schema).coalesce(1), spark.createDataFrame(b, schema).coalesce(1))
    want = {(x[0], y[0]) for x in a for y in b if x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4]}
    rows = found.collect()
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert spatial.overlapping(spark.createDataFrame([], schema), spark.createDataFrame(b, schema)).count() == 0


def test_streets_meet_few_in_a_crowd(spark, met):
    r = random.Random(8)
    ends = lambda lat, lon: ((lat - 0.002, lon - 0.004), (lat + 0.002, lon + 0.004))
    streets = [(i, lat := r.uniform(0, 0.03), lon := r.uniform(0, 0.03), *ends(lat, lon)) for i in range(400)]
    streets.append((400, 0.0, 0.015, (0.0, -1.5), (0.0, 1.5)))  # meets points by its middle
    table = spark.createDataFrame([(i, "", *x) for i, *x in streets], "street_id long, name string, mid_lat double, mid_lon double, first struct<lat:double,lon:double>, last struct<lat:double,lon:double>")
    asked, points = crowd(spark, 400, 9, "query_id", 0.03)
    got = {x.query_id: x for x in spatial.nearest_street(points, table).collect()}
    joined = sum(n for n, _ in met)
    assert joined < 400 * 401 / 2

    def planar(lat, lon, a, b):
        t = ((lat - a[0]) * (b[0] - a[0]) + (lon - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)
        t = min(1, max(0, t))
        return math.hypot(lat - a[0] - t * (b[0] - a[0]), lon - a[1] - t * (b[1] - a[1])) * spatial.KM_PER_DEGREE

    half = 1 / spatial.KM_PER_DEGREE / math.sqrt(2) + 0.0001
    for q, lat, lon in asked:
        near = [planar(lat, lon, a, b) for _, y, x, a, b in streets if abs(y - lat) < half and abs(x - lon) < half]
        assert (q in got) == bool(near) and (not near or got[q].distance == pytest.approx(min(near), abs=2e-4))


def test_lookup_meets_few_in_a_crowd(spark, met):
    rows, _ = crowd(spark, 3000, 10, spread=0.03)
    objects = spark.createDataFrame([(i, a, b, []) for i, a, b in rows], "doc_id long, lat double, lon double, geom array<struct<lat:double,lon:double>>")
    asked, points = crowd(spark, 300, 11, "query_id", 0.03)
    got = {x.query_id: x.doc_id for x in spatial.reverse_geocode(points, objects).collect()}
    for q, lat, lon in asked:
        assert got[q] == min((km(lat, lon, b, c), i) for i, b, c in rows)[1]
    assert sum(n for n, _ in met) < 300 * 100
