import math
import random

import pytest
from pyspark.sql import functions as F

from atlaspark.operators import enrich, spatial

PLANTED = [
    (7, -7.546392935195944, 110.77718220472673), (6, -7.5559986670115675, 110.79466621171177), (5, -7.555869730414206, 110.80500875243253),
    (4, -7.571289544570394, 110.8301500772816), (3, -7.7886707815273155, 110.361625035987), (2, -7.8082872068169475, 110.35793427899466),
    (1, -7.759889166547908, 110.36689459108496),
]


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = (1 - math.cos(c - a)) / 2 + math.cos(a) * math.cos(c) * (1 - math.cos(d - b)) / 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, max(0, h))))


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame([(i, float(a), float(b)) for i, a, b in rows], f"{key} long, lat double, lon double")


def test_nearest(spark):
    r = random.Random(1)
    far = [(1000 + n, r.uniform(-6.107, -5.995), r.uniform(106.131, 107.051)) for n in range(500)]
    objects = frame(spark, PLANTED + far)
    got = spatial.nearest(frame(spark, [(0, -7.548263971398246, 110.78226484631368)], "query_id"), objects, 5).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [7, 6, 5, 4, 1]
    got = spatial.nearest(frame(spark, [(0, 80.0, 10.0)], "query_id"), frame(spark, PLANTED), 9).collect()
    assert len(got) == 7  # fewer objects than asked for


def test_radius_matches_brute_force_everywhere(spark):
    r = random.Random(2)
    objects = [(n, r.choice([r.uniform(-90, 90), r.uniform(88, 90), r.uniform(-1, 1)]), r.choice([r.uniform(-180, 180), r.uniform(179, 180), r.uniform(-180, -179)])) for n in range(400)]
    points = [(n, r.choice([r.uniform(-90, 90), 89.9, 0.0]), r.choice([r.uniform(-180, 180), 179.99, -179.99])) for n in range(25)]
    for reach in (30.0, 900.0, 15_000.0):
        got = {(x.query_id, x.doc_id) for x in spatial.within_radius(frame(spark, points, "query_id"), frame(spark, objects), F.lit(reach), max(0.05, reach / 111)).collect()}
        assert got == {(p, o) for p, a, b in points for o, c, d in objects if km(a, b, c, d) <= reach}


def test_offset_past_the_end(spark):
    objects = frame(spark, PLANTED).withColumn("features", F.array(F.lit("a=b")))
    point = frame(spark, [(0, -7.55, 110.79)], "query_id")
    page = lambda **k: [x.doc_id for x in spatial.nearby(point, objects, k=2, radius=10.0, **k).orderBy("rank").collect()]
    assert len(page()) == 2 and page(offset=50) == [] and page(offset=50, strict_offset=False) == page()
    assert page(feature="a=b") == page() and page(feature="a") == []
    with pytest.raises(ValueError):
        spatial.nearby(point, objects, radius=0)


def test_overlap_join_matches_brute_force(spark):
    r = random.Random(3)
    box = lambda n, s: (n, lat := r.uniform(-1, 1), lon := r.uniform(-1, 1), lat + r.uniform(0, s), lon + r.uniform(0, s))
    a, b = [box(n, 0.1) for n in range(150)], [box(n, 0.4) for n in range(60)]
    schema = "id long, min_lat double, min_lon double, max_lat double, max_lon double"
    rows = spatial.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    want = {(x[0], y[0]) for x in a for y in b if x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4]}
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want


def test_reverse_geocode(spark):
    geom = "array<struct<lat:double,lon:double>>"
    rows = [(1, 0.0, 0.0, [(0.0, -0.001), (0.0, 0.001)]), (2, 0.001, 0.0, []), (3, 5.0, 5.0, [])]
    objects = spark.createDataFrame(rows, f"doc_id long, lat double, lon double, geom {geom}")
    got = {x.query_id: x for x in spatial.reverse_geocode(frame(spark, [(0, 0.0001, 0.0005), (1, 0.00099, 0.0), (2, 40.0, 40.0)], "query_id"), objects).collect()}
    assert got[0].doc_id == 1 and (got[0].lat, got[0].lon) == pytest.approx((0.0, 0.0005), abs=1e-9)
    assert got[1].doc_id == 2 and 2 not in got
    docs = spark.createDataFrame([(1, "", "x, "), (2, "name", "y")], "doc_id long, name string, address string")
    named = {x.doc_id: x.name for x in spatial.reverse_geocoded_documents(spatial.reverse_geocode(frame(spark, [(0, 0.0001, 0.0005)], "query_id"), objects), docs).collect()}
    assert named == {1: "0.0000,0.0005,x, "}


def test_upsert_and_delete(spark):
    changed = spatial.upsert(frame(spark, PLANTED), frame(spark, [(7, 1, 1), (9, 2, 2)]))
    assert sorted(x.doc_id for x in changed.collect()) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert spatial.delete(changed, frame(spark, [(7, 0, 0)])).count() == 7


def test_place_documents(spark):
    way = lambda i, name, *nodes, **t: (i, list(nodes), {"name": name, "building": "yes"} | t)
    ways = [
        way(1, "Hall", 1, 2), way(2, "hall", 1, 2), way(3, "Long Road", 3, 4, **{"highway": "primary"}), way(4, "Gone", 99),
        (5, [1, 2], {"building": "yes"}), (6, [3, 4], {"name": "No tag"}),
    ]
    node = lambda i, lat, lon, **t: (i, lat, lon, t)
    nodes = [node(1, 0.0, 0.0), node(2, 0.002, 0.002), node(3, 0.0, 0.001), node(4, 0.001, 0.002), node(5, 0.001, 0.001, name="HALL"), node(6, 0.0015, 0.0012, name="Shop", shop="tea", **{"addr:housenumber": "7"}), node(7, 9.0, 9.0, historic="yes")]
    regions = spark.createDataFrame([("r", "PROV", "dist", "sub", "vil", [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)])], "region_id string, province string, district string, sub_district string, village string, ring array<struct<lat:double,lon:double>>")
    docs = enrich.place_documents(spark.createDataFrame(ways, "id long, node_ids array<long>, tags map<string,string>"), spark.createDataFrame(nodes, "id long, lat double, lon double, tags map<string,string>"), regions)
    got = [(x.doc_id, x.name, x.type, x.address) for x in docs.orderBy("doc_id").collect()]
    place = "Vil, Sub, Dist, Prov"
    assert got == [(0, "Hall", "", f"Long Road, {place}"), (1, "Long Road", "primary", f"Long Road, {place}"), (2, "Shop", "tea", f"Long Road, 7, {place}")]


def test_strict_way_duplicates(spark):
    box = lambda lo, hi: (lo, lo, hi, hi)
    rows = [(1, "A", box(0.0, 1.0)), (2, "a", box(0.2, 0.5)), (3, "A", box(3.0, 4.0)), (4, "A", box(0.2, 0.5)), (5, "", box(0.0, 1.0)), (6, "", box(0.0, 1.0))]
    ways = spark.createDataFrame(rows, "id long, name string, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>")
    ids = lambda df: sorted(x.id for x in df.collect())
    assert ids(enrich.drop_duplicate_ways(ways)) == [1, 3, 5, 6]
    assert ids(enrich.drop_duplicate_ways(ways, strict=True)) == [1, 3, 4, 5, 6]  # only the box kept last counts


def test_tags(spark):
    rows = spark.createDataFrame([({"name": "N", "short_name": "S", "amenity": "", "shop": "tea", "x": "y"},), ({"wikidata": "Q1"},), ({"wikidata": ""},)], "tags map<string,string>")
    got = rows.select(enrich.place_name().alias("n"), enrich.place_type().alias("t"), enrich.has_wikidata().alias("w"), enrich.features().alias("f")).collect()
    assert [tuple(x) for x in got] == [("N (S)", "", False, ["amenity=", "shop=tea"]), ("", "", True, []), ("", "", False, [])]
