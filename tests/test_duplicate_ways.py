"""Ways of one name: all sizes of boxes, and many rows of one box."""

import random

from pyspark.sql import functions as F

from atlaspark.operators import enrich

BOX = "struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>"


def test_boxes_of_all_sizes_match_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        lat, lon, s = r.choice([0.0, -6.4, r.uniform(-80, 80)]), r.choice([0.0, 106.6, r.uniform(-170, 170)]), r.choice([0.0, 0.5, 10 ** r.uniform(-4, 1.3)])
        rows.append((i, r.choice(["A", "a", "b"]), (lat, lon, lat + s, lon + s * r.choice([0.5, 1.0]))))
    rows += [(300, "", (0.0, 0.0, 1.0, 1.0)), (301, None, (0.0, 0.0, 1.0, 1.0)), (302, "a", None), (303, "a", None), (304, "a", rows[0][2])]
    r.shuffle(rows)
    inside = lambda x, y: x[0] >= y[0] and x[1] >= y[1] and x[2] <= y[2] and x[3] <= y[3]
    again = {i for i, n, x in rows if n and x for j, m, y in rows if m and y and j < i and m.lower() == n.lower() and (inside(x, y) or inside(y, x))}
    got = enrich.drop_duplicate_ways(spark.createDataFrame(rows, f"id long, name string, box {BOX}"))
    assert sorted(x.id for x in got.collect()) == sorted({i for i, *_ in rows} - again) and got.columns == ["id", "name", "box"]


def test_many_ways_of_one_name_and_box(spark):
    n = 200_000  # as pairs, 20 billion
    box = F.struct(*[F.lit(x).alias(c) for c, x in (("min_lat", 0.0), ("min_lon", 0.0), ("max_lat", 1.0))], (F.col("id") % 3 + 1.0).alias("max_lon"))
    ways = spark.range(n).select((F.lit(n) - F.col("id")).alias("id")).select("id", F.lit("Hall").alias("name"), box.alias("box"))
    assert [x.id for x in enrich.drop_duplicate_ways(ways).collect()] == [1]
