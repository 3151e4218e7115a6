import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from atlaspark.operators import fence
from atlaspark.operators.search import BadParameter
from atlaspark.streaming import fences as stream

SCHEMA = "point_id string, ts timestamp, seq long, fence_name string, lat double, lon double"


def moves(spark, *spots, point="p", name="f", start=0):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(point, t, start + n, name, float(a), float(b)) for n, (a, b) in enumerate(spots)], SCHEMA)


def seen(df):
    return [(x.seq, x.key, x.status) for x in df.orderBy("seq", "key", "nth").collect()]


def test_walk_through(spark):
    r = fence.FenceRegistry()
    r.add_fence("ojol")
    r.add_fence_point("ojol", "monumen_nasional", -6.175263997609506, 106.82716214527025, 1.2)
    rows = moves(spark, (-6.169884724072774, 106.8702583208934), (-6.17749341514094, 106.82291254922845), name="ojol")
    assert seen(fence.fence_transitions(rows, r.table(spark))) == [(0, "monumen_nasional", "OUTSIDE"), (1, "monumen_nasional", "ENTER"), (1, "monumen_nasional", "INSIDE")]


def test_all_transitions(spark):
    circle = spark.createDataFrame([("f", "c", 0.0, 0.0, 1.0)], fence.FENCE_SCHEMA)
    inside, west, east, north = (0.0, 0.0), (0.0, -0.1), (0.0, 0.1), (0.1, 0.1)
    got = seen(fence.fence_transitions(moves(spark, west, inside, inside, east, west, (0.1, -0.1), north), circle))
    steps = {n: [s for m, _, s in got if m == n] for n in range(7)}
    assert steps == {0: ["OUTSIDE"], 1: ["ENTER", "INSIDE"], 2: ["INSIDE"], 3: ["EXIT", "OUTSIDE"], 4: ["CROSS"], 5: ["OUTSIDE"], 6: ["OUTSIDE"]}


def test_nearest_three_only(spark):
    circles = [("f", f"c{n}", 0.0, 0.01 * n, 0.2) for n in range(3)] + [("f", "wide", 0.0, 0.2, 20.0)]
    table = spark.createDataFrame(circles, fence.FENCE_SCHEMA)
    keys = lambda n: {x[1] for x in seen(fence.fence_transitions(moves(spark, (0.0, 0.05)), table, n))}
    assert "wide" not in keys(3) and "wide" in keys(None)
    assert fence.fence_transitions(moves(spark, (0.0, 0.05), name="none"), table).count() == 0


def test_registry():
    r = fence.FenceRegistry()
    r.add_fence("a")
    for call in (lambda: r.add_fence("a"), lambda: r.add_fence("a b"), lambda: r.add_fence_point("b", "k", 0, 0, 1), lambda: r.add_fence_point("a", "k", 0, 0, 0.1), lambda: r.add_fence_point("a", "k", 91, 0, 1)):
        with pytest.raises(BadParameter):
            call()
    r.add_fence_point("a", "k", 0, 0, 1)
    r.add_fence_point("a", "k", 1, 1, 2)
    assert r._fences == {"a": {"k": (1.0, 1.0, 2.0)}}
    r.delete_fence("a")
    r.delete_fence("a")


def test_last_positions(spark):
    got = fence.last_positions(moves(spark, (1, 1), (2, 2))).collect()
    assert [tuple(x) for x in got] == [("p", 2.0, 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    circle = spark.createDataFrame([("f", "c", 0.0, 0.0, 1.0), ("f", "d", 0.0, 0.05, 2.0)], fence.FENCE_SCHEMA)
    spots = [(0.0, 0.01 * x) for x in (-5, 0, 0, 5, 9, -9)]
    rows = moves(spark, *spots).unionByName(moves(spark, *spots[::-1], point="q", start=100))
    for n, (lo, hi) in enumerate(itertools.pairwise((0, 2, 4, 6))):
        rows.where((F.col("seq") % 100 >= lo) & (F.col("seq") % 100 < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = []
    q = stream.start(source, circle, lambda df, _: found.extend(map(tuple, df.collect())), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(found) == sorted(map(tuple, fence.fence_transitions(rows, circle).collect()))


def test_steps_are_dealt_out(spark):
    circles = spark.createDataFrame([("f", f"c{n}", 0.0, 0.01 * n, 0.2) for n in range(5)], fence.FENCE_SCHEMA)
    found = fence.fence_transitions(moves(spark, *[(0.0, 0.001 * n) for n in range(100)]).coalesce(1), circles, None)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    first = fence.fence_transitions(moves(spark, *[(0.0, 0.001 * n) for n in range(100)]), circles, 5)
    assert found.exceptAll(first).isEmpty() and found.count() == first.count()
