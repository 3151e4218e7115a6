"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise


SALTS = 8  # keys over which the edges of one node are dealt


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) and m of their end a in least (n, m); the edges of a node with many go to several tasks."""
    least = least.select("n", "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    dealt = edges.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return dealt.join(least, (F.col("a") == F.col("n")) & (F.col("deal") == F.col("salt")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    met = _with_least(down, least)
    return met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label), label being the least node of the component; nodes that are a label themselves are left out.

    Null ends and loops are ignored, repeated edges count once. Rounds grow with
    the logarithm of the number of nodes; each round's table is written.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
