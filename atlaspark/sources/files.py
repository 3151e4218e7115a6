"""Readers of the engine's input files and its JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaspark.sources.osm_pbf import OsmPbf

BOUNDARY = "province string, district string, sub_district string, village string, postal_code string, border array<array<double>>"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an .osm.pbf file, or of Parquet or JSON rows of the same shape."""
    if path.endswith(".pbf"):
        spark.dataSource.register(OsmPbf)
        rows = spark.read.format("osm_pbf").load(path)
    elif path.endswith((".json", ".jsonl")):
        rows = spark.read.schema("kind string, id long, lat double, lon double, node_ids array<long>, tags map<string,string>").json(path)
    else:
        rows = spark.read.parquet(path)
    nodes = rows.where("kind = 'node'").select("id", "lat", "lon", "tags")
    return nodes, rows.where("kind = 'way'").select("id", "node_ids", "tags")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of regions to region_id, names, ring (lat, lon). Borders are lon, lat pairs; regions without one are left out."""
    rows = spark.read.schema(BOUNDARY).option("multiLine", True).json(path)
    ring = F.transform("border", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    rows = rows.where(F.size("border") > 0).select("province", "district", "sub_district", "village", "postal_code", ring.alias("ring"))
    key = F.struct("province", "district", "sub_district", "village", "postal_code", "ring")
    return rows.withColumn("region_id", F.concat_ws("/", "province", "district", "sub_district", "village", F.xxhash64(key).cast("string")))


def read_spellings(spark: SparkSession, path: str, trim_errors: bool = True) -> DataFrame:
    """Lines 'correct: wrong1,wrong2' to correct, wrong (array). Lines without a colon are left out."""
    line = spark.read.text(path).where(F.col("value").contains(":"))
    wrong = F.split(F.trim(F.expr("substring(value, instr(value, ':') + 1)")), ",")
    if trim_errors:
        wrong = F.transform(wrong, lambda w: F.trim(w))
    return line.select(F.trim(F.substring_index("value", ":", 1)).alias("correct"), F.filter(wrong, lambda w: w != "").alias("wrong"))


def write_json(rows: DataFrame, path: str) -> None:
    """One {"data": row} object a line."""
    rows.select(F.to_json(F.struct(F.struct(*rows.columns).alias("data"))).alias("value")).write.mode("overwrite").text(path)
