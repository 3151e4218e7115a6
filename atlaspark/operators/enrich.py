"""From tagged ways and nodes to place documents: names, types, duplicates, addresses.

ways: id, node_ids, tags, has_wikidata. nodes: id, lat, lon, tags, has_wikidata.
vertices: id, lat, lon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlaspark.functions import geo
from atlaspark.functions.text import capitalize
from atlaspark.operators import spatial
from atlaspark.operators.storage import checkpointed

# Tags that make a way or a node searchable, tags that tell a type, classes of streets, and speeds by class.
WAY_TAGS = [
    "amenity", "building", "sport", "tourism", "leisure", "boundary", "landuse", "craft", "aeroway", "historic", "residential",
    "railway", "shop", "junction", "route", "ferry", "highway", "motorcar", "motor_vehicle", "access", "industrial", "service",
    "healthcare", "office", "public_transport", "waterway", "water", "telecom", "power", "place", "geological", "emergency",
    "bulding", "aerialway", "barrier",
]
NODE_TAGS = ["historic", "name"]
TYPE_TAGS = ["amenity", "highway", "historic", "sport", "tourism", "leisure", "landuse", "craft", "aeroway", "residential", "industrial", "shop"]
WIKI_TAGS = ["wikidata", "wikipedia", "wikimedia_commons"]
STREET_CLASSES = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
]
SPEEDS = {
    "motorway": 100, "motorroad": 90, "trunk": 70, "motorway_link": 70, "trunk_link": 65, "primary": 65, "primary_link": 60,
    "secondary": 60, "secondary_link": 50, "tertiary": 50, "tertiary_link": 40, "unclassified": 40, "residential": 30, "road": 20,
    "service": 20, "track": 15, "living_street": 5,
}


def tag(name: str, tags: str | Column = "tags") -> Column:
    return (F.col(tags) if isinstance(tags, str) else tags)[name]


def place_name(tags: str | Column = "tags") -> Column:
    """The name, followed by the short name in parentheses if there is one; '' without either."""
    name, short = F.coalesce(tag("name", tags), F.lit("")), tag("short_name", tags)
    return F.when(short.isNotNull(), F.concat(name, F.lit(" ("), short, F.lit(")"))).otherwise(name)


def place_type(tags: str | Column = "tags") -> Column:
    return F.coalesce(*[tag(t, tags) for t in TYPE_TAGS], F.lit(""))


def has_wikidata(tags: str | Column = "tags") -> Column:
    found = F.lit(False)
    for t in WIKI_TAGS:
        found = found | (F.coalesce(tag(t, tags), F.lit("")) != "")
    return found


def features(tags: str = "tags") -> Column:
    """'key=value' of the searchable tags."""
    kept = F.map_filter(tags, lambda k, v: k.isin(WAY_TAGS))
    return F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def searchable_ways(ways: DataFrame) -> DataFrame:
    """Ways with a name or a highway tag, and any searchable tag."""
    keys = F.map_keys("tags")
    return ways.where((tag("highway").isNotNull() | (place_name() != "")) & F.arrays_overlap(keys, F.array(*map(F.lit, WAY_TAGS))))


def searchable_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where((place_name() != "") & F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, NODE_TAGS))))


def used_vertices(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """id, lat, lon of nodes that some way refers to."""
    return nodes.select("id", "lat", "lon").join(ways.select(F.explode("node_ids").alias("id")).distinct(), "id", "left_semi")


def with_geometry(ways: DataFrame, vertices: DataFrame) -> DataFrame:
    """ways and geom: their vertices in order. Missing vertices are left out, ways without any vertex too."""
    spots = ways.select(F.col("id").alias("way_id"), F.posexplode("node_ids").alias("pos", "id")).join(vertices.select("id", "lat", "lon"), "id")
    rows = spots.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("v"))
    geom = F.transform("v", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return ways.join(rows, ways["id"] == rows["way_id"]).drop("way_id").withColumn("geom", geom).drop("v")


def with_center(ways: DataFrame) -> DataFrame:
    """lat and lon: upper medians of the vertices; box: their bounds."""
    lats, lons = F.transform("geom", lambda p: p["lat"]), F.transform("geom", lambda p: p["lon"])
    box = F.struct(F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon"))
    return ways.withColumns({"lat": geo.upper_median(lats), "lon": geo.upper_median(lons), "box": box})


def streets(ways: DataFrame) -> DataFrame:
    """Ways with geometry to streets: street_id, name, mid_lat, mid_lon, first, last, speed."""
    lat, lon = F.array_sort("geom.lat"), F.array_sort("geom.lon")
    mid = geo.midpoint(lat[0], lon[0], F.element_at(lat, -1), F.element_at(lon, -1))
    speed = F.create_map(*[F.lit(x) for kv in SPEEDS.items() for x in kv])
    rows = ways.where(tag("highway").isin(STREET_CLASSES) & (F.size("geom") > 0))
    return rows.select(F.col("id").alias("street_id"), place_name().alias("name"), mid[0].alias("mid_lat"), mid[1].alias("mid_lon"), F.col("geom")[0].alias("first"), F.element_at("geom", -1).alias("last"), speed[tag("highway")].alias("speed"))


def drop_duplicate_ways(ways: DataFrame, strict: bool = False) -> DataFrame:
    """Ways (id, name, box, ...) without repetitions: same lower-cased name, and one box inside the other.

    The way of least id stays; nameless ways all stay. Ways of one name and box
    count as one, the first; these meet by name and the cell, of the larger box's
    size, that holds the smaller one's corner. strict folds each name's ways in
    order of id and compares with the box kept last only; then a name's ways
    are one task's work."""
    rows = ways.withColumn("_key", F.lower("name"))
    if strict:
        kept = rows.where("_key <> ''").groupBy("_key").applyInPandas(_fold_boxes, "id long")
        return ways.join(kept.unionByName(rows.where("_key = ''").select("id")), "id", "left_semi")
    box = ("min_lat", "min_lon", "max_lat", "max_lon")
    full = F.coalesce(F.col("_key") != "", F.lit(False))
    for c in box:
        full = full & F.col(f"box.{c}").isNotNull()
    rows = rows.withColumn("_full", full)
    first = rows.where("_full").select("id", "_key", *[F.col(f"box.{c}").cast("double").alias(c) for c in box]).groupBy("_key", *box).agg(F.min("id").alias("id"))
    first = checkpointed(first.withColumn("k", F.ceil(F.log2(F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(1e-4)))).cast("int")))
    sizes = [r[0] for r in first.select("k").distinct().collect()]  # some thirty at most
    cell = lambda k: F.least(F.lit(90.0), F.pow(F.lit(2.0), F.col(k)))
    outer = spatial.with_cells(first, spatial.cells_of_box(*[F.col(c) for c in box], cell("k")))
    inner = first.select("*", F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: k >= F.col("k"))).alias("of"))
    inner = inner.withColumn("_c", spatial.cell_of(F.col("min_lat"), F.col("min_lon"), cell("of"))).select("id", "_key", *box, F.col("of").alias("k"), "_c.row", "_c.col")
    held = (F.col("i.min_lat") >= F.col("o.min_lat")) & (F.col("i.max_lat") <= F.col("o.max_lat")) & (F.col("i.min_lon") >= F.col("o.min_lon")) & (F.col("i.max_lon") <= F.col("o.max_lon"))
    for key in ("_key", "k", "row", "col"):
        held = held & (F.col(f"i.{key}") == F.col(f"o.{key}"))
    inner, outer = inner.alias("i"), outer.alias("o")
    again = inner.join(outer, held & (F.col("o.id") < F.col("i.id")), "left_semi").select("id")
    again = again.unionByName(outer.join(inner, held & (F.col("i.id") < F.col("o.id")), "left_semi").select("id"))
    kept = first.select("id").join(again, "id", "left_anti")
    one = rows.where("_full").join(kept, "id", "left_semi")
    return rows.where("not _full").unionByName(one).select(*ways.columns)


def _fold_boxes(rows):
    import pandas as pd

    last, kept = None, []
    for r in rows.sort_values("id").itertuples():
        low, high = (r.box["min_lat"], r.box["min_lon"]), (r.box["max_lat"], r.box["max_lon"])
        within = last and last[0][0] <= low[0] and last[0][1] <= low[1] and last[1][0] >= high[0] and last[1][1] >= high[1]
        around = last and low[0] <= last[0][0] and low[1] <= last[0][1] and high[0] >= last[1][0] and high[1] >= last[1][1]
        if not (within or around):
            kept.append(r.id)
        if not within:
            last = (low, high)
    return pd.DataFrame({"id": kept}, dtype="int64")


def drop_duplicate_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes (id, name, lat, lon, ...) that do not lie in the box of a way of the same lower-cased name."""
    boxes = ways.where("name <> ''").select(F.lower("name").alias("_key"), "box")
    inside = geo.box_contains(F.col("box"), F.col("lat"), F.col("lon"))
    return nodes.join(boxes, (F.lower(nodes["name"]) == F.col("_key")) & inside, "left_anti")


def region_name(region: str = "region") -> Column:
    return F.concat_ws(", ", *[capitalize(F.col(f"{region}.{c}")) for c in ("village", "sub_district", "district", "province")])


def addresses(places: DataFrame, street_table: DataFrame, regions: DataFrame) -> DataFrame:
    """places (doc_id, lat, lon, tags) with address: street, house number, region.

    The street is the place's own or the nearest one's name; the region the one
    that holds the place. ', ' and the region's four names close the address,
    with nothing after the comma where there is no region."""
    points = places.select(F.col("doc_id").alias("query_id"), "lat", "lon")
    own = F.coalesce(tag("addr:street"), F.lit(""))
    lacking = points.join(places.where(own == "").select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    near = spatial.nearest_street(lacking, street_table).join(street_table.select("street_id", F.col("name").alias("near_name")), "street_id").select(F.col("query_id").alias("doc_id"), "near_name")
    held = spatial.containing_region(points, regions).join(regions.drop("ring"), "region_id")
    held = held.select(F.col("query_id").alias("doc_id"), F.struct("province", "district", "sub_district", "village").alias("region"))
    house = F.coalesce(tag("addr:housenumber"), F.lit(""))
    street = F.when(own != "", own).otherwise(F.coalesce("near_name", F.lit("")))
    address = F.concat(street, F.when(house != "", F.concat(F.lit(", "), house)).otherwise(""), F.lit(", "), F.when(F.col("region").isNotNull(), region_name()).otherwise(""))
    return places.join(near, "doc_id", "left").join(held, "doc_id", "left").withColumn("address", address).drop("near_name", "region")


def place_documents(ways: DataFrame, nodes: DataFrame, regions: DataFrame, strict: bool = False) -> DataFrame:
    """The indexing pipeline: doc_id, name, lat, lon, address, type, contain_wikidata, features, geom.

    Ways come before nodes and each in order of id, so doc_id (from 0) is the
    same on every run. Numbers come from counts by range of id."""
    kept_ways = with_center(with_geometry(searchable_ways(ways), used_vertices(nodes, searchable_ways(ways))))
    kept_ways = kept_ways.withColumn("name", place_name()).where((F.col("name") != "") | tag("highway").isNotNull())
    street_table = streets(kept_ways)
    kept_ways = drop_duplicate_ways(kept_ways, strict)
    kept_nodes = drop_duplicate_nodes(searchable_nodes(nodes).withColumn("name", place_name()), kept_ways)
    shape = lambda df, kind, geom: df.select(F.lit(kind).alias("kind"), "id", "name", "lat", "lon", "tags", geom.alias("geom"))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    places = number(shape(kept_ways, 0, F.col("geom")).unionByName(shape(kept_nodes, 1, none)), ["kind", "id"])
    full = addresses(places, street_table, regions)
    return full.select("doc_id", "name", "lat", "lon", "address", place_type().alias("type"), has_wikidata().alias("contain_wikidata"), features().alias("features"), "geom")


def number(rows: DataFrame, order: list[str], name: str = "doc_id", block: int = 100_000) -> DataFrame:
    """Dense numbers from 0 along (order[0], order[1]) without one task that sees all rows: counts by block of order[1], then a place within the block."""
    first, second = order
    part = F.floor(F.col(second) / block).cast("long")
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(first, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(first, "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(first, "_part", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(first, "_part").orderBy(second))
    return rows.withColumn("_nth", nth).join(counts, [first, "_part"]).withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")
