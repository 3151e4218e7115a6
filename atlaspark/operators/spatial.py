"""Spatial search by grid cells: range, radius, nearest neighbours, reverse geocoding.

The earth is cut into rows of CELL degrees of latitude; a row has as many cells
as keep them about square, so a circle needs few cells at any latitude, and
columns wrap around. A query is expanded into the cells its circle can touch,
meets objects by cell in an equi-join, and exact distances decide. Both sides
are dealt by cell, since a table of few row groups is read by few tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlaspark.functions import geo
from atlaspark.operators.search import validate
from atlaspark.operators.storage import checkpointed, dealt

CELL = 0.05  # degrees, about 5.6 km
KM_PER_DEGREE = geo.EARTH_KM * math.pi / 180


def _columns(row: Column, cell: float | Column) -> Column:
    """How many cells a row has."""
    lat = F.least(F.abs(row * cell), F.abs((row + 1) * cell))
    return F.greatest(F.lit(1), F.ceil(360.0 / F.lit(cell) * F.cos(F.radians(F.least(lat, F.lit(90.0)))))).cast("long")


def _column(lon: Column, count: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * count).cast("long")


def cell_of(lat: Column, lon: Column, cell: float | Column = CELL) -> Column:
    """struct(row, col) of a point."""
    row = F.floor(lat / cell).cast("long")
    n = _columns(row, cell)
    return F.struct(row.alias("row"), F.pmod(_column(lon, n), n).alias("col"))


def cells_of_box(low_lat: Column, low_lon: Column, high_lat: Column, high_lon: Column, cell: float | Column = CELL) -> Column:
    """Array of the cells that a box touches."""
    rows = F.sequence(F.floor(low_lat / cell).cast("long"), F.floor(high_lat / cell).cast("long"))

    def row_cells(r: Column) -> Column:
        n = _columns(r, cell)
        first, last = _column(low_lon, n), _column(high_lon, n)
        last = F.least(last, first + n - 1)
        return F.transform(F.sequence(first, last), lambda c: F.struct(r.alias("row"), F.pmod(c, n).alias("col")))

    return F.flatten(F.transform(rows, row_cells))


def cells_of_circle(lat: Column, lon: Column, km: Column, cell: float = CELL) -> Column:
    """Array of the cells that a circle can touch."""
    angle = km / geo.EARTH_KM
    d = F.degrees(angle) + 1e-9
    reach = F.try_divide(F.sin(F.least(angle, F.lit(math.pi / 2))), F.cos(F.radians(lat)))
    polar = (F.abs(lat) + d >= 90.0) | reach.isNull() | (reach >= 1.0) | (angle >= math.pi / 2)
    wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.when(polar, F.lit(0.0)).otherwise(reach))) + 1e-9)
    return cells_of_box(F.greatest(lat - d, F.lit(-90.0)), lon - wide, F.least(lat + d, F.lit(90.0)), lon + wide, cell)


def with_cells(df: DataFrame, cells: Column) -> DataFrame:
    return df.select("*", F.inline(cells))


def met_by_cell(a: DataFrame, b: DataFrame) -> DataFrame:
    return dealt(a, "row", "col").join(dealt(b, "row", "col"), ["row", "col"])


def _met(points: DataFrame, objects: DataFrame, km: Column, cell: float) -> DataFrame:
    """points (plat, plon, ...) x objects (olat, olon, ...) with distance <= km, which points' columns give."""
    p = with_cells(dealt(points, "query_id").withColumn("_km", km), cells_of_circle(F.col("plat"), F.col("plon"), F.col("_km") + 1e-5, cell))
    o = objects.withColumn("_c", cell_of(F.col("olat"), F.col("olon"), cell)).select("*", "_c.row", "_c.col").drop("_c")
    near = F.abs(F.col("plat") - F.col("olat")) <= F.col("_km") / KM_PER_DEGREE + 1e-6
    met = met_by_cell(p, o).where(near).withColumn("distance", geo.haversine("plat", "plon", "olat", "olon"))
    return met.where(F.col("distance") <= F.col("_km")).drop("row", "col", "_km")


def _points(points: DataFrame) -> DataFrame:
    return points.select("query_id", F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"))


def within_radius(points: DataFrame, objects: DataFrame, km: Column | float, cell: float | None = None, feature: str | None = None) -> DataFrame:
    """points (query_id, lat, lon, ...) x objects (doc_id, lat, lon, features) with centre distance <= km: query_id, doc_id, distance.

    feature: objects must have exactly this key=value. All pairs are the result, so its rows grow with both tables."""
    if not isinstance(km, Column):
        cell, km = cell or min(90.0, km / 2 / KM_PER_DEGREE), F.lit(float(km))
    if feature is not None:
        objects = objects.where(F.array_contains("features", feature))
    p = points.select("query_id", F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"), km.alias("km"))
    o = objects.select("doc_id", F.col("lat").cast("double").alias("olat"), F.col("lon").cast("double").alias("olon"))
    return _met(p, o, F.col("km"), cell or CELL).select("query_id", "doc_id", "distance")


def spacing(rows: DataFrame, lat: str, lon: str, k: int) -> float:
    """km of a cell's side at which even the fullest cell holds few more than k rows; at least about 10 m, at most CELL."""
    cell = CELL
    while True:
        c = cell_of(F.col(lat).cast("double"), F.col(lon).cast("double"), cell)
        most = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(c.alias("c")).count().agg(F.max("count")).first()[0] or 0
        if most <= 4 * k or cell <= 1e-4:
            return cell * KM_PER_DEGREE
        cell = max(1e-4, cell / max(1.5, math.sqrt(most / (2 * k))))


def nearby(points: DataFrame, objects: DataFrame, feature: str | None = None, k: int = 10, radius: float = 5.0, offset: int = 0, strict_offset: bool = True) -> DataFrame:
    """The k nearest objects with the feature within radius km, after `offset` of them: query_id, rank, doc_id, distance.

    strict_offset False: an offset past the end gives the first page."""
    validate(k=k, offset=offset, feature=feature, radius=radius)
    if feature is not None:
        objects = objects.where(F.array_contains("features", feature))
    ranked = nearest(points, objects, offset + k, radius=float(radius))
    skip = F.lit(offset)
    if not strict_offset:  # offset + k objects tell whether there are more than offset
        ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
        skip = F.when(F.col("_n") > offset, offset).otherwise(0)
    return ranked.where((F.col("rank") > skip) & (F.col("rank") <= skip + k)).select("query_id", "rank", "doc_id", "distance")


def nearest(points: DataFrame, objects: DataFrame, k: int, start_km: float | None = None, growth: float = 4.0, radius: float = math.inf) -> DataFrame:
    """The k nearest objects of each point within radius km (all, if there are fewer): query_id, rank, doc_id, distance.

    Rings start where the densest cells hold about k objects and grow until every
    point has k objects inside its circle; only points that lack some go on, and
    cells grow with the circle. So a point meets a number of objects that
    depends on k and not on how many there are."""
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    done, left = None, points.select("query_id", "lat", "lon").where("lat is not null and lon is not null")
    last_km = min(radius, math.pi * geo.EARTH_KM + 1.0)
    km = min(last_km, spacing(objects, "lat", "lon", max(1, k)) if start_km is None else start_km)
    o = objects.select("doc_id", F.col("lat").cast("double").alias("olat"), F.col("lon").cast("double").alias("olon"))
    while True:
        last = km >= last_km
        found = _met(_points(left), o, F.lit(min(km, last_km)), min(90.0, km / KM_PER_DEGREE))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "distance")
        full = ranked if last else checkpointed(ranked.withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("_n") == k).drop("_n"))
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        left = checkpointed(left.join(full.select("query_id").distinct(), "query_id", "left_anti"))
        if left.isEmpty():
            return done
        km *= growth


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Range join: ids a_id, b_id of boxes (id, min_lat, min_lon, max_lat, max_lon) that overlap strictly.

    Boxes are classed by size, so that one large box does not cost many cells.
    For each two classes a box of a is in the cell of its lower corner, and a box
    of b in the few cells where lower corners of boxes that overlap it can be;
    so no duplicates arise."""
    box = ("min_lat", "min_lon", "max_lat", "max_lon")

    def classed(df: DataFrame, n: str) -> DataFrame:
        df = df.select(F.col("id").alias(f"{n}_id"), *[F.col(c).cast("double").alias(f"{n}_{c}") for c in box])
        size = F.greatest(F.col(f"{n}_max_lat") - F.col(f"{n}_min_lat"), F.col(f"{n}_max_lon") - F.col(f"{n}_min_lon"), F.lit(1e-4))
        return df.withColumn("_size", size).withColumn(f"k_{n}", F.floor(F.log2("_size")).cast("int"))

    def paired(df: DataFrame, n: str, other: str) -> DataFrame:
        """A row for each class of the other side: size_a, size_b and cell of the two classes."""
        own = F.create_map(*[F.lit(x) for kv in largest[n].items() for x in kv])[F.col(f"k_{n}")]
        classes = F.array(*[F.struct(F.lit(k).alias(f"k_{other}"), F.lit(size).alias(f"size_{other}")) for k, size in largest[other].items()])
        rows = dealt(df, f"{n}_id").drop("_size").withColumn(f"size_{n}", own).select("*", F.inline(classes))
        return rows.withColumn("cell", F.least(F.lit(90.0), F.greatest("size_a", "size_b") / 4))

    a, b = classed(a, "a"), classed(b, "b")
    largest = {n: {r[0]: r[1] * (1 + 1e-9) + 1e-9 for r in df.groupBy(f"k_{n}").agg(F.max("_size")).collect() if r[0] is not None} for n, df in (("a", a), ("b", b))}
    if not (largest["a"] and largest["b"]):
        return a.join(b, F.lit(False)).select("a_id", "b_id")
    a = paired(a, "a", "b").withColumn("_c", cell_of(F.col("a_min_lat"), F.col("a_min_lon"), F.col("cell"))).select("*", "_c.row", "_c.col")
    b = with_cells(paired(b, "b", "a"), cells_of_box(F.col("b_min_lat") - F.col("size_a"), F.col("b_min_lon") - F.col("size_a"), F.col("b_max_lat"), F.col("b_max_lon"), F.col("cell")))
    keys = ["k_a", "k_b", "row", "col"]
    side = lambda df, n: dealt(df.select(*keys, f"{n}_id", *[f"{n}_{c}" for c in box]), *keys)
    met = side(a, "a").join(side(b, "b"), keys)
    return met.where(" and ".join(f"{x}_min_{c} < {y}_max_{c}" for c in ("lat", "lon") for x, y in ("ab", "ba"))).select("a_id", "b_id")


# Km from centre to corner of an object's box, and of the box a reverse lookup searches.
OBJECT_KM, LOOKUP_KM = 0.4, 0.35


def nearest_edge(points: DataFrame, edges: DataFrame, box_km: float, limit: float) -> DataFrame:
    """points (query_id, lat, lon), edges (doc_id, olat, olon, obox, a, b: an arc of an object, its centre and box): query_id, doc_id, distance, lat, lon of the nearest edge's nearest spot, among objects within limit km whose box overlaps the point's of box_km. Ties by doc_id.

    Edges are cut into pieces of about the points' spacing, but into no more
    pieces than four for each row. A point meets the pieces around it, and is
    done if an edge is as near as they reach for sure; else it goes on with a
    circle four times as wide, and at last with the centres within limit. So
    what a point meets follows from the pieces, not from the objects within
    limit. Very long edges meet points by their centres each time."""
    p = _points(points).where("plat is not null and plon is not null")
    edges = checkpointed(edges.withColumn("_len", geo.haversine("a.lat", "a.lon", "b.lat", "b.lon")).where("_len is not null"))
    n, total = edges.agg(F.count("*"), F.coalesce(F.sum("_len"), F.lit(0.0))).first()
    step = max(spacing(p, "plat", "plon", 1) / 2, total / (4 * (n + p.count()) or 1), 0.004)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_len") / step)).cast("int")
    wide = (pieces > 1000) | (F.col("_len") > 100)
    spot = geo.between("a", "b", (F.col("_i") + 0.5) / F.col("_n"))
    parts = edges.where(~wide).withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    parts = parts.select("doc_id", "obox", "a", "b", spot[0].alias("olat"), spot[1].alias("olon"))
    any_wide = not edges.where(wide).isEmpty()
    p = checkpointed(dealt(p, "query_id").withColumn("pbox", geo.corner_box("plat", "plon", box_km)))

    def best(left: DataFrame, near: DataFrame, km: float) -> DataFrame:
        rows = _met(left, near.select("doc_id", "obox", "a", "b", "olat", "olon"), F.lit(km), min(90.0, 2 * km / KM_PER_DEGREE)).where(geo.boxes_overlap(F.col("pbox"), F.col("obox")))
        rows = rows.withColumn("f", geo.project_to_segment("plat", "plon", F.col("a"), F.col("b")))
        hit = F.struct(geo.haversine("plat", "plon", F.col("f.lat"), F.col("f.lon")).alias("distance"), "doc_id", F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))
        return rows.select("query_id", hit.alias("b")).groupBy("query_id").agg(F.min("b").alias("b"))

    done, left, sure = None, p, step / 2
    while (reach := sure + step / 2 * 1.01 + 1e-4) < limit:
        found = best(left, parts, reach)
        if any_wide:
            found = found.unionByName(best(left, edges.where(wide), limit)).groupBy("query_id").agg(F.min("b").alias("b"))
        found = checkpointed(found.where(F.col("b.distance") <= sure))
        done = found if done is None else done.unionByName(found)
        left = checkpointed(left.join(found, "query_id", "left_anti"))
        if left.isEmpty():
            break
        sure *= 4
    else:
        found = best(left, edges, limit)
        done = found if done is None else done.unionByName(found)
    return done.select("query_id", "b.doc_id", "b.distance", "b.lat", "b.lon")


def reverse_geocode(points: DataFrame, objects: DataFrame, point_compat: bool = False) -> DataFrame:
    """Nearest object of each point (query_id, lat, lon), among objects (doc_id, lat, lon, geom) whose box overlaps the point's.

    Boxes stand around the objects' centres. Distance is to the geometry's ring;
    an object without geometry is a point itself (point_compat: it projects to
    -1, -1). Result: query_id, doc_id, distance, lat, lon of the projection;
    points without candidate have no row. Ties by doc_id."""
    o = dealt(objects.select("doc_id", F.col("lat").cast("double").alias("olat"), F.col("lon").cast("double").alias("olon"), "geom"), "doc_id")
    own = F.struct(*[(F.lit(-1.0) if point_compat else F.col(f"o{c}")).alias(c) for c in ("lat", "lon")])
    ring = F.transform("geom", lambda q: F.struct(q["lat"].cast("double").alias("lat"), q["lon"].cast("double").alias("lon")))
    sides = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))
    sides = F.when(F.size("geom") > 0, sides).otherwise(F.array(F.struct(own.alias("a"), own.alias("b"))))
    edges = o.select("doc_id", "olat", "olon", geo.corner_box("olat", "olon", OBJECT_KM).alias("obox"), F.inline(sides))
    return nearest_edge(points, edges, LOOKUP_KM, OBJECT_KM + LOOKUP_KM + 0.01)


def reverse_geocoded_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Joins names and addresses; a document without name is called by the projected point and its address."""
    d = docs.select("doc_id", "name", "address")
    name = F.when(F.col("name") == "", F.format_string("%.4f,%.4f,%s", "lat", "lon", "address")).otherwise(F.col("name"))
    return found.join(d, "doc_id").withColumn("name", name)


STREET_KM = 1.0


def nearest_street(points: DataFrame, streets: DataFrame) -> DataFrame:
    """points (query_id, lat, lon), streets (street_id, mid_lat, mid_lon, first, last): query_id, street_id, distance of the street whose chord from first to last vertex is nearest, among those whose middle's box overlaps the point's."""
    pad = 0.0001
    mid = dealt(streets, "street_id").select(F.col("street_id").alias("doc_id"), F.col("mid_lat").cast("double").alias("olat"), F.col("mid_lon").cast("double").alias("olon"), F.col("first").alias("a"), F.col("last").alias("b"))
    box = F.struct((F.col("olat") - pad).alias("min_lat"), (F.col("olon") - pad).alias("min_lon"), (F.col("olat") + pad).alias("max_lat"), (F.col("olon") + pad).alias("max_lon"))
    return nearest_edge(points, mid.withColumn("obox", box), STREET_KM, STREET_KM + 0.03).select("query_id", F.col("doc_id").alias("street_id"), "distance")


REGION_CELL = 0.25


def containing_region(points: DataFrame, regions: DataFrame, edge_bbox_shortcut: bool = False) -> DataFrame:
    """points (query_id, lat, lon), regions (region_id, ring): the least region_id whose ring holds the point; no row if none does."""
    lat, lon = F.transform("ring", lambda q: q["lat"]), F.transform("ring", lambda q: q["lon"])
    box = F.struct(F.array_min(lat).alias("min_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lat).alias("max_lat"), F.array_max(lon).alias("max_lon"))
    r = regions.where(F.size("ring") > 0).select("region_id", "ring", box.alias("box"))
    r = with_cells(r, cells_of_box(*[F.col(f"box.{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")], REGION_CELL))
    p = points.select("query_id", F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"))
    p = dealt(p, "query_id").select("*", cell_of(F.col("plat"), F.col("plon"), REGION_CELL).alias("c")).select("query_id", "plat", "plon", "c.row", "c.col")
    near = p.join(r, ["row", "col"]).where(geo.box_contains(F.col("box"), "plat", "plon"))
    inside = near.where(geo.point_in_polygon("plat", "plon", F.col("ring"), edge_bbox_shortcut))
    return inside.groupBy("query_id").agg(F.min("region_id").alias("region_id"))


def upsert(objects: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """objects with the rows of changes in place of those with their key."""
    return delete(objects, changes, key).unionByName(changes)


def delete(objects: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return objects.join(gone.select(key).distinct(), key, "left_anti")
