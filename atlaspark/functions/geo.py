"""Geometry on the sphere and in the plane, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6_371_007.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    half = lambda x: (1 - F.cos(x)) / 2
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = half(b - a) + F.cos(a) * F.cos(b) * half(F.radians(_c(lon2)) - F.radians(_c(lon1)))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def equirectangular(lat1, lon1, lat2, lon2) -> Column:
    """Distance in km in a plane; good for short distances."""
    x = (F.radians(_c(lon2)) - F.radians(_c(lon1))) * F.cos((F.radians(_c(lat1)) + F.radians(_c(lat2))) / 2)
    y = F.radians(_c(lat2)) - F.radians(_c(lat1))
    return F.sqrt(x * x + y * y) * EARTH_KM


def destination(lat, lon, bearing, km) -> tuple[Column, Column]:
    """(lat, lon) reached from a point along a bearing in degrees."""
    a, b, d, t = F.radians(_c(lat)), F.radians(_c(lon)), _c(km) / EARTH_KM, F.radians(_c(bearing))
    s = F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t)
    out = b + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * s)
    return F.degrees(F.asin(s)), F.degrees((out + 3 * F.pi()) % (2 * F.pi()) - F.pi())


def midpoint(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """Great-circle midpoint."""
    a, b, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2)) - F.radians(_c(lon1))
    x, y = F.cos(b) * F.cos(dl), F.cos(b) * F.sin(dl)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt((F.cos(a) + x) * (F.cos(a) + x) + y * y))
    return F.degrees(lat), F.degrees(F.radians(_c(lon1)) + F.atan2(y, F.cos(a) + x))


def between(a: str, b: str, share: Column) -> tuple[Column, Column]:
    """(lat, lon) on the minor arc between two structs of lat and lon, at about the share of its length."""
    u, v = (_vector(F.col(f"{s}.lat"), F.col(f"{s}.lon")) for s in (a, b))
    x, y, z = (u[c] * (1 - share) + v[c] * share for c in "xyz")
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def corner_box(lat, lon, km) -> Column:
    """Box with corners km away at bearings 45 and 225: struct of min_lat, min_lon, max_lat, max_lon."""
    top, right = destination(lat, lon, 45, km)
    low, left = destination(lat, lon, 225, km)
    return F.struct(low.alias("min_lat"), left.alias("min_lon"), top.alias("max_lat"), right.alias("max_lon"))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Strictly: boxes that only touch do not overlap."""
    return (a["min_lat"] < b["max_lat"]) & (b["min_lat"] < a["max_lat"]) & (a["min_lon"] < b["max_lon"]) & (b["min_lon"] < a["max_lon"])


def box_contains(box: Column, lat, lon) -> Column:
    """Borders included."""
    return _c(lat).between(box["min_lat"], box["max_lat"]) & _c(lon).between(box["min_lon"], box["max_lon"])


def box_area(box: Column) -> Column:
    return (box["max_lat"] - box["min_lat"]) * (box["max_lon"] - box["min_lon"])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(*[f(a[c], b[c]).alias(c) for c, f in (("min_lat", F.least), ("min_lon", F.least), ("max_lat", F.greatest), ("max_lon", F.greatest))])


def box_distance(box: Column, lat, lon) -> Column:
    """km from a point to the nearest point of a box, 0 inside."""
    clamp = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    return haversine(lat, lon, clamp(_c(lat), box["min_lat"], box["max_lat"]), clamp(_c(lon), box["min_lon"], box["max_lon"]))


def upper_median(values: Column) -> Column:
    """Element of index size/2 of the sorted array."""
    return F.try_element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def _vector(lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))


def _cross(u: Column, v: Column) -> Column:
    return F.struct((u["y"] * v["z"] - u["z"] * v["y"]).alias("x"), (u["z"] * v["x"] - u["x"] * v["z"]).alias("y"), (u["x"] * v["y"] - u["y"] * v["x"]).alias("z"))


def _dot(u: Column, v: Column) -> Column:
    return u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]


def project_to_segment(lat, lon, a: Column, b: Column) -> Column:
    """Nearest point to (lat, lon) on the minor arc from a to b (structs of lat and lon), as such a struct."""

    def placed(v: Column) -> Column:
        n = v["n"]
        inside = (_dot(_cross(n, v["a"]), v["p"]) > 0) & (_dot(_cross(v["b"], n), v["p"]) > 0)
        share = F.try_divide(_dot(v["p"], n), _dot(n, n))
        foot = F.struct(*[(v["p"][c] - n[c] * share).alias(c) for c in "xyz"])
        end = F.when(_dot(v["p"], v["a"]) >= _dot(v["p"], v["b"]), a).otherwise(b)
        land = lambda q: F.struct(F.degrees(F.atan2(q["z"], F.sqrt(q["x"] * q["x"] + q["y"] * q["y"]))).alias("lat"), F.degrees(F.atan2(q["y"], q["x"])).alias("lon"))
        shape = lambda q: F.struct(q["lat"].cast("double").alias("lat"), q["lon"].cast("double").alias("lon"))
        return F.when(inside & (_dot(n, n) > 0), let(foot, land)).otherwise(shape(end))

    ends = F.struct(_vector(a["lat"], a["lon"]).alias("a"), _vector(b["lat"], b["lon"]).alias("b"), _vector(_c(lat), _c(lon)).alias("p"))
    return let(ends, lambda v: let(F.struct(v["a"].alias("a"), v["b"].alias("b"), v["p"].alias("p"), _cross(v["a"], v["b"]).alias("n")), placed))


def nearest_on_ring(lat, lon, ring: Column) -> Column:
    """struct(dist, lat, lon): nearest point over all edges of a closed ring (last to first included)."""
    edge = lambda i: let(
        project_to_segment(lat, lon, F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))),
        lambda q: F.struct(haversine(lat, lon, q["lat"], q["lon"]).alias("dist"), q["lat"].alias("lat"), q["lon"].alias("lon")),
    )
    return F.when(F.size(ring) > 0, F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), edge)))


def point_in_polygon(lat, lon, ring: Column, edge_bbox_shortcut: bool = False) -> Column:
    """Winding number of an array of (lat, lon) structs, which is closed only if its last point is its first.

    edge_bbox_shortcut: a point inside any edge's bounding box counts as inside."""
    y, x = _c(lat), _c(lon)

    def turn(a: Column, b: Column) -> Column:
        side = (b["lon"] - a["lon"]) * (y - a["lat"]) - (x - a["lon"]) * (b["lat"] - a["lat"])
        return F.when((a["lat"] <= y) & (b["lat"] > y) & (side > 0), 1).when((a["lat"] > y) & (b["lat"] <= y) & (side < 0), -1).otherwise(0)

    at = lambda i: (F.get(ring, i), F.get(ring, i + 1))
    edges = F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    wound = F.aggregate(edges, F.lit(0), lambda n, i: n + turn(*at(i))) != 0
    if not edge_bbox_shortcut:
        return wound

    def boxed(i: Column) -> Column:
        a, b = at(i)
        return x.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & y.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(edges, boxed) | wound


def circle_contains(lat, lon, center_lat, center_lon, radius_km) -> Column:
    return haversine(lat, lon, center_lat, center_lon) <= _c(radius_km)


def line_crosses_circle(lat1, lon1, lat2, lon2, center_lat, center_lon, radius_km) -> Column:
    """Does the segment meet the circle's border, in a plane around the centre? A segment of no length does not."""
    c = F.radians(_c(center_lat))
    plane = lambda lat, lon: (F.radians(_c(lat)) * EARTH_M, F.radians(_c(lon)) * EARTH_M * F.cos(c))
    (ay, ax), (by, bx), (cy, cx) = plane(lat1, lon1), plane(lat2, lon2), plane(center_lat, center_lon)
    parts = F.struct((ay - cy).alias("vy"), (ax - cx).alias("vx"), (by - ay).alias("uy"), (bx - ax).alias("ux"), (_c(radius_km) * 1000).alias("r"))

    def solve(v: Column) -> Column:
        alpha = v["uy"] * v["uy"] + v["ux"] * v["ux"]
        beta = v["uy"] * v["vy"] + v["ux"] * v["vx"]
        gamma = v["vy"] * v["vy"] + v["vx"] * v["vx"] - v["r"] * v["r"]
        return let(
            F.struct(alpha.alias("a"), beta.alias("b"), (beta * beta - alpha * gamma).alias("d")),
            lambda w: F.when(
                (w["d"] >= 0) & (w["a"] > 0),
                F.try_divide(-w["b"] + F.sqrt(w["d"]), w["a"]).between(0, 1) | F.try_divide(-w["b"] - F.sqrt(w["d"]), w["a"]).between(0, 1),
            ).otherwise(False),
        )

    # A segment on one side of the circle's bounds does not meet it; this costs less than the roots.
    tall = F.degrees(_c(radius_km) * 1000 / EARTH_M) * (1 + 1e-6) + 1e-9
    wide = F.try_divide(tall, F.cos(c))
    apart = F.lit(False)
    for p, q, at, half in ((_c(lat1), _c(lat2), _c(center_lat), tall), (_c(lon1), _c(lon2), _c(center_lon), wide)):
        apart = apart | ((p > at + half) & (q > at + half)) | ((p < at - half) & (q < at - half))
    return F.when(apart, False).otherwise(F.coalesce(let(parts, solve), F.lit(False)))
