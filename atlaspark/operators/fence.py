"""Geofences: registry, and transitions of moving objects, in batch.

fences: fence_name, key, lat, lon, radius_km (circles, named by key, of a fence).
positions: point_id, ts, seq, fence_name (the fence asked about), lat, lon; order is
(ts, seq) within point_id, whose last position counts whatever the fence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.functions import geo
from atlaspark.operators.search import BadParameter
from atlaspark.operators.storage import dealt

FENCE_SCHEMA = "fence_name string, key string, lat double, lon double, radius_km double"
NAME = re.compile(r"^[A-Za-z0-9_]+$")
MIN_RADIUS, MAX_RADIUS = 0.2, 20.0
NOWHERE = -999.0
MAX_FENCES = 3


class FenceRegistry:
    """Fences by name and their circles; a small driver-side table that becomes a DataFrame."""

    def __init__(self):
        self._fences: dict[str, dict[str, tuple[float, float, float]]] = {}

    def add_fence(self, name: str) -> None:
        if not NAME.match(name or ""):
            raise BadParameter("fence name must be letters, digits and _")
        if name in self._fences:
            raise BadParameter(f"fence {name} exists")
        self._fences[name] = {}

    def delete_fence(self, name: str) -> None:
        self._fences.pop(name, None)

    def add_fence_point(self, name: str, key: str, lat: float, lon: float, radius_km: float) -> None:
        """Adds or replaces a circle."""
        if name not in self._fences:
            raise BadParameter(f"no fence {name}")
        if not NAME.match(key or "") or not MIN_RADIUS <= radius_km <= MAX_RADIUS or not -90 <= lat <= 90 or not -180 <= lon <= 180:
            raise BadParameter("key, position or radius out of range")
        self._fences[name][key] = (float(lat), float(lon), float(radius_km))

    def table(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        if name is not None and name not in self._fences:
            raise BadParameter(f"no fence {name}")
        rows = [(f, k, *v) for f, circles in self._fences.items() if name in (None, f) for k, v in circles.items()]
        return spark.createDataFrame(rows, FENCE_SCHEMA)


def statuses(was_inside: Column, inside: Column, crosses: Column) -> Column:
    """The array of statuses of one step."""
    names = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(was_inside & inside, names("INSIDE"))
        .when(was_inside, names("EXIT", "OUTSIDE"))
        .when(inside, names("ENTER", "INSIDE"))
        .when(crosses, names("CROSS"))
        .otherwise(names("OUTSIDE"))
    )


def with_previous(positions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Adds prev_lat, prev_lon (null at first sight); state (point_id, lat, lon): where objects stood before."""
    w = Window.partitionBy("point_id").orderBy("ts", "seq")
    rows = positions.withColumns({"prev_lat": F.lag("lat").over(w), "prev_lon": F.lag("lon").over(w)})
    if state is None:
        return rows
    known = rows.join(state.select("point_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "point_id", "left")
    return known.withColumns({"prev_lat": F.coalesce("prev_lat", "_lat"), "prev_lon": F.coalesce("prev_lon", "_lon")}).drop("_lat", "_lon")


def put_positions(state: DataFrame, updates: DataFrame) -> DataFrame:
    """The state (point_id, lat, lon) with each object of updates (positions) where its last update puts it. Nothing is reported."""
    new = last_positions(updates)
    return state.select("point_id", "lat", "lon").join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def get_positions(state: DataFrame, ids: DataFrame) -> DataFrame:
    """point_id, lat, lon of the ids (point_id) that have a position."""
    return state.select("point_id", "lat", "lon").join(ids.select("point_id").distinct(), "point_id", "left_semi")


def last_positions(positions: DataFrame) -> DataFrame:
    """The state after all positions: point_id, lat, lon."""
    last = positions.groupBy("point_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "seq")).alias("p"))
    return last.select("point_id", "p.lat", "p.lon")


def fence_steps(steps: DataFrame, fences: DataFrame, max_fences: int | None = MAX_FENCES, first_crosses: bool = False) -> DataFrame:
    """steps (point_id, ts, seq, fence_name, lat, lon, prev_lat, prev_lon) to point_id, ts, seq, fence_name, key, distance, nth, status.

    A step is held against the circles of its fence. These come as one array a
    fence, so the nearest max_fences centres (None: all) are picked within the
    row and nothing is shuffled but what the join on fence_name needs.
    first_crosses: at first sight the object comes from far away and its path may
    cross a circle; otherwise it is outside."""
    circle = F.struct("key", F.col("lat").alias("flat"), F.col("lon").alias("flon"), "radius_km")
    f = fences.groupBy("fence_name").agg(F.array_sort(F.collect_list(circle)).alias("circles"))
    steps = dealt(steps, "point_id", "ts", "seq")
    measured = F.transform("circles", lambda c: F.struct(geo.haversine("lat", "lon", c["flat"], c["flon"]).alias("distance"), *[c[x].alias(x) for x in ("key", "flat", "flon", "radius_km")]))
    rows = steps.join(f, "fence_name")
    if max_fences is not None:
        rows = rows.select(*steps.columns, F.inline(F.slice(F.array_sort(measured), 1, max_fences)))
    else:  # no order is asked for
        rows = rows.select(*steps.columns, F.inline("circles")).withColumn("distance", geo.haversine("lat", "lon", "flat", "flon"))
    seen = F.col("prev_lat").isNotNull()
    from_lat, from_lon = F.coalesce("prev_lat", F.lit(NOWHERE)), F.coalesce("prev_lon", F.lit(NOWHERE))
    was = seen & geo.circle_contains(from_lat, from_lon, "flat", "flon", "radius_km")
    inside = F.col("distance") <= F.col("radius_km")
    crosses = geo.line_crosses_circle(from_lat, from_lon, "lat", "lon", "flat", "flon", "radius_km")
    status = statuses(was, inside, crosses if first_crosses else seen & crosses)
    return rows.select("point_id", "ts", "seq", "fence_name", "key", "distance", F.posexplode(status).alias("nth", "status"))


def fence_transitions(positions: DataFrame, fences: DataFrame, max_fences: int | None = MAX_FENCES, first_crosses: bool = False) -> DataFrame:
    return fence_steps(with_previous(positions), fences, max_fences, first_crosses)
