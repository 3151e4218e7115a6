"""Geofence transitions on a stream: the last position of each object is state.

Within a micro-batch an object's positions are taken in order of (ts, seq). State
is kept for ever unless ttl is given. Results equal the batch operator's on the
same rows, as long as later batches do not hold earlier positions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from atlaspark.operators.fence import MAX_FENCES, fence_steps

STEP = "point_id string, ts timestamp, seq long, fence_name string, lat double, lon double, prev_lat double, prev_lon double"


def steps_with_state(positions: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """positions: point_id, ts, seq, fence_name, lat, lon (a stream) with the position before each."""

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        last = state.get if state.exists else (None, None)
        lat, lon = [last[0], *rows["lat"].tolist()], [last[1], *rows["lon"].tolist()]
        state.update((lat[-1], lon[-1]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield rows.assign(point_id=key[0], prev_lat=pd.array(lat[:-1], dtype="Float64"), prev_lon=pd.array(lon[:-1], dtype="Float64"))[["point_id", "ts", "seq", "fence_name", "lat", "lon", "prev_lat", "prev_lon"]]

    rows = positions.select(F.col("point_id").cast("string"), F.col("ts").cast("timestamp"), F.col("seq").cast("long"), "fence_name", F.col("lat").cast("double"), F.col("lon").cast("double"))
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("point_id").applyInPandasWithState(step, STEP, "lat double, lon double", "append", timeout)


def start(positions: DataFrame, fences: DataFrame, sink, checkpoint: str, max_fences: int | None = MAX_FENCES, first_crosses: bool = False, **trigger):
    """Starts the query; sink(transitions, batch_id) gets each micro-batch's transitions."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(fence_steps(batch, fences, max_fences, first_crosses), batch_id)

    return steps_with_state(positions).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
