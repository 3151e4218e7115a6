"""Packing whole documents into sequences of at most 2048 tokens.

A document's ids (with the closing id) are cut into full windows; what is left
is cut at a multiple of GRAIN into one coarse piece and one crumb. So only a
fixed number of lengths exists, whatever the input, and the plan is made on the
histogram of lengths alone:

1. every shallow combination of crumbs that fills GRAIN, and every shallow
   combination of coarse units that fills the window, is a column of a
   non-negative least-squares problem whose solution is the repeat counts;
2. the counts are rounded down to what the histogram can supply;
3. the remaining pieces are packed greedily, longest first, a pattern at a time.

Crumbs that fill GRAIN act as one coarse unit. The plan is a list of intervals
of ranks within a length; pieces find their sequence by their rank, which comes
from counts by (length, block of documents), so no task sees all pieces of a
length. Sequences are padded up to the window except at a power of two.

Null texts are empty: one piece that holds the closing id. Repeated rows are
packed one by one. Rows without doc_id are packed like any other. An empty
table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise, slices, table
from atlaspark.llm.tokens import END_ID, encoder, vocabulary_path

WINDOW = 2048
GRAIN = 32
DEPTH = 4  # pieces in an enumerated combination
BLOCK_PIECES = 5_000  # pieces in one block, on average

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_points(n: int, window: int, grain: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    tail = n % window
    return [window] * (n // window) + [x for x in (tail - tail % grain, tail % grain) if x]


def cut_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    path = path or vocabulary_path()

    def cut(batches):
        import pyarrow as pa

        coder, end = encoder(path), END_ID.to_bytes(4, "little")
        for batch in slices(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for length in cut_points(n, window, grain):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most `depth` positive integers that sum to `units`."""

    def grow(left: int, most: int, depth: int):
        if left == 0:
            yield ()
        elif depth:
            for x in range(min(left, most), (left - 1) // depth, -1):
                for rest in grow(left - x, x, depth - 1):
                    yield (x, *rest)

    return list(grow(units, units, depth))


def nnls(a, b, rounds: int = 600):
    """Lawson-Hanson: the x >= 0 with least |ax - b|."""
    import numpy as np

    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-12))
            x[on] += step * (s - x[on])
            x[on[x[on] <= 1e-12]] = 0
            active = x > 0
    return x


def solve(counts: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) from counts by size; takes what it uses out of counts."""
    import numpy as np

    if not any(counts.values()):
        return []
    found = [c for c in combinations(units, depth) if all(counts.get(x) for x in c)]
    if not found:
        return []
    a = np.zeros((units, len(found)))
    for j, c in enumerate(found):
        for x in c:
            a[x - 1, j] += 1
    b = np.array([counts.get(k + 1, 0) for k in range(units)], float)
    x, plan = nnls(a, b), []
    for pick in ("rounded", "left"):  # a second pass uses up what rounding left
        for j in np.argsort(-x, kind="stable").tolist() if pick == "rounded" else range(len(found)):
            need = defaultdict(int)
            for size in found[j]:
                need[size] += 1
            most = min(counts[s] // m for s, m in need.items())
            times = min(most, int(x[j] + 1e-6)) if pick == "rounded" else most
            if times > 0:
                plan.append((found[j], times))
                for s, m in need.items():
                    counts[s] -= m * times
    return plan


def greedy(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Fills windows longest first; one pattern is repeated as long as its pieces last."""
    plan = []
    counts = {k: n for k, n in counts.items() if n}
    while counts:
        room, need = window, {}
        for k in sorted(counts, reverse=True):
            if m := min(counts[k], room // k):
                need[k], room = m, room - m * k
        times = min(counts[k] // m for k, m in need.items())
        plan.append((tuple(k for k, m in need.items() for _ in range(m)), times))
        for k, m in need.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
    return plan


def make_plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, how many, first sequence, offset), in order of rank, covering every rank once."""
    crumbs = {k: n for k, n in histogram.items() if k < grain}
    blocks = solve(crumbs, grain, depth)
    coarse = {k // grain: n for k, n in histogram.items() if k >= grain}
    own, made = coarse.get(1, 0), sum(t for _, t in blocks)
    coarse[1] = own + made
    whole = [(c, t) for c, t in solve(coarse, window // grain, depth)]
    rest = greedy({k * grain: n for k, n in coarse.items()} | crumbs, window)
    patterns = [(tuple(x * grain for x in c), t) for c, t in whole] + rest

    used, sequence, plan = defaultdict(int), 0, defaultdict(list)
    for c, times in patterns:
        offset = 0
        for length in c:
            plan[length].append((used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    # A unit of one grain past the histogram's own is a block of crumbs: its crumbs take its place.
    units, plan[grain] = plan[grain], [(r, min(n, own - r), s, o) for r, n, s, o in plan[grain] if r < own]
    place = [(max(r, own) - own, r + n - max(r, own), s + max(r, own) - r, o) for r, n, s, o in units if r + n > own]
    later = {length: plan.pop(length) for length in list(plan) if length < grain}
    taken, first = defaultdict(int), 0
    for c, times in blocks:
        inner = 0
        for length in c:
            for b, n, s, o in place:
                lo, hi = max(b, first), min(b + n, first + times)
                if lo < hi:
                    plan[length].append((taken[length] + lo - first, hi - lo, s + lo - b, o + inner))
            taken[length] += times
            inner += length
        first += times
    for length, rows in later.items():
        plan[length] += [(taken[length] + r, n, s, o) for r, n, s, o in rows]
    return {k: sorted(v) for k, v in plan.items() if v}


def place_pieces(pieces: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset; pieces must be a table that reads the same each time."""
    n = pieces.count()
    blocks = max(1, n // BLOCK_PIECES)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    counts = materialise(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, window, grain, depth)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(counts, ["length", "block"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        arrays = {k: np.array(v, dtype=np.int64).T for k, v in plan.items()}
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) if c.null_count == 0 else c for c in batch.columns]
            length, rank = np.asarray(cols[2]), np.asarray(cols[5])
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, _, seq, off = arrays[k]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[i] + rank[at] - first[i], off[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: PIECE's columns, sequence_id and offset."""
    return place_pieces(materialise(cut_pieces(docs, path), "pieces"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
