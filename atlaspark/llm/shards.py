"""Token shards in training order.

Documents become sequences of at most SEQUENCE ids. Before any text is encoded,
each document owns a block of virtual numbers large enough for whatever it can
encode to (at most one id per byte and the closing one). A keyed Feistel network
with cycle walking permutes the virtual numbers; the order of the permuted
numbers is the training order. Shards are equal ranges of them, so their borders
are known in advance and texts are encoded and shuffled once. A task takes a range
of shards, sorts it and writes each as one file of records of the same size; a
sequence's slot is its place in its shard plus the records of the shards before
it, so slots run from 0 without gaps.

Record: doc_id (int64), number of the sequence in its document (uint32), ids
that count (uint32), then SEQUENCE ids (uint16, zeros after the last), all
little-endian. read_records() starts at any slot of a shard by one seek. A
vocabulary of more than 65,536 ids is an error.

Files get their name by a rename once complete, and equal input gives equal
bytes, so a repeated task does no harm; what failed attempts left is removed at
the end. Paths without a scheme belong to Spark's default file system.

Any 64-bit doc_ids will do: numbers have 64 bits for the id's distance from the
least one, and those of the sequence. Null texts are empty: one sequence with the
closing id. Rows without doc_id take the block that their text's hash names, which
may be another document's as well, and their records hold doc_id -1. Sequences of
one number are ordered by doc_id and ids; repeated rows are written one after the
other. An empty table writes no file. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise, new_path, slices, table
from atlaspark.llm.tokens import END_ID, encoder, vocabulary_path

SEQUENCE = 512
HEADER = "<qII"
HEADER_BYTES = struct.calcsize(HEADER)
STRIDE = HEADER_BYTES + 2 * SEQUENCE
SHARD_BYTES = 16 << 20  # aimed at
TASK_SHARDS = 4  # shards that a task writes, at most
RUN = 4096  # shards whose counts one task adds up
ROUNDS = 6
KEY = b"training order 1"


class Permutation:
    """A keyed bijection of the numbers (at, chunk), at below span and chunk of chunk_bits bits: Feistel rounds on an even number of bits, walked until inside."""

    def __init__(self, span: int, chunk_bits: int = 0, key: bytes = KEY, rounds: int = ROUNDS):
        bits = max(1, (span - 1).bit_length())
        self.chunk_bits = chunk_bits + (bits + chunk_bits) % 2
        self.span, self.half = span, (bits + self.chunk_bits) // 2
        self.keys = [int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8], "little") for r in range(rounds)]

    def _once(self, left, right):
        import numpy as np

        mask = np.uint64((1 << self.half) - 1)
        for k in self.keys:
            f = (right ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return left, right

    def halves(self, at, chunk):
        """The permuted number's upper and lower half."""
        import numpy as np

        cut, bits = np.uint64(abs(self.half - self.chunk_bits)), np.uint64(self.chunk_bits)
        at, chunk = np.asarray(at, np.uint64), np.asarray(chunk, np.uint64)
        if self.half >= self.chunk_bits:
            left, right = at >> cut, (at & ((np.uint64(1) << cut) - np.uint64(1))) << bits | chunk
            inside = lambda a, b: (a << cut | b >> bits) <= np.uint64(self.span - 1)
        else:
            left, right = at << cut | chunk >> np.uint64(self.half), chunk & np.uint64((1 << self.half) - 1)
            inside = lambda a, b: a >> cut <= np.uint64(self.span - 1)
        left, right = self._once(left, right)
        while (out := ~inside(left, right)).any():
            left[out], right[out] = self._once(left[out], right[out])
        return left, right


def shard_count(total_bytes: int, least: int = 1) -> int:
    """From the bytes of all texts, at about three a token."""
    return max(least, -(-(total_bytes * 2 // 3) // SHARD_BYTES))


def encoded(docs: DataFrame, path: str | None = None, key: bytes = KEY) -> tuple[DataFrame, int]:
    """(shard, upper, lower, doc_id, chunk, length, ids) of every sequence, and the number of shards; upper and lower: the permuted number's halves."""
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    low, high, longest, total = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(size), F.sum(size.cast("long"))).first()
    low, high = (-(2**63), 2**63 - 1) if low is None else (low, high)
    order = Permutation(high - low + 1, ((longest or 0) // SEQUENCE).bit_length(), key)
    shards, top = shard_count(total or 0), ((order.span << order.chunk_bits) - 1 >> order.half) + 1

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        coder, end = encoder(path), END_ID.to_bytes(4, "little")
        if len(coder.last) > 1 << 16:
            raise ValueError("records hold 16-bit ids; the vocabulary has more")
        for batch in slices(batches, 1):
            doc, at, chunk, length, ids = [], [], [], [], []
            for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(coder.ids(text.as_py()) + end, "<u4").astype("<u2").tobytes()
                for c in range(-(-len(own) // (2 * SEQUENCE))):
                    part = own[2 * SEQUENCE * c : 2 * SEQUENCE * (c + 1)]
                    doc.append(doc_id)
                    at.append((h + 2**63) % order.span if doc_id is None else doc_id - low)
                    chunk.append(c)
                    length.append(len(part) // 2)
                    ids.append(part)
            upper, lower = order.halves(np.array(at, np.uint64), np.array(chunk, np.uint64))
            shard = np.minimum(upper.astype(float) / top * shards, shards - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(upper.astype(np.int64)), pa.array(lower.astype(np.int64)), pa.array(doc, pa.int64()), pa.array(chunk, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "upper", "lower", "doc_id", "chunk", "length", "ids"])

    return docs.mapInArrow(encode, "shard long, upper long, lower long, doc_id long, chunk long, length long, ids binary"), shards


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


def write_shards(docs: DataFrame, folder: str, path: str | None = None, key: bytes = KEY) -> DataFrame:
    """Writes the shards into folder (any file system that Arrow opens by URI or path); one row per sequence:
    doc_id, chunk, length, ids_crc32, shard, record (its place in the shard), slot."""
    rows, shards = encoded(docs, path, key)
    folder = qualified(docs.sparkSession, folder)
    tasks = max(min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-shards // TASK_SHARDS))
    ranges = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
    ordered = ranges.sortWithinPartitions("shard", "upper", "lower", "doc_id", "ids")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, record = None, None, 0

        def close():
            if out is not None:
                out.close()
                system.move(f"{root}/_{shard_name(shard)}.{attempt}", f"{root}/{shard_name(shard)}")

        for batch in batches:
            crc, place = [], []
            for s, doc_id, chunk, length, ids in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                if s != shard:
                    close()
                    shard, record = s, 0
                    out = system.open_output_stream(f"{root}/_{shard_name(s)}.{attempt}")
                out.write(struct.pack(HEADER, -1 if doc_id is None else doc_id, chunk, length) + ids.ljust(2 * SEQUENCE, b"\0"))
                crc.append(zlib.crc32(ids))
                place.append(record)
                record += 1
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), batch.column(5), pa.array(crc, pa.int64()), batch.column(0), pa.array(place, pa.int64())], names=["doc_id", "chunk", "length", "ids_crc32", "shard", "record"])
        close()

    written = materialise(ordered.mapInArrow(write, "doc_id long, chunk long, length long, ids_crc32 long, shard long, record long"), "written")
    remove_attempts(docs.sparkSession, folder)
    # Bases: sums within runs of shards, and over runs.
    counts = written.groupBy("shard").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("first"))
    bases = counts.select("shard", "run", before(Window.partitionBy("run").orderBy("shard")).alias("base")).join(runs, "run").select("shard", (F.col("base") + F.col("first")).alias("base"))
    return written.join(bases, "shard").select("doc_id", "chunk", "length", "ids_crc32", "shard", "record", (F.col("base") + F.col("record")).alias("slot"))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that names its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", found)


def remove_attempts(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_shard-*")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in system.globStatus(path) or []:
        system.delete(left.getPath(), False)


def read_records(folder: str, shard: int, first: int = 0, count: int | None = None):
    """(doc_id, chunk, ids) of the records of a shard from `first` on, in order."""
    import numpy as np
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    with system.open_input_file(f"{root}/{shard_name(shard)}") as f:
        f.seek(first * STRIDE)
        while count is None or count > 0:
            row = f.read(STRIDE)
            if not row:
                return
            doc_id, chunk, length = struct.unpack_from(HEADER, row)
            yield doc_id, chunk, np.frombuffer(row, "<u2", length, HEADER_BYTES)
            count = None if count is None else count - 1


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
