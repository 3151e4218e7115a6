"""A batch data source for OpenStreetMap .osm.pbf files: spark.read.format("osm_pbf").load(path).

Rows: kind ('node' or 'way'), id, lat, lon, node_ids, tags. The driver lists the
blobs by their headers; groups of blobs are partitions, which decode their own
bytes. Relations are passed over. Corrupt files raise an error.

path is anything that pyarrow.fs opens: a local path or a URI.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lon double, node_ids array<long>, tags map<string,string>"
PARTITION_BYTES = 16 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of a message; length-delimited values are bytes, others integers."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire == 1:
            value, at = struct.unpack_from("<q", data, at)[0], at + 8
        elif wire == 5:
            value, at = struct.unpack_from("<i", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def running(deltas: list[int]) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += d
        out.append(total)
    return out


def open_path(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def blobs(f) -> list[tuple[int, int]]:
    """(offset, size) of the data blobs."""
    at, found = 0, []
    while head := f.read(4):
        (size,) = struct.unpack(">I", head)
        header = dict(fields(f.read(size)))
        at += 4 + size
        if header[1] == b"OSMData":
            found.append((at, header[3]))
        at += header[3]
        f.seek(at)
    return found


def inflate(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("blob compression other than none and zlib")


def rows_of(block: bytes):
    parts: dict[int, list] = {}
    for k, v in fields(block):
        parts.setdefault(k, []).append(v)
    names = [v.decode() for k, v in fields(parts[1][0]) if k == 1]
    grain, lat0, lon0 = (parts.get(k, [d])[0] for k, d in ((17, 100), (19, 0), (20, 0)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    place = lambda v, base: (signed(base) + grain * v) * 1e-9
    zigzag = lambda v: (v >> 1) ^ -(v & 1)
    for group in parts.get(2, []):
        for kind, data in fields(group):
            if kind == 1:
                p = dict(fields(data))
                tags = dict(zip([names[i] for i in packed(p.get(2, b""))], [names[i] for i in packed(p.get(3, b""))], strict=True))
                yield "node", zigzag(p[1]), place(zigzag(p[8]), lat0), place(zigzag(p[9]), lon0), None, tags
            elif kind == 2:
                p = dict(fields(data))
                ids, lats, lons = (running(packed(p.get(k, b""), True)) for k in (1, 8, 9))
                marks, at = packed(p.get(10, b"")), 0
                for i, lat, lon in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while at < len(marks) and marks[at]:
                        tags[names[marks[at]]] = names[marks[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, place(lat, lat0), place(lon, lon0), None, tags
            elif kind == 3:
                p = dict(fields(data))
                tags = dict(zip([names[i] for i in packed(p.get(2, b""))], [names[i] for i in packed(p.get(3, b""))], strict=True))
                yield "way", signed(p[1]), None, None, running(packed(p.get(8, b""), True)), tags


class Blobs(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


class OsmPbfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        with open_path(self.path) as f:
            found = blobs(f)
        groups, size = [[]], 0
        for span in found:
            if groups[-1] and size + span[1] > self.size:
                groups.append([])
                size = 0
            groups[-1].append(span)
            size += span[1]
        return [Blobs(self.path, g) for g in groups]

    def read(self, partition):
        with open_path(partition.path) as f:
            for at, size in partition.spans:
                f.seek(at)
                yield from rows_of(inflate(f.read(size)))


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return OsmPbfReader(self.options)
