import json
import struct
import zlib

import pytest

from atlaspark.sources import files, osm_pbf


def number(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def zigzag(v):
    return number(v * 2 if v >= 0 else -v * 2 - 1)


def field(k, v):
    return number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v


def deltas(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values, strict=False))


def block(nodes, ways):
    names = [""] + sorted({s for *_, t in [*nodes, *ways] for kv in t.items() for s in kv})
    at = {s: n for n, s in enumerate(names)}
    table = b"".join(field(1, s.encode()) for s in names)
    units = lambda x: round(x * 1e7)
    marks = b"".join(b"".join(number(at[s]) for kv in t.items() for s in kv) + number(0) for *_, t in nodes)
    dense = field(1, deltas([n[0] for n in nodes])) + field(8, deltas([units(n[1]) for n in nodes])) + field(9, deltas([units(n[2]) for n in nodes])) + field(10, marks)
    groups = field(2, field(2, dense))
    for i, refs, t in ways:
        groups += field(2, field(3, field(1, i) + field(2, b"".join(number(at[k]) for k in t)) + field(3, b"".join(number(at[v]) for v in t.values())) + field(8, deltas(refs))))
    return field(1, table) + groups


def blob(kind, data, packed=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if packed else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


NODES = [(1, -6.1754, 106.8272, {"name": "Monas"}), (5, 12.5, -3.25, {}), (9, 0.0, 0.0, {"historic": "yes", "name": "X"})]
WAYS = [(77, [1, 5, 9, 1], {"highway": "primary"})]


def test_pbf(spark, tmp_path):
    path = tmp_path / "a.osm.pbf"
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block(NODES, [])) + blob(b"OSMData", block([], WAYS), False))
    nodes, ways = files.read_osm(spark, str(path))
    got = sorted((x.id, round(x.lat, 7), round(x.lon, 7), x.tags) for x in nodes.collect())
    assert got == NODES
    assert [(x.id, x.node_ids, x.tags) for x in ways.collect()] == WAYS
    split = spark.read.format("osm_pbf").option("partitionBytes", 1).load(f"file://{path}")
    assert split.rdd.getNumPartitions() == 2 and split.count() == 4


def test_pbf_errors(tmp_path):
    path = tmp_path / "bad.osm.pbf"
    body = field(4, b"lzma")
    head = field(1, b"OSMData") + field(3, len(body))
    path.write_bytes(struct.pack(">I", len(head)) + head + body)
    reader = osm_pbf.OsmPbfReader({"path": str(path)})
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


def test_boundaries(spark, tmp_path):
    rows = [{"province": "P", "district": "D", "sub_district": "S", "village": "V", "postal_code": "1", "border": [[106.0, -6.0], [107.0, -6.0], [107.0, -7.0]]}, {"province": "E", "border": []}]
    path = tmp_path / "b.json"
    path.write_text(json.dumps(rows))
    (got,) = files.read_boundaries(spark, str(path)).collect()
    assert got.village == "V" and tuple(got.ring[0]) == (-6.0, 106.0)


def test_spellings(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("raining: rainning, raning\nno colon\nempty: ,\na:b:c\n")
    rows = {x.correct: x.wrong for x in files.read_spellings(spark, str(path)).collect()}
    assert rows == {"raining": ["rainning", "raning"], "empty": [], "a": ["b:c"]}
    kept = {x.correct: x.wrong for x in files.read_spellings(spark, str(path), trim_errors=False).collect()}
    assert kept["raining"] == ["rainning", " raning"]


def test_json_sink(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "a")], "id long, name string"), str(tmp_path / "out"))
    (line,) = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(line) == {"data": {"id": 1, "name": "a"}}
