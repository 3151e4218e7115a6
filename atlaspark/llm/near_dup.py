"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is sketched into REGISTERS exponentially
spaced truncated minima: K = clip(floor(1 - log_BASE(h))), h the least of
exponential values, one stream of hashes per register. Registers of a union are
the maxima of the parts' registers, and two documents agree in a register with a
chance close to their Jaccard similarity. BAND registers at a time form a
bucket key; at similarity 0.8 the chance to share no key is below two in a
million.

Inside a bucket nobody meets everybody. Every member is first held against the
bucket's least member; the exact links found give components. Only members
outside a bucket's largest component are then held against the members of other
components, under an exact bound from 2048-bit set signatures that is part of
the join. What passes is estimated jointly by likelihood from both registers and
set sizes, dropped only if far below the threshold (MARGIN, about eight standard
errors), and verified on the full sets. So links between different texts decide
the components, though never all pairs of a group are listed.

Equal word sequences are one class from the start. A task sketches each class
once, as far as it remembers (SEEN classes), so keys and traits have a row per
class and task, however many copies there are; only the last join, which names
every document's component, brings copies to their class's row, and there Spark
may split a class over tasks (spark.sql.adaptive.skewJoin).
A document without words or text has an empty set and is linked with nothing;
one with fewer words than a shingle has all its words as its only shingle.
Rows without doc_id take part, but never name a component (component_id is null
only if no row of it has one). Repeated rows stay, in one class. Empty tables
give empty results; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise, slices, table
from atlaspark.llm.components import components

REGISTERS, BAND = 264, 6
BASE, RATE, TOP = 1.001, 20.0, 65_534
LEVEL = 80  # hundredths of similarity
MARGIN = 0.2  # estimates this far below the level are not verified
SIGNATURE = 32  # 64-bit words in a set signature
MAP_BITS = 1 << 24
SEEN = 500_000  # classes a task remembers
PAIRS = 1024  # pairs estimated at once

SKETCH = "id binary, doc_id long, doc_hash long, n_shingles long, signature array<long>, registers binary, bands array<long>"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def class_of(words: list[bytes]) -> bytes:
    import hashlib

    return hashlib.sha256(b" ".join(words)).digest()[:16]


def shingles(words: list[bytes], width: int):
    """Sorted distinct 64-bit hashes of the shingles."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    g = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(g ^ (g >> np.uint64(31)))


class Sketcher:
    def __init__(self, registers: int = REGISTERS, band: int = BAND):
        import numpy as np

        r = np.random.default_rng(20_240_601)
        self.factor = (r.integers(0, 2**31, registers, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
        self.shift = r.integers(0, 2**32, registers, dtype=np.uint64).astype(np.uint32)
        self.mix = r.integers(0, 2**63, band, dtype=np.uint64) | np.uint64(1)
        self.band, self.room = band, np.empty((512, registers), np.uint32)

    def registers(self, elements):
        """SetSketch registers of a set of 64-bit hashes."""
        import numpy as np

        x = (elements >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 2**32 - 1, np.uint32)
        for at in range(0, len(x), len(self.room)):
            part = x[at : at + len(self.room), None]
            room = self.room[: len(part)]
            np.multiply(part, self.factor[None, :], out=room)
            np.add(room, self.shift[None, :], out=room)
            np.minimum(least, room.min(axis=0), out=least)
        h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype("<u2")

    def bands(self, registers):
        """One 64-bit key per band."""
        import numpy as np

        rows = registers.reshape(-1, self.band).astype(np.uint64)
        key = ((rows + np.uint64(1)) * self.mix).sum(axis=1, dtype=np.uint64)
        key ^= np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (key ^ (key >> np.uint64(29))).view(np.int64)


def signature(elements):
    import numpy as np

    bits = np.zeros(64 * SIGNATURE, bool)
    bits[(elements & np.uint64(64 * SIGNATURE - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def estimate(a, b, na, nb):
    """Jaccard similarities that make the registers likeliest, given the set sizes; a and b are (pairs, registers)."""
    import numpy as np

    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[None, :]
    p = lambda x: -np.log(np.maximum(1 - np.maximum(x, 0) * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    like = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """One row per document; documents of one word sequence share id, and within a task only its first has signature, registers and bands."""

    def run(batches):
        import pyarrow as pa

        sketcher, seen, longs = Sketcher(), set(), pa.list_(pa.int64())
        for batch in slices(batches, 2):
            ids, sizes, marks, registers, bands = [], [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                ids.append(class_of(words))
                s = shingles(words, width)
                sizes.append(len(s))
                if len(s) and ids[-1] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ids[-1])
                    r = sketcher.registers(s)
                    registers.append(r.tobytes())
                    bands.append(sketcher.bands(r))
                    marks.append(signature(s))
                else:
                    registers.append(None)
                    bands.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(marks, longs), pa.array(registers, pa.binary()), pa.array(bands, longs)], names=["id", "doc_id", "doc_hash", "n_shingles", "signature", "registers", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the classes in wanted (id, doc_id). A bitmap of fixed size over their doc_ids spares most texts; the join decides."""
    import numpy as np

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    rows = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("b"))
    bits = np.zeros(MAP_BITS // 64, np.int64)
    for part in rows.toLocalIterator():
        bits[part["w"]] = part["b"]
    bits = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        import pyarrow as pa

        own = np.frombuffer(bits.value, np.uint64)
        for batch in slices(batches, 1):
            at = batch.column(2).to_numpy()
            on = (own[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            ids, sets = [], []
            for text in batch.column(1).filter(pa.array(on)):
                words = words_of(text.as_py())
                ids.append(class_of(words))
                sets.append(shingles(words, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", bit.alias("bit")).mapInArrow(run, "id binary, shingles array<long>")
    return found.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def verified(pairs: DataFrame, traits: DataFrame, docs: DataFrame, width: int, level: int = LEVEL) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough: by the exact bound, then the estimate, then the sets."""
    side = lambda x: traits.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"g{x}"), F.col("registers").alias(f"r{x}"))

    def likely(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (x.slice(at, PAIRS) for x in batches for at in range(0, x.num_rows, PAIRS)):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (3, 5))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 4))
            keep = estimate(a, b, na, nb) >= level / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    first, second = pairs.join(side("a"), "a"), side("b").withColumnRenamed("b", "other")
    rows = first.join(second, (F.col("b") == F.col("other")) & could_link(level)).select("a", "b", "na", "ra", "nb", "rb")
    rows = materialise(rows.mapInArrow(likely, "a binary, b binary"), "likely-pairs")
    wanted = rows.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(traits.select("id", "doc_id"), "id")
    sets = materialise(full_sets(docs, materialise(wanted.select("id", "doc_id"), "wanted"), width), "shingle-sets")
    met = rows.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return materialise(met.where(100 * both >= level * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")


def could_link(level: int):
    """Exact necessary condition on (na, ga) and (nb, gb): differing signature bits bound the symmetric difference from below."""
    apart = sum((F.bit_count(F.get("ga", F.lit(i)).bitwiseXOR(F.get("gb", F.lit(i)))) for i in range(SIGNATURE)), F.lit(0))
    return (100 * F.least("na", "nb") >= level * F.greatest("na", "nb")) & ((100 + level) * apart <= (100 - level) * (F.col("na") + F.col("nb")))


def near_duplicates(docs: DataFrame, width: int = 5, level: int = LEVEL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; and doc_hash (xxhash64 of the text) and group, one value per component, null for empty sets."""
    rows = materialise(sketch(docs, width), "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    classes = rows.groupBy("id").agg(F.min_by("doc_id", order).alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    classes = materialise(classes, "classes")

    # Band keys name classes: copies have none of their own.
    drawn = rows.where("bands is not null")
    keys = drawn.select("id", F.explode("bands").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot <> other").select("key", "pivot"), "buckets")
    entries = materialise(keys.join(shared, "key").groupBy("key", "id").agg(F.first("pivot").alias("pivot")), "entries")
    traits = drawn.join(entries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("registers").alias("registers"))
    traits = materialise(traits.join(classes.select("id", "doc_id"), "id"), "traits")
    stars = materialise(entries.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    links = verified(stars, traits, docs, width, level)

    part = components(links)
    homes = materialise(entries.join(part, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("label", "id").alias("home")), "homes")
    largest = homes.groupBy("key", "home").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("home", F.struct("n", "home")).alias("main"), F.count("*").alias("homes")).where("homes > 1").select("key", "main")
    mixed = materialise(homes.join(largest, "key"), "mixed")
    # A pair that shares several keys is taken under the first of them only.
    own = drawn.groupBy("id").agg(F.first("bands").alias("bands")).join(mixed.select("id").distinct(), "id", "left_semi")
    mixed_traits = mixed.join(traits.select("id", "n_shingles", "signature").join(own, "id"), "id").withColumn("nth", F.array_position("bands", F.col("key")))
    side = lambda x: [F.col("id").alias(x), F.col("home").alias(f"h{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"g{x}"), F.slice("bands", F.lit(1), F.col("nth").cast("int") - 1).alias(f"k{x}")]
    one = mixed_traits.where("home <> main").select("key", *side("a"))
    two = mixed_traits.select("key", "main", *side("b"))
    apart = (F.col("ha") != F.col("hb")) & ((F.col("hb") == F.col("main")) | (F.col("a") < F.col("b")))
    first = ~F.exists(F.zip_with("ka", "kb", lambda x, y: x == y), lambda same: same)
    rest = one.join(two, (one["key"] == two["key"]) & apart & could_link(level) & first).select("a", "b")
    rest = materialise(rest.join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        part = components(links.unionByName(verified(rest, traits, docs, width, level)))

    labelled = classes.join(part, F.col("id") == F.col("node"), "left").select("id", "doc_id", "n_shingles", F.coalesce("label", "id").alias("label"))
    labelled = labelled.select("id", "doc_id", "label", (F.col("n_shingles") > 0).alias("full"))
    labelled = materialise(labelled.where("full"), "labelled")
    names = materialise(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "names")
    named = materialise(labelled.join(names, "label").select("id", "component_id", F.col("label").alias("group")), "components")
    out = rows.where("n_shingles > 0").join(named, "id").select("doc_id", "n_shingles", "component_id", "doc_hash", "group")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "doc_hash", F.lit(None).cast("binary").alias("group"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, level: int = LEVEL) -> DataFrame:
    """docs with one document of each component: the least doc_id (rows without one come last), then the least text hash, then the least JSON of the other columns. Documents with an empty set all stay."""
    marks = materialise(near_duplicates(docs, width, level).select("doc_id", "doc_hash", "group"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_hash"))
    chosen = marks.where("group is not null").groupBy("group").agg(first.alias("first")).select("first.doc_id", "first.doc_hash", F.lit(True).alias("full"))
    chosen = materialise(chosen.unionByName(marks.where("group is null").select("doc_id", "doc_hash", F.lit(False).alias("full")).distinct()), "chosen")
    chosen = chosen.select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("doc_hash").alias("k2"), "full").alias("c")
    d = docs.alias("d")
    met = d.join(chosen, (F.coalesce(F.col("d.doc_id").cast("long"), F.lit(0)) == F.col("c.k0")) & (F.col("d.doc_id").isNull() == F.col("c.k1")) & (F.xxhash64("d.text") == F.col("c.k2")))
    own = F.struct(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
    rest = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c != "text"]
    nth = F.row_number().over(Window.partitionBy("c.k0", "c.k1", "c.k2").orderBy(F.to_json(F.struct(*rest)), "d.text"))
    return met.select(own.alias("own"), nth.alias("nth"), F.col("c.full").alias("full")).where("nth = 1 or not full").select("own.*")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
  UNION SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, r.doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r LEFT JOIN n ON n.doc_id = r.doc_id
"""
