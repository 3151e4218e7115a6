"""Benchmark decontamination by winnowing.

Both sides keep, in every run of WINNOW consecutive k-grams, the one with the
least hash. Any span of GRAM + WINNOW - 1 = 8 words that documents and
benchmark share therefore has a kept k-gram in common. Kept k-grams meet by
hash, each carries the three words on either side, and hits are extended word
by word over these, so every shared window of 8 words is found and nothing else
is. Items of fewer words are one window each, met by the hash of all of it.

A bitmap of fixed size (BITS) over the benchmark's hashes travels to the
document side and drops k-grams that cannot meet; it can let others through,
which the join removes. k-grams that documents hold more than HOT times are dealt
over SALTS keys.

Null or wordless texts have no words and no hits. Items without item_id are left out;
repeated items count once. Every document row gives one row, repeated or
without doc_id as well. Empty tables give empty results or no hits. Only
doc_id, text and item_id are read.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise, slices, table

SPAN = 8  # words in a window
GRAM = 5
WINNOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM  # words kept on either side of a k-gram
BITS = 1 << 23
SALTS = 16
HOT = 10_000  # hits from which a k-gram is dealt out
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

HIT = "struct<gram:int,pos:int,hash:long,words:array<string>,left:array<string>,right:array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def gram_hashes(h, k: int):
    """64-bit hashes of all k-grams of the word hashes h."""
    import numpy as np

    n = len(h) - k + 1
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def kept(g, run: int):
    """Positions of the least hash in each run of `run` hashes, the first among equals."""
    import numpy as np

    if len(g) < run:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, run)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def fingerprints(words: list[bytes], short: list[int], whole: bool, bitmap=None) -> list[dict]:
    """The kept k-grams of a text. whole: a text of fewer than SPAN words is one gram; short: lengths of all grams to look up besides."""
    import numpy as np

    n = len(words)
    if not n:
        return []
    h = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    found = []
    if n >= SPAN:
        g = gram_hashes(h, GRAM)
        at = kept(g, WINNOW)
        found.append((GRAM, at, g[at], True))
    elif whole:
        found.append((n, np.zeros(1, np.int64), gram_hashes(h, n) ^ np.uint64(n), False))
    for k in short:
        if n >= k:
            g = gram_hashes(h, k) ^ np.uint64(k)
            found.append((k, np.arange(len(g)), g, False))
    out = []
    for k, at, g, winnowed in found:
        if bitmap is not None:
            bit = g & np.uint64(BITS - 1)
            on = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
            at, g = at[on], g[on]
        text = lambda a, b: [w.decode("utf-8", "surrogatepass") for w in words[max(a, 0) : b]]
        for p, x in zip(at.tolist(), g.view(np.int64).tolist(), strict=True):
            left, right = (text(p - SIDE, p)[::-1], text(p + k, p + k + SIDE)) if winnowed else ([], [])
            out.append({"gram": SPAN if winnowed else k, "pos": p, "hash": x, "words": text(p, p + k), "left": left, "right": right})
    return out


def hit_table(df: DataFrame, key: str, short: list[int], whole: bool, bitmap=None) -> DataFrame:
    """(key, text) to (key, n_words, hits)."""
    kind = df.schema[key].dataType

    def find(batches):
        import numpy as np
        import pyarrow as pa

        strings = pa.list_(pa.string())
        hit = pa.list_(pa.struct([("gram", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64()), ("words", strings), ("left", strings), ("right", strings)]))
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for batch in slices(batches, 1):
            counts, hits = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                hits.append(fingerprints(words, short, whole, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, hit)], names=[key, "n_words", "hits"])

    return df.select(key, "text").mapInArrow(find, f"`{key}` {kind.simpleString()}, n_words long, hits array<{HIT}>")


def make_bitmap(hashes: DataFrame) -> bytes:
    """Bits that the hashes set; at most BITS / 64 rows reach the driver."""
    import numpy as np

    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    rows = hashes.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("b")).collect()
    bitmap = np.zeros(BITS // 64, np.int64)
    for w, b in rows:
        bitmap[w] = b
    return bitmap.tobytes()


def run_length(a: Column, b: Column, most: int = SIDE) -> Column:
    """How many leading elements two arrays share."""
    same = F.lit(0)
    for k in reversed(range(1, most + 1)):
        same = F.when(F.try_element_at(a, F.lit(k)) == F.try_element_at(b, F.lit(k)), F.lit(1) + same).otherwise(0)
    return same


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), spans (start and end of hit runs of words), doc_hash (xxhash64 of the text)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    grams = hit_table(items, "item_id", [], whole=True).select("item_id", F.inline("hits")).dropDuplicates(["item_id", "hash", "gram", "left", "right", "words"])
    grams = materialise(grams.drop("pos"), "benchmark-grams")
    short = sorted(r[0] for r in grams.where(f"gram < {SPAN}").select("gram").distinct().collect())
    bitmap = docs.sparkSession.sparkContext.broadcast(make_bitmap(grams))

    doc = F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"))
    both = docs.select(doc.alias("doc"), "text")
    found = hit_table(both, "doc", short, whole=False, bitmap=bitmap)
    # Rows without hits keep a key of their own, which meets nothing, so one pass over the texts serves all.
    rows = found.select("doc", "n_words", F.explode_outer("hits").alias("hit")).select(
        "doc",
        "n_words",
        "hit",
        F.coalesce("hit.hash", F.xxhash64("doc.row")).alias("hash"),
        F.coalesce("hit.gram", F.lit(0)).alias("gram"),
    )
    rows = materialise(rows, "document-grams")
    hot = materialise(rows.where("hit is not null").groupBy("hash", "gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash", "gram", F.lit(SALTS).alias("salts")), "hot-grams")
    rows = rows.join(hot, ["hash", "gram"], "left").withColumn("salt", F.pmod(F.xxhash64("doc.row"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salted = grams.join(hot, ["hash", "gram"], "left").select("hash", "gram", "item_id", *[F.col(c).alias(f"item_{c}") for c in ("words", "left", "right")], F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    met = rows.join(salted, ["hash", "gram", "salt"], "left")
    same = F.col("hit.words") == F.col("item_words")
    left, right = run_length(F.col("hit.left"), F.col("item_left")), run_length(F.col("hit.right"), F.col("item_right"))
    met = met.withColumn("l", left).withColumn("r", right)
    good = same & ((F.col("gram") < SPAN) | (F.col("l") + F.col("r") >= SIDE))
    pos = F.col("hit.pos")
    span = F.struct((pos - F.col("l")).alias("start"), (pos + F.when(F.col("gram") < SPAN, F.col("gram")).otherwise(GRAM) + F.col("r")).alias("end"))
    out = met.groupBy("doc").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(good, F.col("item_id")))).alias("items"),
        F.array_sort(F.collect_set(F.when(good, span))).alias("spans"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")),
    )
    return out.select("doc.doc_id", "n_words", covered["n"].cast("long").alias("n_hit"), "items", "spans", "doc.doc_hash")


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n = F.size("items").cast("long")
    return find_hits(docs, benchmark).select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 1) -> DataFrame:
    """docs without those that hold windows of at least `least_items` items."""
    bad = find_hits(docs, benchmark).where(F.size("items") >= least_items).select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("doc_hash").alias("k2"))
    bad = materialise(bad.distinct(), "contaminated")
    d = docs.alias("d")
    same = (F.coalesce(F.col("d.doc_id").cast("long"), F.lit(0)) == F.col("b.k0")) & (F.col("d.doc_id").isNull() == F.col("b.k1")) & (F.xxhash64("d.text") == F.col("b.k2"))
    return d.join(bad.alias("b"), same, "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, w, least(8, len(w)) AS k, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM d, ks),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM di),
hit AS (SELECT doc_id, item_id, k, i FROM dw JOIN bw USING (k, s)),
cover AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN per USING (doc_id)
"""
