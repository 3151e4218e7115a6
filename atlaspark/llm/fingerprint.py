"""Exact document fingerprints, in DataFrame functions only.

The canonical text is NFKC-normalised and case-folded ("straße" and "STRASSE" agree),
with each run of white space folded to one space and none at either end. Its fingerprint is 128 bits: two xxHash64 of it under different
salts, as 32 hex digits. Where two fingerprints are equal the canonical bytes are
compared too, so likeness is 1.0 only for equal canonical texts, and groups hold
equal canonical texts only.

NFKC and case folding come from the ICU library among Spark's own jars, through java_method; a Spark
built without it needs another normaliser in canonical().

Documents in order: descending doc_id, rows of equal doc_id by their text's hash,
then text; rows without doc_id come last, in the order of that hash. Null texts are
empty texts; all empty texts share one fingerprint. Any 64-bit doc_ids will do.
Empty tables give empty results; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise, table

CELL_ROWS = 500  # documents in one cell of the document order at least, on average
CELLS = 16  # cells for each shuffle partition at most, so that what reaches the driver follows the cluster, not the data


def canonical(text: Column) -> Column:
    icu = lambda kind, name, x: F.call_function("java_method", F.lit(f"com.ibm.icu.{kind}"), F.lit(name), x, F.lit(True))
    return F.trim(F.regexp_replace(icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text)), r"[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    wide = [F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)]
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in wide]))


def exact_groups(docs: DataFrame) -> DataFrame:
    """fingerprint, check, group_id (smallest doc_id with the same canonical bytes), n_docs: one row per group of at least two.

    Documents are grouped by digest and, inside a digest, by canonical bytes;
    copies fall together before the shuffle. check: SHA-256 of the bytes, which
    names the group in its bucket.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    groups = texts.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs")).where("n_docs > 1")
    return groups.select("fingerprint", F.sha2("canon", 256).alias("check"), "group_id", "n_docs")


def cell_of(borders: list[int], nulls: int) -> Column:
    """The number of borders above doc_id, by binary search; rows without doc_id follow, in equal ranges of their hash."""
    cell = F.lit(0)
    if borders:
        above, steps = F.lit(borders), [1 << k for k in reversed(range(len(borders).bit_length()))]
        cell = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(borders)) & (F.get(above, at + step - 1) > F.col("doc_id")), at + step).otherwise(at))
    bits = nulls.bit_length()
    beyond = F.shiftrightunsigned(F.col("k2").bitwiseXOR(F.lit(-(2**63))), 64 - bits).cast("int") if bits else F.lit(0)
    return F.when(F.col("doc_id").isNull(), beyond + (len(borders) + 1)).otherwise(cell)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text that follows in the documents' order, the first one after the last.

    The order is dealt into cells between quantiles of doc_id. The first document
    of a cell is also sent to the cell before it, so one shuffle of the texts
    brings every neighbour together. Only equal rows are never split.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.col("doc_id").isNull().alias("k0"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"))
    n, nulls = docs.select("doc_id").agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    most = CELLS * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = max(1, min(most, n // CELL_ROWS))
    shares = [i / cells for i in range(1, cells)]
    borders = docs.select("doc_id").agg(F.percentile_approx("doc_id", shares, 10 * most)).first()[0] if shares else []
    docs = docs.withColumn("cell", cell_of(sorted(set(borders or []), reverse=True), min(most, nulls // CELL_ROWS)))
    tops = docs.groupBy("cell").agg(F.min(F.struct("k0", "k1", "k2")).alias("top"))
    before = Window.orderBy("cell")
    last = F.max("cell").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("top.*", F.coalesce(F.lag("cell").over(before), last).alias("target"))
    sent = docs.join(F.broadcast(tops), ["k0", "k1", "k2"], "left")
    place = lambda c, ghost: F.struct(c.alias("at"), F.lit(ghost).alias("ghost"))
    sent = sent.select("doc_id", "text", "k0", "k1", "k2", F.explode(F.when(F.col("target").isNull(), F.array(place(F.col("cell"), False))).otherwise(F.array(place(F.col("cell"), False), place(F.col("target"), True)))).alias("to"))
    order = Window.partitionBy("to.at").orderBy("to.ghost", "k0", "k1", "k2", "text")
    return sent.withColumn("next_text", F.lead("text").over(order)).where("not to.ghost").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edit, and their likeness, as in op6; and group_id and n_docs, the least doc_id and the number of documents of equal canonical text."""
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = with_next(docs).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"),
        canonical(F.col("text")).alias("canon"),
        canonical(F.col("next_text")).alias("next_canon"),
    )
    rows = rows.withColumn("edited_canon", canonical(F.col("edited")))
    like = lambda a, b: F.when((digest(a) == digest(b)) & (a == b), 1.0).otherwise(0.0)
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("canon")).alias("fingerprint"),
        digest(F.col("edited_canon")).alias("edited_fingerprint"),
        like(F.col("canon"), F.col("edited_canon")).alias("near_edited"),
        like(F.col("canon"), F.col("next_canon")).alias("near_next"),
        F.sha2("canon", 256).alias("check"),
    )
    rows = materialise(rows, "fingerprints")
    found = rows.join(exact_groups(docs), ["fingerprint", "check"], "left")
    return found.select(*[c for c in rows.columns if c != "check"], F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_docs", F.lit(1)).cast("long").alias("n_docs"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
