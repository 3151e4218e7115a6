"""The inverted index as tables: postings with field lengths, and one row of statistics.

docs: doc_id, name, address (and whatever else). Fields are 'name' and
'address'. A field that is null or empty has no postings and does not count in
its average length; a text without tokens counts with length 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaspark.functions.text import tokens

FIELDS = ("name", "address")


@dataclass
class Index:
    postings: DataFrame  # field, term, doc_id, tf, len
    stats: DataFrame  # one row: n_docs, avg_name, avg_address, avg_doc
    docs: DataFrame
    tokens: DataFrame | None = None  # the token stream, while the index is not stored

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms only. Without a stored index, tokens are chosen before they are counted."""
        if self.tokens is None:
            return self.postings.join(terms, "term", "left_semi")
        return counted(self.tokens.join(terms, "term", "left_semi"))


def token_stream(docs: DataFrame, keep_digits: bool = False) -> DataFrame:
    """field, doc_id, pos, term: every token of every field."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f), keep_digits).alias("words")) for f in FIELDS])
    return docs.select("doc_id", F.inline(fields)).select("field", "doc_id", F.size("words").alias("len"), F.posexplode("words").alias("pos", "term"))


def counted(stream: DataFrame) -> DataFrame:
    return stream.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def postings(docs: DataFrame, keep_digits: bool = False) -> DataFrame:
    return counted(token_stream(docs, keep_digits))


def field_lengths(docs: DataFrame, keep_digits: bool = False) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), F.size(tokens(F.col(f), keep_digits)).cast("long").alias("len")) for f in FIELDS])
    return docs.select("doc_id", F.inline(fields)).where("raw <> ''").select("field", "doc_id", "len")


def statistics(docs: DataFrame, keep_digits: bool = False) -> DataFrame:
    size = lambda f: F.size(tokens(F.col(f), keep_digits))
    means = [F.avg(F.when(F.col(f) != "", size(f))).alias(f"avg_{f}") for f in FIELDS]
    return docs.agg(F.count("*").alias("n_docs"), *means, F.avg(size("name") + size("address")).alias("avg_doc"))


def build_index(docs: DataFrame, keep_digits: bool = False) -> Index:
    stream = token_stream(docs, keep_digits)
    return Index(counted(stream), statistics(docs, keep_digits), docs, stream)


def save_index(index: Index, path: str) -> None:
    """Overwrites path. Postings are laid out by field and sorted by term, so a term's rows are found by row-group statistics."""
    index.postings.repartitionByRange("field", "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def upsert_documents(spark: SparkSession, path: str, changed: DataFrame) -> None:
    """Replaces or adds documents of a stored index by doc_id; the new index is written beside the old one, then takes its place."""
    old = spark.read.parquet(f"{path}/docs")
    docs = old.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed.select(*old.columns))
    save_index(build_index(docs), f"{path}.new")
    jvm = spark.sparkContext._jvm
    here, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(here, True)
    fs.rename(new, here)


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "stats", "docs")])


def posting_list(index: Index, field: str, term: str) -> DataFrame:
    """doc_id, tf of one term; empty for an unknown term."""
    return index.postings.where((F.col("field") == field) & (F.col("term") == term)).select("doc_id", "tf")


def document_frequency(index: Index) -> DataFrame:
    """term, df: documents with the term in any field."""
    rows = index.postings if index.tokens is None else index.tokens
    return rows.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def dictionary(index: Index) -> DataFrame:
    """All terms, once."""
    return (index.postings if index.tokens is None else index.tokens).select("term").distinct()


def run_lengths(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Run-length encoding of value along order within key: key, run, value, count. Empty input gives no rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    starts = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", value).agg(F.count("*").alias("count"))
