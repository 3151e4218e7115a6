"""Ranking of documents for batches of queries.

query_terms: query_id, term, one row per occurrence. Rankers return query_id,
doc_id, score. Terms meet postings in one join; a (term, doc) row is scored from
its own columns, the term's document frequency and one row of statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlaspark.functions.text import tokens
from atlaspark.operators.index import Index
from atlaspark.operators.storage import broadcast_if_small, dealt

# Weights and saturation of the three rankers.
WANTED = 500_000  # words of queries that are broadcast
K1, B, DELTA = 1.2, 0.98, 1.0
K1_FIELD, NAME_WEIGHT, ADDRESS_WEIGHT, NAME_B = 10.0, 20.0, 1.0, 0.95


def query_terms(queries: DataFrame, keep_digits: bool = False) -> DataFrame:
    return queries.select("query_id", F.posexplode(tokens(F.col("text"), keep_digits)).alias("pos", "term"))


def matched(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, term, doc_id, qn (occurrences in the query), df, tf and len by field, and the statistics.

    Postings are dealt by document, once; where the queries' terms are few
    enough to be broadcast, rows stay where they are from there on, so scores
    are added up and pages begun without sending a row for each query and
    document."""
    wanted = broadcast_if_small(terms.groupBy("query_id", "term").agg(F.count("*").alias("qn")), WANTED)
    of = lambda c, f: F.coalesce(F.max(F.when(F.col("field") == f, F.col(c))), F.lit(0))
    rows = index.of_terms(broadcast_if_small(wanted.select("term").distinct()))
    rows = dealt(rows, "doc_id").groupBy("term", "doc_id").agg(*[of(c, f).alias(f"{c}_{f}") for c in ("tf", "len") for f in ("name", "address")])
    df = broadcast_if_small(rows.groupBy("term").agg(F.count("*").alias("df")), WANTED)
    return rows.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(index.stats.limit(1)))


def _score(rows: DataFrame, term_score: Column) -> DataFrame:
    return rows.groupBy("query_id", "doc_id").agg(F.sum(term_score).alias("score"))


def bm25_fields(index: Index, terms: DataFrame, canonical: bool = False) -> DataFrame:
    """Field-weighted BM25; repeated query terms count again, and idf can be negative.

    Saturation is per field; canonical adds the fields' weights before it saturates."""

    def weight(field: str, factor: float) -> Column:
        spread = F.lit(1.0) + F.lit(NAME_B) * (F.col(f"len_{field}") / F.col(f"avg_{field}") - 1.0)
        return F.when(F.col(f"tf_{field}") > 0, F.lit(factor) * F.col(f"tf_{field}") / spread).otherwise(0.0)

    idf = F.log10(F.col("n_docs") - F.col("df") + 0.5) - F.log10(F.col("df") + 0.5)
    name, address = weight("name", NAME_WEIGHT), weight("address", ADDRESS_WEIGHT)
    fill = lambda w: w / (F.lit(K1_FIELD) + w)
    return _score(matched(index, terms), F.col("qn") * idf * (fill(name + address) if canonical else fill(name) + fill(address)))


def bm25_plus(index: Index, terms: DataFrame, canonical: bool = False) -> DataFrame:
    """BM25+ over both fields joined; query terms count once. Term frequency is added in the numerator; canonical multiplies it."""
    rows = matched(index, terms).withColumn("tf", F.col("tf_name") + F.col("tf_address"))
    full = index.docs.select("doc_id", (F.size(tokens(F.col("name"))) + F.size(tokens(F.col("address")))).alias("doc_len"))
    rows = rows.join(full, "doc_id")
    idf = F.log10(F.col("n_docs") + 1) - F.log10(F.col("df"))
    numerator = F.lit(K1 + 1) * F.col("tf") if canonical else F.lit(K1 + 1) + F.col("tf")
    return _score(rows, idf * (F.lit(DELTA) + numerator / (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_doc")) + F.col("tf"))))


def tf_idf(index: Index, terms: DataFrame, normalize: bool = False) -> DataFrame:
    """Log-weighted dot product of query and document; normalize divides by both norms over the query's terms."""
    idf = F.log10("n_docs") - F.log10("df")
    doc = (F.lit(1.0) + F.log10(F.col("tf_name") + F.col("tf_address"))) * idf
    query = (F.lit(1.0) + F.log10("qn")) * idf
    rows = matched(index, terms)
    if not normalize:
        return _score(rows, doc * query)
    sums = rows.groupBy("query_id", "doc_id").agg(F.sum(doc * query).alias("s"), F.sqrt(F.sum(doc * doc)).alias("d"), F.sqrt(F.sum(query * query)).alias("q"))
    return sums.select("query_id", "doc_id", F.coalesce(F.try_divide("s", F.col("d") * F.col("q")), F.lit(0.0)).alias("score"))


RANKERS = {"bm25_field": bm25_fields, "bm25_plus": bm25_plus, "tf_idf": tf_idf}


def page(scores: DataFrame, k: int = 10, offset: int = 0, digits: int = 9) -> DataFrame:
    """Rows offset+1..offset+k of each query by score (compared to `digits` places), then doc_id; k = 0 means 10."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + (k or 10)))


def top_documents(index: Index, terms: DataFrame, ranker: str = "bm25_field", k: int = 10, offset: int = 0) -> DataFrame:
    """The page of each query with the documents' columns, which are fetched after paging."""
    best = page(RANKERS[ranker](index, terms), k, offset)
    return best.join(index.docs, "doc_id")
