"""Search and autocomplete for batches of queries (query_id, text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.functions import geo
from atlaspark.operators import index as ix
from atlaspark.operators import lm, rank, spell
from atlaspark.operators.storage import checkpointed

# What a query and its paging may be.
QUERY = re.compile(r"^[A-Za-z0-9_ +,.()'-]+$")
FEATURE = re.compile(r"^[a-zA-Z0-9_:=]+$")
MAX_PAGE, MAX_RADIUS_KM = 100, 1000


class BadParameter(ValueError):
    """A request parameter is out of range."""


def validate(query: str | None = None, k: int = 10, offset: int = 0, lat: float | None = None, lon: float | None = None, feature: str | None = None, radius: float | None = None) -> None:
    if query is not None and not QUERY.match(query):
        raise BadParameter("query is empty or holds other characters than letters, digits and _ +,.()'-")
    if not 0 <= k <= MAX_PAGE:
        raise BadParameter(f"k must be from 1 to {MAX_PAGE}")
    if offset < 0:
        raise BadParameter("offset must not be negative")
    if lat is not None and not -90 <= lat <= 90:
        raise BadParameter("lat must be from -90 to 90")
    if lon is not None and not -180 <= lon <= 180:
        raise BadParameter("lon must be from -180 to 180")
    if feature is not None and not FEATURE.match(feature):
        raise BadParameter("feature is empty or holds other characters than letters, digits and _ : =")
    if radius is not None and not 0 < radius <= MAX_RADIUS_KM:
        raise BadParameter(f"radius must be above 0 and at most {MAX_RADIUS_KM} km")


def validate_queries(queries: DataFrame) -> None:
    """Raises for the first query of the batch whose text, lat or lon (if there) validate() would not take."""
    texts = ~F.coalesce(F.col("text"), F.lit("")).rlike(QUERY.pattern)
    places = [~F.coalesce(F.col(c).between(-most, most), F.lit(False)) for c, most in (("lat", 90), ("lon", 180)) if c in queries.columns]
    wrong = texts
    for x in places:
        wrong = wrong | x
    if bad := queries.where(wrong).limit(1).collect():
        raise BadParameter(f"query {bad[0]['query_id']}: text, lat or lon out of range")


def with_distance(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds to results (query_id, lat, lon of the document) the distance in km from the query's lat and lon; ranks stay as they are."""
    users = queries.select("query_id", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    return found.join(users, "query_id").withColumn("distance", geo.haversine("_lat", "_lon", "lat", "lon")).drop("_lat", "_lon")


def spelling_choices(terms: DataFrame, index: ix.Index, prefixes: bool) -> DataFrame:
    """For each query term the words it may stand for: itself if known, else words it starts (on request), then words one and two edits away, by term."""
    known = ix.dictionary(index)
    flagged = terms.join(known.select("term", F.lit(True).alias("known")), "term", "left")
    own = flagged.where("known").select("query_id", "pos", F.struct(F.lit(0).alias("source"), "term").alias("choice_ord"), F.col("term").alias("typo"), F.col("term").alias("corrected"))
    unknown = flagged.where("known is null").select("query_id", "pos", F.col("term").alias("word"))
    words = unknown.select("word").distinct()
    found = spell.fuzzy_candidates(words, known, 2).select("word", "term", F.greatest(F.lit(1), "distance").alias("source"), F.col("word").alias("typo"))
    if prefixes:  # a completion counts as no edit
        ahead = spell.prefix_candidates(words, known).select("word", "term", F.lit(0).alias("source"), F.col("term").alias("typo"))
        found = found.unionByName(ahead)
    found = found.groupBy("word", "term").agg(F.min(F.struct("source", "typo")).alias("best"))
    found = found.select("word", F.struct(F.col("best.source").alias("source"), "term").alias("choice_ord"), F.col("best.typo").alias("typo"), F.col("term").alias("corrected"))
    guessed = unknown.join(found, "word", "left").select("query_id", "pos", "choice_ord", "typo", "corrected")
    return own.unionByName(guessed)


def corrected_queries(queries: DataFrame, index: ix.Index, counts: DataFrame, channel: spell.Channel, k: int = 1, prefixes: bool = False, max_candidates: int | None = None) -> DataFrame:
    """query_id, place, words, logp: the likeliest spellings; none if a word has no candidate."""
    terms = rank.query_terms(queries)
    return spell.best_queries(spell.query_candidates(spelling_choices(terms, index, prefixes), max_candidates), counts, channel, k)


def _finished(paged: DataFrame, queries: DataFrame) -> DataFrame:
    """With the distance to the user, if queries and documents have positions."""
    return with_distance(paged, queries) if {"lat", "lon"} <= set(queries.columns) & set(paged.columns) else paged


def search(queries: DataFrame, index: ix.Index, counts: DataFrame, channel: spell.Channel, k: int = 10, offset: int = 0, ranker: str = "bm25_field", max_candidates: int | None = None) -> DataFrame:
    """query_id, rank, score and the documents of each query's page, after correction; distance where queries have lat and lon."""
    validate(k=k, offset=offset)
    validate_queries(queries)
    best = checkpointed(corrected_queries(queries, index, counts, channel, 1, False, max_candidates))
    terms = best.select("query_id", F.explode("words").alias("term"))
    return _finished(rank.top_documents(index, terms, ranker, k, offset), queries)


def autocomplete(queries: DataFrame, index: ix.Index, counts: DataFrame, channel: spell.Channel, k: int = 10, offset: int = 0, dedup: bool = False, max_candidates: int | None = None) -> DataFrame:
    """As search, over the three likeliest completions or corrections; a document found by several comes several times unless dedup."""
    validate(k=k, offset=offset)
    validate_queries(queries)
    best = checkpointed(corrected_queries(queries, index, counts, channel, 3, True, max_candidates))
    terms = best.select(F.struct("query_id", "place").alias("query_id"), F.explode("words").alias("term"))
    scores = rank.bm25_fields(index, terms).select("query_id.query_id", "query_id.place", "doc_id", "score")
    if dedup:
        scores = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id", "place")
    paged = scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + (k or 10)))
    return _finished(paged.join(index.docs, "doc_id"), queries)


def language_model(index: ix.Index) -> DataFrame:
    return lm.ngram_counts(lm.corpus(index.docs))


def save_model(path: str, index: ix.Index, counts: DataFrame, channel: spell.Channel) -> None:
    """Writes index, n-gram counts and channel under path, overwriting it."""
    ix.save_index(index, f"{path}/index")
    tables = {"counts": counts, "unigram": channel.unigram, "bigram": channel.bigram, "edit": channel.edit, "alphabet": channel.alphabet}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[ix.Index, DataFrame, spell.Channel]:
    """What save_model() wrote."""
    counts, *channel = (spark.read.parquet(f"{path}/{name}") for name in ("counts", "unigram", "bigram", "edit", "alphabet"))
    return ix.load_index(spark, f"{path}/index"), counts, spell.Channel(*channel)
