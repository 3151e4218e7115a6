"""What a task holds of n-grams follows from a fixed amount of text."""

from pyspark.sql import functions as F

from atlaspark.operators import lm


def test_pieces_follow_the_text(spark):
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("old mill").alias("name"), F.concat(F.lit("by the river no "), F.col("id") % 7).alias("address"))
    pieces = lm.in_pieces(docs, 1000)
    sizes = [x["n"] for x in pieces.groupBy(F.spark_partition_id()).agg(F.sum(F.length("name") + F.length("address")).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 3000 and pieces.count() == 400
    for n in (1, 2, 4):
        one = lm.ngram_counts(lm.corpus(pieces), n, [n])
        assert one.columns == ["n", "gram", "cnt"]
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, lm.ngram_counts(lm.corpus(docs), 4).where(F.col("n") == n).collect()))
    assert lm.in_pieces(docs.limit(0)).count() == 0
