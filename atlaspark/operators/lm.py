"""N-gram language model with stupid back-off.

sequences: id, words. Counts are one table (n, gram, cnt), gram being words
joined by a space; the total is the sum over n = 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaspark.functions.text import UNKNOWN, tokens, windows
from atlaspark.operators.storage import broadcast_if_small

ORDER, BACKOFF = 4, 0.4
PIECE = 16 << 20  # characters of text whose n-grams a task counts before they are sent


def corpus(docs: DataFrame, keep_digits: bool = False) -> DataFrame:
    """One sequence per document: tokens of name and address."""
    return docs.select(F.col("doc_id").alias("id"), tokens(F.concat_ws(" ", "name", "address"), keep_digits).alias("words"))


def in_pieces(docs: DataFrame, chars: int = PIECE) -> DataFrame:
    """docs dealt out so that a task sees about so many characters of name and address, however many a file's parts hold; so what it holds of n-grams is bounded."""
    total = docs.agg(F.sum(F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("address", F.lit(""))))).first()[0] or 0
    return docs.repartition(max(1, -(-total // chars)), "doc_id")


def vocabulary(sequences: DataFrame, min_count: int = 1) -> DataFrame:
    return sequences.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)


def replace_rare(sequences: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words outside the vocabulary become <UNK>."""
    words = sequences.select("id", F.posexplode_outer("words").alias("pos", "term")).join(vocab.select("term", F.lit(True).alias("known")), "term", "left")
    word = F.when(F.col("pos").isNotNull(), F.struct("pos", F.when(F.col("known"), F.col("term")).otherwise(F.lit(UNKNOWN)).alias("w")))
    return words.groupBy("id").agg(F.array_sort(F.collect_list(word)).alias("w")).select("id", F.col("w.w").alias("words"))


def ngram_counts(sequences: DataFrame, order: int = ORDER, sizes: list[int] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Counts of all n-grams up to `order`, or of the sizes given, or of those in only (n, gram). One pass over the sequences serves all sizes."""
    runs = sequences.select(F.inline(windows(F.col("words"), order)))
    tail = lambda n: F.concat_ws(" ", *[f"w{k}" for k in range(order - n + 1, order + 1)])
    if sizes is not None and len(sizes) == 1 and only is None:  # rows need not carry an n that is the same in all of them
        return runs.select(tail(sizes[0]).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt")).select(F.lit(sizes[0]).alias("n"), "gram", "cnt")
    grams = F.array(*[F.struct(F.lit(n).alias("n"), tail(n).alias("gram")) for n in sizes or range(1, order + 1)])
    rows = runs.select(F.inline(grams))
    if only is not None:
        rows = rows.join(only, ["n", "gram"], "left_semi")
    return rows.groupBy("n", "gram").agg(F.count("*").alias("cnt"))


def total_words(counts: DataFrame) -> DataFrame:
    """One row."""
    return counts.where("n = 1").agg(F.sum("cnt").alias("total"))


def total_of(sequences: DataFrame, order: int = ORDER) -> DataFrame:
    """One row: the same total from the sequences, without counting n-grams."""
    return sequences.agg(F.coalesce(F.sum(F.size(windows(F.col("words"), order))), F.lit(0)).alias("total"))


def asked_grams(windows_asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, gram), once each: all that probabilities() looks up for windows (gram, an array)."""
    size = F.size("gram")
    ends = [F.struct(F.lit(n).alias("n"), F.array_join(F.slice("gram", size - m + 1, F.lit(n)), " ").alias("gram")) for n, m in [(n, n) for n in range(1, order + 1)] + [(n - 1, n) for n in range(2, order + 1)]]
    return windows_asked.select(F.inline(F.array(*ends))).distinct()


def probabilities(asked: DataFrame, counts: DataFrame, order: int = ORDER, total: DataFrame | None = None) -> DataFrame:
    """asked: key columns and gram, an array of context and word. Adds p1..p`order` (0 if unseen) and p, the back-off value.

    A window's lookups are rows of one join, not a join each."""
    keys = [c for c in asked.columns if c != "gram"]
    size = F.size("gram")
    slots = [(f"c{n}", F.slice("gram", size - n + 1, F.lit(n)), n) for n in range(1, order + 1)] + [(f"x{n}", F.slice("gram", size - n + 1, F.lit(n - 1)), n - 1) for n in range(2, order + 1)]
    lookups = F.array(*[F.struct(F.lit(name).alias("slot"), F.lit(n).alias("n"), F.array_join(gram, " ").alias("look")) for name, gram, n in slots])
    rows = asked.select(*keys, F.inline(lookups)).join(counts.select("n", F.col("gram").alias("look"), "cnt"), ["n", "look"], "left")
    wide = rows.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("slot") == name, F.col("cnt"))), F.lit(0)).alias(name) for name, *_ in slots])
    wide = wide.crossJoin(F.broadcast(total_words(counts) if total is None else total))
    p = {1: F.coalesce(F.try_divide(F.col("c1"), F.col("total")), F.lit(0.0))} | {n: F.coalesce(F.try_divide(F.col(f"c{n}"), F.col(f"x{n}")), F.lit(0.0)) for n in range(2, order + 1)}
    best = F.lit(0.0)
    for n in range(1, order + 1):
        best = F.when(p[n] > 0, p[n] * BACKOFF ** (order - n)).otherwise(best)
    return wide.select(*keys, *[p[n].alias(f"p{n}") for n in p], best.alias("p"))


def sequence_log_probability(sequences: DataFrame, counts: DataFrame | None, order: int = ORDER, corpus: DataFrame | None = None) -> DataFrame:
    """id, logp: natural log of the product over all words and the end; -Infinity if a word is unknown.

    Without stored counts, those n-grams of the corpus are counted that are asked for."""
    runs = sequences.select("id", F.posexplode(windows(F.col("words"), order)).alias("pos", "w")).where("pos > 0")
    asked = runs.select("id", "pos", F.array(*[F.col(f"w.w{k}") for k in range(1, order + 1)]).alias("gram"))
    total = None
    if counts is None:
        counts, total = ngram_counts(corpus, order, only=broadcast_if_small(asked_grams(asked, order))), total_of(corpus, order)
    p = probabilities(asked, counts, order, total)
    return p.groupBy("id").agg(F.when(F.min("p") > 0, F.sum(F.when(F.col("p") > 0, F.log("p")))).otherwise(F.lit(float("-inf"))).alias("logp"))
