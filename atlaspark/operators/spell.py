"""Spelling: candidate words by edit distance and prefix, and the noisy channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlaspark.functions.edits import START_CHAR, characters, edit_of
from atlaspark.operators.lm import sequence_log_probability
from atlaspark.operators.storage import broadcast_if_small, checkpointed

NO_EDIT = 0.9  # chance that a word is as it was meant


@dataclass
class Channel:
    """Counts of the noisy channel: unigram(c1, n), bigram(c1, c2, n), edit(op, c1, c2, n), and the alphabet's size (one row)."""

    unigram: DataFrame
    bigram: DataFrame
    edit: DataFrame
    alphabet: DataFrame


def build_channel(spellings: DataFrame) -> Channel:
    """spellings: correct, wrong (array of misspellings). Empty misspellings are left out."""
    chars = characters(F.col("correct"))
    letters = spellings.select(F.explode(F.concat(chars, F.array(F.lit(START_CHAR)))).alias("c1"))
    pairs = F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.struct(F.get(chars, i).alias("c1"), F.get(chars, i + 1).alias("c2"))))
    unigram = letters.groupBy("c1").agg(F.count("*").alias("n"))
    bigram = spellings.select(F.inline(pairs)).groupBy("c1", "c2").agg(F.count("*").alias("n"))
    wrong = spellings.select("correct", F.explode("wrong").alias("wrong")).where("wrong <> '' and correct <> ''")
    edit = wrong.select(edit_of(F.col("wrong"), F.col("correct")).alias("e")).select("e.*").where("op <> 'none'").groupBy("op", "c1", "c2").agg(F.count("*").alias("n"))
    return Channel(unigram, bigram, edit, unigram.agg(F.count("*").alias("a")))


def edit_log_probability(pairs: DataFrame, channel: Channel) -> DataFrame:
    """Adds edit_logp to rows of typo and corrected: ln(edits + 1) - ln(chances), ln(NO_EDIT) for equal words."""
    e = pairs.withColumn("_e", edit_of(F.col("typo"), F.col("corrected")))
    e = e.withColumns({f"_{k}": F.col(f"_e.{k}") for k in ("op", "c1", "c2")}).drop("_e")
    n = lambda df, name, *keys: df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias(name))
    e = e.join(n(channel.edit, "_edits", "op", "c1", "c2"), ["_op", "_c1", "_c2"], "left")
    e = e.join(n(channel.unigram, "_one", "c1"), ["_c1"], "left").join(n(channel.bigram, "_two", "c1", "c2"), ["_c1", "_c2"], "left")
    e = e.crossJoin(F.broadcast(channel.alphabet.limit(1)))
    single = F.col("_op").isin("insertion", "substitution")
    chances = F.when(single, F.coalesce("_one", F.lit(0)) + F.col("a")).otherwise(F.coalesce("_two", F.lit(0)) + F.col("a") * F.col("a"))
    value = F.when(F.col("_op") == "none", F.lit(NO_EDIT)).otherwise((F.coalesce("_edits", F.lit(0)) + 1) / chances)
    return e.withColumn("edit_logp", F.log(value)).select(*pairs.columns, "edit_logp")


def _pieces(length, edits: int, i: int):
    """Start and size of piece i of edits + 1 pieces of a word of that length."""
    parts = edits + 1
    size, more = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return i * size + F.greatest(F.lit(0), F.lit(i - parts) + more), size + F.when(F.lit(i) >= F.lit(parts) - more, 1).otherwise(0)


def fuzzy_candidates(words: DataFrame, terms: DataFrame, edits: int) -> DataFrame:
    """words (word) and terms (term) to word, term, distance <= edits (insertions, deletions, substitutions).

    Of edits + 1 pieces of the term one occurs unchanged in the word, near its
    own place; words and terms meet on (length, piece, content), and the exact
    distance decides."""
    words, terms = words.select("word").where("word is not null").distinct(), terms.select("term").where("term is not null").distinct()
    size = F.length("term")
    own = F.array(*[F.struct(size.alias("len"), F.lit(i).alias("piece"), F.substring(F.col("term"), _pieces(size, edits, i)[0] + 1, _pieces(size, edits, i)[1]).alias("part")) for i in range(edits + 1)])
    index = terms.select("term", F.inline(own))
    n, asked = F.length("word"), []
    for d in range(-edits, edits + 1):
        for i in range(edits + 1):
            start, part = _pieces(n + d, edits, i)
            for o in range(-edits, edits + 1):
                good = (n + d > 0) & (start + o >= 0) & (start + o + part <= n)
                asked.append(F.when(good, F.struct((n + d).alias("len"), F.lit(i).alias("piece"), F.substring(F.col("word"), start + o + 1, part).alias("part"))))
    probes = broadcast_if_small(words.select("word", F.inline(F.array_distinct(F.array_compact(F.array(*asked))))))
    met = probes.join(index, ["len", "piece", "part"]).select("word", "term", F.levenshtein("word", "term", edits).alias("distance"))
    return met.where("distance >= 0").distinct()  # far more pairs meet than are near, so these are not sent on


def prefix_candidates(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term: terms that start with the word. Terms are expanded at the lengths that words have."""
    words, terms = words.select("word").where("word <> ''").distinct(), terms.select("term").distinct()
    lengths = [r[0] for r in words.select(F.length("word")).distinct().collect()]  # at most as many as the longest word has characters
    starts = F.array_compact(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    return terms.select("term", F.explode(starts).alias("word")).join(broadcast_if_small(words), "word").select("word", "term")


def query_candidates(choices: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """choices: query_id, pos, choice_ord, typo, corrected. One row per combination of a choice at each position: query_id, ord, words (array of typo, corrected).

    A position without a choice (corrected null) leaves its query without
    candidates. Combinations multiply; max_candidates keeps the first choices of
    a position only."""
    w = Window.partitionBy("query_id", "pos").orderBy("choice_ord")
    rows = choices.withColumn("_n", F.row_number().over(w))
    if max_candidates:
        rows = rows.where(F.col("_n") <= max_candidates)
    one = F.when(F.col("corrected").isNotNull(), F.struct("_n", "typo", "corrected"))
    spots = rows.groupBy("query_id", "pos").agg(F.array_sort(F.collect_list(one)).alias("c"))
    spots = spots.select("query_id", "pos", F.transform("c", lambda x: F.struct(x["typo"].alias("typo"), x["corrected"].alias("corrected"))).alias("c"))
    every = spots.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("spots"))
    word = "array<struct<typo:string,corrected:string>>"
    product = F.aggregate("spots", F.array(F.array().cast(word)), lambda acc, s: F.flatten(F.transform(acc, lambda done: F.transform(s["c"], lambda x: F.concat(done, F.array(x))))))
    return every.select("query_id", F.posexplode(product).alias("ord", "words"))


def best_queries(candidates: DataFrame, counts: DataFrame, channel: Channel, k: int = 1) -> DataFrame:
    """The k likeliest candidates of each query by language model and channel, earlier ones first among equals: query_id, place, words, logp."""
    candidates = checkpointed(candidates.withColumn("id", F.struct("query_id", "ord")))
    lm = sequence_log_probability(candidates.select("id", F.col("words.corrected").alias("words")), counts)
    edits = candidates.select("id", F.explode_outer("words").alias("w")).select("id", "w.typo", "w.corrected").where("typo is not null")
    pairs = edit_log_probability(edits.select("typo", "corrected").distinct(), channel)
    channel_p = edits.join(pairs, ["typo", "corrected"]).groupBy("id").agg(F.sum("edit_logp").alias("edit_logp"))
    scored = candidates.join(lm, "id").join(channel_p, "id").withColumn("total", F.col("logp") + F.col("edit_logp"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("total", 9)), "ord")
    ranked = scored.where(F.col("total") > float("-inf")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select("query_id", "place", F.col("words.corrected").alias("words"), F.col("total").alias("logp"))
