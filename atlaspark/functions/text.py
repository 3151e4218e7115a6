"""Text expressions: tokens, n-grams, capitals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END, UNKNOWN = "<s>", "</s>", "<UNK>"


def tokens(text: Column, keep_digits: bool = False) -> Column:
    """Lower-cased words of a-z (and 0-9 on request), in order, with repetitions; empty for null."""
    other = "[^a-z0-9]+" if keep_digits else "[^a-z]+"
    return F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), other), lambda x: x != "")


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def padded(words: Column, n: int) -> Column:
    """n starts before, one end after."""
    return F.concat(F.array_repeat(F.lit(START), n), words, F.array(F.lit(END)))


def windows(words: Column, n: int) -> Column:
    """All runs of n words of the padded sequence, as an array of structs of w1..wn; the first is all starts.

    The last m words of these are the runs of m words of the sequence padded by m."""
    seq = padded(words, n)
    count = F.size(seq) - (n - 1)
    zipped = F.arrays_zip(*[F.slice(seq, F.lit(k), count).alias(f"w{k}") for k in range(1, n + 1)])
    return zipped.cast("array<struct<" + ",".join(f"w{k}:string" for k in range(1, n + 1)) + ">>")
