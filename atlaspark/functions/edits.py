"""The kind of edit that turns a word into a misspelling, as a Column expression.

Only the first difference counts. Results are structs of op, c1 and c2:
equal words give op 'none'. Same length: 'transposition' if both words hold the
same characters, else 'substitution', of the differing pair. Longer: 'insertion'
of the character after the one before it. Shorter: 'deletion'. '-' stands for the
start of the word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlaspark.functions.geo import let

START_CHAR = "-"


def characters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def edit_of(edited: Column, original: Column) -> Column:
    def classify(v: Column) -> Column:
        e, o, ne, no = v["e"], v["o"], F.size(v["e"]), F.size(v["o"])
        common = F.least(ne, no)
        # Index from 0 of the first difference in the common part; its length if there is none.
        at = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(common - 1, F.lit(0))), lambda i: F.get(e, i) != F.get(o, i))), common)
        make = lambda op, a, b: F.struct(F.lit(op).alias("op"), a.alias("c1"), b.alias("c2"))
        before = lambda i: F.when(i > 0, F.get(o, i - 1)).otherwise(F.lit(START_CHAR))

        def place(i: Column) -> Column:
            same = F.array_sort(e) == F.array_sort(o)
            longer = F.when(i < common, make("insertion", F.get(e, i), before(i))).otherwise(make("insertion", F.get(e, ne - 1), F.coalesce(F.get(o, no - 1), F.lit(START_CHAR))))
            shorter = F.when(i < common, make("deletion", F.get(e, i), before(i))).otherwise(make("deletion", F.coalesce(F.get(e, ne - 1), F.lit(START_CHAR)), F.when(no > 1, F.get(o, no - 2)).otherwise(F.lit(START_CHAR))))
            level = F.when(same, make("transposition", F.get(e, i), F.get(o, i))).otherwise(make("substitution", F.get(e, i), F.get(o, i)))
            none = F.struct(F.lit("none").alias("op"), F.lit(None).cast("string").alias("c1"), F.lit(None).cast("string").alias("c2"))
            return F.when(e == o, none).when(ne == no, level).when(ne > no, longer).otherwise(shorter)

        return let(at, place)

    return let(F.struct(characters(edited).alias("e"), characters(original).alias("o")), classify)
