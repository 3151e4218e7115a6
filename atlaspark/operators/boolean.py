"""Boolean retrieval over one field.

Queries hold terms, AND, OR, NOT and parentheses; NOT binds closest, then AND,
then OR. The plan is built from set operations on document ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaspark.operators.index import Index

BINDING = {"NOT": 3, "AND": 2, "OR": 1}


def postfix(query: str) -> list[str]:
    """Operators after their operands."""
    out, waiting = [], []
    for t in re.findall(r"[()]|[^\s()]+", query):
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("unbalanced parentheses")
            waiting.pop()
        elif t in BINDING:
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] > BINDING[t] - (t != "NOT"):
                out.append(waiting.pop())
            waiting.append(t)
        else:
            out.append(t.lower())
    while waiting:
        if waiting[-1] == "(":
            raise ValueError("unbalanced parentheses")
        out.append(waiting.pop())
    return out


def boolean_query(index: Index, query: str, field: str = "name") -> DataFrame:
    """doc_id of the documents that satisfy the query, once each."""
    stack: list[DataFrame] = []
    for t in postfix(query):
        if t in BINDING and len(stack) < 1 + (t != "NOT"):
            raise ValueError(f"{t} lacks an operand")
        if t == "AND":
            right, left = stack.pop(), stack.pop()
            stack.append(left.join(right, "doc_id", "left_semi"))
        elif t == "OR":
            right, left = stack.pop(), stack.pop()
            stack.append(left.union(right).distinct())
        elif t == "NOT":
            stack.append(index.docs.select("doc_id").distinct().join(stack.pop(), "doc_id", "left_anti"))
        else:
            stack.append(index.postings.where((F.col("field") == field) & (F.col("term") == t)).select("doc_id").distinct())
    if len(stack) != 1:
        raise ValueError("operands without an operator between them")
    return stack[0]


def occurrences(index: Index, term: str, field: str = "name") -> DataFrame:
    """doc_id, once for each time the term occurs."""
    rows = index.postings.where((F.col("field") == field) & (F.col("term") == term))
    return rows.select(F.explode(F.array_repeat("doc_id", F.col("tf").cast("int"))).alias("doc_id"))


def intersect_postings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset intersection: an id occurs as often as in the list where it is rarer."""
    return a.intersectAll(b)
