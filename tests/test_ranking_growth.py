"""Scores are added up where a document's postings are."""

import pytest

from atlaspark.operators import index as ix
from atlaspark.operators import rank


@pytest.mark.parametrize("ranker", sorted(rank.RANKERS))
def test_no_row_for_each_query_and_document_is_sent(spark, ranker, monkeypatch):
    docs = spark.createDataFrame([(i, "old mill" if i % 2 else "mill", "by the river " * (i % 5)) for i in range(60)], "doc_id long, name string, address string")
    index = ix.build_index(docs)
    terms = rank.query_terms(spark.createDataFrame([(1, "the old mill"), (2, "river mill mill")], "query_id long, text string"))
    scores = rank.RANKERS[ranker](index, terms)
    assert "hashpartitioning(query_id" not in scores._jdf.queryExecution().executedPlan().toString()
    got = {(x.query_id, x.doc_id): x.score for x in scores.collect()}
    monkeypatch.setattr(rank, "WANTED", 0)  # too many words to broadcast
    joined = {(x.query_id, x.doc_id): x.score for x in rank.RANKERS[ranker](index, terms).collect()}
    assert got.keys() == joined.keys() and all(joined[k] == pytest.approx(v, abs=1e-12) for k, v in got.items())
