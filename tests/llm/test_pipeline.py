import corpus_pipeline as pipeline
from atlaspark.llm import near_dup, quality
from atlaspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]


def test_stages_do_what_they_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = {x.doc_id for x in docs.collect()}, []
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append({x.doc_id: x.text for x in docs.collect()})
    assert all(a.keys() >= b.keys() for a, b in zip(kept, kept[1:], strict=False)) and kept[0].keys() <= before
    wrong = sum((d in kept[0]) != bool(q) for d, q in labels.items())
    assert wrong <= 0.1 * len(labels)
    seen = set()
    for d in sorted(kept[1]):
        for x in kept[1][d].split("\n"):
            if len(x) >= 10 and not x.isspace():
                assert x not in seen
                seen.add(x)
    again = near_dup.near_duplicates(spark.createDataFrame(list(kept[2].items()), "doc_id long, text string"))
    assert again.where("not kept").count() == 0
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {x.doc_id for x in pieces} == set(kept[3])
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, pipeline.run(spark, SF).collect()))


def test_quality_reads_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    other = docs.selectExpr("doc_id + 10000 AS doc_id", "text", "'xx' AS lang", "'s' AS source", "0L AS n_chars")
    score = lambda d: sorted((x.text, x.score) for x in quality.score_documents(d, model).collect())
    assert score(docs) == score(other)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
