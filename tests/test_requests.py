"""Validation, distances and stored models."""

import pytest
from pyspark.sql import functions as F

from atlaspark.operators import fence, index, search, spatial, spell
from atlaspark.operators.storage import broadcast_if_small, built_once

DOCS = [(1, "Dunia Fantasi", "Ancol", -6.12, 106.83), (2, "Kebun Binatang Ragunan", "Pasar Minggu", -6.31, 106.82), (3, "Taman Mini", "Cipayung", -6.30, 106.89)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, name string, address string, lat double, lon double")
    idx = index.build_index(docs)
    return idx, search.language_model(idx), spell.build_channel(spark.createDataFrame([("taman", ["tamna", "tman"])], "correct string, wrong array<string>"))


def test_stored_models_answer_alike(spark, model, tmp_path):
    asked = spark.createDataFrame([(1, "Duniu Fantasi", -6.2, 106.8), (2, "taman", -6.3, 106.9)], "query_id long, text string, lat double, lon double")
    search.save_model(str(tmp_path / "m"), *model)
    rows = lambda m: sorted((x.query_id, x.rank, x.doc_id, round(x.score, 9), round(x.distance, 6)) for x in search.search(asked, *m).collect())
    found = rows(model)
    assert found == rows(search.load_model(spark, str(tmp_path / "m")))
    assert {(q, d) for q, r, d, *_ in found if r == 1} == {(1, 1), (2, 3)}
    assert abs({(q, d): x for q, _, d, _, x in found}[1, 1] - 9.4906) < 0.01


@pytest.mark.parametrize("text, lat", [("", 0.0), (None, 0.0), ("a;b", 0.0), ("taman", 91.0), ("taman", None)])
def test_bad_queries(spark, model, text, lat):
    with pytest.raises(search.BadParameter):
        search.search(spark.createDataFrame([(1, text, lat, 0.0)], "query_id long, text string, lat double, lon double"), *model)


@pytest.mark.parametrize("bad", [{"feature": "a b"}, {"feature": ""}, {"k": 101}, {"offset": -1}, {"radius": 0.0}, {"radius": 1001.0}])
def test_bad_places(spark, bad):
    rows = spark.createDataFrame([(1, 0.0, 0.0, ["a=b"])], "doc_id long, lat double, lon double, features array<string>")
    with pytest.raises(search.BadParameter):
        spatial.nearby(rows.withColumnRenamed("doc_id", "query_id"), rows, **bad)


def test_positions_are_put_and_got(spark):
    state = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0)], "point_id string, lat double, lon double")
    moves = spark.createDataFrame([("b", 1, 1, 5.0, 5.0), ("b", 1, 2, 6.0, 6.0), ("c", 1, 1, 7.0, 7.0)], "point_id string, ts int, seq int, lat double, lon double")
    new = fence.put_positions(state, moves)
    assert sorted(map(tuple, new.collect())) == [("a", 1.0, 1.0), ("b", 6.0, 6.0), ("c", 7.0, 7.0)]
    assert [tuple(x) for x in fence.get_positions(new, spark.createDataFrame([("c",), ("z",)], "point_id string")).collect()] == [("c", 7.0, 7.0)]
    steps = {(x.point_id, x.seq): x.prev_lat for x in fence.with_previous(moves, state).collect()}
    assert steps == {("b", 1): 2.0, ("b", 2): 5.0, ("c", 1): None}


def test_documents_are_upserted(spark, model, tmp_path):
    path = str(tmp_path / "i")
    index.save_index(model[0], path)
    index.upsert_documents(spark, path, spark.createDataFrame([(3, "Taman Safari", "Bogor", 0.0, 0.0), (4, "Monas", "Gambir", 0.0, 0.0)], "doc_id long, name string, address string, lat double, lon double"))
    new = index.load_index(spark, path)
    assert new.docs.count() == 4 and not index.posting_list(new, "name", "mini").count()
    assert [x.doc_id for x in index.posting_list(new, "name", "safari").collect()] == [3]


def test_artefacts_are_built_for_their_inputs(spark, tmp_path):
    table, built = str(tmp_path / "t"), []
    make = lambda path: (built.append(path), spark.range(3).write.parquet(path))
    spark.range(5).write.parquet(table)
    first = built_once(spark, "x", [table], make)
    assert built_once(spark, "x", [table], make) == first and len(built) == 1
    spark.range(500).write.mode("overwrite").parquet(table)
    assert built_once(spark, "x", [table], make) != first
    plan = lambda n: spark.range(9).join(broadcast_if_small(spark.range(5).where(F.lit(True)), n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)
