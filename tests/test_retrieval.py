import itertools
import math

import pytest
from pyspark.sql import functions as F

from atlaspark.functions.edits import edit_of
from atlaspark.operators import boolean, lm, rank, search, spell
from atlaspark.operators import index as ix

NAMES = [
    "Jalan Sentosa Harapan", "Jalan Dunia Baru", "Jalan Mulwo Apel", "Jalan Kebun Jeruk Apel", "Jalan Pantai Ancol", "Jalan Gambir",
    "Jalan Pasar Minggu", "Jalan Adi Sucipto", "Jalan Ahmad Yani", "Jalan Dani", "Jalan Dani Jadul",
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(n, name, name + ", ") for n, name in enumerate(NAMES)], "doc_id long, name string, address string").cache()
    return ix.build_index(docs)


def scores(spark, index, ranker, text):
    terms = rank.query_terms(spark.createDataFrame([(1, text)], "query_id long, text string"))
    return {r.doc_id: r.score for r in rank.RANKERS[ranker](index, terms).collect()}


def test_postings(index):
    rows = index.postings.where("field = 'name'").collect()
    found = {}
    for r in rows:
        found.setdefault(r.term, []).append(r.doc_id)
    assert len(found) == 20
    assert sorted(found["jalan"]) == list(range(11)) and sorted(found["apel"]) == [2, 3] and sorted(found["dani"]) == [9, 10]
    assert index.stats.first().avg_name == pytest.approx(32 / 11)


def test_field_weighted_scores(spark, index):
    s = scores(spark, index, "bm25_field", "jalan dani")
    assert len(s) == 11
    assert s[10] == pytest.approx(-0.585405796, abs=1e-8) and s[9] == pytest.approx(-0.675911046, abs=1e-8)
    assert s[3] == pytest.approx(-0.904967136, abs=1e-8) and s[5] == pytest.approx(-1.177074834, abs=1e-8)
    s = scores(spark, index, "bm25_field", "dani")
    assert s == {9: pytest.approx(0.501163788, abs=1e-8), 10: pytest.approx(0.434057393, abs=1e-8)}


def test_other_rankers(spark, index):
    s = scores(spark, index, "bm25_plus", "jalan dani")
    assert s[9] == pytest.approx(2.025806433, abs=1e-8) and s[5] == pytest.approx(0.093821025, abs=1e-8) and s[3] == pytest.approx(0.081378771, abs=1e-8)
    s = scores(spark, index, "tf_idf", "jalan dani")
    assert s[9] == pytest.approx(0.713142564, abs=1e-8) and s[0] == 0.0


def test_paging_and_ties(spark, index):
    terms = rank.query_terms(spark.createDataFrame([(1, "jalan")], "query_id long, text string"))
    pages = [[r.doc_id for r in rank.page(rank.tf_idf(index, terms), 4, o).orderBy("rank").collect()] for o in (0, 4, 8, 12)]
    assert pages == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10], []]


def test_save_and_load(spark, index, tmp_path):
    ix.save_index(index, str(tmp_path / "i"))
    ix.save_index(index, str(tmp_path / "i"))
    loaded = ix.load_index(spark, str(tmp_path / "i"))
    assert loaded.postings.count() == index.postings.count()
    assert [r.doc_id for r in ix.posting_list(loaded, "name", "apel").orderBy("doc_id").collect()] == [2, 3]
    assert ix.posting_list(loaded, "name", "nothing").count() == 0


@pytest.mark.parametrize("text,want", [("dani AND jadul", {10}), ("apel OR dani", {2, 3, 9, 10}), ("NOT jalan", set()), ("jalan AND NOT (apel OR dani)", {0, 1, 4, 5, 6, 7, 8}), ("apel OR dani AND jadul", {2, 3, 10})])
def test_boolean(index, text, want):
    assert {r.doc_id for r in boolean.boolean_query(index, text).collect()} == want


@pytest.mark.parametrize("text", ["a AND", "(a", "a)", "a b", "OR a"])
def test_boolean_errors(index, text):
    with pytest.raises(ValueError):
        boolean.boolean_query(index, text)


def test_run_lengths(spark):
    values = [v for v, n in ((1, 4), (2, 3), (3, 3), (4, 5), (5, 2), (6, 2), (7, 2), (8, 3), (9, 2), (10, 2)) for _ in range(n)]
    rows = spark.createDataFrame([("k", n, v) for n, v in enumerate(values)], "k string, n long, v long")
    got = [(r.v, r["count"]) for r in ix.run_lengths(rows, "k", "n", "v").orderBy("run").collect()]
    assert got == [(1, 4), (2, 3), (3, 3), (4, 5), (5, 2), (6, 2), (7, 2), (8, 3), (9, 2), (10, 2)]
    assert ix.run_lengths(rows.limit(0), "k", "n", "v").count() == 0


SEQUENCES = [["3", "4", "5"], ["6", "5", "5", "5", "5"], ["11", "12", "6", "6", "6"]]


@pytest.fixture(scope="module")
def counts(spark):
    return lm.ngram_counts(spark.createDataFrame(list(enumerate(SEQUENCES)), "id long, words array<string>")).cache()


def test_ngram_counts(counts):
    got = {(r.n, r.gram): r.cnt for r in counts.collect()}
    assert {g: c for (n, g), c in got.items() if n == 1} == {"<s>": 3, "</s>": 3, "3": 1, "4": 1, "5": 5, "6": 4, "11": 1, "12": 1}
    assert lm.total_words(counts).first().total == 19
    assert got[2, "6 6"] == 2 and got[3, "6 6 6"] == 1 and got[4, "<s> <s> <s> <s>"] == 3


def test_probabilities(spark, counts):
    asked = spark.createDataFrame([(1, ["x", "x", "x", "6"]), (2, ["x", "x", "6", "6"]), (3, ["x", "6", "6", "6"]), (4, ["9", "10", "11", "12"]), (5, ["x", "x", "x", "y"])], "id long, gram array<string>")
    got = {r.id: r for r in lm.probabilities(asked, counts).collect()}
    assert got[1].p1 == pytest.approx(4 / 19) and got[2].p2 == pytest.approx(2 / 4) and got[3].p3 == pytest.approx(1 / 2)
    assert got[4].p == pytest.approx(0.16) and got[5].p == 0.0


def test_sequence_log_probability(spark, counts):
    asked = spark.createDataFrame([(1, ["5", "5", "12", "11"]), (2, ["11", "12", "6", "6", "5"]), (3, ["nowhere"])], "id long, words array<string>")
    got = {r.id: r.logp for r in lm.sequence_log_probability(asked, counts).collect()}
    assert got[1] == pytest.approx(-22.408601586, abs=1e-8) and got[2] == pytest.approx(-7.066360309, abs=1e-8)
    assert got[3] == -math.inf


def test_rare_words(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id long, words array<string>")
    got = {r.id: r.words for r in lm.replace_rare(rows, lm.vocabulary(rows, 2)).collect()}
    assert got == {1: ["a", "<UNK>", "a"], 2: []}


@pytest.mark.parametrize(
    "edited,original,want",
    [
        ("abcd", "abcd", ("none", None, None)), ("abdc", "abcd", ("transposition", "d", "c")), ("abcf", "abcd", ("substitution", "f", "d")),
        ("abfcd", "abcd", ("insertion", "f", "b")), ("fabc", "abc", ("insertion", "f", "-")), ("abce", "abcde", ("deletion", "e", "c")),
        ("bc", "abc", ("deletion", "b", "-")), ("stanfords", "stanford", ("insertion", "s", "d")), ("stanfor", "stanford", ("deletion", "r", "r")),
    ],
)
def test_edits(spark, edited, original, want):
    assert tuple(spark.range(1).select(edit_of(F.lit(edited), F.lit(original)).alias("e")).first().e) == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_fuzzy_candidates_match_brute_force(spark):
    terms = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("ab", repeat=n)] + ["abcabc", "kebun", "kebab"]
    words = ["a", "ab", "abba", "kebun", "keabun", "abcab", "bbbbb"]
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    for d in (1, 2):
        got = {(r.word, r.term, r.distance) for r in spell.fuzzy_candidates(df(words, "word"), df(terms, "term"), d).collect()}
        assert got == {(w, t, levenshtein(w, t)) for w in words for t in terms if levenshtein(w, t) <= d}


def test_prefixes(spark):
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = {(r.word, r.term) for r in spell.prefix_candidates(df(["ke", "kebu", "x"], "word"), df(["kebun", "kebab", "ke", "k"], "term")).collect()}
    assert got == {("ke", "kebun"), ("ke", "kebab"), ("ke", "ke"), ("kebu", "kebun")}


@pytest.fixture(scope="module")
def model(spark):
    names = ["Dunia Fantasi", "Kebun Binatang Ragunan", "Monumen Nasional", "Taman Mini Indonesia", "Taman Surya", "Kebun Raya"]
    docs = spark.createDataFrame([(n, x, "Jakarta") for n, x in enumerate(names)], "doc_id long, name string, address string").cache()
    index = ix.build_index(docs)
    channel = spell.build_channel(spark.createDataFrame([("fantasi", ["fantaso", "fsntasi"]), ("dunia", ["duniu"]), ("ragunan", ["raginan"])], "correct string, wrong array<string>"))
    return index, search.language_model(index).cache(), channel


def test_search_corrects(spark, model):
    asked = spark.createDataFrame([(1, "Dunia Fantasi"), (2, "Duniu Fsntaso"), (3, "Kebun Bibatqng Raginan"), (4, "zzzzzzzz dunia")], "query_id long, text string")
    got = {r.query_id: r.name for r in search.search(asked, *model).where("rank = 1").collect()}
    assert got == {1: "Dunia Fantasi", 2: "Dunia Fantasi", 3: "Kebun Binatang Ragunan"}


def test_autocomplete(spark, model):
    asked = spark.createDataFrame([(1, "Monumen Nasi"), (2, "Kebun Binatang Ra"), (3, "Taman Min")], "query_id long, text string")
    got = {r.query_id: r.name for r in search.autocomplete(asked, *model).where("rank = 1").collect()}
    assert got == {1: "Monumen Nasional", 2: "Kebun Binatang Ragunan", 3: "Taman Mini Indonesia"}
    twice = search.autocomplete(asked, *model, k=100, dedup=True)
    assert twice.groupBy("query_id", "doc_id").count().where("count > 1").count() == 0


def test_query_candidates_order(spark):
    rows = [(1, 0, n, "x", w) for n, w in enumerate("ab")] + [(1, 1, n, "y", w) for n, w in enumerate("cd")] + [(2, 0, 0, "z", None)]
    got = spell.query_candidates(spark.createDataFrame(rows, "query_id long, pos long, choice_ord long, typo string, corrected string")).orderBy("ord").collect()
    assert [[w.corrected for w in r.words] for r in got] == [["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]]


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "a;b"}, {"k": 101}, {"offset": -1}, {"lat": 91.0}, {"lon": -181.0}])
def test_validation(bad):
    with pytest.raises(search.BadParameter):
        search.validate(**bad)
    search.validate("Jalan Dani", 0, 0, 0.0, 0.0)
