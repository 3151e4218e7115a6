import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, white-space and long texts, repeated rows, shared ids, and columns that clash with the operators' own."""
    long = " ".join(WORDS * 2000)
    rows = [(1, "Alpha beta gamma delta"), (2, None), (3, ""), (4, " \n\t "), (5, long), (5, long), (6, "one"), (None, "Alpha beta gamma delta"), (None, None), (7, "one"), (7, "two words")]
    return spark.createDataFrame([(i, t, "x", 0.5, 1, False, "k", 3) for i, t in rows], "doc_id long, text string, n_words string, score double, id int, full boolean, k0 string, `group` int").repartition(3)
