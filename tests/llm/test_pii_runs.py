import pytest

from atlaspark.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.Model()


@pytest.mark.parametrize(
    "text, want",
    [
        ("call 555-123-4567, 555-987-6543", {("phone", "555-123-4567"), ("phone", "555-987-6543")}),
        ("card 4111 1111 1111 1111 123", {("card", "4111 1111 1111 1111")}),
        ("an 7536784127813050 4845168114407329 so", {("card", "7536784127813050"), ("card", "4845168114407329")}),
        ("wh 2353820953013749 4550997810720808 th", {("card", "4550997810720808")}),
        ("Des +1 (826) 555-4081 190.137.223.204 du", {("phone", "+1 (826) 555-4081")}),
        ("rows 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", set()),
    ],
)
def test_numbers_beside_other_numbers(model, text, want):
    offered = {(pii.NAMES[k], text[a:b]) for a, k, b in pii.proposals(text)}
    assert want <= offered
    assert {(pii.NAMES[k], text[a:b]) for a, k, b in model.chosen(text, pii.base_spans(text))} == want


def test_sub_runs_are_bounded():
    text = " ".join("1" * 400)
    assert len(pii.proposals(text)) <= 400 * (pii.MOST_DIGITS + 1)
    assert all(sum(c.isdigit() for c in text[a:b]) <= pii.MOST_DIGITS for a, _, b in pii.proposals(text))
