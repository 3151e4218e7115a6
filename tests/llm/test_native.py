import hashlib
import random

import pytest
from pyspark.sql import functions as F

from atlaspark.llm import chat, fingerprint, url_filter


def test_fingerprints_match_brute_force(spark, odd_documents):
    r = random.Random(1)
    rows = [(n, "".join(r.choice("ab é\n") for _ in range(r.randint(0, 12)))) for n in r.sample(range(10_000), 1200)]
    got = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(reverse=True)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + u[:cut]
        canon = lambda s: " ".join(s.lower().split())
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == float(canon(t) == canon(edited)) and got[i].near_next == float(canon(t) == canon(u))
    assert fingerprint.fingerprints(odd_documents).count() == odd_documents.count()
    assert fingerprint.fingerprints(odd_documents.limit(0)).count() == 0


def test_canonical_text(spark):
    same = ["Ａ ﬁne\u00a0 Day\n", "a fine day", " A  FINE\tDAY"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([*same, "a fine dáy", "a fine da\u0301y", "straße", "STRASSE"])], "doc_id long, text string")
    found = fingerprint.fingerprints(rows).collect()
    assert {x.doc_id: x.group_id for x in found} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}
    assert {x.doc_id: x.n_docs for x in found} == {0: 3, 1: 3, 2: 3, 3: 2, 4: 2, 5: 2, 6: 2}


def test_wide_and_missing_ids(spark):
    ids = [-(2**63), -9 * 10**18, *range(2000), 4 * 10**18, 9 * 10**18, 2**63 - 1, *[None] * 1500]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(docs).collect()
    next_of = {x.text: x.next_text for x in got}
    known = [t for i, t in sorted((r for r in rows if r[0] is not None), reverse=True)]
    assert [next_of[t] for t in known[:-1]] == known[1:]
    at, seen = known[0], []
    while at not in seen[:1]:
        seen.append(at)
        at = next_of[at]
    assert len(seen) == len(rows)
    assert {x.doc_id for x in fingerprint.fingerprints(docs.limit(0)).collect()} == set()


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "\\h\\b", "a\n b", None, "", "### : <", "\\\\"]
    rows = [(n % 3, n, ["user", "assistant", None, "we:ird#"][n % 4], t) for n, t in enumerate(texts)] + [(None, 0, "assistant", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1))
    out = chat.format_conversations(df).withColumn("t", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask"))).collect()
    assert len(out) == 4
    for x in out:
        own = sorted((r for r in rows if r[0] == x.conv_id), key=lambda r: r[1])
        assert [(t.role, t.text) for t in x.t] == [(r[2] or "", r[3] or "") for r in own]
        assert x.loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_best_paths_match_brute_force(spark):
    r = random.Random(3)
    rows = [(f"{t}:{n}", f"{t}:{r.randint(max(0, n - 3), n - 1)}" if n else None, float(r.randint(0, 5))) for t in range(5) for n in range(r.randint(1, 30))]
    rows += [("x", "missing", 1.0), ("c1", "c2", 1.0), ("c2", "c1", 1.0), ("x", "missing", 1.0)]
    parent, score = {a: b for a, b, _ in rows}, {a: c for a, _, c in rows}
    leaves = {}
    for n in parent:
        path, at = [], n
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at not in path and n not in parent.values():
            leaves.setdefault(path[-1], []).append((-sum(score[p] for p in path), n, path[::-1]))
    want = {(n, path[0], p, d) for v in leaves.values() for _, n, path in sorted(v)[:2] for d, p in enumerate(path)}
    got = [tuple(x) for x in chat.best_paths(spark.createDataFrame(rows, "id string, parent string, score double"), 2).select("leaf", "root", "id", "depth").collect()]
    assert len(got) == len(want) and set(got) == want


URLS = [
    (1, "http://a.Example.ORG/es/1?x#y", "example.org/es/", "block"), (2, "https://example.org", None, "allow"), (3, "x://example.org/en/12", "example.org/en/1", "block"),
    (4, "http://org/", "org/", "allow"), (5, "http://norg/", None, "allow"), (6, "http://b.com/de/", "com/de/", "block"), (7, "example.com/de/", None, "allow"),
    (8, None, None, "allow"), (9, "", None, "allow"), (10, "http:///fr/", None, "allow"), (None, "http://b.com/fr/a", "com/fr/", "allow"), (1, "http://a.Example.ORG/es/1?x#y", "example.org/es/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u, *_ in URLS], "page_id long, url string, rule string")
    got = sorted([(x.page_id or 0, x.rule or "", x.verdict) for x in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()])
    assert got == sorted((i or 0, r or "", v) for i, _, r, v in URLS)
    first = url_filter.judge_urls(pages.where("page_id = 1"), url_filter.rule_table(spark)).first()
    assert (first.host, first.path) == ("a.example.org", "/es/1")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


@pytest.mark.parametrize("rules,want", [([("a.b", "", "block"), ("b", "", "allow")], "a.b"), ([("b", "/x", "allow"), ("b", "/x", "block")], "b/x"), ([], None)])
def test_precedence(spark, rules, want):
    pages = spark.createDataFrame([(1, "h://c.a.b/x/y")], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, table).first()
    assert got.rule == want and got.verdict == ("block" if want else "allow")
