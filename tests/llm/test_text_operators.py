import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from atlaspark.llm import components, decontam, lines, near_dup, pii, quality

# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_base_spans_match_plain_patterns():
    r = random.Random(1)
    for letters in ("0129a.@-+ ()%b", "0123456789 -", "09.", "a@.b-"):
        for _ in range(8000):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def model():
    return pii.Model()


def test_model_adds_and_spares(model):
    chosen = lambda t: {(pii.NAMES[k], t[a:b]) for a, k, b in model.chosen(t, pii.base_spans(t))}
    assert chosen("mail me at jo.do [at] site [dot] com today") == {("email", "jo.do [at] site [dot] com")}
    assert chosen("call (212) 555-0188 now") == {("phone", "(212) 555-0188")}
    for clean in ("order 1234567890", "in 2019 2020 and 2021-10-12", "build 10.2.3.4.5", "serial no. 4539148803436468", "pi 3.14159265358979", "a 123456789 b", ""):
        assert chosen(clean) == set(), clean


def test_held_out_examples(model):
    made = pii.examples(3000, seed=99)
    x = np.array([pii.features(t, s) for t, s, _ in made], float)
    p = np.array([model.trees[s[1]].probability(row[None, :])[0] >= model.least[s[1]] for (_, s, _), row in zip(made, x, strict=True)])
    truth = np.array([g for *_, g in made])
    kind = np.array([s[1] for _, s, _ in made])
    for k, name in enumerate(pii.NAMES):
        chosen, right = p[kind == k], truth[kind == k]
        assert right[chosen].mean() > 0.96 and chosen[right].mean() > 0.9, name
        assert min(model.measured[name]) > 0.9, name


def test_secrets(model):
    chosen = lambda t: {(pii.NAMES[k], t[a:b]) for a, k, b in model.chosen(t, pii.base_spans(t))}
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert chosen(f'so token = "{value}" and on') == {("secret", value)}
    assert chosen("export API_KEY=Zx81kQpL0vbn37TyAqWe92Kd now") == {("secret", "Zx81kQpL0vbn37TyAqWe92Kd")}
    for clean in ("a well-known-and-long-word here", "see docs/guide/chapter12 for more", "width = 1200px", "name: alexander", "2024-10-12-report", "x" * 5000, "= : = :"):
        assert chosen(clean) == set(), clean


def test_find_pii(spark, odd_documents, model):
    rows = spark.createDataFrame([(1, "é a@b.co 10.0.0.1 x +1 (212) 555-0188 y 4539148803436467"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find_pii(rows, model, redact=True).collect()}
    t = rows.first().text
    assert got[1].base_sha256 == hashlib.sha256(pii.joined(plain_spans(t)).encode()).hexdigest()
    assert got[1].text == "é [EMAIL] [IP] x [PHONE] y [CARD]" and got[2].spans == "" and got[2].text == ""
    assert pii.find_pii(odd_documents, model).count() == odd_documents.count()
    assert pii.find_pii(odd_documents.limit(0), model).count() == 0


# --- quality


def sample(spark, n=400):
    r = random.Random(4)
    good = lambda: ". ".join(" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(r.randint(4, 14))).capitalize() for _ in range(r.randint(2, 12))) + "."
    bad = lambda: r.choice([" ".join([r.choice(["spam", "buy"])] * r.randint(20, 90)), " ".join(w + r.choice(["***", "###"]) for w in good().split()), good().upper().replace(" ", "!! ")])
    rows = [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(n)]
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_quality(spark, odd_documents):
    docs, labels = sample(spark)
    model = quality.learn(docs, labels)
    truth = {x.doc_id: x.quality for x in labels.collect()}
    got = [x for x in quality.score_documents(docs, model).collect() if x.held_out]
    assert len(got) > 40 and np.mean([x.predicted == truth[x.doc_id] for x in got]) > 0.95
    odd = quality.score_documents(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= x.score <= 1 for x in odd)
    blank = quality.learn(docs, labels.limit(0))
    assert all(x.score == pytest.approx(0.5) for x in quality.score_documents(docs.limit(3), blank).collect())


# --- near duplicates


def plain_components(rows, width, level=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= level * len(sets[i] | sets[j]):
                home[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def family(r, words, n, edits):
    base = [r.choice(words) + r.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(60)] = r.choice(words) + "x"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, words, width):
    r = random.Random(7)
    texts = family(r, words, 60, 9) + family(r, words, 40, 5) + [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(80)]
    texts += [None, "", " \t", "One", "one", "ONE two", "é É"] + texts[:5]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "lonely words here"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in near_dup.near_duplicates(df, width).collect())
    assert got == sorted((a or -1, b, c or -1) for a, b, c in plain_components(rows, width))


def test_keep_one(spark, odd_documents):
    kept = Counter((x.doc_id, x.text if x.doc_id != 5 else "long") for x in near_dup.keep_one(odd_documents, 2).collect())
    assert kept == Counter([(1, "Alpha beta gamma delta"), (2, None), (3, ""), (4, " \n\t "), (5, "long"), (6, "one"), (None, None), (7, "two words")])
    assert near_dup.keep_one(odd_documents.limit(0)).columns == odd_documents.columns


def test_registers_are_mergeable_and_estimate():
    r = np.random.default_rng(1)
    s = near_dup.Sketcher()
    for share in (0.3, 0.8, 0.95):
        n = 3000
        both, a, b = (r.integers(0, 2**64, k, dtype=np.uint64) for k in (round(n * share), round(n * (1 - share) / 2), round(n * (1 - share) / 2)))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        rx, ry = s.registers(x), s.registers(y)
        assert (np.maximum(rx, ry) == s.registers(np.concatenate([x, y]))).all()
        assert abs(near_dup.estimate(rx[None], ry[None], np.array([len(x)]), np.array([len(y)]))[0] - share) < 0.1


def test_components_of_a_chain(spark):
    edges = [(n, n + 1) for n in range(30)] + [(100, 101), (100, 102), (7, 7), (5, None)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(1, 31)} | {101: 100, 102: 100}


# --- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(0)
    for k in (0, 1, 2, 3):
        for _ in range(4000):
            a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
            assert lines.within(a, b, k) == (distance(a, b) <= k)


def changed(r, text, most):
    b = list(text)
    for _ in range(r.randint(0, most)):
        p = r.randrange(len(b) + 1)
        b[p : p + r.randint(0, 1)] = r.choice(["", "a", "é"])
    return "".join(b)


def test_keys_meet():
    r, k = random.Random(2), lines.LineKeys()
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(10, 17)))
        b = changed(r, a, 2)
        if len(b) >= 10:
            a, b = sorted((a, b), key=len, reverse=True)
            *_, sa, _ = k.lines(["x\n" + a])
            probes = set(k.probe()[0].tolist())
            *_, sb, _ = k.lines(["", b + "\n"])
            assert probes & set(k.index()[0].tolist()), (a, b)
            assert bin(int(sa[0] ^ sb[0]) & (2**64 - 1)).count("1") <= 4


def test_dedup_lines_matches_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(6, 24))) for _ in range(25)]
    docs = [(i, "\n".join(changed(r, r.choice(base), 4) if r.random() < 0.7 else "".join(r.choice("abcd") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 9))), "x") for i in range(120)]
    docs += [(None, docs[3][1], "y"), (500, None, "z"), (3, docs[3][1], "x"), (501, "", "z"), (502, " " * 20 + "\n" + " " * 20, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_lines string").coalesce(1)
    hashes = [x[0] for x in df.selectExpr("xxhash64(text)").collect()]
    parts = [(((d is None), d or 0, h, i), x) for (d, t, _), h in zip(docs, hashes, strict=True) for i, x in enumerate((t or "").split("\n"))]
    first = {}
    for place, x in parts:
        if len(x) >= 10 and not x.isspace():
            first[x] = min(first.get(x, place), place)
    near = {x for x in first if any(first[y] < first[x] and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in first)}
    stays = lambda place, x: x not in first or (first[x] == place and x not in near)
    want = []
    for (d, t, _), h in zip(docs, hashes, strict=True):
        rows = (t or "").split("\n")
        kept = [x for i, x in enumerate(rows) if stays((d is None, d or 0, h, i), x)]
        want.append((str(d), "\n".join(kept), len(rows), len(rows) - len(kept)))
    assert sorted((str(x.doc_id), x.text or "", x.n_lines, x.n_dropped) for x in lines.dedup_lines(df).collect()) == sorted(want)
    assert lines.dedup_lines(df.limit(0)).count() == 0


# --- decontamination


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        k = min(8, len(v))
        for window in {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else ():
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) == window:
                    hit.update(range(p, p + k))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, odd_documents):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["a", "B", "c,", "d9", "é"]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 7, 8, 9, 20, 40]))) for i in range(14)] + [(50, None), (51, ""), (None, text(9)), (3, text(12))]
    docs = [(i, text(r.randint(0, 60)) + " " + r.choice([t or "" for _, t in items])) for i in range(80)] + [(90, None), (90, ""), (None, items[4][1]), (5, items[5][1]), (5, items[5][1])]
    got = decontam.find_hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    own = [(i, t) for i, t in items if i is not None]
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x["items"]) for x in got) == sorted((str(d), *plain_hits(t, own)) for d, t in docs)
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert {x.doc_id for x in decontam.drop_contaminated(odd_documents, bench).collect()} == {1, 2, 3, 4, 5, 7, None}
    assert decontam.contamination(odd_documents, bench.limit(0)).where("n_items > 0").count() == 0
    assert decontam.contamination(odd_documents.limit(0), bench).count() == 0
