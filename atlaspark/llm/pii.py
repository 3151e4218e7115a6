"""Personal data and secrets: base patterns, and candidates chosen by boosted trees.

Base spans follow fixed patterns, leftmost and non-overlapping within a kind.
Besides, generators propose further spans with high recall: loose digit groups and
all their sub-runs that start and end at borders of groups, loose and spelled-out
mail addresses, and, as a further kind, secrets: values behind a name and = or :,
and long runs of mixed letters and digits. They overlap each other and the base
spans. Boosted trees score each proposal from its format and its context, the
scores are calibrated by isotonic regression on held-out examples, a kind's
threshold is the least score that is right with a chance of PRECISION, and of
overlapping choices the likelier stays. Base spans always stay.

The trees are trained here, on TRAIN_ROWS made-up examples (a fixed number, a
fixed seed), on the driver, since no table marks such spans; Model.measured has
precision and recall on the held-out third.

Null texts are empty and have no spans. Each row is handled by itself, so ties,
repeated rows and rows without doc_id come out as they are; an empty table
gives an empty result. Only doc_id and text are read. All scans are linear in
the text's length but spelled-out addresses, whose parts have mail's own limits
of 64 and 63 characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaspark.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")  # of all spans; the last kind has no base pattern

# The base patterns. Look-behinds only skip starts that cannot lead to another match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# What the generators look for.
LOOSE_DIGITS = re.compile(r"\+?\(?(?<![0-9])[0-9](?:[\x20().,/_-]{0,3}[0-9])+")
DIGITS = re.compile("[0-9]+")
MOST_DIGITS = 19  # of a proposal
BESIDE = (re.compile(r"[0-9][\x20().,/_-]{1,3}\(?\Z"), re.compile(r"[\x20().,/_-]{1,3}[0-9]"))
MAIL_END = re.compile(r"[^\s@<>,;]{2,}")
KEYED = re.compile(r"""[A-Za-z_-]+["']?[ ]?(?:=>|:=|=|:)[ ]?["']?([^\s"'<>(){}\[\],;]{6,})""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SPELLED_MAIL = re.compile(r"(?<![^\s<>,;:])[A-Za-z0-9._%+-]{1,64}[ ]?(?:[\[(][ ]?at[ ]?[\])]|[ ]at[ ])[ ]?[A-Za-z0-9-]{1,63}[ ]?(?:[\[(][ ]?dot[ ]?[\])]|[ ]dot[ ])[ ]?[A-Za-z]{2,24}\b", re.I)
CUES = {
    "email": re.compile(r"e-?mail|mail|contact|write to|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|ping|subnet", re.I),
    "card": re.compile(r"card|visa|master|credit|amex|debit|pay", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|fax|mobile|cell|whatsapp|dial", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential", re.I),
}
AGAINST = re.compile(r"isbn|order|invoice|ver\b|version|v\.?$|build|serial|no\.|nr\.|id\b|sku|ref|[$€£#]\s*$|price|total|date|page|section|chapter", re.I)
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}")

TRAIN_ROWS, TREES, RATE = 15_000, 80, 0.2
PRECISION = 0.995  # asked of each kind's threshold on held-out examples


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str):
    """Local part, @, domain: found from the @, since neither part can hold one."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposals(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "@" in text:
        end = 0
        for piece in re.finditer("@", text):
            start = piece.start()
            while start > end and not text[start - 1].isspace() and text[start - 1] not in "@<>,;:":
                start -= 1
            if start < piece.start() and (m := MAIL_END.match(text, piece.end())):
                found.append((start, 0, m.end()))
            end = piece.end()
    low = text.lower()
    if "dot" in low and "at" in low and ("[at" in low or "(at" in low or "[ at" in low or "( at" in low or " dot " in low):
        found += [(m.start(), 0, m.end()) for m in SPELLED_MAIL.finditer(text)]
    if DIGIT.search(text):
        for m in LOOSE_DIGITS.finditer(text):
            groups = [g.span() for g in DIGITS.finditer(text, m.start(), m.end())]
            for i, (a, _) in enumerate(groups):
                start, n, marks = (m.start() if i == 0 else a - (text[a - 1] == "(")), 0, 0
                for j in range(i, len(groups)):
                    n += groups[j][1] - groups[j][0]
                    if n > MOST_DIGITS:
                        break
                    if j > i:
                        between = text[groups[j - 1][1] : groups[j][0]]
                        marks += between.count(".") + between.count(",")
                    if 4 <= n <= 12 and marks >= 3:
                        found.append((start, 1, groups[j][1]))
                    if 12 <= n <= MOST_DIGITS:
                        found.append((start, 2, groups[j][1]))
                    if 7 <= n <= 15:
                        found.append((start, 3, groups[j][1]))
    found += {(m.start(1), 4, m.end(1)) for m in KEYED.finditer(text)} | {(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if DIGIT.search(m[0])}
    return found


def opaque(s: str) -> list[float]:
    """Entropy a character in bits, and shares and mixtures of characters."""
    from collections import Counter
    from math import log2

    n, counts = len(s), Counter(s)
    upper, lower, digit = (sum(map(f, s)) for f in (str.isupper, str.islower, str.isdigit))
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    return [-sum(c / n * log2(c / n) for c in counts.values()), upper / n, lower / n, digit / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n, turns / n, sum(c in "-_/." for c in s) / n]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = "".join(DIGIT.findall(s))
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    cues = [float(bool(CUES[k].search(before) or CUES[k].search(after))) for k in NAMES]
    return [
        *opaque(s), before[-1:] in ("'", '"') and after[:1] == before[-1:], bool(re.search(r"(?:=>|:=|=|:)[ ]?[\"']?\Z", before)),
        len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        len(set(digits)) / max(1, len(digits)), s.count("-"), s.count(" "), s.count("."), s.count(",") + s.count("/") + s.count("_"),
        s.startswith("+"), "(" in s and ")" in s, bool(digits) and luhn(digits), digits[:1] in ("3", "4", "5", "6"),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), bool(DATE.fullmatch(s)),
        before[-1:].isalnum() or before[-1:] in ("-", "/", "."), after[:1].isalnum() or after[:1] in ("-", "/"),
        cues[kind], max(c for k, c in enumerate(cues) if k != kind), bool(AGAINST.search(before[-12:])),
        bool(BESIDE[0].search(before)), bool(BESIDE[1].match(after)),
        "@" in s, bool(re.search(r"[\[(]\s?(?:at|dot)|\s(?:at|dot)\s", s, re.I)), bool(re.search(r"[a-z]{2,}$", s, re.I)),
    ]


def examples(rows: int = TRAIN_ROWS, seed: int = 7):
    """Made-up texts with one marked span each: (text, span, is personal data)."""
    import random

    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def with_luhn(n: int, good: bool, lead: str = "3456") -> str:
        stem = r.choice(lead) + number(n - 2)
        check = next(d for d in "0123456789" if luhn(stem + d))
        return stem + (check if good else str((int(check) + r.randint(1, 9)) % 10))

    def grouped(d: str, sep: str, size: int = 4) -> str:
        return sep.join(d[i : i + size] for i in range(0, len(d), size))

    def make(kind: int, good: bool) -> str:
        if kind == 0:
            if good:
                a, d, c = r.choice([(" [at] ", " [dot] ", ""), ("(at)", "(dot)", ""), (" at ", " dot ", ""), ("[at]", "[dot]", "")])[:2] + (r.choice(["com", "org", "net", "de", "fr", "es"]),)
                return f"{word()}{r.choice(['.', '', '_'])}{number(r.randint(0, 2))}{a}{word()}{d}{c}"
            return r.choice([f"{word()}@{word()}", f"@{word()}@{number(2)}", f"{word()}@", f"{word()}@{number(3)}!!", f"{word()} at {word()} dot {word()}ing"])
        if kind == 1:
            parts = [str(r.randint(0, 255)) for _ in range(4)]
            if good:
                return r.choice([",", ".", ". "]).join(parts)
            return r.choice([".".join(str(r.randint(0, 40)) for _ in range(5)), ".".join(str(r.randint(256, 999)) for _ in range(4)), ",".join([str(r.randint(1, 999))] + [number(3) for _ in range(3)])])
        if kind == 2:
            d = with_luhn(r.choice([13, 14, 15, 16, 16, 16, 19]), good)
            return r.choice([d, grouped(d, "."), grouped(d, "  "), grouped(d, "/"), grouped(d, " - ")]) if good else r.choice([d, grouped(d, " "), grouped(d, "-"), with_luhn(r.randint(12, 19), False, "0123456789")])
        a, b, c = number(3), number(3), number(4)
        if good:
            return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b} {c}", f"0{number(3)} {number(3)} {number(4)}", f"({a}){b}{c}"])
        return r.choice([number(r.randint(7, 15)), f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{number(2)}.{number(3)},{number(2)}", f"{r.randint(1, 9)},{number(3)},{number(3)}", f"{number(4)}-{number(4)}", f"{number(5)}/{number(5)}", f"{r.randint(1900, 2099)} {r.randint(1900, 2099)}", f"{number(3)} {number(5)}"])

    def run(kind: int, good: bool) -> tuple[str, int, int]:
        """Numbers side by side, and the place of one of them, or of a stretch of groups that is none of them."""
        phone = lambda: (f"+{r.randint(1, 99)} " if r.random() < 0.5 else "") + make(3, True)
        first = phone() if kind == 3 else grouped(with_luhn(16, True, "123456789"), r.choice(["", " ", "-"]))
        if not good and r.random() < 0.4:  # a list of numbers, of which some stretch may pass for a card
            s = r.choice([" ", ", ", "  "]).join(str(r.randint(0, r.choice([9, 99, 999, 9999]))) for _ in range(r.randint(6, 20)))
            spans = [(a, b) for a, k, b in proposals(s) if k == kind]
            spans = [x for x in spans if luhn("".join(DIGIT.findall(s[slice(*x)])))] or spans
            if spans:
                return s, *r.choice(spans)
        then = r.choice(["same", "same", "code", "digits", "ip"])
        other = {"ip": ".".join(str(r.randint(0, 255)) for _ in range(4)), "same": phone() if kind == 3 else re.sub("[0-9]", lambda _: number(1), first), "code": number(3), "digits": number(r.randint(4, 16))}[then]
        sep = r.choice([" ", ", ", " / ", "  "] if kind == 3 else [" ", " ", ", ", "  "])
        parts = [first, other] if r.random() < 0.6 else [other, first]
        s = sep.join(parts)
        at = 0 if parts[0] is first else len(other) + len(sep)
        truth = {(at, at + len(first))} | ({(len(s) - len(other) if at == 0 else 0, len(s) if at == 0 else len(other))} if then == "same" else set())
        wrong = sorted({(a, b) for a, k, b in proposals(s) if k == kind} - truth)
        if good:
            return s, at, at + len(first)
        return (s, *r.choice(wrong)) if wrong else ((t := make(kind, False)), 0, len(t))

    def secret(good: bool) -> tuple[str, int, int]:
        pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
        hexes, every = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        names = ["token", "secret", "api_key", "apikey", "password", "passwd", "access_key", "auth_token", "client_secret", "private_key", "TOKEN", "SECRET_KEY"]
        link, quote = r.choice([" = ", "=", ": ", ":"]), r.choice(['"', '"', "'", ""])
        if good:
            value = r.choice([pick(hexes, r.choice([32, 40, 64])), pick(hexes, 40).upper(), pick(every, r.randint(20, 48)), pick(every + "+/", r.randint(24, 64)) + r.choice(["", "=", "=="])])
            if r.random() < 0.15:
                value = r.choice(["sk-", "ghp_", "AKIA", "xoxb-"]) + pick(every, r.randint(16, 36))
            lead = r.choice(names) + link + quote if r.random() < 0.85 else r.choice(["Bearer ", "authorization: bearer ", "secret "])
            quote = quote if lead.endswith(quote) else ""
        else:
            value = r.choice([word() + word(), "-".join(word() for _ in range(r.randint(2, 5))), f"{word()}/{word()}/{word()}{r.randint(1, 99)}", f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word()}", number(r.randint(6, 20)), f"{word()}_{word()}_{r.randint(1, 2000)}", word().upper() + word().upper() + number(2), word() * 3 + number(1)])
            lead = r.choice([word(), word(), "note", "name", "title", "width", "date", "color", "http", "file", r.choice(names)]) + link + quote if len(value) >= 6 and r.random() < 0.6 else ""
            quote = quote if lead else ""
            value = value if len(value) >= 6 else value + "-" + word() + word()
        return lead + value + quote, len(lead), len(lead) + len(value)

    cue = [["mail me at ", "contact: ", "e-mail "], ["ip ", "host ", "server address "], ["card ", "visa ", "credit card no "], ["call ", "phone: ", "tel. "], [""]]
    wrong = ["order ", "isbn ", "version ", "serial no. ", "total $", "page ", "ref "]
    made = []
    while len(made) < rows:
        kind, good = r.randrange(len(NAMES)), r.random() < 0.5
        said = r.random() < (0.6 if good else 0.15)
        before = " ".join(word() for _ in range(r.randint(0, 6))) + r.choice([" ", ".\n", " "])
        before += r.choice(cue[kind]) if said else (r.choice(wrong) if not good and r.random() < 0.5 else "")
        beside = kind in (2, 3) and r.random() < 0.3
        s, a, b = secret(good) if kind == 4 else run(kind, good) if beside else ((t := make(kind, good)), 0, len(t))
        if kind == 3 and good and not said and re.fullmatch("[0-9. ]+", s[a:b]):
            continue  # bare digits without a cue could be anything
        text = before + s + " " + " ".join(word() for _ in range(r.randint(0, 6)))
        made.append((text, (len(before) + a, kind, len(before) + b), good))
    return made


class Trees:
    """Gradient boosting for the logistic loss, trees of depth two."""

    def __init__(self, x, y, trees: int = TREES, rate: float = RATE):
        import numpy as np

        self.bias = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        score, self.trees = np.full(len(y), self.bias), []
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            j, t = self._split(x, g, h, cuts)
            right = x[:, j] > t
            node = [j, t]
            for side in (~right, right):
                k, u = self._split(x[side], g[side], h[side], cuts)
                low = side & (x[:, k] <= u)
                high = side & (x[:, k] > u)
                leaf = [rate * g[m].sum() / (h[m].sum() + 1.0) for m in (low, high)]
                score[low] += leaf[0]
                score[high] += leaf[1]
                node += [k, u, *leaf]
            self.trees.append(tuple(node))

    @staticmethod
    def _split(x, g, h, cuts):
        import numpy as np

        best, all_g, all_h = (-1.0, 0, 0.0), g.sum(), h.sum()
        for j, column in enumerate(cuts):
            over = x[:, j][:, None] > column[None, :]
            rg, rh = g @ over, h @ over
            gain = rg**2 / (rh + 1) + (all_g - rg) ** 2 / (all_h - rh + 1)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, float(column[int(gain.argmax())]))
        return best[1], best[2]

    def probability(self, x):
        import numpy as np

        score = np.full(len(x), self.bias)
        for j, t, k, u, a, b, m, v, c, d in self.trees:
            score += np.where(x[:, j] > t, np.where(x[:, m] > v, d, c), np.where(x[:, k] > u, b, a))
        return 1 / (1 + np.exp(-score))


class Cover:
    """Intervals of a text, merged where they overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        lo, hi = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if lo < hi:
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]


def calibrated(p, truth, precision: float) -> float:
    """The least score whose isotonic calibration is at least `precision`; beyond all scores if there is none."""
    import numpy as np

    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least score
    for score, y in zip(p[order].tolist(), truth[order].tolist(), strict=True):
        blocks.append([y, 1, score])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    return min((b[2] for b in blocks if b[0] >= precision * b[1]), default=1.1)


class Model:
    """A forest, a calibration and so a threshold for each kind; measured: precision and recall on held-out examples."""

    def __init__(self, made=None, precision: float = PRECISION):
        import numpy as np

        made = made or examples()
        x = np.array([features(t, s) for t, s, _ in made], float)
        y = np.array([float(good) for *_, good in made])
        kind = np.array([s[1] for _, s, _ in made])
        part = np.arange(len(y)) % 6  # of six parts three are learned from, one calibrates, two measure
        self.trees, self.least, self.measured = [], [], {}
        for k, name in enumerate(NAMES):
            trees = Trees(x[(kind == k) & (part < 3)], y[(kind == k) & (part < 3)])
            least = calibrated(trees.probability(x[(kind == k) & (part == 3)]), y[(kind == k) & (part == 3)], precision)
            self.trees.append(trees)
            self.least.append(least)
            chosen, truth = trees.probability(x[(kind == k) & (part > 3)]) >= least, y[(kind == k) & (part > 3)] > 0
            self.measured[name] = (float((chosen & truth).sum() / max(1, chosen.sum())), float((chosen & truth).sum() / max(1, truth.sum())))

    def chosen(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Proposals to add: likely enough, clear of base spans, the likelier of those that overlap."""
        import numpy as np

        covered = Cover()
        for a, _, b in base:
            covered.add(a, b)
        free = [s for s in proposals(text) if not covered.meets(s[0], s[2])]
        if not free:
            return []
        x = np.array([features(text, s) for s in free], float)
        scored = []
        for k in range(len(NAMES)):
            at = [i for i, s in enumerate(free) if s[1] == k]
            if at:
                scored += [(-p, free[i]) for i, p in zip(at, self.trees[k].probability(x[at]).tolist(), strict=True) if p >= self.least[k]]
        taken: list[tuple[int, int, int]] = []
        for _, s in sorted(scored):
            if not covered.meets(s[0], s[2]):
                covered.add(s[0], s[2])
                taken.append(s)
        return taken


def joined(spans) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans) -> str:
    """Each span becomes [KIND]; of overlapping spans the first gives the name and all their text goes."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"[{NAMES[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame, model: Model | None = None, redact: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added (spans the trees selected), n_spans and, if asked for, the redacted text."""
    model = model or Model()

    def find(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            counts, digests, spans, added, texts = [[] for _ in KINDS], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                more = model.chosen(text, base)
                added.append(len(more))
                spans.append(joined(base + more))
                texts.append(redacted(text, base + more) if redact else "")
            n_spans = [a + sum(c[i] for c in counts) for i, a in enumerate(added)]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(n_spans, pa.int64())]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"]
            if redact:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema + ", text string" * redact)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
