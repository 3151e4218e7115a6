"""Quality scores from preference pairs.

Bradley-Terry: of two labelled documents the one of quality 1 is preferred, and
the chance of that is the logistic function of the difference of their scores,
which are linear in features of the whole text. The weights minimise the
logistic loss on feature differences. The cut is a quantile of the scores, as
far up as the share of quality 0 among the labels (the middle of the quantiles
one hundredth to either side), and scores are mapped so
that the cut falls on THRESHOLD.

Labels come from at most SAMPLE labelled rows (the least hashes of doc_id), and
only from rows whose crc32(doc_id) mod 5 is not 0. A score sees the text alone.

Null texts are scored as empty texts. Each row is scored by itself, so repeated
rows and rows without doc_id (held_out false) stay. Labels that are null or
conflict for a doc_id are left out; without labels of both kinds every score is
0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaspark.llm.common import slices, table

THRESHOLD = 0.3
SAMPLE = 20_000
PAIRS = 200_000
FEATURES = 17
SYMBOLS = "*#$%&|!@^~<>{}[]=+\\/_"
SPACES = re.compile(r"\s+")


def text_features(text: str | None) -> list[float]:
    """Shares and logarithms only, so length alone decides little."""
    import math

    text = text or ""
    words = text.split()
    n, m = len(words), max(1, len(text))
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    lower = text.lower()
    distinct = len(set(words))
    upper = sum(map(str.isupper, words))
    again = sum(map(str.__eq__, words, words[1:]))
    marked = sum(text.count(c) for c in SYMBOLS)
    digits = sum(text.count(c) for c in "0123456789")
    lines = text.split("\n")
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = len(lower) - lower.count(" ") - lower.count("\n")
    return [
        math.log1p(n),
        min(letters / n, 30) / 10,
        distinct / n,
        distinct / math.sqrt(n) / 10,
        pairs / max(1, n - 1),
        upper / n,
        min(again / n, 0.5),
        min(marked / m, 0.2),
        math.log1p(100 * marked / n),
        min(digits / m, 0.2),
        len(set(lines)) / len(lines),
        math.log1p(len(lines)) / 5,
        min(stops / n, 0.5),
        math.log1p(100 * stops / n),
        float(again / n > 0.2),
        float(marked / n > 0.5),
        0.0,
    ]


class BradleyTerry:
    """score(features) in 0..1."""

    def __init__(self, x, y, pairs: int = PAIRS, threshold: float = THRESHOLD, seed: int = 11, ridge: float = 1e-3):
        import numpy as np

        x, y = np.asarray(x, float).reshape(-1, FEATURES), np.asarray(y, int)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.cut, self.slope, self.at = np.zeros(FEATURES), 0.0, 1.0, 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        r = np.random.default_rng(seed)
        d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
        w = np.zeros(FEATURES)
        for _ in range(25):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            h = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(FEATURES)
            step = np.linalg.solve(h, d.T @ (1 - p) / pairs - ridge * w)
            w += step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        share = len(bad) / len(y)
        self.weights, self.cut = w, float(np.quantile(s, [max(0.0, share - 0.01), min(1.0, share + 0.01)]).mean())
        self.slope = 1.0 / max(float(s.std()), 1e-6)
        self.at = float(np.log(threshold / (1 - threshold)))

    def score(self, x):
        import numpy as np

        s = ((np.asarray(x, float).reshape(-1, FEATURES) - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.at + self.slope * (s - self.cut), -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BradleyTerry:
    """Fits on at most `sample` labelled rows; their features are all that reaches the driver."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")

    def measure(batches):
        import pyarrow as pa

        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text_features(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.join(F.broadcast(rows), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    found = sorted(known.mapInArrow(measure, "doc_id long, quality int, x array<double>").collect())
    return BradleyTerry([r["x"] for r in found], [r["quality"] for r in found])


def score_documents(docs: DataFrame, model: BradleyTerry, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """All columns of docs, and held_out, score and predicted; docs' own columns of these names give way."""
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    at = own.index("text")

    def score(batches):
        import pyarrow as pa

        for batch in slices(batches, at):
            scores = model.score([text_features(t.as_py()) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    schema = docs.select(*own).schema.add("score", "double")
    return docs.select(*own).mapInArrow(score, schema).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")
