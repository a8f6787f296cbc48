"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (poor, not toxic) and 2 (good). One linear score over hashed words of the whole text
and a few measures of its shape is shared by all grades; ordered thresholds part them:
P(grade <= k) = sigmoid(threshold_k - score). The expected grade ranks documents, the tail probability
P(grade >= 2) selects them.

The model is fitted on the driver, on at most ``TRAIN_ROWS`` of the documents that have labels (those whose ids have
the least hashes), by FTRL-proximal steps, which leave most weights at zero. Scoring is one pass over all
documents; what is broadcast is the table of weights, whose size is fixed.

Rows: null text counts as empty; labels with null quality or toxic count as good for that part, and several
labels of one id count as the worst; without any labels every document is kept, with the tail probability
1; repeated rows are answered each; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, unused
from weftgraph.llm.decontaminate import WORD_BYTES

TRAIN_ROWS = 12_000
BITS = 18
GRADES = 3
GOOD = 2
EPOCHS = 12
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.05  # of FTRL-proximal
KEEP_FROM = 0.5  # tail probability

_SIZE = 1 << BITS
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER, _DIGITS, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_SIGNS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + b".,;:'\"()-")


def feature_of(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) & (_SIZE - 1)


def shape_names(text: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Measures of the text in steps, each as the name of a feature."""
    n = max(1, len(text))
    without = lambda chars: n - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda x, of: int(20 * x / max(1, of))
    return [
        b"\x00signs %d" % min(20, int(100 * without(_SIGNS) / n)), b"\x00upper %d" % share(without(_UPPER), n), b"\x00digits %d" % share(without(_DIGITS), n),
        b"\x00letters %d" % share(without(_LETTERS + _HIGH), n), b"\x00length %d" % int(math.log2(n)), b"\x00distinct %d" % share(distinct, len(words)),
        b"\x00lines %d" % share(len(set(lines)), len(lines)), b"\x00word %d" % min(20, n // max(1, len(words))), b"\x00line %d" % int(math.log2(max(1, n // max(1, len(lines))))),
    ]


def names_of(text: bytes | None) -> list[bytes]:
    """Names of all features that the text has."""
    text = text or b""
    words = text.translate(WORD_BYTES).split()
    distinct = set(words)
    return [*distinct, *shape_names(text, words, len(distinct))]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: tuple[float, ...]

    @classmethod
    def fit(cls, rows: list[tuple[int, list[int]]], seed: int = 9) -> OrdinalModel:
        """``rows``: grade and features. The order of rows matters; callers fix it."""
        z, n = np.zeros(_SIZE), np.zeros(_SIZE)
        data = [(g, np.array(f, dtype=np.int64)) for g, f in rows]
        # Thresholds start where the score 0 gives the grades' shares.
        counts = np.bincount([g for g, _ in data], minlength=GRADES) + 1.0
        below = np.cumsum(counts)[:-1] / counts.sum()
        theta = np.log(below / (1 - below))
        seen = np.ones(GRADES - 1)
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(data)):
                grade, f = data[k]
                zf, nf = z[f], n[f]
                w = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
                score = float(w.sum())
                up = _sigmoid(theta[grade] - score) if grade < GRADES - 1 else 1.0
                low = _sigmoid(theta[grade - 1] - score) if grade else 0.0
                g = 1.0 - up - low  # of the loss by the score
                sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA
                z[f] = zf + g - sigma * w
                n[f] = nf + g * g
                p = max(up - low, 1e-12)
                for t, slope in ((grade, -up * (1 - up) / p), (grade - 1, low * (1 - low) / p)):
                    if 0 <= t < GRADES - 1:
                        seen[t] += slope * slope
                        theta[t] -= 0.1 * slope / math.sqrt(seen[t])
                theta = np.maximum.accumulate(theta + np.array([0.0, 1e-3]) * (np.diff(theta, prepend=theta[0] - 1) <= 0))
        w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        return cls(w.astype(np.float32), tuple(float(x) for x in theta))

    def grades(self, score: float) -> tuple[float, float]:
        """Expected grade and P(grade >= GOOD)."""
        above = [1 - _sigmoid(t - score) for t in self.thresholds]
        return round(sum(above), 9), round(above[GOOD - 1], 9)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[int, list[int]]]:
    """Grade and features of at most ``limit`` labelled documents, in a fixed order."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) != 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(GOOD)
    rated = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))
    present = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()  # labels of other documents do not use up the bound
    rated = rated.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted({feature_of(x) for x in names_of(t.as_py())}) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], schema=schema)

    # At most ``limit`` rows are broadcast; rows that repeat an id leave one.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(rated), "doc_id")
    rows = arrow_map(rows.select("doc_id", "grade", "text"), run, "doc_id bigint, grade int, features array<int>")
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("features").alias("features"))
    return [(r.grade, r.features) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()]


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> OrdinalModel:
    rows = training_rows(docs, labels, limit)
    return OrdinalModel.fit(rows) if rows else OrdinalModel(np.zeros(_SIZE, np.float32), (-math.inf,) * (GRADES - 1))


class _Weights(dict):
    """Weights by feature name; forgets all when it has grown too large."""

    LIMIT = 1 << 20

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table.tolist()

    def __missing__(self, name: bytes) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        w = self[name] = self.table[feature_of(name)]
        return w


def score_quality(docs: DataFrame, model: OrdinalModel, keep_from: float = KEEP_FROM, carry: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``carry`` columns (doc_id) of each document, with expected_grade, tail_prob and kept; ``prefix`` keeps these names off the input's."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds))
    carry = carry or ["doc_id"]
    schema = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        known, own = _Weights(weights), OrdinalModel(weights, thresholds)
        for b in batches:
            # Sums of exact order, so that a document's score does not hang on the order of a set.
            scored = [own.grades(math.fsum(map(known.__getitem__, names_of(t.as_py())))) for t in b.column(b.num_columns - 1)]
            more = [pa.array([s[0] for s in scored], pa.float64()), pa.array([s[1] for s in scored], pa.float64()), pa.array([s[1] >= keep_from for s in scored], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], *(f"{prefix}{x}" for x in ("expected_grade", "tail_prob", "kept"))])

    out = f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in schema)}, {prefix}expected_grade double, {prefix}tail_prob double, {prefix}kept boolean"
    return arrow_map(docs.select(*carry, F.col(text_col).cast("binary").alias(unused(carry, "_text"))), run, out)
