"""Compression of vectors to codes: one codebook of integers for each of ``PARTS`` parts of a vector.

A vector of integers (see ``vectors``) is cut into equal consecutive parts, the last ones with zeros behind them where
its length is no multiple. Each part has a codebook of ``ENTRIES`` entries, at first that part of the vectors with the
least ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the floor of its parts' mean; entries without parts stay.

Codebooks are broadcast: ``PARTS`` x ``ENTRIES`` entries of a part's length, so as many numbers as ``ENTRIES`` vectors
have (32 kB for 64 components), whatever the input's size. Arrow batches take all distances but the part's own
norm from |c|^2 - 2 x c, an int64 matrix product, and the first least one by argmin. Each task sums its parts by entry,
and a grouped shuffle of at most PARTS x ENTRIES rows a task merges these sums; what the driver sees of a round is the
merged sums. Labels are summed with partial aggregation, so a label may have any number of rows.

Rows: null and non-finite vectors are left out; vectors shorter than the longest are followed by zeros; an empty vector
is all zeros; fewer vectors than ``ENTRIES`` make a smaller codebook; null ids come last in the order of ids, and equal
ids go by their vectors; repeated rows are coded each; a null label is a group of its own; an empty table gives an
empty result; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, stage, unstage
from weftgraph.llm.vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BROADCAST_LABELS = 100_000  # sums of labels, of 16 bytes each, that may be broadcast; beyond, codes are joined by label


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``parts`` (rows, parts, width) the index of the nearest entry of ``books`` (parts, entries, width), and its squared distance."""
    norms = (books * books).sum(axis=2)
    codes = np.empty(parts.shape[:2], np.int64)
    least = np.empty(parts.shape[:2], np.int64)
    for p in range(parts.shape[1]):
        far = norms[p] - 2 * (parts[:, p] @ books[p].T)
        codes[:, p] = far.argmin(axis=1)
        least[:, p] = far[np.arange(len(far)), codes[:, p]]
    return codes, least + (parts * parts).sum(axis=2)


@dataclass
class VectorCodes:
    """Codebooks (parts, entries, width) of integers, and how to use them."""

    spark: SparkSession
    books: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), self.books.shape[0], self.books.shape[2])

    def refined(self, vectors: DataFrame) -> VectorCodes:
        """After a round of assigning the staged ``vectors`` and moving the entries."""
        parts, entries, width = self.books.shape
        sent = self.spark.sparkContext.broadcast(self.books)
        names = [f"s{k}" for k in range(width)]
        schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *((x, pa.int64()) for x in names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
            for b in batches:
                cut = matrix(b.column(0), parts * width).reshape(-1, parts, width)
                codes, _ = nearest(cut, books)
                at = (codes + np.arange(parts) * entries).ravel()
                np.add.at(sums, at, cut.reshape(-1, width))
                counts += np.bincount(at, minlength=parts * entries)
            used = np.flatnonzero(counts)
            columns = [(used // entries).astype(np.int32), (used % entries).astype(np.int32), counts[used], *sums[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        sums = arrow_map(vectors.select("q"), run, "part int, entry int, n bigint, " + ", ".join(f"{x} bigint" for x in names))
        merged = sums.groupBy("part", "entry").agg(*(F.sum(x).alias(x) for x in ("n", *names)))
        books = self.books.copy()
        for r in merged.collect():  # at most one row an entry
            books[r.part, r.entry] = [r[x] // r.n for x in names]
        return VectorCodes(self.spark, books)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) of the staged ``vectors``. Lazy."""
        parts, _, width = self.books.shape
        sent = self.spark.sparkContext.broadcast(self.books)
        digits = np.array([f"{k:02x}" for k in range(self.books.shape[1])])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, far = nearest(matrix(b.column(2), parts * width).reshape(-1, parts, width), sent.value)
                text = pa.array(["".join(x) for x in digits[codes].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array(far.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

        return arrow_map(vectors.select("vec_id", "label", "q"), run, "vec_id bigint, label bigint, code string, error bigint")

    def decode(self, codes: list[str]) -> np.ndarray:
        """Vectors of integers that the codes stand for."""
        at = np.array([[int(x[k : k + 2], 16) for k in range(0, len(x), 2)] for x in codes], np.int64)
        return self.books[np.arange(self.books.shape[0]), at].reshape(len(codes), -1)


def first_codebooks(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES) -> VectorCodes:
    """Codebooks of the ``entries`` vectors with the least ids, the only ones that reach the driver."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()
    width = max(1, -(-size // parts))
    column = first.column("q").combine_chunks() if first.num_rows else pa.array([], pa.list_(pa.int32()))
    return VectorCodes(vectors.sparkSession, np.ascontiguousarray(matrix(column, parts * width).reshape(-1, parts, width).transpose(1, 0, 2)))


def compress_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector_col: str = "embedding") -> tuple[DataFrame, VectorCodes]:
    """One row per kept vector: vec_id, code, error, label_error; and the codebooks. ``entries`` is at most 256, two digits each."""
    if not 0 < entries <= 256:
        raise ValueError("a code's digits hold 1 to 256 entries")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector_col).alias("vector"))
    vectors, size = integer_vectors(rows, "vector", {"vec_id": "bigint", "label": "bigint"}, "integer-vectors")
    codes = first_codebooks(vectors, size, parts, entries)
    for _ in range(rounds if codes.books.shape[1] else 0):
        codes = codes.refined(vectors)
    coded = stage(codes.encode(vectors), "vector-codes")
    unstage(vectors)
    per = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    per = F.broadcast(per) if per.count() <= BROADCAST_LABELS else per
    out = coded.alias("c").join(per.alias("p"), F.col("c.label").eqNullSafe(F.col("p.label")))
    return out.select("c.vec_id", "c.code", "c.error", "p.label_error"), codes


_ASSIGN = """
d{k} AS (SELECT p.rid, p.vec_id, p.label, p.part, p.x, min(((p.x[1] - c.x[1]) * (p.x[1] - c.x[1]) + (p.x[2] - c.x[2]) * (p.x[2] - c.x[2])
    + (p.x[3] - c.x[3]) * (p.x[3] - c.x[3]) + (p.x[4] - c.x[4]) * (p.x[4] - c.x[4])) * 64 + c.entry) AS best
  FROM p JOIN c{k} c ON c.part = p.part GROUP BY ALL),"""
_MOVE = """
m{k} AS (SELECT part, best % 64 AS entry, count(*)::BIGINT AS n, {sums} FROM d{k} GROUP BY 1, 2),
c{next} AS (SELECT c.part, c.entry, CASE WHEN n IS NULL THEN x ELSE [{means}] END AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry),"""
_SUMS = ", ".join(f"sum(x[{i}])::BIGINT AS s{i}" for i in range(1, 5))
_MEANS = ", ".join(f"(s{i} - ((s{i} % n) + n) % n) // n" for i in range(1, 5))  # the floor, below zero too

#: For vectors of 64 components.
ORACLE = (
    """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT rid, vec_id, label, q, unnest(range(0, 16)) AS part FROM v),
p AS (SELECT rid, vec_id, label, part, q[part * 4 + 1 : part * 4 + 4] AS x FROM r),
c0 AS (SELECT part, rid AS entry, x FROM p WHERE rid < 64),"""
    + "".join(_ASSIGN.format(k=k) + _MOVE.format(k=k, next=k + 1, sums=_SUMS, means=_MEANS) for k in range(ROUNDS))
    + _ASSIGN.format(k=ROUNDS)
    + f"""
coded AS (SELECT rid, vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM d{ROUNDS} GROUP BY ALL),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""
)
