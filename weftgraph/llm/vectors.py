"""Vectors as integers: what the vector operators share.

A component x becomes floor(256 * x), x as a double. Rows whose vector is null, or holds a null, NaN or infinite
component, are left out. Vectors may differ in length: in a matrix the shorter ones are followed by zeros, which
change neither inner products nor distances among them. Components beyond +-2^18 count as that, so that sums of up
to 1,024 squares of differences fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, numbered, stage, unused

SCALE = 256
MOST = 1 << 26  # of an integer component's magnitude
EXACT = 1 << 53  # below it, float64 products and sums of integers are exact


def _offsets(column: pa.ListArray) -> np.ndarray:
    return column.offsets.to_numpy()


def finite_rows(column: pa.ListArray) -> np.ndarray:
    """Which lists of doubles are there and hold finite numbers alone."""
    at = _offsets(column)
    flat = column.values
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False)) | flat.is_null().to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(bad)])
    return (upto[at[1:]] == upto[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of integers as rows of int64, zeros behind the shorter ones."""
    at = _offsets(column)
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
    sizes = np.diff(at)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def integer_vectors(rows: DataFrame, vector_col: str, carry: dict[str, str], name: str) -> tuple[DataFrame, int]:
    """Staged (the ``carry`` columns, given as name and type, with q array<int> and size int), and the greatest size."""
    values = unused(list(carry), "_values")
    head = rows.select(*carry, F.col(vector_col).cast("array<double>").alias(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(finite_rows(b.column(b.num_columns - 1)))
            kept = b.filter(ok)
            vectors = kept.column(kept.num_columns - 1)
            at = _offsets(vectors)
            flat = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(vectors) else np.empty(0)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(whole))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], lists, pa.array(np.diff(at), pa.int32())], names=[*carry, "q", "size"])

    out = stage(arrow_map(head, run, ", ".join(f"{k} {v}" for k, v in carry.items()) + ", q array<int>, size int"), name)
    return out, out.agg(F.max("size")).first()[0] or 0


def numbered_vectors(rows: DataFrame, columns: list, vector_col: str) -> DataFrame:
    """``columns`` and the vector with a number per row, ``rid``, that tells repeated rows apart."""
    return numbered(rows.select(*columns, F.col(vector_col).alias("vector")), "rid")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices, exact: by float64 where every partial sum is below 2^53, else by int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b
