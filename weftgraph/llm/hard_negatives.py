"""Hard negatives by bit-sliced integer products.

A row's score for an anchor is the inner product of their vectors of integers (see ``vectors``). Anchors' positives
are the other rows of their label with the highest scores; hard negatives of an anchor and a positive are the rows of
other labels with the highest scores from ``LEAST_SHARE`` to ``MOST_SHARE`` per cent of the positive's.

Components in two's complement are bit-planes, the sign's the most significant. ``SLICE`` planes at a time are
multiplied with the anchors and added to the scores, most significant first. While K planes are left, the rest of a row
lies in 0 .. 2^K - 1 in each component, so its score lies between what is known plus 2^K - 1 times the sum of the
anchor's negative components, and the same with its positive ones. These intervals shrink with every slice, and a
candidate is dropped once its interval cannot qualify: for positives, where it ends below the last of the best
lower ends; for negatives, where it meets no window, or ends below the last of the best lower ends that certainly lie in
the window. The first slice takes whole blocks of anchors and rows at once; later slices only the pairs that are left.
What survives all slices has its exact score, so nothing is estimated.

Work. The anchors are a stated query set, met with all rows in blocks: they are sent out in chunks of at most
``CHUNK_BYTES``, and each chunk scans the staged rows twice. A task goes through its rows in blocks of ``BLOCK`` and
keeps the best of each anchor, so it returns at most ``BEST`` rows an anchor (or an anchor and positive), and a
window by anchor, limited before its shuffle, merges these. No label is ever gathered: a hot label's rows lie in all tasks.

Rows: rows with a null label, a null vector or null or non-finite components take no part; shorter vectors are followed
by zeros; ids may be null (such a row is no anchor, and comes last among equal scores); repeated rows are rows of their
own, each other's positives, and as anchors answered each; ties of score go to the smaller id; positives with a score
below 0 have no negatives, as the window is empty; an empty table gives an empty result; other input columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, stage, unstage
from weftgraph.llm.vectors import integer_vectors, matrix, numbered_vectors, product

ANCHOR_EACH = 100
BEST = 5  # positives an anchor, and negatives a positive
LEAST_SHARE, MOST_SHARE = 80, 100  # of a positive's score, in per cent
SLICE = 3  # bit-planes of a step
BLOCK = 2048  # rows that meet the anchors at once
ANCHOR_BLOCK = 512  # anchors that meet them
CHUNK_BYTES = 16 << 20  # of anchors' vectors that are broadcast
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max  # in place of a null id


def slices(rows: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``rows`` as a sum of (planes, shift): planes << shift, most significant first; ``shift`` planes are left after each."""
    bits = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length() + 1
    out, left = [], bits
    while left > 0:
        step = min(SLICE, left)
        left -= step
        part = rows >> left  # arithmetic, so that the first slice holds the sign
        out.append((part if not out else part & ((1 << step) - 1), left))
    return out


class Bounds:
    """Intervals of the scores of a block's pairs, as (anchor, row, what is known of the score)."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray):
        self.anchors = anchors
        self.below, self.above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
        self.steps = slices(rows)
        first, self.left = self.steps[0]
        known = product(anchors, first.T) << self.left
        self.i, self.j = np.nonzero(allowed)
        self.known = known[self.i, self.j]

    def interval(self) -> tuple[np.ndarray, np.ndarray]:
        rest = (1 << self.left) - 1
        return self.known + rest * self.below[self.i], self.known + rest * self.above[self.i]

    def keep(self, ok: np.ndarray) -> None:
        self.i, self.j, self.known = self.i[ok], self.j[ok], self.known[ok]

    def advance(self, step: int) -> None:
        """Add a slice's products: as whole blocks while many pairs are left, else pair by pair."""
        planes, self.left = self.steps[step]
        if len(self.i) * 8 > len(self.anchors) * len(planes):
            more = product(self.anchors, planes.T)[self.i, self.j]
        else:
            more = np.empty(len(self.i), np.int64)
            for at in range(0, len(self.i), 1 << 16):
                part = slice(at, at + (1 << 16))
                more[part] = np.einsum("ij,ij->i", self.anchors[self.i[part]], planes[self.j[part]])
        self.known = self.known + (more << self.left)


def last_of_best(groups: np.ndarray, values: np.ndarray, count: int, best: int = BEST) -> np.ndarray:
    """Of each of ``count`` groups the ``best``-th largest value, or _NONE where there are fewer."""
    out = np.full(count, _NONE)
    order = np.lexsort((-values, groups))
    g = groups[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(g)]
    full = ends - starts >= best
    out[g[starts[full]]] = values[order][starts[full] + best - 1]
    return out


def raised(floor: np.ndarray, groups: np.ndarray, low: np.ndarray, best: int) -> np.ndarray:
    """``floor`` with the last of the best lower ends in place of what no block has set so far."""
    new = np.flatnonzero(floor[groups] == _NONE) if len(groups) and (floor == _NONE).any() else ()
    return np.maximum(floor, last_of_best(groups[new], low[new], len(floor), best)) if len(new) else floor


def head(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, best: int = BEST) -> np.ndarray:
    """Places of the first ``best`` of each group, by score and then by id."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    at = np.arange(len(g))
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < best]


class _Held:
    """The best (group, score, id) so far of a task, and the least score that can still enter a group."""

    def __init__(self, groups: int, best: int = BEST):
        self.best = best
        self.group, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(groups, _NONE)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(group):
            g, s, x = np.r_[self.group, group], np.r_[self.score, score], np.r_[self.id, ids]
            at = head(g, s, x, self.best)
            self.group, self.score, self.id = g[at], s[at], x[at]
            self.floor = last_of_best(self.group, self.score, len(self.floor), self.best)

    def batch(self, rids: np.ndarray, names: list[str]) -> pa.RecordBatch:
        ids = pa.array(self.id, pa.int64(), mask=self.id == _LAST)
        return pa.RecordBatch.from_arrays([pa.array(rids[self.group]), ids, pa.array(self.score)], names=names)


def best_positives(vectors: np.ndarray, labels: np.ndarray, rids: np.ndarray, rows: np.ndarray, row_labels: np.ndarray, row_rids: np.ndarray, row_ids: np.ndarray, held: _Held, start: int) -> None:
    """Let the rows of a block into the best of the anchors from ``start`` on, where their labels are equal."""
    b = Bounds(vectors, rows, (labels[:, None] == row_labels[None, :]) & (rids[:, None] != row_rids[None, :]))
    for step in range(len(b.steps)):
        if step:
            b.advance(step)
        low, high = b.interval()
        floor = raised(held.floor[start : start + len(vectors)], b.i, low, held.best)
        b.keep(high >= floor[b.i])
        if not len(b.i):
            return
    held.add(b.i + start, b.known, row_ids[b.j])


def best_negatives(vectors: np.ndarray, labels: np.ndarray, windows: np.ndarray, rows: np.ndarray, row_labels: np.ndarray, row_ids: np.ndarray, held: _Held, start: int) -> None:
    """Let the rows of a block into the best of each window (anchors, slots, lower and upper end), where the labels differ."""
    slots = windows.shape[1]
    low_end, high_end = windows[:, :, 0], windows[:, :, 1]
    least, most = low_end.min(axis=1), high_end.max(axis=1)  # an empty window is (1, 0) of extremes
    b = Bounds(vectors, rows, labels[:, None] != row_labels[None, :])
    for step in range(len(b.steps)):
        if step:
            b.advance(step)
        low, high = b.interval()
        near = (high >= least[b.i]) & (low <= most[b.i])
        b.keep(near)
        low, high = low[near], high[near]
        if not len(b.i):
            return
        wanted = np.zeros(len(b.i), bool)
        for k in range(slots):
            lo, hi = low_end[b.i, k], high_end[b.i, k]
            sure = np.flatnonzero((low >= lo) & (high <= hi))
            floor = raised(held.floor[start * slots + k : (start + len(vectors)) * slots : slots], b.i[sure], low[sure], held.best)
            wanted |= (high >= lo) & (low <= hi) & (np.minimum(high, hi) >= floor[b.i])
        b.keep(wanted)
        if not len(b.i):
            return
    for k in range(slots):
        ok = (b.known >= low_end[b.i, k]) & (b.known <= high_end[b.i, k])
        held.add((b.i[ok] + start) * slots + k, b.known[ok], row_ids[b.j[ok]])


def window_of(scores: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Lower and upper ends of the whole scores that a positive's score allows; none where there is no positive."""
    low, high = -(-LEAST_SHARE * scores // 100), MOST_SHARE * scores // 100
    ok = there & (low <= high)
    return np.stack([np.where(ok, low, _LAST), np.where(ok, high, _NONE)], axis=-1)


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rid, id, label, vectors) of blocks of rows (rid, vec_id, label, q)."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            ids = part.column(1).fill_null(_LAST).to_numpy()
            yield part.column(0).to_numpy(), ids, part.column(2).to_numpy(), matrix(part.column(3), width)


def _first(rows: DataFrame, by: list[str], best: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= best)


def mine_hard_negatives(embeddings: DataFrame, anchor: Column | None = None, label: Column | None = None, best: int = BEST, vector_col: str = "embedding") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` and ``label`` are expressions over the input's columns: which rows are anchors (each whose vec_id is
    divisible by ``ANCHOR_EACH``), and the rows' labels (the column label).
    """
    is_anchor = F.col("vec_id") % ANCHOR_EACH == 0 if anchor is None else anchor
    own_label = F.col("label") if label is None else label
    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), own_label.cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")]
    rows = numbered_vectors(embeddings, columns, vector_col).where("label IS NOT NULL")
    rows, width = integer_vectors(rows, "vector", {"rid": "bigint", "vec_id": "bigint", "label": "bigint", "anchor": "boolean"}, "integer-vectors")
    count = rows.where("anchor").count()
    chunks = max(1, -(-count * max(1, width) * 8 // CHUNK_BYTES))
    # Chunks go by a hash of the row's number, so that repeated ids part as well.
    anchors = stage(rows.where("anchor").select(F.pmod(F.xxhash64("rid"), F.lit(chunks)).alias("chunk"), "rid", "vec_id", "label", "q"), "anchors") if count else None
    found = [_of_chunk(rows, anchors.where(F.col("chunk") == k), max(1, width), best) for k in range(chunks)] if count else []
    if not found:
        return _result(embeddings.sparkSession)
    unstage(rows, anchors)
    return reduce(DataFrame.unionByName, found)


def _of_chunk(rows: DataFrame, chunk: DataFrame, width: int, best: int) -> DataFrame:
    spark = rows.sparkSession
    table = chunk.select("rid", "vec_id", "label", "q").toArrow().combine_chunks()  # at most about CHUNK_BYTES
    if not table.num_rows:
        return _result(spark)
    rids, labels = table.column("rid").to_numpy(), table.column("label").to_numpy()
    anchors = spark.sparkContext.broadcast((rids, labels, matrix(table.column("q").chunk(0), width)))
    data = rows.select("rid", "vec_id", "label", "q")

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, labels, vectors = anchors.value
        held = _Held(len(rids), best)
        for row_rids, row_ids, row_labels, block in _rows(batches, width):
            for at in range(0, len(rids), ANCHOR_BLOCK):
                s = slice(at, at + ANCHOR_BLOCK)
                best_positives(vectors[s], labels[s], rids[s], block, row_labels, row_rids, row_ids, held, at)
        yield held.batch(rids, ["rid", "vec_id", "score"])

    of = _first(arrow_map(data, positives, "rid bigint, vec_id bigint, score bigint"), ["rid"], best, "slot")
    of = stage(of.select("rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "slot"), "positives")
    got = of.select("rid", "slot", "positive_score").toArrow()  # at most ``best`` rows an anchor of the chunk
    place = {int(r): k for k, r in enumerate(rids)}
    scores, there = np.zeros((len(rids), best), np.int64), np.zeros((len(rids), best), bool)
    at = np.array([place[r] for r in got.column(0).to_pylist()], np.int64), np.asarray(got.column(1).to_pylist(), np.int64) - 1
    scores[at], there[at] = got.column(2).to_numpy(), True
    sent = spark.sparkContext.broadcast(window_of(scores, there))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rids, labels, vectors), windows = anchors.value, sent.value
        held = _Held(len(rids) * best, best)
        for _, row_ids, row_labels, block in _rows(batches, width):
            for at in range(0, len(rids), ANCHOR_BLOCK):
                s = slice(at, at + ANCHOR_BLOCK)
                best_negatives(vectors[s], labels[s], windows[s], block, row_labels, row_ids, held, at)
        slot = pa.array((held.group % best + 1).astype(np.int32))
        held.group //= best
        found = held.batch(rids, ["rid", "vec_id", "score"])
        yield pa.RecordBatch.from_arrays([*found.columns, slot], names=["rid", "vec_id", "score", "slot"])

    hits = _first(arrow_map(data, negatives, "rid bigint, vec_id bigint, score bigint, slot int"), ["rid", "slot"], best, "rank")
    hits = hits.select("rid", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = chunk.select("rid", F.col("vec_id").alias("anchor_id"))
    out = hits.join(of, ["rid", "slot"]).join(ids, "rid").select(*_COLUMNS)
    return stage(out, "hard-negatives")


_COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _result(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'bigint'}" for c in _COLUMNS))


def shifted_label() -> Column:
    """The query's labels: where vec_id is divisible by 7, the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % {ANCHOR_EACH} = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {BEST})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LEAST_SHARE} * positive_score <= 100 * score AND 100 * score <= {MOST_SHARE} * positive_score
QUALIFY rank <= {BEST}
"""
