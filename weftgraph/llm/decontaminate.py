"""Benchmark decontamination by winnowing.

A text's fingerprints are, of the hashes of its ``GRAM``-word grams, those that are least in some window of
``WINDOW - GRAM + 1`` grams in a row. Two texts that share ``WINDOW`` words in a row share the grams of that
span, hence its least one: every shared window is found by a join on fingerprints, and the hits are extended
word by word to what is shared around them. Items of fewer than ``WINDOW`` words are one window, found by the
hash of all their words.

A fingerprint carries the windows that hold it, as 128-bit hashes with their offsets, so hits are extended without
the texts: a fingerprint that both sides have brings its windows, and each window that an item has is hit. Before
documents' fingerprints are shuffled, a Bloom filter of the items' drops what no item has; its size has a fixed bound,
whatever the tables hold, and false positives only cost rows in the join. Fingerprints with the same windows in one
text are one row with several positions, so repetitive texts do not multiply.

A passage may be part of many items and of many documents. No item is paired with a document for it: a window stands
for the set of its items, windows of equal sets count as one class, and the items of a document are put together
once for all documents that hit the same classes.

Rows: null text has no words and is clean; documents are told apart by row, not by id; repeated rows are each
judged; empty tables give an empty or a clean result; items without words, and items with null ids, match
nothing or count under the id 'null'; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, numbered, stage

WINDOW = 13  # words that count as contamination
GRAM = 8  # words of a fingerprint
SIDE = WINDOW - GRAM  # words that a window can reach beyond a fingerprint on either side
SHARE = 20  # contaminated: SHARE * n_hit >= n_words
FILTER_BITS = (16, 26)  # the Bloom filter's least and largest size, as powers of two

#: Bytes of words after ASCII lower-casing: digits, a-z and whatever is not ASCII; all others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = np.array([int.from_bytes(xxhash.xxh3_128_digest(f"gram-{j}".encode())[:8], "big") | 1 for j in range(WINDOW)], dtype=np.uint64)


class WordHashes(dict):
    """Hashes by word; forgets all when it has grown too large."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: bytes | None, known: WordHashes) -> np.ndarray:
    words = text.translate(WORD_BYTES).split() if text else []
    return np.array([known[w] for w in words], dtype=np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n words in a row."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out += words[j : j + size] * _FACTORS[j]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of grams that are least in a window of SIDE + 1 (all of equal ones)."""
    n = len(grams) - SIDE
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, SIDE + 1):
        np.minimum(least, grams[j : j + n], out=least)
    most = np.zeros(len(grams), np.uint64)
    for j in range(SIDE + 1):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero(most == grams)


def window_keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for every row of words."""
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        h = np.full(len(rows), rows.shape[1], np.uint64)
        for j in range(rows.shape[1]):
            h += (rows[:, j] ^ np.uint64(salt)) * _FACTORS[j]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
        out.append(h ^ (h >> np.uint64(29)))
    return out[0], out[1]


def fingerprints(words: np.ndarray, kinds: list[int], keep=None) -> list[tuple[int, int, list[tuple[int, int, int]], list[int]]]:
    """(kind, fingerprint, windows as (offset, hash, hash), positions) for windows of ``kind`` words.

    Kind WINDOW is winnowed; a smaller kind, of short items, takes every gram of so many words. ``keep``
    tells which fingerprints to go on with.
    """
    out = []
    for kind in kinds:
        n = GRAM if kind == WINDOW else kind
        grams = gram_hashes(words, n)
        found = winnow(grams) if kind == WINDOW else np.arange(len(grams))
        marks = grams[found] ^ np.uint64(kind << 56)
        if keep is not None:
            held = keep(marks)
            found, marks = found[held], marks[held]
        offsets = np.arange(n - kind, 1)
        by: dict[tuple, tuple] = {}
        for part in range(0, len(found), 8192):
            at, mark = found[part : part + 8192], marks[part : part + 8192]
            starts = at[:, None] + offsets
            row, which = np.nonzero((starts >= 0) & (starts <= len(words) - kind))
            a, b = (x.view(np.int64).tolist() for x in window_keys(words[starts[row, which][:, None] + np.arange(kind)]))
            windows: list[list] = [[] for _ in at]
            for r, w, x, y in zip(row.tolist(), offsets[which].tolist(), a, b, strict=True):
                windows[r].append((w, x, y))
            for p, m, w in zip(at.tolist(), mark.view(np.int64).tolist(), windows, strict=True):
                by.setdefault((m, *w), (kind, m, w, []))[3].append(p)
        out += by.values()
    return out


class Filter:
    """Bloom filter of 64-bit marks with two probes, over a bitmap of at most 2^26 bits."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.bytes = bits, words.astype("<i8").view(np.uint8)

    @staticmethod
    def probes(bits: int) -> list[int]:
        return [64 - bits, max(0, 32 - bits)]

    def __call__(self, marks: np.ndarray) -> np.ndarray:
        ok = np.ones(len(marks), bool)
        for shift in self.probes(self.bits):
            at = (marks >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            ok &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok

    @classmethod
    def of(cls, marks: DataFrame) -> Filter:
        """Or the bits together on the executors; what comes to the driver is the bitmap, of bounded size."""
        n = marks.select("mark").distinct().count()
        bits = min(FILTER_BITS[1], max(FILTER_BITS[0], math.ceil(math.log2(32 * max(n, 1)))))
        probes = F.explode(F.array(*(F.shiftrightunsigned("mark", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in cls.probes(bits)))).alias("at")
        bit = F.expr("shiftleft(1L, cast(at & 63 AS int))")
        rows = marks.select(probes).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("set")).collect()
        words = np.zeros(1 << (bits - 6), np.int64)
        for word, value in rows:
            words[word] = value
        return cls(bits, words)


_WINDOW = pa.struct([("off", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("mark", pa.int64()), ("windows", pa.list_(_WINDOW)), ("at", pa.list_(pa.int32()))]))
FOUND = "array<struct<kind:int,mark:bigint,windows:array<struct<off:int,a:bigint,b:bigint>>,at:array<int>>>"


def _fingerprinted(rows: DataFrame, types: dict[str, str], kinds: list[int] | None, keep: Filter | None) -> DataFrame:
    """The columns of ``types`` with n_words and found, of rows that end in the text as binary.

    Without ``kinds`` a text is an item, of the one kind that its length makes it.
    """
    schema = pa.schema([*((k, {"bigint": pa.int64(), "string": pa.string()}[t]) for k, t in types.items()), ("n_words", pa.int64()), ("found", _FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                n_words, found = [], []
                for text in part.columns[-1]:
                    words = word_hashes(text.as_py(), known)
                    own = kinds if kinds is not None else [min(len(words), WINDOW)] if len(words) else []
                    n_words.append(len(words))
                    found.append([{"kind": k, "mark": m, "windows": [{"off": o, "a": x, "b": y} for o, x, y in w], "at": at} for k, m, w, at in fingerprints(words, own, keep)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n_words, pa.int64()), pa.array(found, _FOUND)], schema=schema)

    return arrow_map(rows, run, f"{', '.join(f'{k} {t}' for k, t in types.items())}, n_words bigint, found {FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (windows hit, as [start, end) pairs)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = stage(_fingerprinted(items, {"item_id": "string"}, None, None), "item-fingerprints")
    marks = stage(items.select(F.explode("found").alias("f")).select("f.kind", "f.mark").distinct(), "item-marks")
    kinds = sorted(r[0] for r in marks.select("kind").distinct().collect())  # 1 to WINDOW at most
    keep = Filter.of(marks)
    key = ["kind", "a", "b"]
    held = items.select("item_id", F.explode("found").alias("f")).select("item_id", "f.kind", F.explode("f.windows").alias("w"))
    held = stage(held.select("kind", "w.a", "w.b", "item_id").distinct(), "item-windows")
    # A class is a set of items, told by its size and two hashes; one of its windows stands for it.
    mixed = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "item_id"))
    windows = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), mixed(1).alias("x"), mixed(2).alias("y"))
    windows = windows.select(*key, F.md5(F.concat_ws("|", "n", "x", "y")).alias("class"))
    windows = stage(windows, "window-classes")
    first = windows.groupBy("class").agg(F.min(F.struct(*key)).alias("w")).select("class", "w.*")
    members = stage(first.join(held, key).select("class", "item_id"), "class-items")

    rows = numbered(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    rows = rows.select("_rid", "doc_id", "text")
    found = stage(_fingerprinted(rows, {"_rid": "bigint", "doc_id": "bigint"}, kinds, keep), "document-fingerprints")

    hits = found.where("size(found) > 0").select("_rid", F.explode("found").alias("f")).select("_rid", "f.kind", "f.mark", "f.windows", "f.at")
    hits = hits.join(marks, ["kind", "mark"], "left_semi").select("_rid", "kind", "at", F.explode("windows").alias("w")).select("_rid", "kind", "at", "w.*")
    hits = stage(hits.join(windows, key).select("_rid", "class", "kind", "off", "at"), "hits")
    start = F.col("p") + F.col("off")
    spans = hits.select("_rid", "kind", "off", F.explode("at").alias("p")).select("_rid", start.alias("s"), (start + F.col("kind")).alias("e")).distinct()
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("s", "e"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
    )
    spans = spans.groupBy("_rid").agg(merged["n"].alias("n_hit"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    which = stage(hits.groupBy("_rid").agg(F.array_sort(F.collect_set("class")).alias("classes")), "document-classes")
    sets = which.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(members, "class").select("classes", "item_id").distinct()
    sets = sets.groupBy("classes").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    sets = sets.select("classes", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    both_sides = spans.join(which.join(sets, "classes").drop("classes"), "_rid")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return found.drop("found").join(both_sides, "_rid", "left").select(
        "_rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), "spans",
    )


ORACLE = r"""
WITH di AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM it WHERE len(w) > 0)),
dw AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT rid, w, k.n AS n, unnest(range(1, len(w) - k.n + 2)) AS p FROM di, (SELECT DISTINCT n FROM iw) k)),
h AS (SELECT dw.rid, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY rid),
s AS (SELECT rid, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM di LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""
