"""MinHash near-dedup with sequential Bayesian verification.

Documents are linked when the Jaccard similarity of their sets of five-word shingles is at least
``similarity`` per cent (``SIMILARITY`` unless the caller names another); the result is the connected
components of these links.

1. One pass makes the shingle set of every whole text, its digest and a signature of ``HASHES`` minimum
   hashes (16 bits each). Documents with equal sets collapse to one representative (partial sums first).
2. Keys of a band of signature values each make candidates of representatives that share a key: a pair at the
   threshold is missed with probability (1 - 0.85^6)^24 = 1e-5 (24 bands of 6; at 0.8, 29 bands of 5), and
   less above it.
3. Candidates are compared by batches of signature values. With m of n values equal and a uniform prior,
   P(similarity >= threshold) = P(Bin(n + 1, threshold) <= m); a pair is pruned once that falls under
   ``MISS``. Survivors are verified on their full sets; only these links count.
4. A bucket is never expanded into all its pairs. First every member meets one centre of its buckets, and
   the links found merge components. Then only pairs across different components of a bucket matter: the
   members outside the bucket's largest component meet its other members in blocks of ``BLOCK`` rows. Of a component of
   more than ``LARGE`` members each is sent once, in a block of ``LARGE_BLOCK``, and meets there the at most ``HOT`` others,
   which are sent to every such block; so copies grow as the component, not as its product with the others. A
   first round hands on the most similar partner a member has per bucket, which merges what can be merged;
   a second round verifies every remaining pair that survives the pruning. So no candidate between different
   components goes unchecked, and pairs inside one component, which cannot change the result, are not made.
5. A bucket that has more than ``HOT`` members outside its largest component (documents of one template, say, that
   share much and link with nothing) is not compared so. Its members are keyed anew by their prefixes: of the
   shingles in order of their frequency among these members, rarest first, the first n - ceil(similarity * n) + 1.
   Two sets at the similarity always share one of these, so nothing is missed, and what a template has in common
   lies behind the prefixes.

Sets too small to link with any but equal ones (at 0.85 up to five shingles, as 5/6 < 0.85; at 0.8 up to three)
skip steps 2 to 4. Sets are fetched
for candidates alone, by a Bloom filter of bounded size that the second pass over the texts asks before it
splits a text. Components come from label propagation with pointer jumping over staged tables.

Rows: texts without words, and null texts, have no shingles and are linked with nothing; fewer than five
words are one shingle; repeated rows fall into one component and share ``kept``; a null id never wins over
another, and is kept only where no other id is; an empty table gives an empty result; other input columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, stage, unstage
from weftgraph.llm.decontaminate import Filter, WordHashes, gram_hashes

SHINGLE = 5
SIMILARITY = 85  # per cent
HASHES, ROWS = 256, 6  # rows of a band at most
MOST_BANDS = 30
MISS_BANDS = 1.2e-5  # of all bands, for a pair at the threshold
MORE = 768  # further values of candidates, of 8 bits each
LOOKS = (32, 64, 96, 128, 192, 256)  # signature values compared before each pruning
MORE_LOOKS = (384, 512, 768, 1024)  # and with the further ones
MISS = 1e-6  # of a pruning, for a pair that would be linked
BLOCK = 512  # members of a bucket on either side of a task's comparison
HOT = 16 * BLOCK  # members of a bucket outside its largest component, beyond which prefixes take the place of its key
LARGE, LARGE_BLOCK = 64 * BLOCK, 8 * BLOCK  # a largest component of more members comes in blocks of so many, each of which meets all others at once

_RNG = np.random.default_rng(85)
_A = (_RNG.integers(0, 1 << 32, HASHES + MORE, dtype=np.uint64) | 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES + MORE, dtype=np.uint64).astype(np.uint32)
_M = _RNG.integers(0, 1 << 63, ROWS + 1, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Distinct shingle hashes in order. Words are parted by ASCII white space, and bytes.lower() lowers A-Z alone."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(np.array([known[w] for w in words], dtype=np.uint64), min(SHINGLE, len(words))))


def _least(shingles: np.ndarray, of: slice) -> np.ndarray:
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    factors, terms = _A[of], _B[of]
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):
        np.minimum(least, (low[start : start + 1024, None] * factors + terms).min(axis=0), out=least)
    return least ^ (least >> np.uint32(16))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum hashes, 16 bits of each."""
    return _least(shingles, slice(0, HASHES)).astype(np.uint16)


def more_values(shingles: np.ndarray) -> np.ndarray:
    """Further minimum hashes, 8 bits of each. That some agree by chance can only keep a pair."""
    least = _least(shingles, slice(HASHES, None))
    return (least ^ (least >> np.uint32(8))).astype(np.uint8)


@lru_cache
def banding(similarity: int = SIMILARITY) -> tuple[int, int]:
    """(bands, rows of each): the most rows whose bands, ``MOST_BANDS`` at most, miss no more than ``MISS_BANDS``."""
    for rows in range(ROWS, 0, -1):
        if (bands := ceil(log(MISS_BANDS) / log1p(-((similarity / 100) ** rows)))) <= MOST_BANDS:
            return bands, rows
    raise ValueError(f"no bands for a similarity of {similarity} per cent")


def least_set(similarity: int = SIMILARITY) -> int:
    """The least k with k / (k + 1) >= similarity: smaller sets can only link with equal ones."""
    return -(-similarity // (100 - similarity))


def band_keys(sigs: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """(rows, bands) keys that hold the band's number."""
    n, width = banding(similarity)
    bands = sigs[:, : n * width].reshape(-1, n, width).astype(np.uint64)
    out = np.broadcast_to(np.arange(n, dtype=np.uint64) * _M[ROWS], bands.shape[:2]).copy()
    for r in range(width):
        out += (bands[:, :, r] + np.uint64(1)) * _M[r]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


@lru_cache
def least_matches(n: int, similarity: int = SIMILARITY, miss: float = MISS) -> int:
    """The least m of n equal values that keeps a pair: P(Bin(n + 1, t) <= m) >= miss."""
    t, total = similarity / 100, 0.0
    for m in range(n + 1):
        total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
        if total >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, at: tuple[np.ndarray, np.ndarray] | None = None, more: np.ndarray | None = None, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs survive all looks, and their equal values.

    Pairs are the rows of ``left`` and ``right``, or those that ``at`` names; ``more`` holds the further values by row.
    """
    i, j = at if at is not None else (np.arange(len(left)), np.arange(len(right)))
    alive, same, done = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for look in LOOKS if more is None else (*LOOKS, *MORE_LOOKS):
        x, y, start, end = (left, right, done, look) if look <= HASHES else (more, more, done - HASHES, look - HASHES)
        same = same + (x[i[alive], start:end] == y[j[alive], start:end]).sum(axis=1, dtype=np.int32)
        ok = same >= least_matches(look, similarity)
        alive, same, done = alive[ok], same[ok], look
    return alive, same


def _sigs(column: pa.Array, kind: type = np.uint16, width: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(-1, width)


_SIGNED = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def _mark(text: bytes | None, doc_id: int | None) -> int:
    """Of a row: equal rows alone share it (but for chance)."""
    h = xxhash.xxh3_64_intdigest(text or b"", seed=(doc_id or 0) & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >= 1 << 63 else h


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """A row per document: _rid, doc_id, mark, n (shingles), digest of the set, signature. Lazy; stage it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids, marks, ns, digests, sigs = part.column(1).to_pylist(), [], [], [], []
                for doc_id, cell in zip(ids, part.column(2), strict=True):
                    text = cell.as_py()
                    found = shingle_set(text, known)
                    marks.append(_mark(text, doc_id))
                    ns.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sigs.append(signature(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=_SIGNED)

    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(number.alias("_rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return arrow_map(rows.select("_rid", "doc_id", "text"), run, "_rid bigint, doc_id bigint, mark bigint, n bigint, digest binary, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles, n, more) of the wanted rows (id, mark, doc_id), by a second pass over the texts."""
    keep = Filter.of(wanted.select("mark"))
    schema = pa.schema([("mark", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("more", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids = part.column(0).to_pylist()
                marks = np.array([_mark(t.as_py(), i) for i, t in zip(ids, part.column(1), strict=True)], dtype=np.int64)
                at = np.flatnonzero(keep(marks.view(np.uint64)))
                if len(at):
                    sets = [shingle_set(part.column(1)[int(k)].as_py(), known) for k in at]
                    columns = [marks[at], [ids[k] for k in at], [x.view(np.int64) for x in sets], [more_values(x).tobytes() for x in sets]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = arrow_map(rows, run, "mark bigint, doc_id bigint, shingles array<bigint>, more binary")
    same = (F.col("f.mark") == F.col("w.mark")) & F.col("f.doc_id").eqNullSafe(F.col("w.doc_id"))
    found = found.alias("f").join(wanted.alias("w"), same).groupBy("id").agg(F.first("shingles").alias("shingles"), F.first("more").alias("more"))
    return stage(found.withColumn("n", F.size("shingles").cast("bigint")), "shingles")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id that is reachable over ``links`` (a, b), for ids with links."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    lab = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")).select("*", F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(lab.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        jump = lab.select(F.col("id").alias("comp"), F.col("comp").alias("jump"))
        new = lab.drop("moved").join(near, "id").join(jump, "comp", "left")
        least = F.least("comp", "near", F.coalesce("jump", "comp"))
        new = stage(new.select("id", least.alias("comp"), (least < F.col("comp")).alias("moved")), "labels")
        unstage(lab)
        lab = new
        if lab.where("moved").isEmpty():
            unstage(both)
            return lab.drop("moved")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links join labels, and labels get new ones."""
    ends = links.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    ends = stage(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "component-links")
    if ends.isEmpty():
        return comp
    to = components(ends).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    new = stage(comp.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "components")
    unstage(comp, ends)
    return new


def _pruned(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that survive the comparison of their signatures."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                at, _ = survivors(_sigs(x.column(2)), _sigs(x.column(3)), similarity=similarity)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(at)), x.column(1).take(pa.array(at))], schema=schema)

    sig = reps.select("id", "sig")
    rows = pairs.select("a", "b").join(sig.withColumnsRenamed({"id": "b", "sig": "sb"}), "b").join(sig.withColumnsRenamed({"id": "a", "sig": "sa"}), "a")
    return arrow_map(rows.select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links among the pairs, on full sets."""
    one = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    rows = pairs.select("a", "b").join(one("b"), "b").where("nb > 0").join(one("a"), "a")
    rows = rows.where(f"100 * least(na, nb) >= {similarity} * greatest(na, nb)")
    common = F.size(F.array_intersect("sa", "sb"))
    return rows.select("a", "b", common.alias("i"), "na", "nb").where(f"100 * i >= {similarity} * (na + nb - i)").select("a", "b")


_BLOCKS = "a bigint, b bigint"


def _spread(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, major, most, others) of the buckets that hold several components: the largest one, its members and the other members.

    Staged, so that the join with the members is one of two shuffled tables, in which a hot key can be split.
    """
    per = members.join(comp, "id").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("key").agg(F.max(F.struct("k", F.col("comp"))).alias("top"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return stage(per.select("key", F.col("top.comp").alias("major"), F.col("top.k").alias("most"), (F.col("all") - F.col("top.k")).alias("others")), "bucket-components")


def _prefixes(ids: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(id, key): buckets of the sets of ``ids`` that share a shingle of their prefixes."""
    rows = stage(sets.join(ids, "id", "left_semi").select("id", "n", F.explode("shingles").alias("key")), "hot-shingles")
    often = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "hot-frequencies")
    # A shingle of one set alone comes first in every prefix and is no bucket: counting the others places them.
    shared = rows.join(often, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"))
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") / 100) + 1
    head = F.greatest(F.lit(0), length - (F.col("n") - F.size("shared"))).cast("int")
    keys = stage(shared.select("id", F.explode(F.slice("shared", F.lit(1), head)).alias("x")).select("id", "x.key"), "prefixes")
    more = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "prefix-buckets")
    found = stage(keys.join(more, "key", "left_semi"), "prefix-members")
    unstage(rows, often, keys, more)
    return found


def _across(members: DataFrame, comp: DataFrame, reps: DataFrame, best_only: bool, similarity: int, banded: bool = True) -> DataFrame:
    """Pairs of different components that share a bucket and survive the pruning.

    ``best_only``: of each member outside a bucket's largest component, the most similar partner in the bucket.
    ``banded``: whether the buckets' keys are those of bands.
    """
    per = _spread(members, comp)
    large = F.col("most") > LARGE
    per = per.select("key", "major", F.ceil(F.col("most") / F.when(large, LARGE_BLOCK).otherwise(BLOCK)).cast("int").alias("nx"), F.ceil(F.col("others") / BLOCK).cast("int").alias("ny"), large.alias("large"))
    rows = members.join(per, "key").join(comp, "id").join(reps.select("id", "sig", "more", "n"), "id")
    minor = F.col("comp") != F.col("major")
    slot = F.pmod(F.xxhash64("id", "key"), F.when(minor, F.col("ny")).otherwise(F.col("nx"))).cast("int")
    rows = rows.withColumn("slot", slot)
    # Blocks (x, y): x is a part of the largest component, or from nx on a part of the others; y a part of the others (all of them, for a large component).
    cell = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_major = F.transform(upto(F.when(F.col("large"), 1).otherwise(F.col("ny"))), lambda y: cell(F.col("slot"), y.cast("int"), 0))
    with_major = F.transform(upto(F.col("nx")), lambda x: cell(x.cast("int"), F.when(F.col("large"), 0).otherwise(F.col("slot")), 1))
    as_right = F.transform(F.sequence(F.col("nx"), F.col("nx") + F.col("slot")), lambda x: cell(x.cast("int"), F.col("slot"), 1))
    as_left = F.transform(F.sequence(F.col("slot"), F.col("ny") - 1), lambda y: cell(F.col("nx") + F.col("slot"), y.cast("int"), 0))
    cells = F.when(minor, F.concat(with_major, as_right, as_left)).otherwise(of_major)
    rows = rows.select("key", "id", "comp", "n", "sig", "more", F.explode(cells).alias("c")).select("key", "c.x", "c.y", "c.side", "id", "comp", "n", "sig", "more")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(key: int, side: np.ndarray, ids: np.ndarray, comps: np.ndarray, ns: np.ndarray, sigs: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found_l, found_r, found_m = [], [], []
        for start in range(0, len(left), 64):
            li = left[start : start + 64]
            ok = comps[li][:, None] != comps[right][None, :]
            small, large = np.minimum(ns[li][:, None], ns[right][None, :]), np.maximum(ns[li][:, None], ns[right][None, :])
            ok &= 100 * small >= similarity * large
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            alive, same = survivors(sigs, sigs, (li[i], right[j]), more, similarity)
            found_l.append(li[i[alive]])
            found_r.append(right[j[alive]])
            found_m.append(same)
        if not found_l:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        fl, fr, fm = np.concatenate(found_l), np.concatenate(found_r), np.concatenate(found_m)
        if best_only:
            order = np.lexsort((ids[fl], -fm, fr))
            fl, fr = fl[order], fr[order]
            first = np.ones(len(fr), bool)
            first[1:] = fr[1:] != fr[:-1]
            fl, fr = fl[first], fr[first]
        elif len(fl) and banded:
            # Of the buckets that a pair shares, the first hands it on.
            kl, kr = band_keys(sigs[fl], similarity), band_keys(sigs[fr], similarity)
            mine = kl[np.arange(len(fl)), (kl == kr).argmax(axis=1)] == key
            fl, fr = fl[mine], fr[mine]
        return np.minimum(ids[fl], ids[fr]), np.maximum(ids[fl], ids[fr])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(arrays: list) -> Iterator[pa.RecordBatch]:
            head = np.stack(arrays[:3], axis=1)
            cuts = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
            outs = [block(int(p[0][0]), *p[3:]) for p in zip(*(np.split(x, cuts) for x in arrays), strict=True)]
            a, b = np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])
            if len(a):
                ab = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema=schema)

        held: list | None = None
        for x in batches:
            if not x.num_rows:
                continue
            new = [x.column(k).to_numpy(zero_copy_only=False) for k in range(7)] + [_sigs(x.column(7)), _sigs(x.column(8), np.uint8, MORE)]
            held = new if held is None else [np.concatenate([p, q]) for p, q in zip(held, new, strict=True)]
            head = np.stack(held[:3], axis=1)
            last = int(np.flatnonzero((head == head[-1]).all(axis=1))[0])  # the last block may go on
            if last:
                yield from emit([p[:last] for p in held])
                held = [p[last:] for p in held]
        if held is not None:
            yield from emit(held)

    return arrow_map(rows, run, _BLOCKS).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: _rid, doc_id, n_shingles, component_id, kept, stays.

    ``kept`` goes by ids; ``stays`` marks exactly one row of each component, the one with the least id (then the
    least _rid; null ids come last). ``row_col`` names a unique number that the rows have; else they get one.
    ``similarity``, in per cent from 32 to 99, is that from which documents are linked.
    """
    rows = stage(signed(docs, id_col, text_col, row_col), "signatures")
    reps = rows.where("n > 0").groupBy("digest").agg(
        F.min("_rid").alias("id"), F.min("doc_id").alias("doc"), F.min(F.struct("_rid", "mark", "doc_id")).alias("of"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("lead"),
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"),
    )
    reps = stage(reps.withColumns({"mark": F.col("of.mark"), "doc_id": F.col("of.doc_id")}).drop("of"), "representatives")

    key_schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(_sigs(b.column(1)), similarity)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], schema=key_schema)

    keys = arrow_map(reps.where(f"n >= {least_set(similarity)}").select("id", "sig"), keyed, "id bigint, keys array<bigint>")
    keys = stage(keys.select("id", F.explode("keys").alias("key")), "band-keys")
    shared = stage(keys.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "bucket-centres")
    members = stage(keys.join(shared, "key"), "buckets")  # of two shuffled tables, so that a hot key can be split
    unstage(shared)
    unstage(keys)

    ids = members.select("id").distinct()
    comp = stage(ids.select("id", F.col("id").alias("comp")), "components")
    held = stage(reps.join(ids, "id", "left_semi").select("id", "sig", "n", "mark", "doc_id"), "candidates")
    sets = _sets(docs, held.select("id", "mark", "doc_id"), id_col, text_col)
    held = stage(held.select("id", "sig", "n").join(sets.select("id", "more"), "id"), "candidates")

    # Each member meets the centre with which it shares most buckets.
    meets = members.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("k"))
    meets = meets.groupBy("id").agg(F.max(F.struct("k", (-F.col("centre")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("a"), F.col("id").alias("b"))
    members = members.drop("centre")
    comp = _merged(comp, _verified(_pruned(meets, held, similarity), sets, similarity))
    hot = _spread(members, comp).where(f"others > {HOT}").select("key")
    if hot.isEmpty():
        parts = [(members, True)]
    else:
        cold = stage(members.join(hot, "key", "left_anti"), "cold-buckets")
        parts = [(cold, True), (_prefixes(members.join(hot, "key", "left_semi").select("id").distinct(), sets, similarity), False)]
    seen = []
    for part, banded in parts:
        best = stage(_across(part, comp, held, best_only=True, similarity=similarity, banded=banded), "best-pairs")
        comp = _merged(comp, _verified(best, sets, similarity))
        seen.append(best)
    for (part, banded), best in zip(parts, seen, strict=True):
        rest = _across(part, comp, held, best_only=False, similarity=similarity, banded=banded).join(best, ["a", "b"], "left_anti")
        comp = _merged(comp, _verified(rest, sets, similarity))

    # Components of representatives; a document finds its own through its digest, where there is more than itself.
    of = reps.select("digest", "id", "doc", "lead", "copies").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = of.groupBy("comp").agg(F.min("doc").alias("component_id"), F.min("lead").alias("lead"), F.sum("copies").alias("size")).where("size > 1")
    verdicts = of.select("digest", "comp").join(least.select("comp", "component_id", F.col("lead._rid").alias("first")), "comp")
    verdicts = stage(verdicts.select("digest", "component_id", "first"), "near-verdicts")
    unstage(members, sets, held, comp, *seen, *(part for part, _ in parts))
    out = rows.select("_rid", "doc_id", F.col("n").alias("n_shingles"), "digest").join(verdicts, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    kept, stays = F.col("doc_id").eqNullSafe(component), F.coalesce(F.col("_rid") == F.col("first"), F.lit(True))
    return out.select("_rid", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), stays.alias("stays"))
