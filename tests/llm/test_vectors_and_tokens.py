"""Vector codes, token files and hard negatives: against brute force, by round trips, and on awkward rows."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import hard_negatives, token_files, vector_codes, vectors

VECTORS = "vec_id bigint, embedding array<double>, label int, q string, size int, vector string, rid int, code string, error string, anchor string, score int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Vectors of (vec_id, embedding, label) with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "x", 2, "x", "x", "x", 3) for r in rows], VECTORS)


def made_up(n, width, seed, spread=0.4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    out = []
    for k in range(n):
        c = rng.randrange(6)
        out.append((k, [x + rng.gauss(0, spread) for x in centres[c]], rng.choice([c, c, 7])))
    out += [(n + k, list(out[k][1]), out[k][2]) for k in range(5)]  # ties
    rng.shuffle(out)
    return out


AWKWARD = [(None, [0.5, -0.25], 1), (900, None, 1), (901, [None, 1.0], 1), (902, [NAN, 1.0], 2), (903, [INF, 1.0], 2), (904, [-INF, 1.0], None), (905, [], None), (906, [1e30, -1e30], 3),
           (907, [0.1], 3), (908, [0.5, -0.25], None), (908, [0.5, -0.25], None), (1000, [0.5, -0.25, 0.75], 1)]


def integers(rows):
    """Kept rows with whole components, zeros behind the shorter ones."""
    kept = [(i, [max(-vectors.MOST, min(vectors.MOST, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    return [(i, v + [0] * (width - len(v)), label) for i, v, label in kept], width


# 11 vector code compression
def brute_codes(rows, parts, entries, rounds):
    rows, width = integers(rows)
    w = max(1, -(-width // parts))
    rows = sorted(((i, v + [0] * (parts * w - len(v)), label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in rows]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), best in zip(rows, found, strict=True) if best[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label) for (i, _, label), best in zip(rows, assign(), strict=True)]
    per = {}
    for _, _, error, label in out:
        per[label] = per.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(map(repr, ((i, code, error, per[label]) for i, code, error, label in out))), digest


@pytest.mark.parametrize(("rows", "parts", "entries"), [(made_up(300, 12, 1), 4, 16), (made_up(60, 7, 2), 3, 64), (AWKWARD, 2, 4), (AWKWARD, 16, 64), ([], 16, 64)])
def test_vector_codes_brute_force(spark, rows, parts, entries):
    got, codes = vector_codes.compress_vectors(table(spark, rows), parts, entries)
    want, digest = brute_codes(rows, parts, entries, vector_codes.ROUNDS)
    assert sorted(repr(tuple(r)) for r in got.select("vec_id", "code", "error", "label_error").collect()) == want
    assert codes.sha256 == digest


def test_vector_codes_stand_for_their_vectors(spark, monkeypatch):
    rows = made_up(200, 8, 3, spread=0.01)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    got, codes = vector_codes.compress_vectors(table(spark, rows), 4, 64)
    q = {i: np.array(v) for i, v, _ in integers(rows)[0]}
    for r in got.collect():
        assert ((codes.decode([r.code])[0] - q[r.vec_id]) ** 2).sum() == r.error
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(table(spark, rows), 4, 257)


def test_products_are_exact():
    rng = np.random.default_rng(4)
    for most in (10, 1 << 20, vectors.MOST):
        a, b = rng.integers(-most, most + 1, (5, 64)), rng.integers(-most, most + 1, (64, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(row, col, strict=True)) for col in b.T] for row in a]
        assert vectors.product(a, b).tolist() == want


# 13 hard negatives
def brute_negatives(rows, each, best=hard_negatives.BEST):
    rows, _ = integers([r for r in rows if r[2] is not None])
    by = lambda s: sorted(s, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:best]
    out = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or i % each:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, (j, w, other) in enumerate(rows) if m != k]
        for score, positive, _ in by([x for x in scored if x[2] == label]):
            inside = [x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score]
            out += [(i, positive, rank, j, score, s) for rank, (s, j, _) in enumerate(by(inside), 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "chunk"), [(2048, 16 << 20), (7, 400)])
def test_hard_negatives_brute_force(spark, monkeypatch, block, chunk):
    for name, value in (("BLOCK", block), ("ANCHOR_BLOCK", 3), ("CHUNK_BYTES", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    for rows in (made_up(150, 6, 5), made_up(120, 3, 6, spread=0.05), AWKWARD + [(10, [1.0, 1.0], 3), (20, [1.0, 1.0], 3), (20, [1.0, 1.0], 3), (None, [0.9, 1.0], 4), (30, [0.9, 0.9], 4), (30, [0.9, 0.9], 4)], [(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 1.0], 2)], []):
        got = hard_negatives.mine_hard_negatives(table(spark, rows), anchor=F.col("vec_id") % 10 == 0)
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute_negatives(rows, 10)


def test_slices_and_intervals():
    rng = np.random.default_rng(7)
    for low, high in ((-160, 160), (0, 1), (-1, 0), (0, 0), (-(1 << 26), 1 << 26), (5, 9)):
        rows, anchors = rng.integers(low, high + 1, (40, 9)), rng.integers(-300, 300, (6, 9))
        parts = hard_negatives.slices(rows)
        assert (sum(p << shift for p, shift in parts) == rows).all() and parts[-1][1] == 0
        b, exact, before = hard_negatives.Bounds(anchors, rows, np.ones((6, 40), bool)), anchors @ rows.T, None
        for step in range(len(b.steps)):
            if step:
                b.advance(step)
            lower, upper = b.interval()
            assert (lower <= exact[b.i, b.j]).all() and (exact[b.i, b.j] <= upper).all()
            assert before is None or ((lower >= before[0]) & (upper <= before[1])).all()  # they only shrink
            before = lower, upper
        assert (before[0] == before[1]).all()


# 12 token files
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab,.!?' \n\t\r\x1c\x85᠎　é1²<|>_"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def encoder():
    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        return token_files.Encoder(f.read())


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_pieces_give_the_ids_of_whole_texts(encoder, texts):
    texts = [*texts, "<|endoftext|>".join(texts), " ".join(texts)]
    assert encoder.encode_texts(texts) == [x + encoder.end for x in encoder.encode_whole(texts)]


def test_vocabularies_that_cut_otherwise_are_given_whole_texts(encoder):
    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        own = json.load(f)
    assert token_files.splits_at_spaces(own)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "a b"}]}, {"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}):
        assert not token_files.splits_at_spaces(own | change)
    encoder.by_pieces = False
    assert encoder.encode_texts(["a b", ""]) == [encoder.encode_whole(["a b"])[0] + encoder.end, encoder.end]
    encoder.by_pieces = True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(0, 62))
def test_packed_sequences(values, shift):
    values = np.sort(np.array(values, np.uint64) << np.uint64(max(0, min(shift, 22))))
    universe, width, low, high, samples = token_files.pack_sequence(values)
    data = low + high + samples
    at = [0, len(low), len(low) + len(high), len(data)]
    got = token_files.Sequence(lambda a, b: data[a:b], len(values), universe, width, *at)
    assert [x for k in range(-(-len(values) // token_files.SAMPLE)) for x in got.block(k).tolist()] == values.tolist()
    assert all(got.select(k) == values[k] for k in range(0, len(values), 37))
    if len(values):
        assert 8 * (len(low) + len(high)) <= len(values) * (width + 3) + 16  # near-minimal: about l + 2 bits a value


def read_back(spark, rows, encoder, **bounds):
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id bigint, text string, row int, hash string, ids binary")
    files = token_files.write_tokens(docs)
    got = sorted(map(tuple, files.read().collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in order]
    start = 0
    for _, at, n, ids in got:
        assert at == start and n * 4 == len(ids) and ids[-4:] == b"\0\0\0\0"
        start += n
    whole = [x + encoder.end for x in encoder.encode_whole([t or "" for _, t in rows])]
    as_wide = lambda x: np.frombuffer(x, "<u2").astype("<u4").tobytes()
    assert sorted((repr(r[0]), zlib.crc32(r[3])) for r in got) == sorted((repr(i), zlib.crc32(as_wide(x))) for (i, _), x in zip(rows, whole, strict=True))
    return files


def test_token_files_round_trip(spark, encoder, monkeypatch):
    rng = random.Random(12)
    rows = [(rng.choice([k, k, -k, 7, (1 << 62) + k]), " ".join(rng.choices(["word", "an,", "ü", "\n\nx", "long" * 30], k=rng.randrange(12)))) for k in range(900)]
    rows += [(None, None), (None, "a b"), (None, "a b"), (3, None), (5, ""), (6, " \n "), (8, "w " * 30_000), (9, "x" * 50_000), (10, "<|endoftext|> a\x00b")]
    read_back(spark, rows, encoder)
    monkeypatch.setattr(token_files, "FILE_BYTES", 4000)  # not seen by workers that have forked before, so by manifest below
    files = read_back(spark, rows, encoder)
    fs, root = token_files.filesystem_of(f"{files.path}/ids")
    listed = files.manifest().orderBy("start").collect()
    assert sum(r.docs for r in listed) == len(rows)
    with fs.open_input_file(f"{root}/{listed[0].file}") as handle:
        file = token_files.TokenFile(handle)
        assert file.docs == listed[0].docs and file.ids == listed[0].ids
        ends = np.cumsum([len(file.document(k)) for k in range(file.docs)])
        assert ends[-1] == file.ids and all(file.document(k)[-1] == 0 for k in range(file.docs))


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.write_tokens(docs).read().count() == 0


def test_token_files_hold_bounds(tmp_path, encoder):
    fs, root = token_files.filesystem_of(f"file://{tmp_path}")
    writer = token_files._Writer(fs, f"{root}/a.bin", 2)
    rng = random.Random(1)
    want = []
    for k in range(1000):
        ids = np.array([rng.randrange(50_000) for _ in range(rng.choice([1, 1, 5, 300]))], "<u2")
        want.append((None if k > 990 else k * 3 - 50, ids.tolist()))
        writer.add(want[-1][0], ids.tobytes())
    writer.close()
    with fs.open_input_file(f"{root}/a.bin") as handle:
        file = token_files.TokenFile(handle)
        assert [x for k in range(file.blocks()) for x in file.doc_ids(k)] == [i for i, _ in want]
        for k in (0, 255, 256, 999, 500):
            assert file.document(k).tolist() == want[k][1]
        size, table_size = handle.size() - 2 * file.ids, 8 * 2 * file.docs
        assert size < table_size / 3
    (tmp_path / "b.bin").write_bytes(b"no ids")
    with fs.open_input_file(f"{root}/b.bin") as handle, pytest.raises(ValueError):
        token_files.TokenFile(handle)
