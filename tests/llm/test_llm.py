"""The training-data operators: against SQL, against brute force, by round trips, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of, rows_of_sql
from pyspark.sql import functions as F

from weftgraph.llm import chat_format, decontaminate, exact_dedup, html_extract, license_scan, license_texts, mixing, near_dedup, quality, sharding, warc
from weftgraph.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, key bigint, size bigint, kept boolean, bytes string, rank int"


def docs(spark, rows):
    """Documents of (doc_id, text[, source]) with further columns whose names operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", 7, 8, True, "b", 3) for r in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "One two three"), (3, "One two three"), (4, "ONE two three"), (None, "one two three"), (5, "É é \x00 weird   text " * 3), (6, " \n\t "), (7, "w " * 30_000), (8, "a\\b\n</turn>")]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        columns, want = rows_of_sql(ORACLES[name], sf_dir)
        assert sorted(got.columns) == columns
        assert rows_of(got) == want
    else:
        assert got.count() > 0


# 1 license scans
def test_license_scan(spark):
    mit = license_texts.TEXTS["MIT"]
    wild = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(" ", "  ") + "\n\n"
    rows = docs(spark, [*AWKWARD, (20, mit), (21, wild), (22, "prose\nReleased under the MIT Licence\nmore\n  licensed under CC BY 4.0 "), (23, mit + " and more"), (24, "(C) 2001 A")])
    got = {r.doc_id: r for r in license_scan.license_scan(rows).where("doc_id >= 20").collect()}
    assert [got[k].license_id for k in (20, 21, 22, 23)] == ["MIT", "MIT", None, None]
    assert got[22].notice_ids == "CC-BY-4.0,MIT"
    assert got[24].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert license_scan.license_scan(rows).count() == len(AWKWARD) + 5
    assert license_scan.license_scan(rows.limit(0)).count() == 0
    own = license_scan.license_scan(rows, [("X", "one TWO, three")], []).where("license_id = 'X'")
    assert own.count() == 4


def test_license_files_with_titles(spark):
    t, own = license_texts.TEXTS, "Copyright (c) 2020 Someone"
    files = [("MIT", f"MIT License\n\n{own}\n\n{t['MIT']}\n"), ("MIT", f"The MIT License (MIT)\n\n{own}\n\n{t['MIT']}"), ("ISC", f"ISC License\n\n{own}\n\n{t['ISC']}"),
             ("BSD-3-Clause", f"BSD 3-Clause License\n\n{own}\nAll rights reserved.\n\n{t['BSD-3-Clause']}"), ("BSD-2-Clause", f"{own}\nAll rights reserved.\n\n{t['BSD-2-Clause']}"), (None, f"My own title\n\n{t['MIT']}")]
    folder = Path("/usr/share/common-licenses")
    wrapped = t["ISC"].replace("above copyright", "above\ncopyright")  # a line that begins so states no copyright
    files += [("ISC", f"The ISC License\n\nCopyright (c) Someone and Contributors\n\n{wrapped}"), ("BSD-3-Clause", t["BSD-3-Clause"].replace("the copyright holder nor", "the\ncopyright holder nor")), ("BSL-1.0", t["BSL-1.0"]), ("WTFPL", t["WTFPL"]),
              ("BSD-2-Clause", t["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("HOLDER OR", "OWNER OR")), ("ISC", t["ISC"].replace("THE AUTHOR ", "THE COPYRIGHT HOLDERS "))]
    for name, file in (("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("GPL-3.0-only", "GPL-3"), ("GPL-2.0-only", "GPL-2"), ("GPL-1.0-only", "GPL-1"), ("LGPL-3.0-only", "LGPL-3"), ("LGPL-2.1-only", "LGPL-2.1"),
                       ("LGPL-2.0-only", "LGPL-2"), ("GFDL-1.2-only", "GFDL-1.2"), ("GFDL-1.3-only", "GFDL-1.3"), ("MPL-1.1", "MPL-1.1"), ("CC0-1.0", "CC0-1.0"), ("Artistic-1.0-Perl", "Artistic")):
        if (folder / file).exists():
            files.append((name, (folder / file).read_text()))
    got = license_scan.license_scan(docs(spark, [(k, text) for k, (_, text) in enumerate(files)])).collect()
    assert len(got) == len(files) and {r.doc_id: r.license_id for r in got} == {k: name for k, (name, _) in enumerate(files)}
    digests = [r.digest for r in license_scan.catalogue(spark, [*license_texts.WHOLE, *license_texts.TITLED, *license_texts.NOTICES]).collect()]
    assert not set(digests) & {d for _, d in license_texts.LONG}
    assert len({name for name, _ in [*license_texts.WHOLE, *license_texts.LONG]}) >= 30


def test_license_files_against_sql(spark, tmp_path):
    """Entire texts, under heads and wrapped anew, through both engines."""
    import textwrap

    rng = random.Random(1)
    some = rng.sample(license_texts.TITLED, 40) + license_texts.WHOLE
    texts = [f"Copyright (c) 20{k:02} X\n\n" + "\n".join(textwrap.fill(x, 40 + k % 50, break_on_hyphens=False) for x in text.split("\n")) for k, (_, text) in enumerate(some)]
    docs(spark, [*enumerate(texts), (1000, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "sql").mkdir()
    frame.toPandas().to_parquet(tmp_path / "sql" / "documents.parquet")
    got = license_scan.license_scan(frame)
    assert {r.doc_id: r.license_id for r in got.collect() if r.doc_id < 1000} == {k: name for k, (name, _) in enumerate(some)}
    assert rows_of(got) == rows_of_sql(ORACLES["op1_license_scan"], tmp_path / "sql")[1]


# 2 chat formatting
def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </turn>\n### User: \\x"), (2, 0, "assistant", None), (2, 1, "odd </role>: \\", "t"), (2, 2, None, ""), (None, 0, "user", "n"),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 5, "system", "s"), (4, 9, "user", "u"), (4, 10, "assistant", "l" * 200_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, segment int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].order_error for c in (1, 2, 3, 4)] == [None, 0, 1, None]
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_chat_escapes():
    codec, rng = chat_format.Codec(chat_format.Template()), random.Random(2)
    parts = ["\\", "### Assistant:", "</turn>", " ", "\n", "#", "<", "### Role", "</role>:", "a", " </turn>\n"]
    for _ in range(3000):
        text, role = "".join(rng.choices(parts, k=rng.randint(0, 8))), rng.choice(["user", "assistant", "".join(rng.choices(parts, k=3))])
        formatted = "".join(s for _, s, _ in codec.segments(role, text))
        assert codec.end_of_turn(formatted) == len(formatted) - len(codec.t.end)
        assert codec.read_turn(formatted[: -len(codec.t.end)]) == (role, text)


# 3 exact dedup
def test_exact_dedup_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, AWKWARD), index).collect()}
    assert (first[1].keep_id, first[1].group_size, first[1].kept) == (2, 2, False)
    assert (first[3].keep_id, first[3].group_size, first[4].kept, first[None].kept) == (4, 4, True, False)
    second = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, [(9, "One two three"), (10, "new"), (11, "NEW")]), index).collect()}
    assert (second[9].keep_id, second[9].kept, second[10].kept, second[11].kept) == (4, False, False, True)
    assert exact_dedup.exact_dedup(docs(spark, AWKWARD).limit(0), index).count() == 0
    assert index.rows().count() == index.rows().select("text_sha256").distinct().count() == 7
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert exact_dedup.exact_dedup(docs(spark, [(12, "new")]), again).first().kept is False
    plan = again.rows().hint("merge").join(index.rows().select("text_sha256"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    wider = again.rebucketed(8)
    assert wider.buckets == 8 and rows_of(wider.rows()) == rows_of(again.rows()) and exact_dedup.exact_dedup(docs(spark, [(13, "NEW"), (14, "newer")]), wider).where("kept").count() == 1
    assert [exact_dedup.buckets_for(n) for n in (0, 1, 128_000_000, 128_000_001, 10**13)] == [64, 64, 64, 128, 65536]
    tables = len(spark.catalog.listTables())
    exact_dedup.exact_dedup(docs(spark, AWKWARD)).collect()
    assert len(spark.catalog.listTables()) == tables


# 4 near dedup
def brute_components(rows, similarity=85):
    sets = {}
    for k, (i, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    group = defaultdict(list)
    for k in sets:
        group[find(k)].append(rows[k][0])
    return {(rows[k][0], len(sets[k]), min(x for x in group[find(k)] if x is not None)) for k in sets if rows[k][0] is not None}


def near_rows(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for k in range(n):
        kind = k % 4
        text = list(base) if kind < 2 else [rng.choice(words) for _ in range(rng.choice((1, 3, 4, 5, 9, 10, 60)))]
        for _ in range(rng.randint(0, 3) if kind < 2 else 0):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text)))
        if kind == 3:
            rows.append((1000 + k, " ".join([*text[:-1], "tail"])))
    return rows


@pytest.mark.parametrize(("hot", "large"), [(near_dedup.HOT, near_dedup.LARGE), (3, near_dedup.LARGE), (near_dedup.HOT, 5)])
def test_near_dedup_brute_force(spark, monkeypatch, hot, large):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "LARGE_BLOCK", 40)
    rows = [*near_rows(), *((None if i is None else 5000 + i, t) for i, t in AWKWARD)]
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    by = defaultdict(list)
    for r in got:
        by[r.component_id if r.n_shingles else (r.doc_id, r._rid)].append(r.stays)
    assert all(sum(x) == 1 for x in by.values())
    assert near_dedup.near_dedup(docs(spark, rows).limit(0)).count() == 0


def test_near_dedup_of_a_template(spark, monkeypatch):
    """Texts that share most and mostly link with nothing: few pairs are compared, and no link is lost."""
    rng = random.Random(12)
    same = [f"t{k}" for k in range(160)]
    rows = [(k, " ".join([*same, *(f"p{k}-{j}" for j in range(44))])) for k in range(300)]  # 0.65 of each other
    rows += [(1000 + k, rows[k][1].rsplit(" ", rng.randint(0, 9))[0] + " end") for k in range(0, 300, 25)]
    pairs = []
    real = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda p, *rest: pairs.append(p.count()) or real(p, *rest))
    monkeypatch.setattr(near_dedup, "HOT", 20)
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert sum(pairs) < 2000


def test_pruning_keeps_what_links():
    rng = np.random.default_rng(1)
    lost = 0
    for k in range(200):
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        b = np.concatenate([a[:368], rng.integers(0, 1 << 63, 32, dtype=np.uint64)])  # 368 / 432 = 0.852
        x, y = np.unique(a), np.unique(b)
        sigs, more = np.stack([near_dedup.signature(x), near_dedup.signature(y)]), np.stack([near_dedup.more_values(x), near_dedup.more_values(y)])
        keys = near_dedup.band_keys(sigs)
        alive, _ = near_dedup.survivors(sigs, sigs, (np.array([0]), np.array([1])), more)
        lost += not len(alive) or not (keys[0] == keys[1]).any()
    assert lost == 0


def test_near_dedup_at_other_similarity(spark, monkeypatch):
    """The pipeline's stage links from 0.8 on, op4 from 0.85; components at 0.8 are those of brute force."""
    import corpus_pipeline

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    words = [f"v{k}" for k in range(104)]
    cut = words[:84]  # 80 of 100 shingles
    rows = [(1, " ".join(words)), (2, " ".join(cut)), (3, " ".join(words[:83])[1:] + "x"), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "a b c d e f g"), (7, "k l m n o p q r"), (8, "k l m n o p q")]
    stage = lambda r: {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs(spark, r), "").collect()}
    assert stage(rows[:2]) == {1}
    assert stage(rows[3:5]) == {4} and stage(rows[6:]) == {7, 8}  # 4 of 5 shingles, and 3 of 4
    assert near_dedup.near_dedup(docs(spark, rows[:2])).where("kept").count() == 2

    rows += [(100 + i, t) for i, t in near_rows()]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in links)
    for _ in sets:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    got = near_dedup.near_dedup(docs(spark, rows), similarity=80).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_bands_at_other_similarity():
    assert near_dedup.banding() == (24, 6) and near_dedup.least_set() == 6 and near_dedup.least_set(80) == 4
    for similarity in (50, 70, 80, 90, 99):
        bands, width = near_dedup.banding(similarity)
        assert bands * width <= near_dedup.HASHES and (1 - (similarity / 100) ** width) ** bands <= near_dedup.MISS_BANDS
    with pytest.raises(ValueError):
        near_dedup.banding(20)


def test_links_between_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {r.id: r.comp for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for a, b in edges if a != b for k in (a, b)}


# 5 WARC
PAGES = "page_id bigint, url string, html string, digest string, first bigint, path string, offset bigint"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 2) for r in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://B.example.org/a?x=1", big), (2, "http://b.example.org/a?x=1", big), (3, None, None), (4, "https://www.a.org:8443/\r\nx", "small"), (5, "u v", "small"), (5, "u v", "small"), (None, "http://c.org", big), (6, "http://d.org/", "y" * 3_000_000)]
    index = warc.archive_pages(pages(spark, rows), f"file://{tmp_path}/warc")
    got = index.read(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type, by[None].record_type) == ("revisit", 2, "response", "revisit")
    assert by[1].payload_bytes == len(big.encode()) and by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[6].payload_bytes == 3_000_000
    assert (by[4].record_type, by[5].record_type, by[3].payload_bytes) == ("response", "response", 0)
    found = index.lookup("http://b.example.org/a?x=1")
    assert sorted(f["warc-type"] for f, _ in found) == ["response", "revisit"]
    assert next(b for f, b in found if f["warc-type"] == "response").endswith(b"\r\n\r\n" + big.encode())
    assert index.lookup("http://nowhere.org/") == []
    assert warc.url_key("http://www.A.org:80/") == "org,a)/" and warc.url_key("http://[bad") == ")http://[bad"


def test_warc_empty(spark):
    none = pages(spark, [(1, "u", "x")]).limit(0)
    index = warc.archive_pages(none)
    assert index.read(none).count() == index.read(pages(spark, [(1, "u", "x")])).count() == 0


def test_warc_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, f"http://h{k % 13}.org/{k % 50}", f"t{k}") for k in range(200)]
    index = warc.archive_pages(pages(spark, rows))
    assert index.directory().count() >= 200 // 7
    for k in (0, 49, 130):
        assert len(index.lookup(rows[k][1])) == sum(r[1] == rows[k][1] for r in rows)
    some = pages(spark, [(0, rows[k][1], "") for k in (0, 49, 130)] + [(0, "http://nowhere.org/", "")])
    want = sorted(r[0] for r in rows if r[1] in {rows[k][1] for k in (0, 49, 130)})
    assert sorted(r.page_id for r in index.read(some).collect()) == want
    monkeypatch.setattr(warc, "DIRECTORY_LIMIT", 0)  # the way beyond the limit
    assert sorted(r.page_id for r in index.read(some).collect()) == want
    monkeypatch.setattr(warc.CaptureIndex, "blocks", lambda self: spark.read.schema(warc.BLOCK).parquet(f"{self.path}/blocks").limit(0))
    assert index.read(some).count() == 0  # nothing is read past the index


def test_warc_reads_what_is_asked_for(spark, tmp_path, monkeypatch):
    """Of 4,000 pages in a few archives, the bytes that a read of some URLs takes, counted at the file."""
    rng = random.Random(5)
    rows = [(k, f"http://h{k % 50}.org/{k}", f"<p>{k}</p>" + "x" * rng.randrange(2000, 6000)) for k in range(4000)]
    index = warc.archive_pages(pages(spark, rows).coalesce(2), f"file://{tmp_path}/warc")
    total = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    found = index.find(pages(spark, rows[::100])).collect()
    assert sorted(r.page_id for r in found) == [r[0] for r in rows[::100]]
    took, got = 0, []

    class Counted:
        def __init__(self, path):
            self.file = open(path.removeprefix("file:"), "rb")

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            nonlocal took
            took += n
            return self.file.read(n)

    for archive in {r.archive for r in found}:
        ranges = sorted((r.offset, r.length) for r in found if r.archive == archive)
        got += [warc.capture(archive, record, at) for at, record in warc.records(Counted(archive), ranges)]
    assert len(got) == 40 and all(x[-1] for x in got)
    assert took < 1.01 * sum(r.length for r in found) < total / 80
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    assert [x[:2] for x in warc.spans([(0, 5), (5, 5), (30, 5), (32, 9)])] == [(0, 10), (30, 41)]
    monkeypatch.setattr(warc, "SPAN_BYTES", 12)
    assert [x[:2] for x in warc.spans([(0, 5), (5, 9), (14, 100), (114, 1)])] == [(0, 5), (5, 14), (14, 114), (114, 115)]
    assert list(warc.spans([])) == []


def test_warc_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "CLASS_BYTES", (2_000, 8_000, 20_000))
    rows = [(k, f"http://h.org/{k}", "x" * (200 * (k % 150)) + str(k)) for k in range(400)]
    index = warc.archive_pages(pages(spark, rows), f"file://{tmp_path}/warc")
    sizes = [f.stat().st_size for f in Path(f"{tmp_path}/warc").rglob("part-*")]
    assert max(sizes) <= 40_000 and len(sizes) > 20
    got = {r.page_id: r for r in index.read(pages(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[k].payload_digest == hashlib.sha1(x.encode()).hexdigest() and got[k].intact for k, _, x in rows)


# 6 decontamination
def brute_contamination(doc_texts, items):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for t in doc_texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "a", "Über", "x1", "y", "z"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 5, 8, 12, 13, 14, 20, 40))))) for k in range(2, 40)] + [(100, None), (101, "!!!"), (102, "the " * 60)]
    texts = []
    for _ in range(120):
        t = [rng.choice(words) for _ in range(rng.choice((0, 3, 13, 50, 300)))]
        for _ in range(rng.randint(0, 2)):
            piece = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(t))
            t[at:at] = piece[rng.randint(0, 3) :]
        texts.append(" ".join(t) + rng.choice(["", ".", " -- "]))
    texts += [None, "", "the " * 5000, "?!"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, mark int")
    got = decontaminate.decontaminate(docs(spark, [(k % 50, t) for k, t in enumerate(texts)]), bench)
    got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())
    assert got == sorted(brute_contamination(texts, [(str(i), t) for i, t in items]))
    none = decontaminate.decontaminate(docs(spark, [(1, "a b")]), bench.limit(0)).first()
    assert (none.n_hit, none.contaminated) == (0, False)
    assert decontaminate.decontaminate(docs(spark, [(1, "a")]).limit(0), bench).count() == 0


def test_decontamination_of_a_passage_in_many_items(spark, monkeypatch):
    """A passage that many items and many documents hold makes rows for neither times the other."""
    passage = " ".join(f"p{k}" for k in range(40))
    items = [(k, f"{passage} q{k} " + " ".join(f"own{k}-{j}" for j in range(15))) for k in range(60)]
    texts = [f"d{k} {passage} q{k % 90} " + " ".join(f"own{k % 90}-{j}" for j in range(k % 14)) for k in range(300)]
    staged = {}
    real = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs(spark, list(enumerate(texts))), bench)
    got = [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.orderBy("doc_id").collect()]
    assert got == brute_contamination(texts, [(str(i), t) for i, t in items])
    assert staged["hits"].count() < 300 * 40 * 6  # fingerprints of a document times the windows around one
    assert staged["document-classes"].selectExpr("max(size(classes))").first()[0] <= 2


def test_winnowing_guarantee():
    rng = random.Random(6)
    known = decontaminate.WordHashes()
    for _ in range(200):
        shared = " ".join(f"s{rng.randrange(1000)}" for _ in range(13))
        mark = lambda: {m for _, m, _, _ in decontaminate.fingerprints(decontaminate.word_hashes(f"{' '.join(f'q{rng.randrange(1000)}' for _ in range(rng.randrange(20)))} {shared} r{rng.randrange(9)}".encode(), known), [13])}  # noqa: E731, B023
        assert mark() & mark()


# 7 HTML extraction
PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header><nav>Menu</nav><div class="cookie-notice">We use</div>
<div id="wrap"><main><article><header><h1>Head &amp; more</h1></header><p>One<br>two &lt;b&gt; <b>bold</b>text<p>Open <i>para</i><ul><li>x<li>y</ul><div class="ad-box">Buy</div><form>f<input></form><aside>no</aside>
<table><tr><td>c1<td>c2</table><!-- c --><script>if (a</b) "</p>"</script>tail &nbsp; end</article><section class="comments"><article class="comment"><p>troll</p></article></section></main></div><footer>F</footer></body>"""


def test_html_page():
    assert html_extract.Page(PAGE).text(frozenset()).split("\n") == ["Head & more", "One two <b> boldtext", "Open para", "x", "y", "c1", "c2", "tail end"]
    assert html_extract.Page("<p>no body</p><div class=sidebar>s</div>plain").text(frozenset()) == "no body\nplain"
    for broken in ("", "<", "<p", "</p></div>", "<!--", "<script>x", "a < b > c", "<p a='x>y</p>", "<<p>>", "<table><td>1<tr><td>2"):
        html_extract.Page(broken).text(frozenset())
    assert html_extract.Page("a < b").text(frozenset()) == "a < b"


def test_html_names_never_hide_the_article():
    text = lambda x: html_extract.Page(f"<body>{x}</body>").text(frozenset())
    for page in ("<div class='content-sidebar-wrap'><main><p>T</p></main><div class=sidebar>s</div></div>", "<article class='post has-sidebar'><p>T</p></article>", "<div class='elementor-widget-container'><p>T</p></div>",
                 "<div class='overflow-hidden'><article>T</article></div>", "<div class=widget><article class=promo>T</article></div>", "<div class=modal><main>T<div class=ad-box>a</div></main></div>",
                 "<form><div class=x><main><p>T</p></main></div><nav>n</nav></form>", "<form><article>T</article></form>", "<form><div><p>T</p></div><footer>f</footer></form>", "<aside>a</aside><nav><main>T</main></nav>"):
        assert text(page) == "T", page
    for noise in ("<div class=main-nav>n</div>", "<div id=sidebar>s</div>", "<div class='cookieNotice x'>c</div>", "<div class='ad-box-2'>a</div>", "<form>f</form>", "<article class=comment>c</article>", "<div hidden><article>h</article></div>", "<div class=widget>w</div>"):
        assert text(noise + "<p>T</p>") == "T", noise


def test_html_style_tree(spark):
    """A block without any telling name goes where a site repeats it, and stays where each page has its own."""
    rows = [(k, f"http://h.org/{k}", f"<body><div class=zz>Same on all</div><div class=story>Story number {k} is here</div><div class=q>{'ABC'[k % 3]}</div></body>") for k in range(30)]
    rows += [(100 + k, f"http://few.org/{k}", "<body><div class=zz>Same on all</div></body>") for k in range(2)] + [(200, None, None), (201, "no host", "<p>x</p>"), (202, "http://h.org/1", "")]
    got = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert all(got[k] == f"Story number {k} is here" for k in range(30))
    assert got[100] == "Same on all" and got[200] == "" and got[201] == "x" and got[202] == ""
    assert html_extract.extract_text(pages(spark, rows).limit(0)).count() == 0


def test_html_same_sentence_in_articles_stays(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><article><h1>T{k}</h1><p>Every article says this.</p><p>own {k}</p></article></body>") for k in range(20)]
    assert all(r.text == f"T{r.page_id}\nEvery article says this.\nown {r.page_id}" for r in html_extract.extract_text(pages(spark, rows)).collect())


def test_html_text_goes_by_mass():
    text = lambda x: html_extract.Page(f"<body>{x}</body>").text()
    story = "<p>The story goes on and on for some time, and then it goes on.</p>"
    assert text("<div id='content-sidebar-wrap'><article><p>T</p></article></div>") == text("<article class='post comment-status-open'><p>T</p></article>") == "T"
    assert text("<article><p>T</p><div class='form-group'>fg</div><div class='side-note'>sn</div><div class='share'>sh</div></article>") == "T\nfg\nsn\nsh"
    assert text("<article><p>T</p><div class='share'><a href=x>on a</a> <a href=y>on b</a></div></article>") == "T"
    assert story[3:-4] in text(f"<main>{story}{story}<article class=card><a href=x>teaser</a></article></main>")
    assert text(f"<div class=widget>{story}</div><div>x</div>").startswith(story[3:-4])
    assert text(f"<article>{story}<div class=ad>buy</div></article><div class=promo>p</div><div>more</div>") == story[3:-4]


def test_html_sections_of_an_article_stay_whatever_they_are_called():
    text = lambda x: html_extract.Page(f"<body><nav>n</nav><article><h1>T</h1><p>{story}</p>{x}</article></body>").text()
    story = "The story goes on. " * 20 + "It ends."
    told = "<h2>Head</h2><p>One paragraph of it.</p><p>And <a href=x>one</a> more.</p>"
    for start in ("<section id='discussion'>", "<section id='related'>", "<section class='menu'>", "<section id='copyright'>", "<div class='related'>", "<section class='recommended section'>"):
        end = f"</{start[1:].split()[0]}>"
        assert text(start + told + end) == f"T\n{story}\nHead\nOne paragraph of it.\nAnd one more.", start
        lists = start + "<h2>Head</h2><ul><li><a href=a>One that links</a><li><a href=b>Another that links</a></ul>" + end
        others = start + "<h2>Head</h2><div><span class=author>A</span><p>First says so.</p></div><div><span class=author>B</span><p>Second says no.</p></div>" + end
        for gone in (lists, others, start + "<h2>Head</h2><article><p>Not this one.</p></article>" + end, start + "No heading here." + end):
            assert text(gone) == f"T\n{story}", gone
    for start in ("<section class='comments'>", "<div class='ad'>", "<section class='newsletter related'>", "<section class='related ads'>", "<div class=notice>", "<aside class=related>"):
        assert text(start + told + f"</{start[1:].split()[0].rstrip('>')}>") == f"T\n{story}", start


def made_up_page(rng, k):
    """A page of a site, and its article's text by construction."""
    words = [f"w{x}" for x in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    blocks, want = [], []
    for _ in range(rng.randint(2, 7)):
        kind = rng.choice(["p", "p", "p", "h2", "list", "table", "pre", "ad", "share", "comments", "related", "section", "script", "inline"])
        text = prose(rng.randint(8, 20))
        if kind in ("p", "h2", "pre"):
            blocks.append(f"<{kind}>{text}</{kind}>")
            want.append(text)
        elif kind == "inline":
            blocks.append(f"<p>{text} <b>bold</b>, <a href='/x{k}'>a link</a> &amp;\n more<br>line</p>")
            want.append(f"{text} bold, a link & more line")
        elif kind in ("list", "table"):
            items = [prose(3) for _ in range(3)]
            blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>" if kind == "list" else "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in items) + "</table>")
            want += items
        elif kind == "section":
            blocks.append(f"<section id='related'><h3>{prose(2)}</h3><p>{text}</p></section>")
            want += [blocks[-1].split("<h3>")[1].split("</h3>")[0], text]
        else:
            blocks.append({"ad": f"<div class='ad-box'>{text}</div>", "share": f"<div class=share><a href='/s{k}'>{text}</a></div>", "comments": f"<div id=comments><p>{text}</p></div>",
                           "related": f"<div class=related><a href='/r{k}'>{text}</a></div>", "script": f"<script>var a = '<p>{text}</p>';</script>"}[kind])
    title = prose(4)
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(words, 5))
    page = (f"<html><head><title>{title}</title><style>p {{}}</style></head><body><header><a href='/'>Site</a></header><nav><ul>{menu}</ul></nav><div class='cookie-notice'>{prose(9)}</div>"
            f"<main><article><h1>{title}</h1>{''.join(blocks)}</article><aside>{prose(6)}</aside></main><form><input><p>{prose(3)}</p></form><footer>&copy; {prose(4)}</footer></body></html>")  # fmt: skip
    return page, "\n".join([title, *want])


def test_html_whole_texts_of_made_up_sites(spark):
    rng = random.Random(77)
    made = [made_up_page(rng, k) for k in range(120)]
    rows = [(k, f"http://{'abc'[k % 3]}.org/{k}", page) for k, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    for k, (_, want) in enumerate(made):
        assert got[k] == want, k


def test_html_deep_and_broken_pages_take_linear_time():
    import time

    start = time.perf_counter()
    for source in ("<div>" * 100_000 + "x", "<div><p>a" * 50_000 + "</div>x<p>" * 50_000, "<b><p>" * 50_000 + "x", "<ul><li>x" * 50_000, "</div></p>" * 100_000 + "x", "<table><tr><td>x" * 30_000,
                   "x" + "</" * 500_000 + ">", "x" + "<a " * 300_000, "x<a \"" * 100_000 + ">", "x" + "<!-- " * 200_000 + ">"):
        page = html_extract.Page(source)
        assert "x" in page.text() and page.features()
    assert time.perf_counter() - start < 40


def brute_style_tree(pages):
    """Importance by path of one host's pages, from its definition: the merged tree as a dict, sums by walking down."""
    import math

    tree = {}  # path -> [parent, pages that have it, {feature: (weight, pages)}]
    for page, source in enumerate(dict.fromkeys(pages)):
        for path, parent, feature, weight in html_extract.Page(source).features():
            node = tree.setdefault(path, [None, set(), {}])
            if parent is not None:
                node[0] = parent
                node[1].add(page)
            node[2].setdefault((feature, parent is None), (weight, set()))[1].add(page)

    def sums(path):
        _, m, shown = tree[path]
        total = sum(w * len(n) for w, n in shown.values())
        says = sum(w * len(n) * (1 - (math.log(len(n)) / math.log(len(m)) if len(m) > 1 else 0)) for w, n in shown.values())
        for child in (c for c, x in tree.items() if x[0] == path):
            t, s = sums(child)
            total, says = total + t, says + s
        return total, says

    return {p: (len(x[1]), s / t if t else 1.0) for p, x in tree.items() for t, s in (sums(p),)}


def made_up_site(n=50):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    menu = [f"<li><a href='/m{k}'>Entry {k}</a>" for k in range(6)]
    out = []
    for k in range(n):
        items = "".join([*rng.sample(menu, 5), f"<li><a href='/p{k}'>Next {k}</a>"])
        bar = f"<div class=zz><ul>{items}</ul><span>All of this site</span></div>"
        body = "".join(f"<div class=t{k % 3}>{prose(12)}</div>" for _ in range(rng.randint(1, 4)))
        out.append(f"<html><body>{bar}<div class=yy><h2>{prose(3)}</h2>{body}<img src={k % 2}></div>{'<div class=xx><i>Rare</i></div>' if k % 9 == 0 else ''}<div class=ww><div>Made by <b>us</b></div></div></body></html>")
    return [*out, out[0], out[0]]


def test_html_style_tree_brute_force(spark):
    rows = [(k, f"http://{'h' if k % 2 else 'g'}.org/{k}", x) for k, x in enumerate([*made_up_site(), "<div>" * 40 + "deep" + "<p>a<p>b", "", "plain"])]
    frame = pages(spark, rows).selectExpr("CASE WHEN page_id % 2 = 1 THEN 1L ELSE 0L END AS host", "html")
    got = {(r.host, r.path & 0xFFFFFFFFFFFFFFFF): (r.pages, r.importance) for r in html_extract.style_tree(frame).collect()}
    want = {(h, p): x for h in (0, 1) for p, x in brute_style_tree([x for k, _, x in rows if k % 2 == h]).items()}
    assert set(got) == set(want) and len(want) > 50
    for key, (n, importance) in want.items():
        assert got[key][0] == n and abs(got[key][1] - importance) < 1e-9, key
    assert any(x < 0.5 for _, x in want.values()) and any(0.1 < x < 0.9 for _, x in want.values())


def test_html_tree_decides_on_a_site_without_telling_names(spark, monkeypatch):
    site = pages(spark, [(k, f"http://h.org/{k}", x) for k, x in enumerate(made_up_site())])
    texts = lambda: {r.page_id: r.text for r in html_extract.extract_text(site).collect()}
    got = texts()
    assert all("Entry" not in x and "Made by" not in x and "All of this" not in x and len(x) > 50 for x in got.values())
    monkeypatch.setattr(html_extract, "BROADCAST_PATHS", 0)
    assert texts() == got
    monkeypatch.setattr(html_extract, "unimportant", lambda tree: tree.select("host", "path").limit(0))
    assert all("Entry" in x and "Made by us" in x for x in texts().values())


# 8 mixing
def test_mixing_targets(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", "tiny" if k % 50 == 0 else "a", None])) for k in range(3000)] + [*((x[0], x[1], "z") for x in AWKWARD)]
    out = mixing.mix_sources(docs(spark, rows), carry=("key",))
    got = out.collect()
    assert len(got) == len(rows) and rows_of(out) == rows_of(mixing.mix_sources(docs(spark, rows[::-1]), carry=("key",)))
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        x = per[r.source]
        x[0], x[1], x[2], x[3] = x[0] + r.size, x[1] + r.taken, r.target, max(x[3], r.size)
        assert r.taken == r.copies * r.size <= 3 * r.size and r.source_size >= r.size
    total = sum(x[0] for x in per.values())
    assert abs(sum(x[2] for x in per.values()) - total) < 1e-6 * total
    for size, taken, target, largest in per.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= largest / 2 + 1
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(x for x in per if x is not None) + [None])}
    free = [x[2] / weight[s] for s, x in per.items() if x[2] < 3 * x[0] - 1e-6]
    assert max(free) - min(free) < 1e-6 * total
    many = [(k, "w " * (k % 7 + 1) * (200 if k % 40 == 0 else 1), f"s{k}") for k in range(800)]  # a source for each document
    sources = {r.source: (r.source_size, r.target) for r in mixing.mix_sources(docs(spark, many)).collect()}
    rank = {s: k % 3 + 1 for k, s in enumerate(sorted(sources))}
    level = max(t / rank[s] for s, (n, t) in sources.items() if t < 3 * n)
    assert all(abs(t - min(3 * n, level * rank[s])) < 1e-6 for s, (n, t) in sources.items()) and abs(sum(t for _, t in sources.values()) - sum(n for n, _ in sources.values())) < 1e-6
    taken = defaultdict(int)
    for r in mixing.repeat_rows(docs(spark, rows)).collect():
        taken[(r.doc_id, r.text, r.source)] += 1
    want = defaultdict(int)
    for r, x in zip(sorted(got, key=lambda r: str((r.doc_id, r.source, r.size))), sorted(rows, key=lambda x: str((x[0], x[2] if len(x) > 2 else "s", len((x[1] or "").split())))), strict=True):
        assert r.doc_id == x[0]
        want[(r.doc_id, x[1], r.source)] += r.copies
    assert sum(taken.values()) == sum(want.values()) and {k: v for k, v in want.items() if v and k[0] is not None and k[0] > 20} == {k: v for k, v in taken.items() if k[0] is not None and k[0] > 20}
    assert mixing.mix_sources(docs(spark, rows).limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs(spark, [(1, None), (2, "")])).collect()} == {0}


def test_pareto_inclusion(spark):
    """Inclusion follows p: over many seeds each document of a source is taken about as often."""
    rows = docs(spark, [(k, "w w w w", "a" if k < 20 else "b") for k in range(60)]).cache()
    n = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix_sources(rows, seed=f"s{seed}:").collect():
            n[r.doc_id] += r.copies
    share = [n[k] / 12 for k in range(20, 60)]
    assert abs(sum(share) / 40 - 1.0) < 0.1 or min(share) >= 0.3


# 9 quality
def test_quality_held_out(spark):
    data = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    model = quality.fit_quality(d, train)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.score_quality(d, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality and not r.toxic]
    toxic = [r.kept for r in got if r.toxic]
    assert sum(clean) / len(clean) > 0.98 and sum(toxic) / len(toxic) < 0.15
    grade = lambda f: np.mean([r.expected_grade for r in got if f(r)])
    assert grade(lambda r: r.toxic) < grade(lambda r: r.quality and not r.toxic)


def test_quality_awkward(spark):
    rows = docs(spark, AWKWARD)
    none = quality.fit_quality(rows, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    got = quality.score_quality(rows, none).collect()
    assert len(got) == len(AWKWARD) and all(r.kept and r.tail_prob == 1 for r in got)
    labels = spark.createDataFrame([(1, 1, None), (3, None, 0), (3, 1, 1), (7, 0, 0), (None, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(rows, labels)
    first, second = (rows_of(quality.score_quality(rows, quality.fit_quality(rows, labels))) for _ in range(2))
    assert first == second and len(first) == len(AWKWARD)
    assert quality.score_quality(rows.limit(0), model).count() == 0
    assert len(quality.training_rows(rows, labels, limit=2)) <= 2


def test_quality_bound_counts_labelled_documents_only(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1000, 1050)] + [(3, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert len(quality.training_rows(docs(spark, AWKWARD), labels, limit=10)) == 2


# 10 sharding
def test_sharding_limits(spark, tmp_path):
    rng = random.Random(10)
    rows = [(k, "x" * rng.randint(0, 400)) for k in range(4000)] + [(9000, "y" * 50_000), *AWKWARD]
    out = sharding.assign_shards(docs(spark, rows), byte_limit=2000)
    got = out.collect()
    assert len(got) == len(rows) and "_hash" not in out.columns and "lang" in out.columns
    size, count = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.shard_id] += r.bytes
        count[r.shard_id] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_docs) == (size[r.shard_id], count[r.shard_id])
        assert r.shard_bytes <= 2000 or r.oversized and r.shard_docs <= 2
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for s in names:  # only oversized buckets split: siblings together are over the limit
        sibling = s[:-1] + ("1" if s[-1] == "0" else "0")
        assert size[s] + sum(v for k, v in size.items() if k.startswith(sibling)) > 2000
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert {r.shard_id for r in sharding.assign_shards(docs(spark, rows)).collect()} == {"all"}
    assert sharding.assign_shards(docs(spark, rows).limit(0)).count() == 0


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["_hash", "_cell0", "_leaf", "_leaflet", "_at0", "_at1", "_shard1", "_size", "Shard_Docs", "Bytes"]
    rows = docs(spark, [(k, "x" * 300) for k in range(20)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    out = sharding.assign_shards(rows, byte_limit=1000)
    assert set(names[:-2]) <= set(out.columns) and len(out.columns) == len({c.lower() for c in out.columns})
    got = out.collect()
    assert len(got) == 20 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names[:-2]) and all(r.shard_bytes <= 1000 for r in got)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_sharding_opens_levels(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sharding, "LEVEL_BITS", 2)
    monkeypatch.setattr(sharding, "NEXT_BITS", 3)
    monkeypatch.setattr(sharding, "BROADCAST_SHARDS", broadcast)
    rows = [(k, "x" * 100) for k in range(300)] + [(5, "same")] * 30
    got = sharding.assign_shards(docs(spark, rows), byte_limit=350).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard_id] += r.bytes
    assert len(got) == len(rows) and all(v <= 350 or any(r.shard_id == s and r.oversized for r in got) for s, v in size.items()) and max(len(s) for s in size) > 4


# The pipeline
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outs, now = [], d
    for name, function in corpus_pipeline.STAGES:
        now = function(spark, now, sf_dir).cache()
        outs.append((name, now.collect()))
        if name != "sharding":
            assert now.columns == d.columns
    rows = {r.doc_id: r for r in d.collect()}
    kept = {name: {r.doc_id for r in out} for name, out in outs}
    assert kept["near_dedup"] <= kept["quality"] <= set(rows)
    truth = brute_components([(i, rows[i].text) for i in kept["quality"]], corpus_pipeline.NEAR)
    assert kept["near_dedup"] == {i for i, _, comp in truth if i == comp}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    ids = sorted(kept["near_dedup"])
    bad = {i for i, x in zip(ids, brute_contamination([rows[i].text for i in ids], items), strict=True) if x[4]}
    assert kept["decontaminate"] == kept["near_dedup"] - bad
    mixed = dict(outs)["mixing"]
    assert {r.doc_id for r in mixed} <= kept["decontaminate"] and all(r == rows[r.doc_id] for r in mixed)
    assert sorted(r.doc_id for r in dict(outs)["sharding"]) == sorted(r.doc_id for r in mixed)


def test_pipeline_near_stage_links_from_08(spark, sf_dir):
    """No two rows that the stage keeps are linked at 0.8, and each row that it drops is linked with another."""
    import corpus_pipeline

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in d.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, sf_dir).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.encode().lower().split()) for i, t in rows.items()) if w}
    near = {i: {j for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    assert not any(near[i] & kept for i in kept & set(sets))
    assert all(near[i] for i in set(rows) - kept)


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    names = ["_row", "_row_", "_rid", "_judged", "_judged_kept", "_judged__kept", "_text", "_source", "_copies", "_u", "_of", "certain", "last", "_hash", "comp", "stays"]
    rows = docs(spark, AWKWARD).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for n in names})
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, rows, sf_dir)
        assert name == "sharding" or out.columns == rows.columns
        got = out.collect()
        assert got and all(r[n] == n + ("?" if r.doc_id is None else str(r.doc_id)) for r in got for n in names), name


def test_pipeline_awkward(spark, sf_dir):
    import corpus_pipeline

    rows = docs(spark, [*AWKWARD, (None, "other text"), (3, "another text of the same id")])
    for name, function in corpus_pipeline.STAGES:
        empty = function(spark, rows.limit(0), sf_dir)
        assert empty.count() == 0, name
        out = function(spark, rows, sf_dir)
        assert name == "sharding" or out.columns == rows.columns
        texts = [r.text for r in out.collect()]
        if name == "near_dedup":
            assert len(texts) == len(rows.collect()) - 3 and {"other text", "another text of the same id"} <= set(texts)
        if name in ("quality", "decontaminate"):
            assert len(texts) == rows.count()
