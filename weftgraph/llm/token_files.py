"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds the ids of neighbouring documents in ascending order of doc_id, each document closed by ``END_ID``:

    magic | ids, 2 or 4 bytes each, little-endian | boundaries | doc ids | footer

Boundaries (where each document ends, counted in ids) and doc ids (less the file's first) are non-decreasing, so both
are Elias-Fano sequences: of n values below u, l = floor(log2(u / n)) low bits each lie side by side, and the high
parts are unary in a bit string, a one at place (value >> l) + k for the k-th value. That is l + 2 bits a value, where
a table of offsets has 64. Select: the 32-bit places of every ``SAMPLE``-th one; a reader goes from there to the next
and finds the k-th value without what lies before. The footer of fixed size says where everything is.

Writing. Texts are range-partitioned by doc_id (then by a hash and a number, so that repeated ids may spread over
files), sorted within partitions, and a task appends ids as they come to files of at most ``FILE_BYTES`` of ids (or one
document). A task holds the boundaries and doc ids of one file, never its ids. Files are named by partition and attempt
and count only once Spark has committed the task's rows of the manifest (Parquet), so lost executors, retries and
speculation leave at most files that nothing refers to. Where a file's ids start among all is a running sum over the
manifest, one row a file. The folder is any that Arrow's file systems reach.

Reading. Each file is read by one task, ``SAMPLE`` documents at a time, through the select structures.

Encoding. Byte-level vocabularies split a text before white space and behind words, whatever lies around, so a text is
cut there and each distinct piece is encoded once by the tokenizers library. Texts are cut at spaces, and their pieces
numbered, a batch at a time by Arrow; distinct pieces are looked up in a bounded table; and NumPy puts the ids together.
``Encoder`` states why this gives the ids of the whole text, and tests hold it against encoding whole texts. With
other vocabularies whole texts are encoded as they are.

Rows: null text counts as empty (its one id is the end id); null ids come last; repeated ids and rows are documents of
their own, equal ids by their texts; an empty table gives no file and an empty result; other input columns, whatever
their names, are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, filesystem_of, new_path, one_task_each, stage

END_ID = 0
FILE_BYTES = 64 << 20  # of ids
FILE_DOCS = 1 << 22
SAMPLE = 256  # ones from one select sample to the next
MAGIC = b"WEFTIDS1"
#: Footer: ids, documents, documents without an id, first doc id, bytes of an id; then of boundaries and doc ids the
#: count, universe, low bits, and places of low bits, high bits, samples and end.
_FOOTER = struct.Struct("<QQQqQ" + "QQQQQQQ" * 2)
VOCABULARY_BYTES = 64 << 20  # of a tokenizer's file, which goes to the executors
PIECES, PIECE_CHARS = 400_000, 40  # pieces of either kind that a worker keeps in a table, and their length at most
BATCH_BYTES = 8 << 20  # of texts that are encoded at once
JOINED = 256  # new pieces that are encoded as one text

MARKS = ".,;:!?"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed values: white space as Unicode has it
#: White space and what follows it, up to the next white space, or to the end of a Latin word before white space or a mark.
_PIECE = re.compile(rf"[{_SPACE}]*(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]++(?=[{MARKS}{_SPACE}]|\Z)|[^{_SPACE}]+)|[{_SPACE}]+\Z")
_JOINS = re.compile(rf"[{_SPACE}].*[^{_SPACE}]\Z", re.DOTALL)


# Elias-Fano.


def pack_sequence(values: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """Universe, low bits, and the sections (low bits, high bits, samples) of non-decreasing uint64 ``values``."""
    n = len(values)
    universe = int(values[-1]) + 1 if n else 0
    width = max(0, (universe // n).bit_length() - 1) if n else 0
    low = bytearray()
    shifts = np.arange(width, dtype=np.uint64)
    for at in range(0, n if width else 0, 1 << 16):  # a multiple of 8 values fills whole bytes
        bits = (values[at : at + (1 << 16), None] >> shifts) & np.uint64(1)
        low += np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(places[-1]) >> 3) + 1 if n else 0, np.uint8)
    np.bitwise_or.at(high, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    return universe, width, bytes(low), high.tobytes(), places[::SAMPLE].astype("<u4").tobytes()


@dataclass
class Sequence:
    """A packed sequence in a file: ``read(start, end)`` gives its bytes."""

    read: Callable[[int, int], bytes]
    count: int
    universe: int
    width: int
    low: int
    high: int
    samples: int
    end: int

    def block(self, k: int) -> np.ndarray:
        """The values k * SAMPLE and on, SAMPLE of them at most: select by two samples, then the ones between."""
        first, last = k * SAMPLE, min(self.count, (k + 1) * SAMPLE)
        found = np.frombuffer(self.read(self.samples + 4 * k, min(self.samples + 4 * (k + 2), self.end)), "<u4")
        start = int(found[0])
        stop = int(found[1]) if len(found) > 1 else 8 * (self.samples - self.high)
        bits = np.unpackbits(np.frombuffer(self.read(self.high + start // 8, self.high + (stop + 7) // 8), np.uint8), bitorder="little")
        places = np.flatnonzero(bits[start % 8 :])[: last - first] + start
        values = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            begin = first * self.width // 8  # whole, as SAMPLE is a multiple of 8
            data = np.frombuffer(self.read(self.low + begin, self.low + (last * self.width + 7) // 8), np.uint8)
            low = np.unpackbits(data, bitorder="little")[: (last - first) * self.width].reshape(-1, self.width).astype(np.uint64)
            values |= (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values

    def select(self, k: int) -> int:
        return int(self.block(k // SAMPLE)[k % SAMPLE])


class TokenFile:
    """A file of token ids, read by ranges."""

    def __init__(self, handle: pa.NativeFile):
        self.handle = handle
        size = handle.size()
        if size < len(MAGIC) + _FOOTER.size or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("no file of token ids")
        head = _FOOTER.unpack(self._read(size - _FOOTER.size, size))
        self.ids, self.docs, self.nameless, self.first, self.width = head[:5]
        self.ends, self.names = Sequence(self._read, *head[5:12]), Sequence(self._read, *head[12:])

    def _read(self, start: int, end: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(end - start)

    def blocks(self) -> int:
        return -(-self.docs // SAMPLE)

    def bounds(self, k: int) -> np.ndarray:
        """Where the documents of block k start, and where the last one ends."""
        ends = self.ends.block(k).astype(np.int64)
        return np.r_[self.ends.select(k * SAMPLE - 1) if k else 0, ends]

    def doc_ids(self, k: int) -> list[int | None]:
        """Of the documents of block k; the last of a file may have none."""
        named = min(self.docs, (k + 1) * SAMPLE) - k * SAMPLE
        with_id = max(0, min(named, self.docs - self.nameless - k * SAMPLE))
        found = [int(x) + self.first for x in self.names.block(k)] if with_id else []
        return found + [None] * (named - with_id)

    def token_ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end, as unsigned 32-bit integers."""
        data = self._read(len(MAGIC) + start * self.width, len(MAGIC) + end * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.token_ids(self.ends.select(k - 1) if k else 0, self.ends.select(k))


class _Writer:
    """Appends documents to a file; boundaries and doc ids go behind the ids."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, width: int):
        self.stream, self.width, self.path = fs.open_output_stream(path), width, path
        self.stream.write(MAGIC)
        self.at, self.ids, self.ends, self.names, self.nameless = len(MAGIC), 0, [], [], 0

    def add(self, name: int | None, ids: bytes) -> None:
        self._put(ids)
        self.ids += len(ids) // self.width
        self.ends.append(self.ids)
        if name is None:
            self.nameless += 1
        else:
            self.names.append(name)

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> tuple[int, int]:
        """Documents and ids."""
        first = self.names[0] if self.names else 0
        footer = [self.ids, len(self.ends), self.nameless, first, self.width]
        names = np.array([x - first for x in self.names], np.uint64)
        for values in (np.array(self.ends, np.uint64), names):
            universe, width, *sections = pack_sequence(values)
            footer += [len(values), universe, width, *(self._put(x) for x in sections), self.at]
        self._put(_FOOTER.pack(*footer))
        self.stream.close()
        return len(self.ends), self.ids


# Encoding.


def splits_at_spaces(vocabulary: dict) -> bool:
    """Whether a tokenizer of the file's text cuts texts as ``encode_texts`` needs: byte level with its own pattern, nothing before it, and no special token with white space or marks."""
    pre = vocabulary.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    tokens = vocabulary.get("added_tokens") or []
    easy = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(rf"[{MARKS}{_SPACE}]", t["content"])) for t in tokens)
    return bool(plain and easy and not vocabulary.get("normalizer") and not vocabulary.get("truncation") and not vocabulary.get("padding"))


def _ends_in_space(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which UTF-8 strings, whose bytes in ``data`` end before ``ends``, are empty or end in white space."""
    last, before, third = (np.where(sizes >= k, data[np.maximum(ends - k, 0)], 0) for k in (1, 2, 3))
    short = (last >= 9) & (last <= 13) | (last == 32) | (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    two = (third == 0xE2) & (before == 0x80) & ((last >= 0x80) & (last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    wide = (third == 0xE1) & (before == 0x9A) & (last == 0x80) | (third == 0xE2) & (before == 0x81) & (last == 0x9F) | (third == 0xE3) & (before == 0x80) & (last == 0x80)
    return (sizes == 0) | short | two | wide


class Encoder:
    """Texts to ids as bytes, ``END_ID`` behind each.

    The byte-level pattern has no match that goes on from other characters to white space, so one starts with each run of
    white space; and a run of letters is one match that ends before a mark. What lies before a cut never changes the
    matches behind it, and no match before it looks over it: only white space at the end of a match looks ahead, and
    what is before a cut ends with other characters. Merges never cross matches, and a special token holds neither white
    space nor such a mark. A space behind white space is no cut: texts that have one are cut by ``_PIECE`` alone.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(names.values(), default=0) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.by_pieces = splits_at_spaces(json.loads(vocabulary))
        self.lengths = np.zeros(max(names.values(), default=0) + 1, np.int64)  # bytes that an id stands for, at the byte level
        self.lengths[list(names.values())] = [len(x) for x in names]
        self.end = END_ID.to_bytes(self.width, "little")
        self.parts: dict[str, bytes] = {}  # of _PIECE
        self.words: dict[str, bytes] = {}  # what follows a space, up to the next, without it
        self.older: dict[str, bytes] = {}  # words before these; one that comes again is taken over

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _side_by_side(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that start with white space and end without: encoded as few texts, and parted by their lengths in bytes."""
        out = []
        groups = [parts[at : at + JOINED] for at in range(0, len(parts), JOINED)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            upto = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(upto, np.cumsum([len(x) if x.isascii() else len(x.encode("utf-8")) for x in some]), "left") + 1
            data, stops = ids.astype(self.kind).tobytes(), (cuts * self.width).tolist()
            out += [data[x:y] for x, y in zip([0, *stops], stops, strict=False)]
        return out

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts of _PIECE."""
        fits = [_JOINS.match(x) is not None for x in parts]
        side, alone = ([x for x, ok in zip(parts, fits, strict=True) if ok is wanted] for wanted in (True, False))
        self.parts.update(zip(side, self._side_by_side(side), strict=True))
        self.parts.update(zip(alone, self.encode_whole(alone), strict=True))

    def _new_words(self, words: list[str]) -> list[bytes]:
        """The ids of new words, each with its space in front. A word of letters is one part, and so is what a Latin one's mark follows."""
        heads = [x if x.isalpha() else x[:-1] if x[-1:] in MARKS and x[:-1].isalpha() and max(x) <= "\u00ff" else None for x in words]
        new = list({x for x in heads if x is not None and x not in self.words})
        own = dict(zip(new, self._side_by_side([" " + x for x in new]), strict=True))
        other = [k for k, x in enumerate(heads) if x is None]
        rest = dict(zip(other, self._by_parts([" " + words[k] for k in other]), strict=True))
        out = [own.get(x) or self.words.get(x) for x in heads]
        for k in other:
            out[k] = rest[k]
        marked = [k for k, (word, x) in enumerate(zip(words, heads, strict=True)) if x is not None and len(x) < len(word)]
        self.words.update((heads[k], out[k]) for k in marked if len(words[k]) < PIECE_CHARS)
        ends = {x: self.encode_whole([x])[0] for x in MARKS}
        for k in marked:
            out[k] += ends[words[k][-1]]
        return out

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        cut = [_PIECE.findall(t) for t in texts]
        new = list(set().union(*cut) - self.parts.keys())
        self._learn(new)
        find = self.parts.__getitem__
        out = [b"".join(map(find, pieces)) for pieces in cut]
        for x in new:
            if len(x) > PIECE_CHARS:
                del self.parts[x]
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, column: pa.StringArray) -> list[bytes]:
        """The ids of whole texts, none of which is null."""
        if not self.by_pieces:
            return [x + self.end for x in self.encode_whole(column.to_pylist())]
        if len(self.parts) > PIECES:
            self.parts.clear()
        if len(self.words) > PIECES:
            self.older, self.words = self.words, {}
        cut = pc.split_pattern(pc.cast(column, pa.large_string()), " ")
        flat, at = cut.values, cut.offsets.to_numpy()
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2] or b"\0", np.uint8)
        bad = _ends_in_space(data, ends[1:], np.diff(ends))
        bad[at[1:] - 1] = False  # the last piece ends with its text
        counted = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        odd = counted[at[1:]] > counted[at[:-1]]
        del bad, counted, ends

        coded = flat.dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()  # of 32 bits, as all numbers of a batch are
        # Not all words are needed: those of odd texts, and the first of each text, which has no space in front.
        wanted = np.ones(len(flat), bool)
        wanted[at[:-1]] = False
        wanted &= ~np.repeat(odd, np.diff(at))
        used = np.flatnonzero(np.bincount(index[wanted], minlength=len(words)))
        own = [words[k] for k in used.tolist()]
        found = list(map(self.words.get, own))
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(missing, map(self.older.get, [own[k] for k in missing]), strict=True):
            found[k] = ids
        fresh = [k for k in missing if found[k] is None]
        for k, ids in zip(fresh, self._new_words([own[k] for k in fresh]), strict=True):
            found[k] = ids
        self.words.update((own[k], found[k]) for k in missing if len(own[k]) < PIECE_CHARS)
        firsts = self._by_parts([words[k] for k in index[at[:-1]].tolist()])
        whole = dict(zip(np.flatnonzero(odd).tolist(), self._by_parts([column[int(k)].as_py() for k in np.flatnonzero(odd)]), strict=True))

        # Entries: the used words, then the texts' first pieces, then the end.
        place = np.zeros(len(words), np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        entry = place[index]
        entry[at[:-1]] = len(used) + np.arange(len(column), dtype=np.int32)
        table = [*found, *firsts, self.end]
        sizes = np.fromiter(map(len, table), np.int32, len(table)) // self.width
        ids, starts = np.frombuffer(b"".join(table), self.kind), np.cumsum(sizes, dtype=np.int32) - sizes
        entry = np.insert(entry[~np.repeat(odd, np.diff(at))], np.cumsum(np.diff(at)[~odd]), len(table) - 1)
        lengths = sizes[entry]
        upto = np.cumsum(lengths, dtype=np.int32)
        places = np.repeat(starts[entry] - upto + lengths, lengths)
        places += np.arange(len(places), dtype=np.int32)
        out = ids[places].tobytes()
        stops = (upto[entry == len(table) - 1].astype(np.int64) * self.width).tolist()
        plain = iter([out[x:y] for x, y in zip([0, *stops], stops, strict=False)])
        return [whole[k] + self.end if is_odd else next(plain) for k, is_odd in enumerate(odd.tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """One encoder a worker, with the pieces that earlier tasks have met."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Tables.

MANIFEST = "part bigint, file string, docs bigint, ids bigint"


@dataclass
class TokenFiles:
    spark: SparkSession
    path: str

    def manifest(self) -> DataFrame:
        """(file, docs, ids, start): the files in order, and how many ids lie before each."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
        return rows.withColumn("start", F.coalesce(before, F.lit(0)))

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every document, from the files."""
        folder = f"{self.path}/ids"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = filesystem_of(folder)
            for b in batches:
                for name, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with fs.open_input_file(f"{root}/{name}") as handle:
                        file = TokenFile(handle)
                        for k in range(file.blocks()):
                            yield from _documents(file, k, before)

        files = one_task_each(self.manifest().select("file", "start"))
        return arrow_map(files, run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


BATCH_IDS = 1 << 22  # of a batch of documents that are read back, but for one document


def _documents(file: TokenFile, k: int, before: int) -> Iterator[pa.RecordBatch]:
    at, names = file.bounds(k), file.doc_ids(k)
    first = 0
    while first < len(names):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BATCH_IDS, "right")) - 1)
        data = file.token_ids(int(at[first]), int(at[last])).tobytes()
        bounds = at[first : last + 1]
        ids = [data[4 * (x - at[first]) : 4 * (y - at[first])] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [pa.array(names[first:last], pa.int64()), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.array(ids, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
        first = last


def _gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in batches of about ``most`` bytes of text, or one row: the more words, the more of them repeat."""
    held, size = [], 0
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)) if b.num_rows else ()
        at, before = 0, 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, before + most - size, "right")))
            held.append(b.slice(at, upto - at))
            size += int(sizes[upto - 1]) - before
            at, before = upto, int(sizes[upto - 1])
            if size >= most or at < b.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, vocabulary: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode the texts with the tokenizer of the file ``vocabulary`` and write them below ``path``, a new folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        text = f.read(VOCABULARY_BYTES + 1)
    if len(text) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send to the executors")
    sent, folder = spark.sparkContext.broadcast(text), f"{path}/ids"
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, (fs, root), task = encoder_of(sent.value), filesystem_of(folder), TaskContext.get()
        writer, done, number = None, [], task.partitionId() << 32
        for part in _gathered(batches):
            for name, ids in zip(part.column(0).to_pylist(), encoder.encode_column(part.column(1)), strict=True):
                if writer and (writer.ids * encoder.width + len(ids) > FILE_BYTES or len(writer.ends) == FILE_DOCS):
                    done.append((number, writer.path.rsplit("/", 1)[1], *writer.close()))
                    writer, number = None, number + 1
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = _Writer(fs, f"{root}/ids-{number:016x}-{task.taskAttemptId()}.bin", encoder.width)
                writer.add(name, ids)
        if writer:
            done.append((number, writer.path.rsplit("/", 1)[1], *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2], "row").select("doc_id", "text")
    arrow_map(rows, run, MANIFEST).write.parquet(f"{path}/manifest")
    return TokenFiles(spark, path)
