"""WARC archives and a two-level capture index.

Writing. Every page becomes one WARC/1.1 record, built by DataFrame functions and written by Spark's text
sink, so any file system that Spark can write holds the archives. Of records with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the largest id keeps the payload; the others become revisits
that carry its HTTP head alone. An archive holds at most ``ARCHIVE_BYTES`` bytes, or one record: pages are
written by classes of size, each with so many records a file as fit at the class's largest size.

Index. One sequential scan of the archives gives the captures. First level: captures sorted by reversed-host
URL key in compressed blocks of ``BLOCK_LINES`` lines. Second level: a sparse directory, one line a block.

Reading. Keys find their blocks by binary search in the directory, their captures by binary search in the
unpacked block. Captures are grouped by archive; a task opens its archive, seeks, and reads the wanted ranges, near
ones together (through Arrow's file systems). The directory is sent to the executors up to ``DIRECTORY_LIMIT`` lines and ``DIRECTORY_BYTES``;
beyond, blocks are unpacked and joined by key. Only what the index leads to is read.

Rows: null html counts as empty, a null url is written as ``urn:none:``; ids may be null, and rows that
repeat the largest id of a group of copies are all responses; an empty table gives archives without
records; other input columns are ignored; a page of any length that a row can hold is one record.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import MOST_TASKS, arrow_map, filesystem_of, new_path, stage

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
CLASS_BYTES = (64 << 10, 1 << 20, 16 << 20)  # a record's largest size in each class; in the last class, every record has an archive of its own
HEAD_BYTES = 1024  # of a record without its url and payload, at most
BLOCK_LINES = 1000
DIRECTORY_LIMIT, DIRECTORY_BYTES = 200_000, 64 << 20  # of the directory that may be held in memory
GAP_BYTES, SPAN_BYTES = 64 << 10, 8 << 20  # records so near to each other are read at once, up to so many bytes
BROADCAST_GROUPS = 100_000  # groups of copies, of some 70 bytes each, that may be broadcast; beyond, pages are shuffled to them
WARC_DATE = "2000-01-01T00:00:00Z"  # pages carry no time of their own

CAPTURE = (
    "url_key string, archive string, offset bigint, length bigint, page_id bigint, url string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, intact boolean"
)
_CAPTURE = pa.schema([
    ("url_key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
])


def url_key(url: str) -> str:
    """Reversed host, then port, path and query: 'http://a.b.org:80/x?y' gives 'org,b,a)/x?y'."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url
    port = "" if port in (None, 80, 443) else f":{port}"
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def target_uri(url: Column) -> Column:
    """As a record's header has it."""
    return F.regexp_replace(F.coalesce(url, F.lit("urn:none:")), r"[\x00-\x1F\x7F]", "%20")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the records of ``pages`` (page_id, url, html) as files under ``path``, a folder for each class of sizes."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), target_uri(F.col("url")).alias("url"), html.alias("html"), F.octet_length(html).alias("bytes"))
    size = F.octet_length("url") + F.col("bytes") + HEAD_BYTES
    rows = rows.withColumn("class", sum((size > x).cast("int") for x in CLASS_BYTES))
    classes = sorted(r[0] for r in rows.select("class").distinct().collect()) or [0]  # of four
    copies = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy(F.sha1("html").alias("digest")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stage(copies.where("n > 1").drop("n"), "payload-groups")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_GROUPS else copies
    for k in classes:
        part = rows.where(F.col("class") == k).withColumn("digest", F.sha1("html")).join(copies, "digest", "left")
        most = max(1, ARCHIVE_BYTES // CLASS_BYTES[k]) if k < len(CLASS_BYTES) else 1
        part.select(_record().alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", most).text(f"{path}/class={k}")


def _record() -> Column:
    """A record but for its last byte, which is the sink's line end."""
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    profile = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), page("first"), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), page("page_id"), F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\n"),
        F.when(revisit, profile).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string"), F.lit("\r\n\r\n"),
        head, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n\r"),
    )


def _id(value: str | None) -> int | None:
    found = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def record_at(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Header fields (lower-case names), start of the block and end of the record that starts at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    end = body + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has a wrong length")
    return fields, body, end + 4


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that starts at ``at``."""
    fields, body, end = record_at(data, at)
    return fields, data[body : end - 4], end


def capture(archive: str, record: bytes, offset: int) -> tuple:
    """A row of CAPTURE for a record. ``intact``: the payload has the digest that the header says."""
    fields, block, end = parse_record(record)
    head, _, payload = block.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, intact = said, not payload
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        intact = digest == said
    url = fields.get("warc-target-uri", "")
    refers = _id(fields.get("warc-refers-to")) if fields["warc-type"] == "revisit" else None
    return url_key(url), archive, offset, end, _id(fields.get("warc-record-id")), url, fields["warc-type"], size, digest, refers, intact


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), "content")


LINE = "url_key string, archive string, offset bigint, length bigint, page_id bigint"
_LINE = pa.schema([("url_key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Where every record of the archives under ``path`` lies, by one sequential scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1), strict=True):
                name, data, rows, at = archive.as_py(), content.as_py(), [], 0
                while at < len(data):
                    fields, _, end = record_at(data, at)
                    rows.append((url_key(fields.get("warc-target-uri", "")), name, at, end - at, _id(fields.get("warc-record-id"))))
                    at = end
                if rows:
                    yield _batch(rows, _LINE)

    return arrow_map(_archives(spark, path), run, LINE)


def spans(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges) of one read each: sorted ranges (offset, length) that lie within ``GAP_BYTES`` of each other, up to ``SPAN_BYTES`` or one range."""
    held: list[tuple[int, int]] = []
    for offset, length in ranges:
        if held and (offset - sum(held[-1]) > GAP_BYTES or offset + length - held[0][0] > SPAN_BYTES):
            yield held[0][0], max(map(sum, held)), held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], max(map(sum, held)), held


def records(handle: pa.NativeFile, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the sorted ranges of an open archive: seeks, and reads what is asked for."""
    for start, end, held in spans(ranges):
        handle.seek(start)
        data = handle.read(end - start)
        for offset, length in held:
            yield offset, data[offset - start : offset - start + length]


def read_ranges(spark: SparkSession, path: str, captures: DataFrame) -> DataFrame:
    """The records at the captures' ranges, as rows of CAPTURE.

    What is shuffled are ranges, 24 bytes and a path each: those of an archive meet in one task, which opens it and reads
    them in their order. An archive is bounded, so a task's work is.
    """
    captures = stage(captures.select("archive", "offset", "length").distinct(), "captures")
    archives = captures.select("archive").distinct().count()
    # As many partitions as archives: the few bytes of a range stand for a record.
    rows = captures.repartition(max(1, min(archives, MOST_TASKS)), "archive").sortWithinPartitions("archive", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_archive(name: str, ranges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            fs, at = filesystem_of(name)
            with fs.open_input_file(at) as handle:
                found = []
                for offset, record in records(handle, ranges):
                    found.append(capture(name, record, offset))
                    if len(found) == BLOCK_LINES:
                        yield _batch(found, _CAPTURE)
                        found = []
                if found:
                    yield _batch(found, _CAPTURE)

        held: list[tuple[int, int]] = []
        name = None
        for b in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name and held:
                    yield from of_archive(name, held)
                    held = []
                name = archive
                held.append((offset, length))
        if held:
            yield from of_archive(name, held)

    return arrow_map(rows, run, CAPTURE)


BLOCK = "block bigint, first_key string, last_key string, lines int, data binary"
_BLOCK = pa.schema([("block", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int32()), ("data", pa.binary())])
DIRECTORY = "block bigint, first_key string, last_key string, lines int, file string"


@dataclass
class CaptureIndex:
    spark: SparkSession
    path: str
    archives: str

    @classmethod
    def build(cls, spark: SparkSession, archives: str, path: str | None = None) -> CaptureIndex:
        """Scan the archives, sort the captures by key over all partitions, and pack them."""
        path = path or new_path(spark, "capture-index")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held: list[str] = []
            number = TaskContext.get().partitionId() << 32  # blocks are numbered within their task

            def block() -> pa.RecordBatch:
                nonlocal number
                number += 1
                first, last = held[0].split("\t", 1)[0], held[-1].split("\t", 1)[0]
                return _batch([(number, first, last, len(held), zlib.compress("\n".join(held).encode("utf-8"), 6))], _BLOCK)

            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append("\t".join("" if x is None else str(x) for x in row))
                    if len(held) == BLOCK_LINES:
                        yield block()
                        held.clear()
            if held:
                yield block()

        lines = stage(scan_archives(spark, archives), "capture-lines")  # the sort by ranges reads them twice
        # Offsets and archives part equal keys, so a much captured page spreads over partitions.
        lines = lines.repartitionByRange("url_key", "archive", "offset").sortWithinPartitions("url_key", "archive", "offset")
        arrow_map(lines, pack, BLOCK).write.parquet(f"{path}/blocks")
        index = cls(spark, path, archives)
        index.blocks().select("block", "first_key", "last_key", "lines", F.col("_metadata.file_name").alias("file")).write.parquet(f"{path}/directory")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks")

    def directory(self) -> DataFrame:
        return self.spark.read.schema(DIRECTORY).parquet(f"{self.path}/directory")

    def captures(self) -> DataFrame:
        """All lines of the index, unpacked."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0):
                    yield _batch([_line(x) for x in zlib.decompress(data.as_py()).decode("utf-8").split("\n")], _LINE)

        return arrow_map(self.blocks().select("data"), unpack, LINE)

    def find(self, urls: DataFrame) -> DataFrame:
        """The captures, as lines of the index, of the URLs in ``urls`` (url)."""
        schema = pa.schema([("url_key", pa.string())])

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in b.column(0).to_pylist()], pa.string())], schema=schema)

        keys = arrow_map(urls.select(target_uri(F.col("url")).alias("url")), keyed, "url_key string").distinct()
        lines, size = self.directory().agg(F.count(F.lit(1)), F.sum(F.octet_length("first_key") + F.octet_length("last_key"))).first()
        if lines > DIRECTORY_LIMIT or (size or 0) > DIRECTORY_BYTES:
            return self.captures().join(keys, "url_key", "left_semi")
        entries = sorted(map(tuple, self.directory().select("last_key", "first_key", "block").collect()))
        sent = self.spark.sparkContext.broadcast(entries)
        placed_schema = pa.schema([("block", pa.int64()), ("url_key", pa.string())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries = sent.value
            for b in batches:
                rows = []
                for key in b.column(0).to_pylist():
                    for last, first, block in entries[bisect.bisect_left(entries, (key,)) :]:  # the first block that ends at the key or later
                        if first > key:
                            break
                        rows.append((block, key))
                if rows:
                    yield _batch(rows, placed_schema)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data, wanted in zip(*b.columns, strict=True):
                    lines = zlib.decompress(data.as_py()).decode("utf-8").split("\n")
                    if rows := [x for key in wanted.as_py() for x in _of_key(lines, key)]:
                        yield _batch(rows, _LINE)

        # A block has at most BLOCK_LINES keys.
        placed = arrow_map(keys, place, "block bigint, url_key string").groupBy("block").agg(F.sort_array(F.collect_list("url_key")).alias("wanted"))
        return arrow_map(self.blocks().select("block", "data").join(placed, "block").select("data", "wanted"), search, LINE)

    def read(self, urls: DataFrame) -> DataFrame:
        """The records of the URLs in ``urls`` (url), each once, as rows of CAPTURE."""
        return read_ranges(self.spark, self.archives, self.find(urls))

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Header fields and block of every record of a URL, by two binary searches and range reads."""
        key = url_key(re.sub(r"[\x00-\x1f\x7f]", "%20", url))
        directory = self.directory().where((F.col("first_key") <= key) & (F.col("last_key") >= key))
        entries = sorted(directory.select("last_key", "first_key", "file").collect())
        found = []
        for last, first, file in entries[bisect.bisect_left(entries, (key,)) :]:
            if first > key:
                break
            at = self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks/{file}").where((F.col("first_key") == first) & (F.col("last_key") == last))
            for (data,) in at.select("data").collect():
                found += _of_key(zlib.decompress(data).decode("utf-8").split("\n"), key)
        return [parse_record(self._range(archive, offset, length))[:2] for _, archive, offset, length, _ in sorted(set(found))]

    def _range(self, archive: str, offset: int, length: int) -> bytes:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(archive)
        stream = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()


def _line(line: str) -> tuple[str, str, int, int, int | None]:
    key, archive, offset, length, page = line.split("\t")
    return key, archive, int(offset), int(length), int(page) if page else None


def _of_key(lines: list[str], key: str) -> list[tuple]:
    """The lines of a key, by binary search in the sorted lines of a block."""
    low = high = bisect.bisect_left(lines, key + "\t")
    while high < len(lines) and lines[high].startswith(key + "\t"):
        high += 1
    return [_line(x) for x in lines[low:high]]


def archive_pages(pages: DataFrame, path: str | None = None) -> CaptureIndex:
    """Write archives and index them."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return CaptureIndex.build(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
