"""A streaming source of file events: what was created, changed and deleted below a folder.

    spark.dataSource.register(FileEvents)
    events = spark.readStream.format("file_events").option("root", "/src").option("state", "s3a://graphs/watch").load()

An offset is the number of a snapshot: the folder's files with their times and sizes, kept below ``state`` in ``PARTS`` tables
by a hash of the path. A batch is the difference of two snapshots, taken part by part on executors, so a part holds a share of the
files. A snapshot that equals the last one makes no new offset. Snapshots before the last committed one go; those of a
batch that is run again after a restart are still there, so no event is lost or changed.

Folders called as ``ignored`` names, and hidden ones, are never listed. Options: root, state, extensions (".py,.java"; all without),
ignored (names, comma-separated), initial ("true": the files that are there at the first start come as created).
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftgraph.sources.files import IGNORED_DIRS

PARTS = 16
SCHEMA = "path string, event string, ts timestamp"


def _filesystem(uri: str) -> tuple:
    """Arrow's file system of a path or URI as Spark has them, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif colon and scheme == "file":
        uri = "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def listing(root: str, extensions: tuple[str, ...], ignored: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """(path, time in nanoseconds, size) of the files below a folder, folder by folder; what is ignored is never listed."""
    from pyarrow import fs

    files, top = _filesystem(root)
    waiting = [top]
    while waiting:
        try:
            found = files.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True))
        except (FileNotFoundError, PermissionError):  # gone meanwhile, or not ours to read
            continue
        for x in found:
            if x.type == fs.FileType.Directory:
                if x.base_name not in ignored and not x.base_name.startswith("."):
                    waiting.append(x.path)
            elif not extensions or x.base_name.endswith(extensions):
                yield x.path, x.mtime_ns or 0, x.size or 0


class _Part(InputPartition):
    def __init__(self, state: str, before: int, after: int, number: int):
        self.state, self.before, self.after, self.number = state, before, after, number


def _read(state: str, snapshot: int, part: int) -> dict[str, list[int]]:
    if snapshot < 0:
        return {}
    files, top = _filesystem(state)
    with files.open_input_stream(f"{top}/{snapshot:09d}/{part}.json") as f:
        return json.loads(f.read())


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["root"], options["state"].rstrip("/")
        self.extensions = tuple(x.strip() for x in options.get("extensions", "").split(",") if x.strip())
        self.ignored = frozenset(x.strip() for x in options.get("ignored", ",".join(IGNORED_DIRS)).split(",") if x.strip())
        self.initial = options.get("initial", "false").lower() == "true"

    def _snapshots(self) -> list[int]:
        """Those that are whole: their mark is written last."""
        from pyarrow import fs

        files, top = _filesystem(self.state)
        found = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        names = [x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.isdigit()]
        return sorted(int(n) for n in names if files.get_file_info(f"{top}/{n}/done").type == fs.FileType.File)

    def _take(self) -> int:
        """The number of a snapshot of now: the last one's where nothing has changed."""
        parts: list[dict[str, list[int]]] = [{} for _ in range(PARTS)]
        for path, at, size in listing(self.root, self.extensions, self.ignored):
            parts[zlib.crc32(path.encode("utf-8", "surrogateescape")) % PARTS][path] = [at, size]
        have = self._snapshots()
        if have and all(_read(self.state, have[-1], k) == part for k, part in enumerate(parts)):
            return have[-1]
        number = have[-1] + 1 if have else 0
        files, top = _filesystem(self.state)
        files.create_dir(f"{top}/{number:09d}", recursive=True)
        stamp = str(time.time_ns())
        for name, data in [*((f"{k}.json", json.dumps(part)) for k, part in enumerate(parts)), ("at", stamp), ("done", "")]:
            with files.open_output_stream(f"{top}/{number:09d}/{name}") as f:
                f.write(data.encode())
        return number

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": -1 if self.initial else self._take()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"snapshot": self._take()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(self.state, start["snapshot"], end["snapshot"], k) for k in range(PARTS)] if start != end else []

    def read(self, partition: _Part) -> Iterator[tuple]:
        before, after = (_read(partition.state, x, partition.number) for x in (partition.before, partition.after))
        files, top = _filesystem(partition.state)
        with files.open_input_stream(f"{top}/{partition.after:09d}/at") as f:
            seen = int(f.read())
        when = lambda ns: datetime.fromtimestamp(ns / 1e9, UTC)
        for path, what in after.items():
            if before.get(path) != what:
                yield path, "modify" if path in before else "create", when(what[0] or seen)
        for path in before:
            if path not in after:
                yield path, "delete", when(seen)  # a deletion is seen, not dated

    def commit(self, end: dict) -> None:
        files, top = _filesystem(self.state)
        for old in self._snapshots():
            if old < end["snapshot"]:
                files.delete_dir(f"{top}/{old:09d}")


class FileEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        for needed in ("root", "state"):
            if needed not in self.options:
                raise ValueError(f"file_events needs the option {needed}")
        return _Reader(dict(self.options))
