"""Chat formatting: turns to text segments with loss flags, from a declarative template.

A finite-state machine over roles checks the order of turns. Each turn becomes three segments: the
role's mark, the escaped text and the end mark; only text of roles with ``loss`` is under the loss mask.
Inside texts every backslash and every control string of the template gets a backslash before it, which
``unescape`` takes away again, so that a mark in a text is never read as a mark.

Turns of a conversation meet in one task in order and are streamed: the task holds one turn at a time,
so memory does not grow with a conversation.

Rows: null text and null role count as empty; unknown roles get a mark that carries their name; equal
turn numbers are ordered by role and text; repeated rows are turns of their own; a null conversation id
is one conversation; a wrong order of turns is formatted all the same and reported in ``order_error``;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map

BATCH = 4096  # rows that a task holds back before it hands them on
BATCH_CHARS = 1 << 22  # or so many characters


@dataclass(frozen=True)
class Role:
    mark: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, and the machine: which role may follow which ('' is the start), and where it may end."""

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("### System: "), "user": Role("### User: "), "tool": Role("### Tool: "), "assistant": Role("### Assistant: ", loss=True),
    })
    other: tuple[str, str] = ("### Role ", "</role>: ")  # around the name of any other role
    end: str = " </turn>\n"
    follow: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user", "tool"}), "tool": frozenset({"assistant"}),
    })
    final: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        return [*(r.mark.strip() for r in self.roles.values()), self.other[0].strip(), self.other[1].strip(), self.end.strip()]


class Codec:
    """What the template means for single strings."""

    def __init__(self, template: Template):
        self.t = template
        self._special = re.compile("|".join(map(re.escape, ["\\", *sorted(template.controls(), key=len, reverse=True)])))
        self._escaped = re.compile(r"\\(.)", re.DOTALL)
        self._end = re.compile(r"\\.|" + re.escape(template.end), re.DOTALL)
        self._by_mark = sorted(((r.mark, name) for name, r in template.roles.items()), key=lambda x: -len(x[0]))

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def mark(self, role: str) -> str:
        known = self.t.roles.get(role)
        return known.mark if known else self.t.other[0] + self.escape(role) + self.t.other[1]

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, text, loss) of a turn."""
        known = self.t.roles.get(role)
        return [("mark", self.mark(role), False), ("text", self.escape(text), bool(known and known.loss)), ("end", self.t.end, False)]

    def end_of_turn(self, formatted: str, start: int = 0) -> int:
        """Where the end mark that closes the turn begins, or -1."""
        for m in self._end.finditer(formatted, start):
            if m[0][0] != "\\":
                return m.start()
        return -1

    def read_turn(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn without its end mark."""
        for mark, name in self._by_mark:
            if formatted.startswith(mark):
                return name, self.unescape(formatted[len(mark) :])
        if not formatted.startswith(self.t.other[0]):
            raise ValueError(f"no mark: {formatted[:40]!r}")
        rest = formatted[len(self.t.other[0]) :]
        for m in re.finditer(r"\\.|" + re.escape(self.t.other[1]), rest, re.DOTALL):
            if m[0][0] != "\\":
                return self.unescape(rest[: m.start()]), self.unescape(rest[m.end() :])
        raise ValueError(f"no end of the role: {formatted[:40]!r}")


SEGMENTS = "conv_id bigint, segment bigint, kind string, text string, loss boolean, order_error bigint"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("order_error", pa.int64())])
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, order_error bigint"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("order_error", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[text_at]) if text_at is not None else 0
        if len(held) >= BATCH or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


_NONE = object()


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, by conversation and in order within each partition.

    ``order_error`` is set on the segments of the first turn that may not stand where it does, to its
    number from 0.
    """
    template = template or Template()
    codec = Codec(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, state, n, k, wrong = _NONE, "", 0, 0, False
            for conv_id, _, role, text in _rows(batches):
                if conv is _NONE or conv_id != conv:
                    conv, state, n, k, wrong = conv_id, "", 0, 0, False
                error = None
                if not wrong and role not in template.follow.get(state, ()):
                    wrong, error = True, n
                for kind, part, loss in codec.segments(role, text):
                    yield conv_id, k, kind, part, loss, error
                    k += 1
                state, n = role, n + 1

        return _batches(rows(), _SEGMENTS, 3)

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    return arrow_map(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader finds in the formatted text alone, per conversation: turns, loss text and sizes.

    Needs the segments of a conversation in order in one partition, as format_conversations() gives them.
    """
    codec = Codec(template or Template())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv: object = _NONE
            for conv_id, _, _, part, loss, error in _rows(batches):
                if conv is _NONE or conv_id != conv:
                    if conv is not _NONE:
                        yield conv, n, all_turns.hexdigest(), loss_n, all_loss.hexdigest(), chars, wrong
                    conv, n, chars, loss_n, wrong, open_turn = conv_id, 0, 0, 0, None, ""
                    all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
                chars += len(part)
                wrong = error if wrong is None else wrong
                if loss:
                    plain = codec.unescape(part)
                    loss_n += len(plain)
                    all_loss.update(plain.encode("utf-8", "surrogatepass"))
                open_turn += part
                if part.endswith(codec.t.end):
                    while (at := codec.end_of_turn(open_turn)) >= 0:
                        role, text = codec.read_turn(open_turn[:at])
                        all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        n, open_turn = n + 1, open_turn[at + len(codec.t.end) :]
            if conv is not _NONE:
                yield conv, n, all_turns.hexdigest(), loss_n, all_loss.hexdigest(), chars, wrong

        return _batches(rows(), _READ, None)

    return arrow_map(segments, run, READ)


#: A conversation that holds control strings of the template, to show that they come back.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(text, '(\\|### System:|### User:|### Tool:|### Assistant:|### Role|</role>:|</turn>)', '\\\1', 'g') AS esc,
        lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + 9 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'tool' THEN 10 WHEN 'assistant' THEN 15 ELSE 18 + length(role) END)::BIGINT AS formatted_chars,
  min(pos) FILTER (NOT CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
    WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role = 'assistant' ELSE false END) AS order_error
FROM e GROUP BY conv_id
"""
