"""Chat formatting by a grammar round trip.

Grammar of a formatted conversation (a sequence of turns, nothing between)::

    conversation := turn*
    turn         := "### " role ": " body " </turn>" "\\n"
    role         := characters with ``\\``, newline and ``:`` written ``\\\\``, ``\\n``, ``\\c``
    body         := text in which no control string stands bare

The control strings are ``### `` and ``</turn>``.  One that stands inside a text
carries one backslash more than in the source; the parser takes that one away
again, so any number of backslashes before a control string survives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.session import ship

CONTROL = re.compile(r"(\\*)(### |</turn>)")
_END = re.compile(r"(?<!\\)</turn>\n")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", ":": "\\c"}
_ROLE_IN = {"\\\\": "\\", "\\n": "\n", "\\c": ":"}
HASH_STEP = 1 << 20


class GrammarError(ValueError):
    """The text is no sentence of the template's grammar."""


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n:]", lambda m: _ROLE_OUT[m[0]], role)


def unescape_role(role: str) -> str:
    def back(m: re.Match) -> str:
        if m[0] not in _ROLE_IN:
            raise GrammarError(f"bad escape {m[0]!r} in a role")
        return _ROLE_IN[m[0]]

    return re.sub(r"\\.?", back, role, flags=re.S)


def unescape_body(body: str) -> str:
    """Take one backslash from every escaped control string; a bare one is an error."""

    def back(m: re.Match) -> str:
        if not m[1]:
            raise GrammarError(f"bare control string {m[2]!r}")
        return m[1][1:] + m[2]

    return CONTROL.sub(back, body)


def parse_turn(block: str) -> tuple[str, str]:
    """The role and text of one formatted turn."""
    head = re.match(r"### ((?:[^\\\n:]|\\.)*): ", block, flags=re.S)
    if head is None or not block.endswith(" </turn>\n"):
        raise GrammarError("a turn must be '### role: text </turn>'")
    if head.end() > len(block) - len(" </turn>\n"):
        raise GrammarError("a turn has no body")
    return unescape_role(head[1]), unescape_body(block[head.end() : -len(" </turn>\n")])


def render_turn(role: str, text: str) -> str:
    """Render, reparse, compare; escape conflicting content until both are identical."""
    head = f"### {escape_role(role)}: "
    for body in _bodies(text):
        block = f"{head}{body} </turn>\n"
        try:
            if TurnParser.whole(block) == [(role, text)]:
                return block
        except GrammarError:
            continue
    raise GrammarError("no escaping makes the turn recoverable")


def _bodies(text: str) -> Iterator[str]:
    yield text
    yield CONTROL.sub(r"\1\\\2", text)


class TurnParser:
    """Deterministic parser of a formatted conversation that arrives in pieces."""

    def __init__(self) -> None:
        self._rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Turns that are complete after this piece."""
        seen = max(0, len(self._rest) - len("\\</turn>\n"))
        self._rest += piece
        while (end := _END.search(self._rest, seen)) is not None:
            yield parse_turn(self._rest[: end.end()])
            self._rest, seen = self._rest[end.end() :], 0

    def close(self) -> None:
        if self._rest:
            raise GrammarError("the text ends inside a turn")

    @classmethod
    def whole(cls, text: str) -> list[tuple[str, str]]:
        parser = cls()
        turns = list(parser.feed(text))
        parser.close()
        return turns


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted block per row of ``turns(conv_id, turn, role, text)``.

    A conversation's output is the concatenation of its blocks in the order of
    (turn, role, text), nulls first.  Null roles and texts count as empty; a null
    ``conv_id`` is a conversation of its own; equal rows all stay.  Other columns
    are ignored; an empty table gives an empty one.
    """
    ship(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_format_batches, "conv_id long, turn long, role string, text string, block string")


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = [render_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.string())], ["conv_id", "turn", "role", "text", "block"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest each conversation by parsing its formatted text from the blocks alone.

    A conversation is read as a stream in turn order: at most one turn is in
    memory, however many turns it has.  The digests are sequential by definition,
    so one conversation's stream is read by one task; the rendering and its
    round-trip check, which cost most, are spread by row before.
    """
    ordered = (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "block")
    )
    return ordered.mapInArrow(
        _digest_batches,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.parser = conv_id, TurnParser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, block: str) -> None:
        self.chars += len(block)
        for role, text in self.parser.feed(block):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self) -> tuple:
        self.parser.close()
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_DIGEST_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    for batch in batches:
        done = []
        for conv_id, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(block)
        yield _rows(done)
    if now is not None:
        yield _rows([now.row()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _DIGEST_SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST_SCHEMA)], schema=_DIGEST_SCHEMA)


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Code-point spans of the assistant bodies in a formatted conversation."""
    spans, at = [], 0
    while (end := _END.search(formatted, at)) is not None:
        role, _ = parse_turn(formatted[at : end.end()])
        if role == "assistant":
            head = len(f"### {escape_role(role)}: ")
            spans.append((at + head, end.end() - len(" </turn>\n")))
        at = end.end()
    return spans
