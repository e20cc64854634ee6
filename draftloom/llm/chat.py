"""Chat formatting with a grammar round trip.

A conversation is rendered as turns: ``### <role>:`` and a line feed, the text, a line feed, ``</turn>`` and a line feed. A small
deterministic parser (:class:`Reader`) reads such text back. Every turn is rendered as it is, parsed again and
compared with its source; where a text or role conflicts with the grammar, its control strings are escaped and the
turn is parsed again, until both are identical.

Escape: a backslash goes before each control string (``### `` or ``</turn>``) of a text, in front of those backslashes that
already stand there; the parser takes one backslash off every control string that has any. In roles, backslash, colon and
line feed take a backslash each. Both are reversible for every string.

Turns are rendered one by one, so a conversation is never held as a whole: rows are grouped and sorted by Spark and
stream through, and each turn is a row of the output with its place under the loss mask. A conversation of any length needs
the memory of one batch.

Defined cases: null text is empty; a null role is the empty role; turns come in order of turn (nulls first), then role, then
text; repeated rows are turns of their own; an empty table gives no rows; a null conv_id is one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import small_batches

OPEN, CLOSE = "### ", "</turn>"
TRAINED = "assistant"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:### |</turn>))")
_HEAD = re.compile(r"### ((?:[^\\:\n]|\\[\\:n])*):\n")
_ROLE_OUT = {"\\": "\\\\", ":": "\\:", "\n": "\\n"}
_ROLE_IN = {"\\\\": "\\", "\\:": ":", "\\n": "\n"}


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\:\n]", lambda m: _ROLE_OUT[m[0]], role)


class Reader:
    """Reads turns (role, text, start of the body, end of the body) from rendered text that arrives in pieces."""

    def __init__(self) -> None:
        self.rest, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        self.rest += piece
        start = 0
        while start < len(self.rest):
            head = _HEAD.match(self.rest, start)
            if not head:
                break
            end = self._end(head.end())
            if end < 0:
                break
            body = self.rest[head.end():end]
            role = re.sub(r"\\[\\:n]", lambda m: _ROLE_IN[m[0]], head[1])
            yield role, unescape(body), self.at + head.end(), self.at + end
            start = end + len(CLOSE) + 2
        self.at += start
        self.rest = self.rest[start:]

    def _end(self, start: int) -> int:
        """Where the body ends: at the first control string without a backslash, which must be a closing line."""
        for found in _CONTROL.finditer(self.rest, start):
            if found[1]:
                continue
            at = found.start(2)
            if found[2] == CLOSE and at > start and self.rest[at - 1] == "\n" and self.rest.startswith("\n", found.end()):
                return at - 1
            raise GrammarError(f"unescaped control string at {self.at + at}")
        return -1

    def close(self) -> None:
        if self.rest:
            raise GrammarError("text after the last turn")


def _render(role: str, body: str) -> str:
    return f"{OPEN}{escape_role(role)}:\n{body}\n{CLOSE}\n"


def parse(text: str) -> list[tuple[str, str, int, int]]:
    reader = Reader()
    turns = list(reader.feed(text))
    reader.close()
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its body starts and ends; proven by parsing it again."""
    for body in (text, escape(text)):
        piece = _render(role, body)
        try:
            turns = parse(piece)
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return piece, turns[0][2], turns[0][3]
    raise GrammarError(f"turn of role {role!r} does not come back")


def format_turns(rows: DataFrame) -> DataFrame:
    """Rendered turns in order: conv_id, turn, role, rendered, body_start, body_end, trained.

    The conversation is the concatenation of ``rendered``; the loss mask covers the code points from body_start to
    body_end of the pieces that are ``trained``. All pieces of a conversation lie in one partition, in order.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(2).to_pylist()
            made = [render_turn(role, text) for role, text in zip(roles, batch.column(3).to_pylist())]
            pieces = [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2)), pa.array([r == TRAINED for r in roles], pa.bool_())]
            # Ids and turns go through as they are: a null beside them must not make numbers of them that lose digits.
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *pieces], names=["conv_id", "turn", "role", "rendered", "body_start", "body_end", "trained"])

    ordered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(render, f"conv_id {kind}, turn {turn}, role string, rendered string, body_start long, body_end long, trained boolean")


class _Digest:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.reader = conv_id, Reader()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int, end: int, trained: bool) -> None:
        for role, text, _, _ in self.reader.feed(piece):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        if trained:
            masked = unescape(piece[start:end])
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(masked)
        self.chars += len(piece)

    def row(self) -> tuple:
        self.reader.close()
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and return one row of digests for each.

    Takes the rows of :func:`format_turns` as they stand, so no shuffle follows.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, id_type = None, None
        for batch in batches:
            done = []
            id_type = batch.schema.field("conv_id").type
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "rendered", "body_start", "body_end", "trained")]
            for conv_id, piece, start, end, trained in zip(*columns):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(piece, start, end, trained)
            if done:
                yield _table(done, id_type)
        if current is not None:
            yield _table([current.row()], id_type)

    def _table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return formatted.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
