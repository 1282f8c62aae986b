"""Chat formatting by a finite-state machine over roles.

A template says, for each role, which strings stand before and after a text and
whether the text counts in the loss, and which roles may follow which. Texts are
escaped so that no control string occurs in them, so the formatted text can
be read back without looking at anything else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import arrow_schema, mapped

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``other`` marks roles without an entry; between its two first strings stands the role itself.

    ``follows`` gives the roles that may come after each state; the state is the last role, or "" at the
    start. ``ends`` are the states in which a conversation may end.
    """

    turns: dict[str, Turn]
    other: tuple[str, str, str]
    follows: dict[str, frozenset[str]]
    ends: frozenset[str]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [mark for turn in self.turns.values() for mark in (turn.before, turn.after)] + list(self.other)
        controls = tuple(sorted({mark.strip() for mark in marks}, key=lambda mark: (-len(mark), mark)))
        for control in controls:
            if len(control) < 2 or ESCAPE in control:
                raise ValueError("a control string needs two characters and no escape character")
            tails = [control[n:] for n in range(1, len(control))]
            if any(mark.startswith(tail) for mark in marks for tail in tails):
                raise ValueError("a mark could complete a control string that a text begins")
        begins = [turn.before for turn in self.turns.values()] + [self.other[0]]
        if any(a is not b and a.startswith(b) for a in begins for b in begins):
            raise ValueError("the strings before the texts must tell the roles apart")
        object.__setattr__(self, "controls", controls)

    @cached_property
    def _special(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (ESCAPE, *self.controls))))

    def escape(self, text: str) -> str:
        """An escape character is doubled; behind the first character of a control string one is put in."""
        return self._special.sub(lambda m: m[0] + ESCAPE if len(m[0]) == 1 else m[0][0] + ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, whether it counts in the loss), in order."""
        turn = self.turns.get(role)
        if turn is None:
            first, second, last = self.other
            return [(first + self.escape(role) + second, False), (self.escape(text), False), (last, False)]
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def allowed(self, state: str, role: str) -> bool:
        return role in self.follows.get(state, frozenset())

    def read(self, formatted: str, at: int) -> tuple[str, int, int, int] | None:
        """Role, start and end of the escaped text, and where the next turn starts; None if the turn is not complete."""
        for role, turn in self.turns.items():
            if formatted.startswith(turn.before, at):
                start = at + len(turn.before)
                end = formatted.find(turn.after, start)
                return None if end < 0 else (role, start, end, end + len(turn.after))
        first, second, last = self.other
        if not formatted.startswith(first, at):
            return None
        middle = formatted.find(second, at + len(first))
        end = formatted.find(last, middle + len(second)) if middle >= 0 else -1
        if end < 0:
            return None
        return self.unescape(formatted[at + len(first) : middle]), middle + len(second), end, end + len(last)


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    },
    other=("[ROLE]", "[/ROLE]", "[END]"),
    follows={
        "": frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
    ends=frozenset({"assistant"}),
)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            yield from batch.slice(start, 2_000).to_pylist()


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_chats(
    conversations: DataFrame,
    template: Template = INSTRUCT,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per turn: conv_id, place, role, legal, segments (array of text and loss), in order within each partition.

    The formatted conversation is the segments' texts one behind the other. ``legal``
    says whether the machine may take this role in its state; it then goes on from this role
    in any case. Turns go by number; turns with one number, or none (these come first), by role and
    then text. A null text or role counts as empty, a null conversation is one of its own, repeated rows are turns
    of their own. A conversation streams through one task row by row, so its length
    does not bound memory.
    """
    narrow = conversations.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("conv_id", narrow.schema["conv_id"].dataType),
            T.StructField("place", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("legal", T.BooleanType()),
            T.StructField("segments", T.ArrayType(T.StructType().add("text", "string").add("loss", "boolean"))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def formatted() -> Iterator[dict]:
            current, place, state = object(), 0, ""
            for row in _rows(batches):
                if row["conv_id"] != current:
                    current, place, state = row["conv_id"], 0, ""
                legal = template.allowed(state, row["role"])
                state = row["role"]
                segments = [{"text": part, "loss": loss} for part, loss in template.segments(row["role"], row["text"])]
                yield {"conv_id": current, "place": place, "role": state, "legal": legal, "segments": segments}
                place += 1

        yield from _batches(formatted(), arrow_schema(schema))

    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ordered, run, schema)


class Reader:
    """Reads one conversation back from its formatted text and loss flags, piece by piece."""

    def __init__(self, template: Template):
        self.template = template
        self.rest, self.flags = "", []
        self.turns = self.characters = self.loss_characters = 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.state, self.legal = "", True

    def feed(self, text: str, loss: bool) -> None:
        start = len(self.rest)
        self.rest += text
        self.characters += len(text)
        if loss and text:
            self.flags.append((start, start + len(text)))

    def advance(self) -> None:
        """Take the complete turns off the front."""
        at = 0
        while at < len(self.rest) and (found := self.template.read(self.rest, at)) is not None:
            role, start, end, at = found
            text = self.template.unescape(self.rest[start:end])
            self.turn_digest.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            self.legal &= self.template.allowed(self.state, role)
            self.state = role
        for start, end in (span for span in self.flags if span[1] <= at):
            text = self.template.unescape(self.rest[start:end])
            self.loss_characters += len(text)
            self.loss_digest.update(text.encode())
        self.flags = [(start - at, end - at) for start, end in self.flags if end > at]
        self.rest = self.rest[at:]

    def result(self, conversation) -> dict:
        if self.rest:
            raise ValueError("a formatted conversation does not end with a complete turn")
        return {
            "conv_id": conversation,
            "n_turns": self.turns,
            "turns_sha256": self.turn_digest.hexdigest(),
            "loss_chars": self.loss_characters,
            "loss_sha256": self.loss_digest.hexdigest(),
            "formatted_chars": self.characters,
            "legal": self.legal and self.state in self.template.ends,
        }


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row per conversation, from the formatted text and flags alone: what ``format_chats`` returned, in its order."""
    schema = T.StructType(
        [
            T.StructField("conv_id", formatted.schema["conv_id"].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
            T.StructField("legal", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[dict]:
            reader, current = None, None
            for row in _rows(batches):
                if reader is None or row["conv_id"] != current:
                    if reader is not None:
                        yield reader.result(current)
                    reader, current = Reader(template), row["conv_id"]
                for segment in row["segments"]:
                    reader.feed(segment["text"], segment["loss"])
                reader.advance()
            if reader is not None:
                yield reader.result(current)

        yield from _batches(read(), arrow_schema(schema))

    return mapped(formatted.select("conv_id", "segments"), run, schema)
