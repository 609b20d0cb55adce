"""Chat formatting: turns become text by a declarative template, with a loss flag per segment.

A finite-state machine over the roles says of every turn whether the order so far is allowed.
Nothing is left out: turns out of order and unknown roles are formatted too, and ``valid`` is false
from there on. Control strings inside texts are escaped: every backslash is doubled and each
control string gets a backslash after its first character; reading back undoes both.

Turns are dealt by conversation and sorted by turn, role and text; a conversation, however long, is
streamed turn by turn and never held. Null roles and texts count as empty; rows of the same turn
are turns each on its own; a null turn comes first; rows without conversation id are one
conversation. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sliceworks.llm.common import column, slices

SEGMENTS = ("open", "text", "close")


@dataclass(frozen=True)
class Template:
    """Markers of the roles, which roles bear loss, and which role may follow which.

    ``order`` maps a state to the roles that may come next; a role is the state that it leads to.
    Roles without markers are written out between ``other``'s three markers.
    """

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("<s> ", " </s>")})
    loss: frozenset[str] = frozenset({"assistant"})
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user",)})
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")

    def controls(self) -> list[str]:
        """The control strings: the markers without white space around them."""

        return [m.strip() for pair in self.markers.values() for m in pair] + list(self.other)

    def escape(self, text: str) -> str:
        start = "(?=" + "|".join(map(re.escape, self.controls())) + ")(.)"
        return re.sub(start, r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def around(self, role: str) -> tuple[str, str]:
        """What stands before and after a turn's text."""

        if role in self.markers:
            return self.markers[role]
        return self.other[0] + self.escape(role) + self.other[1], self.other[2]


class Reader:
    """Reads turns back out of formatted text that comes in pieces with loss flags."""

    def __init__(self, template: Template) -> None:
        self.template, self.text, self.flags = template, "", []

    def feed(self, piece: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """Role, text and text under the loss mask of every turn that is complete."""

        self.text += piece
        self.flags.append((len(piece), loss))
        while (turn := self.turn()) is not None:
            yield turn

    def turn(self) -> tuple[str, str, str] | None:
        template = self.template
        for role, (before, after) in template.markers.items():
            if self.text.startswith(before):
                start = len(before)
                break
        else:
            role, after, start = None, template.other[2], self.text.find(template.other[1])
            if not self.text.startswith(template.other[0]) or start < 0:
                return None
            role = template.unescape(self.text[len(template.other[0]):start])
            start += len(template.other[1])
        end = self.text.find(after, start)
        if end < 0:
            return None
        at, masked = 0, []
        used = end + len(after)
        while at < used:
            size, loss = self.flags.pop(0)
            if at + size > used:
                self.flags.insert(0, (at + size - used, loss))
                size = used - at
            if loss:
                masked.append(self.text[at:at + size])
            at += size
        body, self.text = self.text[start:end], self.text[used:]
        return role, template.unescape(body), template.unescape("".join(masked))


def format_chat(df: DataFrame, template: Template | None = None, key: str = "conv_id",
                turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of the formatted conversations: key, ``position`` in the conversation, ``part``
    (open, text or close), ``segment``, ``loss``, and ``valid``, whether the order holds so far.

    The formatted text of a conversation is its segments, joined in order.
    """

    template = template or Template()
    kind = df.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("position", T.LongType()),
        T.StructField("part", T.StringType()), T.StructField("segment", T.StringType()),
        T.StructField("loss", T.BooleanType()), T.StructField("valid", T.BooleanType())])
    arrow_key = to_arrow_type(kind)
    turns = df.select(column(key).alias("k"), column(turn).alias("n"),
                      F.coalesce(column(role).cast("string"), F.lit("")).alias("r"),
                      F.coalesce(column(text).cast("string"), F.lit("")).alias("t"))
    dealt = turns.repartition("k").sortWithinPartitions("k", "n", "r", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, state, valid, position = False, None, "", True, 0
        for rows in slices(batches):
            out: list[tuple] = []
            for k, _, r, t in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if not begun or k != last:
                    begun, last, state, valid, position = True, k, "", True, 0
                valid = valid and r in template.order.get(state, ())
                state = r
                before, after = template.around(r)
                for part, segment in zip(SEGMENTS, (before, template.escape(t), after),
                                         strict=True):
                    out.append((k, position, part, segment,
                                part == "text" and r in template.loss, valid))
                    position += 1
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    arrow_key, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()),
                    strict=True)], names=schema.names)

    return dealt.mapInArrow(run, schema)
