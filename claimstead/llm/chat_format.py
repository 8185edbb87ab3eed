"""Chat formatting with a grammar that a deterministic parser reads back.

    conversation := turn*
    turn         := "<s>[INST] " text " [/INST]"                 user
                  | " " text " </s>"                             assistant
                  | "<s><<SYS>> " text " <</SYS>>"               system
                  | "<s>[ROLE] " role " [AS] " text " [/ROLE]"   any other role

Control strings inside a text get a backslash in front, and backslashes already standing there are doubled;
so no control string of a text is without one, and none of the template has one. A turn is rendered plain
first and parsed again; where the parser does not return exactly the turn, its text is escaped and the
result parsed again. A turn that differs even then stops the job.

Rows are dealt by conversation and read in order of turn, one turn at a time: a conversation of any length
needs the room of one turn. The output is one row for each turn (conversation, position, rendered text, and
the span of it that the loss covers: the assistant's text), which joined in order is the conversation.

Defined results: null text is empty, a null role is the role "null"; rows of the same turn follow each
other by role and text; a null conv_id is a conversation of its own; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[AS]", "[/ROLE]")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_IN_TEXT = re.compile(rf"(\\*)({_CONTROL})")
_NEXT = re.compile(rf"(?<!\\)(?:{_CONTROL})")


class Malformed(ValueError):
    pass


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, with text (escaped or not) as given, and the span the loss covers."""
    if role == "user":
        return f"<s>[INST] {text} [/INST]", 0, 0
    if role == "assistant":
        return f" {text} </s>", 1, 1 + len(text)
    if role == "system":
        return f"<s><<SYS>> {text} <</SYS>>", 0, 0
    return f"<s>[ROLE] {escape(role)} [AS] {text} [/ROLE]", 0, 0


def _until(data: str, at: int, control: str) -> tuple[str, int]:
    """The text from at to the blank before the next control string, which must be this one."""
    m = _NEXT.search(data, at)
    if m is None or m[0] != control or m.start() <= at or data[m.start() - 1] != " ":
        raise Malformed(f"{control} expected after character {at}")
    return data[at : m.start() - 1], m.end()


def parse(data: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a rendered conversation: text unescaped, its place in data."""
    at = 0
    while at < len(data):
        if data.startswith("<s>[INST] ", at):
            role, start, close = "user", at + 10, "[/INST]"
        elif data.startswith("<s><<SYS>> ", at):
            role, start, close = "system", at + 11, "<</SYS>>"
        elif data.startswith("<s>[ROLE] ", at):
            role, start = _until(data, at + 10, "[AS]")
            if data[start : start + 1] != " " or (role := unescape(role)) in ("user", "assistant", "system"):
                raise Malformed(f"no role at character {at}")
            start, close = start + 1, "[/ROLE]"
        elif data[at] == " ":
            role, start, close = "assistant", at + 1, "</s>"
        else:
            raise Malformed(f"no turn at character {at}")
        text, at = _until(data, start, close)
        yield role, unescape(text), start, start + len(text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    for content in (text, escape(text)):
        out = render(role, content)
        try:
            turns = list(parse(out[0]))
        except Malformed:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return out
    raise Malformed("a turn cannot be written")


FORMATTED = "conv_id long, position long, formatted string, loss_start long, loss_end long"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row for each turn, see FORMATTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position = object(), 0
        for batch in batches:
            places, rendered = [], []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                current, position = conv_id, position + 1 if conv_id == current else 0
                places.append(position)
                rendered.append(format_turn(role, text))
            columns = [batch.column("conv_id"), pa.array(places, pa.int64()), pa.array([r[0] for r in rendered], pa.string())]
            columns += [pa.array([r[k] for r in rendered], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "formatted", "loss_start", "loss_end"])

    return _turns(conversations).mapInArrow(run, FORMATTED)


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Rows of format_conversations -> for each conversation conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv_id, data, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv_id != current:
                    close()
                    current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(data):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                covered = unescape(data[start:end])
                state[2] += len(covered)
                state[3].update(covered.encode())
                state[4] += len(data)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    rows = formatted.select("conv_id", "position", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
