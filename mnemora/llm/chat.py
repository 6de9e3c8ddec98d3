"""Chat formatting by event-sourced reconstruction.

The log is partitioned by conversation and sorted by (turn, sequence); streamed deltas, edits and
regenerations fold into final messages as the rows pass by, and each message is rendered as a
segment of its conversation's training string. Tasks hold one message at a time, so a
conversation of any length streams through.

Events (conv_id, turn, seq, kind, role, text): `message` or null begins a message of the turn; `delta`
appends to it; `edit` replaces its text; `regenerate` discards its text and starts it anew; `delete` drops it.
A delta, edit or regenerate without a message before it begins one.

A segment is OPEN role ] newline text CLOSE. Inside roles and texts, a backslash stands before each of
\\ [ ] < >, so no control string of a text survives, and removing those backslashes gives it back. The
loss mask (loss_start, loss_end: code points of the conversation's string, null for others) covers exactly
the texts of assistant messages.

Edge cases: null texts and roles count as empty; rows of one turn with equal sequence are ordered by kind, role and
text; repeated `message` rows are messages of their own; null conv_ids form one conversation. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "[INST ", "</s>\n"
_SEGMENT = re.compile(r"\[INST ((?:[^\\\[\]<>]+|\\.)*)\]\n((?:[^\\\[\]<>]+|\\.)*)</s>\n", re.S)
_SCHEMA = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
_escape = re.compile(r"[\\\[\]<>]")
_unescape = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _escape.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """The segment of a message, and where its text begins."""
    head = f"{OPEN}{escape(role)}]\n"
    return f"{head}{escape(text)}{CLOSE}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a training string."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m:
            raise ValueError(f"no segment at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Batches:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2000, chars: int = 4 << 20):
        self.schema, self.rows, self.chars = schema, rows, chars
        self.held: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int):
        self.held.append(row)
        self.size += size
        if len(self.held) >= self.rows or self.size >= self.chars:
            yield from self.rest()

    def rest(self):
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.held), self.schema.types)], schema=self.schema)
        self.held, self.size = [], 0


def _rows(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in batch.slice(i, 256).columns])


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): the segments, in order within each partition; a conversation is
    whole in its partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        out = _Batches(schema)
        conv, turn, role, text, place = object(), None, None, None, 0

        def close():
            nonlocal place, text
            if text is not None:
                said = "".join(text)
                segment, at = render(role, said)
                loss = (place + at, place + len(segment) - len(CLOSE)) if role == "assistant" else (None, None)
                place += len(segment)
                text = None
                yield from out.add((conv, turn, segment, *loss), len(segment))

        for conv_id, turn_no, kind, who, said in _rows(batches):
            kind = kind or "message"
            if conv_id != conv or turn_no != turn or kind == "message":
                yield from close()
                if conv_id != conv:
                    place = 0
                conv, turn = conv_id, turn_no
            if text is None and kind != "delete":
                role, text = who or "", []
            if kind in ("message", "delta"):
                text.append(said or "")
            elif kind in ("edit", "regenerate"):
                text = [said or ""]
            elif kind == "delete":
                text = None
            else:
                raise ValueError(f"unknown kind of event: {kind}")
        yield from close()
        yield from out.rest()

    log = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return log.select("conv_id", "turn", "kind", "role", "text").mapInArrow(run, _SCHEMA)


def digests(segments: DataFrame) -> DataFrame:
    """Read back from the output of format_conversations: a row for each conversation, streamed."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        out = _Batches(pa.schema(list(zip(names, kinds))))
        conv, n, chars, loss_chars = object(), 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def close():
            if n:
                yield from out.add((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), 200)

        for conv_id, formatted, start, end in _rows(batches):
            if conv_id != conv:
                yield from close()
                conv, n, chars, loss_chars = conv_id, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in parse(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if start is not None:
                under = unescape(formatted[start - chars : end - chars])
                loss.update(under.encode())
                loss_chars += len(under)
            chars += len(formatted)
        yield from close()
        yield from out.rest()

    return segments.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"
DRAFT = "(draft)"


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as the log of a streamed chat: a message begins with half of its text and a delta brings the rest;
    an assistant's is first a draft that is regenerated. Rows of one turn follow each other by role and text."""
    row = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    begin, rest = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))
    none = F.lit(None).cast("string")

    def event(k: int, kind: str, role: F.Column, text: F.Column) -> F.Column:
        return F.struct((4 * F.col("row") + k).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    plain = F.array(event(0, "message", F.col("role"), begin), event(2, "delta", none, rest))
    said = F.array(event(0, "message", F.col("role"), F.lit(DRAFT)), event(1, "regenerate", none, begin), event(2, "delta", none, rest))
    log = conversations.withColumn("row", row).select("conv_id", "turn", F.explode(F.when(F.col("role") == "assistant", said).otherwise(plain)).alias("e"))
    return log.select("conv_id", "turn", "e.*")
