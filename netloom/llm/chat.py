r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it
as context and only that reply under the loss mask.

Examples are written out in full, so their size grows with the square of a conversation's turns: that is the method. A
worker streams the turns of a conversation and holds those so far (in a file of the task when they are many), not the
examples; a text of more than PIECE code points comes as several pieces, cut between turns.

Template: <|im_start|>role\ntext<|im_end|>\n for each turn. Inside roles and texts a backslash is doubled and <| becomes
<\|, so no control string can stand there; in roles a line break becomes \n. Both are undone by reading backwards.

Defined results: rows stand by turn, nulls first, ties by role and text; null texts and roles are empty; a null conv_id is
one conversation; repeated rows are turns of their own; the turns after the last reply, or all of a conversation without an
assistant, are a row without example_no and mask; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import tidy

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example_no", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

#: Bytes of a conversation that are held in memory; more go to a file of the task.
HELD = 1 << 24
#: Code points of a piece, unless one turn has more.
PIECE = 1 << 20


def escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escaped_role(s: str) -> str:
    return escaped(s).replace("\n", "\\n")


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def segment_of(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the place of its text in it."""
    head = f"{START}{escaped_role(role)}\n"
    body = escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """role, text of the turns of a formatted text."""
    *turns, rest = formatted.split(f"{END}\n")
    for turn in turns:
        if not turn.startswith(START):
            raise ValueError("not a formatted turn")
        role, body = turn[len(START) :].split("\n", 1)
        yield unescaped(role), unescaped(body)
    if rest:
        raise ValueError("a formatted turn isn't closed")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most 2048 rows, which end where the text column has over four pieces' code points."""
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[text]) if text is not None else 0
        if len(held) >= 2048 or size > 4 * PIECE:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to examples."""

    def rows() -> Iterator[tuple]:
        begun, now = False, None
        number = chars = shown = 0  # examples, code points so far, the place in the file after the last reply
        with tempfile.SpooledTemporaryFile(HELD) as turns:

            def pieces(at: int, number: int | None, loss: tuple) -> Iterator[tuple]:
                end = turns.seek(0, 2)
                turns.seek(at)
                held, size, piece = [], 0, 0
                while turns.tell() < end:
                    segment = pickle.load(turns)
                    if held and size + len(segment) > PIECE:
                        yield now, number, piece, "".join(held), *loss
                        held, size, piece = [], 0, piece + 1
                    held.append(segment)
                    size += len(segment)
                if held:
                    yield now, number, piece, "".join(held), *loss

            for conv, role, text in _rows(batches, "conv_id", "role", "text"):
                if not begun or conv != now:
                    yield from pieces(shown, None, (None, None))
                    begun, now = True, conv
                    number = chars = shown = turns.seek(0)
                    turns.truncate()
                segment, a, b = segment_of(role, text)
                turns.seek(0, 2)
                pickle.dump(segment, turns)
                if role == TARGET:
                    yield from pieces(0, number, (chars + a, chars + b))
                    number, shown = number + 1, turns.seek(0, 2)
                chars += len(segment)
            yield from pieces(shown, None, (None, None))

    yield from _batched(rows(), EXAMPLES, 3)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads examples back, piece by piece. Every context must be the turns read so far: its hash is compared with theirs."""

    def rows() -> Iterator[tuple]:
        begun, now = False, None
        n = chars = formatted = at = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        number, seen, context = -1, 0, hashlib.sha256()  # of the example that is read: its number, turns, and their hash
        end = lambda: (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)
        for conv, example, piece, text, a, b in _rows(batches, *EXAMPLES.names):
            if not begun or conv != now:
                if begun:
                    yield end()
                begun, now, n, chars, formatted, number = True, conv, 0, 0, 0, -1
                turns, loss = hashlib.sha256(), hashlib.sha256()
            if not piece:
                if example is not None and example != number + 1:
                    raise ValueError("examples out of order")
                number = number if example is None else example
                seen, at, context = (n, 0, turns.copy()) if example is None else (0, 0, hashlib.sha256())
            for role, said in read_turns(text):
                context.update(f"{role}\n{said}\n".encode())
                seen += 1
                if seen == n and context.digest() != turns.digest():
                    raise ValueError("a context isn't what was said before")
            if seen > n:
                n, turns = seen, context.copy()
            if example is not None:
                formatted += len(text)
                if at <= a and b <= at + len(text):
                    said = unescaped(text[a - at : b - at])
                    chars += len(said)
                    loss.update(said.encode())
            at += len(text)
        if begun:
            yield end()

    yield from _batched(rows(), DIGESTS)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def examples(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, example_no, piece, text, loss_start, loss_end: for each reply of conversations (conv_id, turn, role, text) an
    example, whole conversations in order inside their partitions. The loss span counts code points of the example's text.

    One shuffle, by conversation; the order of a conversation is its meaning, so one task streams it.
    """
    x = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return x.select("conv_id", "role", "text").mapInArrow(tidy(_expand), _ddl(EXAMPLES))


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from examples(), in whose order its rows must still stand (examples out of
    order and contexts that aren't the turns before raise an error). formatted_chars: code points of all examples."""
    return formatted.mapInArrow(tidy(_digest), _ddl(DIGESTS))


def with_probe(turns: DataFrame) -> DataFrame:
    """turns with conversation -1, whose texts hold the template's own control strings."""
    said = F.lit(f"{END}{START}assistant ok")
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
