"""Chat formatting with a compiled template, read back from its own output.

Rows are sorted by conversation and turn; a task streams them through the template's
closures, one turn in memory at a time, so a conversation may be longer than memory.
A digest over one conversation is sequential by definition: the turns of one
conversation meet in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.templates import compiled

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# strings that models read as control; those of the template above and common others
CONTROL = (
    START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' + (m.role | escape) + '<|im_sep|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}"
    "{% endfor %}"
)
_BREAK = re.compile(r"\\|[<\[](?=(?:" + "|".join(re.escape(c[1:]) for c in CONTROL) + "))")
_FRAME = re.compile("|".join(map(re.escape, (START, SEP, END))))


def escape(text: str | None) -> str:
    """No control string is left: a backslash follows its first character; backslashes are doubled."""
    return _BREAK.sub(lambda m: m[0] + "\\", text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)|([<\[])\\", lambda m: m[1] or m[2], text)


class Reader:
    """Reads formatted pieces back: hashes of the turns and of what carries loss."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.buffer: list[tuple[str, bool]] = []

    def feed(self, piece: str, loss: bool) -> None:
        self.chars += len(piece)
        self.buffer.append((piece, loss))
        if not loss and END in piece:
            self._turn()

    def _turn(self) -> None:
        text = "".join(p for p, _ in self.buffer)
        marks = [(m[0], m.start(), m.end()) for m in _FRAME.finditer(text)]
        if [m[0] for m in marks] != [START, SEP, END]:
            raise ValueError("a turn is not framed as the template does it")
        role, said = text[marks[0][2] : marks[1][1]], text[marks[1][2] : marks[2][1]]
        for part in (unescape(role), "\n", unescape(said), "\n"):
            self.turns.update(part.encode("utf-8", "surrogatepass"))
        under = unescape("".join(p for p, loss in self.buffer if loss))
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(under)
        self.n_turns += 1
        self.buffer = []


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(3)))


def formatted(
    turns: DataFrame, template: str = TEMPLATE, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> DataFrame:
    """``(conv_id, part, formatted, loss)``: the output of the template in order, and where it carries loss.

    A null text or role is empty; a null conv_id is one more conversation. Turns that
    tie are ordered by role, then text; repeated rows stay. No rows give no rows.
    """

    def task(batches):
        render = compiled(template, {"escape": escape})
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": r[1] or "", "text": r[2] or ""} for r in rows)
            part = 0
            for piece, loss in render(messages=messages):
                yield conv, part, piece, loss
                part += 1

    def arrow(batches):
        chunk, chars = [], 0
        for row in task(batches):
            chunk.append(row)
            chars += len(row[2])
            if chars > 1_000_000 or len(chunk) >= 10_000:
                yield _batch(chunk, schema)
                chunk, chars = [], 0
        yield _batch(chunk, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.bool_())])
    return _sorted(turns, conv_col, turn_col, role_col, text_col).mapInArrow(
        arrow, "conv_id long, part long, formatted string, loss boolean"
    )


def _sorted(turns, conv_col, turn_col, role_col, text_col) -> DataFrame:
    t = turns.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x")
    )
    return t.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digests(turns: DataFrame, template: str = TEMPLATE, **columns) -> DataFrame:
    """What a reader finds in the formatted output, one row per conversation."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def read(batches):
        pieces = ((r[0], r[1], r[2]) for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))))
        found = []
        for conv, own in groupby(pieces, key=lambda r: r[0]):
            reader = Reader()
            for _, piece, loss in own:
                reader.feed(piece, loss)
            found.append((
                conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars,
            ))
            if len(found) >= 10_000:
                yield _batch(found, schema)
                found = []
        yield _batch(found, schema)

    return formatted(turns, template, **columns).mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
