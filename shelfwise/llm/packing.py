"""Packing token sequences by the sum-of-squares rule.

Documents are placed online, in the order of their partition. For each, the window
to extend is of the fill level that makes the sum of the squared numbers of partly
filled windows per level smallest; one array holds those numbers. Full lengths of
long documents are cut off first. What is still open when a partition ends is cut:
the emptiest windows fill the fullest, and the last remainder is split into windows
of power-of-two lengths, which need no padding.

A partition packs by itself, so there is no shuffle; the open windows are all that a
task keeps, and how many there are depends on the lengths, not on the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
BATCH_CHARS = 400_000  # texts tokenized at once; bounds memory, not results

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Packer:
    """Sum-of-squares placement of items (key, ids) into windows; yields (key, start, ids, total, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.next = window, first_sequence
        self.open: list[list] = [[] for _ in range(window)]  # by fill level: [sequence, pieces]
        self.counts = np.zeros(2 * window, dtype=np.int64)  # the second half stands for windows that would overflow

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        """Place one piece of at most a window. A window's pieces come out when it is full."""
        size, w = len(ids), self.window
        if size == w:
            yield key, start, ids, total, self._sequence(), 0
            return
        # change of the sum of squares by moving one window from level h to h + size
        n = self.counts
        top = w - size  # the level that becomes full
        change = 2 * (n[size : size + top + 1] - n[: top + 1]) + 2
        change[n[: top + 1] == 0] = np.iinfo(np.int64).max
        if n[top]:
            change[top] = 1 - 2 * n[top]
        change[0] = 2 * n[size] + 1  # a new window
        h = int(change.argmin())
        sequence, pieces = self.open[h].pop() if h else (self._sequence(), [])
        if h:
            n[h] -= 1
        pieces.append((key, start, ids, total, h))
        if h + size == w:
            yield from self._out(sequence, pieces)
        else:
            n[h + size] += 1
            self.open[h + size].append((sequence, pieces))

    @staticmethod
    def _out(sequence, pieces):
        for key, start, ids, total, offset in pieces:
            yield key, start, ids, total, sequence, offset

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        for start in range(0, total, self.window):
            yield from self.place(key, start, ids[start : start + self.window], total)

    def close(self) -> Iterator[tuple]:
        """Cut what is open: pieces of the emptiest windows fill up the fullest."""
        left = [(h, s, p) for h in range(self.window - 1, 0, -1) for s, p in self.open[h]]
        i, j = 0, len(left) - 1
        loose: list[tuple] = []  # pieces without a window, of the emptiest window that is taken apart
        while i <= j:
            level, sequence, pieces = left[i]
            i += 1
            while level < self.window:
                if not loose:
                    if i > j:
                        break
                    loose = [x[:4] for x in left[j][2]]
                    j -= 1
                key, start, ids, total = loose.pop()
                fits = self.window - level
                pieces.append((key, start, ids[:fits], total, level))
                level += min(fits, len(ids))
                if len(ids) > fits:
                    loose.append((key, start + fits, ids[fits:], total))
            if level == self.window:
                yield from self._out(sequence, pieces)
            else:
                loose = [x[:4] for x in pieces] + loose
        rest = sum(len(x[2]) for x in loose)
        for bit in reversed(range(self.window.bit_length())):
            size = 1 << bit
            while rest >= size:
                rest -= size
                sequence, offset = self._sequence(), 0
                while offset < size:
                    key, start, ids, total = loose.pop()
                    fits = size - offset
                    yield key, start, ids[:fits], total, sequence, offset
                    if len(ids) > fits:
                        loose.append((key, start + fits, ids[fits:], total))
                    offset += min(fits, len(ids))


def encoder(tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
    """A function from a list of texts to their ids.

    The tokenizer's file decides. ``ranks_file`` may hold the same vocabulary as ranks,
    which a faster library reads; it takes the texts whose characters both libraries
    class alike (those below U+0250, unchanged in all Unicode versions).
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True

    def slow(texts):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not ranks_file:
        return slow
    import base64
    import re

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    alike = re.compile("[\x00-\u024f]*").fullmatch
    return lambda texts: [fast.encode_ordinary(t) if alike(t) else slow([t])[0] for t in texts]


def _tokens(encode, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text and the end id, a bounded number of characters at a time."""
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= BATCH_CHARS):
            chars += len(texts[j])
            j += 1
        for ids in encode(texts[i:j]):
            yield np.asarray([*ids, END_ID], dtype="<u4")
        i = j


def packed(
    docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per piece, columns of ``SCHEMA``.

    Null and empty texts are a document of the end id alone. Repeated rows and null
    ids are documents like others. Strings of special tokens inside a text are
    ordinary text. An empty table gives no rows.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, ranks_file, pattern)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows):
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def row(key, start, ids, total, sequence, offset):
            return key, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset

        for b in batches:
            keys = b.column(0).to_pylist()
            rows = []
            for key, ids in zip(keys, _tokens(encode, b.column(1).to_pylist())):
                rows += [row(*x) for x in packer.add(key, ids)]
            yield batch(rows)
        yield batch([row(*x) for x in packer.close()])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return d.mapInArrow(task, SCHEMA)
