"""Removal of passages that repeat, by prefix-partitioned suffix trees over words.

A suffix matters here to a depth of one window (35 words). Suffixes are routed so that
equal windows meet: by the smallest hash of the 8-word grams in the window, which
neighbouring suffixes of a document mostly share. They travel as one segment, whose
words are sent once. A gram at a single place of the corpus cannot be in a
repeated window, so most of the corpus stops there, before any word is shuffled.

A task takes the segments of some grams and grows their subtrees: it splits suffixes by
prefixes of as many words as it takes to get groups that fit a memory budget. A group's
tree is its sorted suffixes with the lengths of their common prefixes; an internal node is a
run of suffixes that agree to its depth. Nodes at a window's depth or below are the
repeats, and the leaves under them are the windows to remove. Where a gram has more than
``HEAVY`` segments, the prefix of a group grows to the whole window: the group is a node by
itself, and its leaves need only be counted, which is combined before the shuffle.
Segments with the same words are one leaf with a count, so thousands of copies cost one
entry per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import NULL_ID
from shelfwise.llm.shingles import windows, word_hashes, words
from shelfwise.session import stored

WINDOW = 35
GRAM = 8
SEGMENT = 60  # windows of a segment at most; their marks fit a long
HEAVY = 5_000
SUFFIXES = 100_000  # sorted at once
KEEP_SEEN = 500_000  # segments a task remembers having sent

KEY = ("k1", "k2")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same smallest gram: its hash, first window, number of windows, places.

    ``places`` is the number of positions of the gram in the document, on its first
    segment only: a gram with one place in the corpus is in no repeated window.
    """
    if len(h) < window:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    g, width = windows(h, gram), window - gram + 1
    low = _sliding_min(g, width)
    change = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    lengths = np.diff(np.r_[change, len(low)])
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(change)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = change[owner] + nth * SEGMENT
    v = low[start]
    # a position counts if it is the smallest of some window around it
    none = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    highest = ~_sliding_min(np.concatenate([none, ~low, none]), width)
    values, count = np.unique(g[highest == g], return_counts=True)
    own, first = np.unique(v, return_index=True)
    places = np.zeros(len(v), np.int64)
    places[first] = count[np.searchsorted(values, own)]
    return v, start, np.minimum(SEGMENT, change[owner] + lengths[owner] - start), places


class Subtree:
    """The suffix tree of some suffixes: their order, and the common prefix lengths of neighbours.

    ``ends`` are the ends of the texts that the suffixes are of. The node of depth ``d``
    above a leaf is the run of neighbours around it that agree in ``d`` words or more.
    """

    def __init__(self, w: np.ndarray, suffixes: np.ndarray, ends: np.ndarray):
        self.w, self.suffixes = w, suffixes
        lengths = ends - suffixes
        width = int(lengths.max(initial=0))
        at = suffixes[:, None] + np.arange(width)
        inside = np.arange(width) < lengths[:, None]
        rows = np.where(inside, w[np.minimum(at, len(w) - 1)], 0).astype(">u4")  # bytes in the order of numbers
        self.order = np.argsort(np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * width))).ravel(), kind="stable") if width else np.arange(len(suffixes))
        rows, lengths = rows[self.order], lengths[self.order]
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(max(len(rows) - 1, 0), np.int64)
        self.common = np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))

    def repeated(self, depth: int) -> np.ndarray:
        """Which suffixes are below a node of this depth or more."""
        out = np.zeros(len(self.suffixes), bool)
        deep = self.common >= depth
        out[self.order[1:][deep]] = True
        out[self.order[:-1][deep]] = True
        return out

    def nodes(self, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """Depth and suffixes of every internal node of ``depth`` or more, inner nodes first."""
        stack: list[tuple[int, int]] = []
        for i, c in enumerate([*self.common.tolist(), 0], start=1):
            first = i - 1
            while stack and stack[-1][0] > c:
                d, first = stack.pop()
                yield d, self.suffixes[self.order[first:i]]
            if c >= depth and (not stack or stack[-1][0] < c):
                stack.append((c, first))


def repeated(w: np.ndarray, suffixes: np.ndarray, window: int = WINDOW, budget: int = SUFFIXES, ends: np.ndarray | None = None) -> np.ndarray:
    """Which of the suffixes (positions in the words ``w``) share their first ``window`` words with another."""
    out = np.zeros(len(suffixes), bool)
    ends = np.full(len(suffixes), len(w)) if ends is None else ends

    def subtree(which: np.ndarray, depth: int) -> None:
        if depth == window:
            out[which] = len(which) > 1
            return
        if len(which) <= budget:
            at = suffixes[which]
            out[which] = Subtree(w, at + depth, np.minimum(ends[which], at + window)).repeated(window - depth)
            return
        word = w[suffixes[which] + depth]
        which = which[np.argsort(word, kind="stable")]
        word = w[suffixes[which] + depth]
        edges = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(which)]
        i = 0
        while i < len(edges) - 1:  # neighbouring small groups together, a large one deeper
            j = i + 1
            while j < len(edges) - 1 and edges[j + 1] - edges[i] <= budget:
                j += 1
            group = which[edges[i] : edges[j]]
            subtree(group, depth + 1 if len(group) > budget else depth)
            i = j

    if len(suffixes) > 1:
        subtree(np.arange(len(suffixes)), 0)
    return out


def _laid_out(contents: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, the suffix positions in them, and the content each belongs to."""
    lengths = np.array([len(x) for x in contents])
    base = np.cumsum(lengths) - lengths
    n = lengths - window + 1
    owner = np.repeat(np.arange(len(contents)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate(contents), base[owner] + nth, owner


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _found(docs: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, v, start, n, places)``: the segments of every document."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [segments(word_hashes(words(raw.as_py())), window) for raw in b.column(2)]
            count = [len(p[0]) for p in parts]
            repeat = np.repeat(np.arange(b.num_rows), count)
            v, start, n, places = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(repeat)), b.column(1).take(pa.array(repeat)), pa.array(v.view(np.int64)),
                 pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(places.astype(np.int32))],
                ["k1", "k2", "v", "start", "n", "places"],
            )

    return docs.mapInArrow(task, "k1 long, k2 long, v long, start int, n int, places int")


def _compressed(docs: DataFrame) -> DataFrame:
    """Texts as they travel through a shuffle."""

    def task(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array([z.compress(raw.as_py()) for raw in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["k1", "k2", "z"])

    return docs.mapInArrow(task, "k1 long, k2 long, z binary")


def _contents(rows: DataFrame, window: int) -> DataFrame:
    """Per segment the digest ``c`` of its words; the words where a task meets them first."""

    def task(batches):
        z, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            out: list[tuple] = []
            for k1, k2, raw, segs in zip(*(b.column(i).to_pylist() for i in range(4))):
                h = (word_hashes(words(z.decompress(raw))) >> np.uint64(32)).astype("<u4")
                for s in segs:
                    content = h[s["start"] : s["start"] + s["n"] + window - 1].tobytes()
                    c = xxhash.xxh3_128_digest(content)
                    new = c not in seen
                    if new:
                        if len(seen) >= KEEP_SEEN:
                            seen.clear()
                        seen.add(c)
                    out.append((k1, k2, s["start"], s["n"], s["v"], s["heavy"], c, content if new else None))
                if len(out) >= 20_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    def _rows(out):
        columns = list(zip(*out)) if out else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        names = ("k1", "k2", "start", "n", "v", "heavy", "c", "words")
        return _batch({x: (col, t) for x, col, t in zip(names, columns, kinds)})

    return rows.mapInArrow(
        task, "k1 long, k2 long, start int, n int, v long, heavy boolean, c binary, words binary"
    )


def _tree_marks(contents: DataFrame, window: int) -> DataFrame:
    """``(c, mask)`` of contents ``(v, c, words)``: windows that occur at another place in the same subtree."""

    def marks(ids, own):
        if not own:
            return _batch({"c": ([], pa.binary()), "mask": ([], pa.int64())})
        w, suffixes, owner = _laid_out(own, window)
        hit = repeated(w, suffixes, window)
        first = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
        nth = np.arange(len(owner)) - first[owner]
        mask = np.zeros(len(own), np.uint64)
        np.bitwise_or.at(mask, owner[hit], np.uint64(1) << nth[hit].astype(np.uint64))
        some = mask != 0
        return _batch({"c": ([c for c, on in zip(ids, some) if on], pa.binary()), "mask": (mask[some].view(np.int64), pa.int64())})

    def task(batches):
        ids, own, size, last, last_c = [], [], 0, None, None
        for b in batches:
            for v, c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if v != last and size >= SUFFIXES:
                    yield marks(ids, own)
                    ids, own, size = [], [], 0
                if v == last and c == last_c:
                    continue  # the same words, from another task
                last, last_c = v, c
                ids.append(c)
                own.append(np.frombuffer(raw.as_py(), "<u4"))
                size += len(own[-1]) - window + 1
        yield marks(ids, own)

    return contents.repartition("v").sortWithinPartitions("v", "c").mapInArrow(task, "c binary, mask long")


def _heavy_marks(contents: DataFrame, window: int) -> DataFrame:
    """The same for grams with very many segments: each window is a group of its own, counted."""

    def task(batches):
        for b in batches:
            for c, raw in zip(b.column(1).to_pylist(), b.column(2)):
                words = raw.as_py()
                n = len(words) // 4 - window + 1
                digests = [xxhash.xxh3_128_digest(words[4 * i : 4 * (i + window)]) for i in range(n)]
                yield _batch({"c": ([c] * n, pa.binary()), "i": (np.arange(n, dtype=np.int32), pa.int32()), "w": (digests, pa.binary())})

    w = contents.mapInArrow(task, "c binary, i int, w binary")
    often = w.groupBy("w").agg(F.count("*").alias("times")).filter("times > 1").select("w")
    bit = F.expr("shiftleft(1L, i)")
    return w.join(often, "w", "left_semi").groupBy("c").agg(F.bit_or(bit).alias("mask"))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row: the text without words of repeated windows.

    Windows are judged on the input. ``kept`` is joined by single spaces. Null texts
    and those without words have 0 words; fewer than a window stay as they are. Two
    rows with the same id and text are two places. Words are compared by 32 bits of
    their hash, all 35 of them: two windows that differ agree with a chance of 2^-32
    or less. Segments and windows are known by 128 bits.
    """
    d = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(text_col).alias("k2"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"),
    )
    segs = stored(_found(d, window), "substr-segments")
    often = segs.groupBy("v").agg(F.sum("places").alias("times")).filter("times > 1")
    mine = segs.join(often, "v").groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "n", "v", (F.col("times") > HEAVY).alias("heavy"))).alias("segs")
    )
    met = _compressed(d).join(mine, list(KEY)).select(*KEY, "z", "segs")
    placed = stored(_contents(met, window), "substr-contents")
    sent = placed.filter("words IS NOT NULL").select("v", "c", "words", "heavy")
    copies = placed.groupBy("c").agg(F.count("*").alias("times"), F.max("n").alias("n")).filter("times > 1")
    all_of = F.expr("shiftleft(1L, n) - 1L")
    marks = (
        _tree_marks(sent.filter("NOT heavy").select("v", "c", "words"), window)
        .unionByName(_heavy_marks(sent.filter("heavy").select("v", "c", "words"), window))
        .unionByName(copies.select("c", all_of.alias("mask")))
    )
    marks = stored(marks.groupBy("c").agg(F.bit_or("mask").alias("mask")), "substr-marks")
    hits = placed.select(*KEY, "start", "c").join(marks, "c").groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "mask")).alias("hits")
    )

    def task(batches):
        z = zstandard.ZstdDecompressor()
        bits = np.arange(64, dtype=np.uint64)
        for b in batches:
            ids, n_words, removed, kept = [], [], [], []
            for k1, raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = words(z.decompress(raw))
                if found:
                    starts = np.array([f["start"] for f in found])
                    on = (np.array([f["mask"] for f in found], np.int64).view(np.uint64)[:, None] >> bits) & np.uint64(1)
                    i, bit = np.nonzero(on)
                    at = starts[i] + bit
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    left = [x for x, gone in zip(w, covered.tolist()) if not gone]
                else:
                    left = w
                ids.append(None if k1 == NULL_ID else k1)
                n_words.append(len(w))
                removed.append(len(w) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            yield _batch({
                "doc_id": (ids, pa.int64()), "n_words": (n_words, pa.int64()), "n_removed": (removed, pa.int64()),
                "kept": (kept, pa.string()),
            })

    rows = _compressed(d).join(hits, list(KEY), "left").select("k1", "z", "hits")
    return rows.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """The same with a digest of the text that is kept."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
