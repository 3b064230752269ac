"""Counts of terms in blocks of texts, and how a block meets what is known of its terms.

A block holds the counts of a bounded number of words: its distinct terms once, in the order
of a hash, and for each row places among these. What moves is cut from blocks and squeezed:
a block's terms by ranges of their hash, what is found for them back to the block, and the
block itself once. So a term moves once per block and not once per text, and the weights of a
text are worked out where all its terms are.

The rows of an id that repeats may lie in several blocks; ``split_ids`` sets them apart.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.operators.weights import TermOptions, term_codes, text_tokens, word_slices
from shelfwise.session import stored

BLOCK_WORDS = 1 << 19
BLOCK_ROWS = 1 << 16
FEW_TERMS, MANY_TERMS = 1 << 16, 1 << 21  # of all blocks, in a range of hashes
OUT_ROWS = 1 << 16  # in a batch of postings


def squeezed(value) -> bytes:
    raw = pickle.dumps(value, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def restored(data: bytes):
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def planes(x: np.ndarray, kind=np.int32) -> np.ndarray:
    """The bytes of whole numbers, lowest ones first: the high ones of small numbers squeeze to nothing."""
    x = np.ascontiguousarray(x, kind)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def from_planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view(np.int64 if len(x) == 8 else np.int32).ravel()


def text_of(strings: pa.StringArray) -> tuple[np.ndarray, bytes]:
    """Lengths, in a byte each if they are short, and bytes of strings without nulls."""
    if not len(strings):
        return np.empty(0, np.uint8), b""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    sizes = np.diff(ends)
    return sizes.astype(np.uint8) if sizes.max() < 256 else sizes, data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b""


def strings_of(sizes: np.ndarray, data: bytes) -> pa.StringArray:
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


def hashes(strings: pa.StringArray) -> np.ndarray:
    """Hashes of strings, the same everywhere: equal strings are equal, others may be."""
    sizes, data = text_of(strings)
    sizes = sizes.astype(np.int64)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
            at = np.arange(len(data)) - np.repeat(starts, sizes)
            out[full] = np.add.reduceat((np.frombuffer(data, np.uint8) + np.uint64(1)) * powers[at], starts[full])
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                out = (out ^ (out >> np.uint64(shift))) * np.uint64(by)
    return out ^ (out >> np.uint64(31))


def _gathered(batches: Iterable[pa.RecordBatch], tokens: int) -> Iterable[pa.RecordBatch]:
    """The rows of batches in slices of about ``BLOCK_WORDS`` words, also over small batches."""
    held, words, rows = [], 0, 0
    for b in batches:
        for i in range(0, b.num_rows, BLOCK_ROWS):
            some = b.slice(i, BLOCK_ROWS)
            for j, k in word_slices(some.column(tokens), BLOCK_WORDS):
                own = some.slice(j, k - j)
                n = pc.sum(own.column(tokens).value_lengths()).as_py() or 0
                if held and (words + n > BLOCK_WORDS or rows + len(own) > BLOCK_ROWS):
                    yield pa.concat_batches(held)
                    held, words, rows = [], 0, 0
                held.append(own)
                words, rows = words + n, rows + len(own)
    if held:
        yield pa.concat_batches(held)


def split_ids(df: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is theirs alone, and the others, if any."""
    again = stored(df.groupBy(F.col(doc).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "repeated-ids")
    if again.isEmpty():
        return df, None
    same = df[doc].eqNullSafe(again["_id"])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


class TermBlocks:
    """Written blocks: ``(block, n_terms, terms, docs)``, read by ``terms_of`` and ``Block``."""

    def __init__(self, df: DataFrame, doc: str, text: str, options: TermOptions, keep: Iterable[str] = (), number: int = 0):
        self.number = number  # 0 or 1, a bit of the ids of blocks
        low, high = options.ngram_range
        rows = text_tokens(df, doc, text, options, list(keep))
        n = len(rows.columns) - 1
        self.schema = T.StructType(rows.schema.fields[:-1])

        def task(batches: Iterable[pa.RecordBatch]):
            first = TaskContext.get().partitionId() << 32 | number << 31
            for i, own in enumerate(_gathered(batches, n)):
                terms, codes, tfs, starts = term_codes(own.column(n), low, high)
                order = np.argsort(hashes(terms), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                text = np.repeat(np.arange(len(own)), np.diff(starts))
                codes = place[codes]
                by_place = np.argsort(text * max(len(order), 1) + codes, kind="stable")
                codes, tfs = codes[by_place], tfs[by_place]
                known = text_of(terms.take(pa.array(order))), np.bincount(codes, minlength=len(order))
                docs = pa.RecordBatch.from_arrays(own.columns[:n], names=own.schema.names[:n]).serialize().to_pybytes()
                counts = docs, planes(np.diff(starts)), planes(np.diff(codes, prepend=0)), planes(tfs, np.int32)
                cells = ([first + i], pa.int64()), ([len(order)], pa.int64()), ([squeezed(known)], pa.binary()), ([squeezed(counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(*c) for c in cells], ["block", "n_terms", "terms", "docs"])

        self.table = stored(rows.mapInArrow(task, "block long, n_terms long, terms binary, docs binary"), "term-blocks")


def term_blocks(df: DataFrame, doc: str, text: str, options: TermOptions, keep: Iterable[str] = ()) -> list[TermBlocks]:
    """Blocks of the rows whose id is theirs alone, then those of the others, if any."""
    alone, again = split_ids(df, doc)
    return [TermBlocks(part, doc, text, options, keep, i) for i, part in enumerate((alone, again)) if part is not None]


class Block:
    """The rows of a block and their counts, by row: row ``i`` has entries ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, terms: bytes, docs: bytes, schema: pa.Schema):
        (sizes, data), _ = restored(terms)
        docs, counts, codes, tfs = restored(docs)
        self.terms = strings_of(sizes, data)
        self.docs = pa.ipc.read_record_batch(pa.py_buffer(docs), schema)
        self.counts = from_planes(counts).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.codes, self.tfs = np.cumsum(from_planes(codes), dtype=np.int64), from_planes(tfs)


def _cuts(terms: pa.StringArray, parts: int) -> np.ndarray:
    """Where the ranges of hashes begin and end in terms in the order of their hash."""
    at = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes(terms), at), [len(terms)]])


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterable[tuple[int, list[tuple[int, bytes]]]]:
    """``(p, [(block, piece)])`` of rows ``(p, block, piece)`` sorted by ``p``."""
    now, own = None, []
    for b in batches:
        for p, block, piece in zip(*(b.column(i).to_pylist() for i in range(3))):
            if p != now and own:
                yield now, own
                own = []
            now = p
            own.append((block, piece))
    if own:
        yield now, own


def found(blocks: list[TermBlocks], look: Callable[[pa.StringArray, np.ndarray, list], Callable], values: Callable[[int], DataFrame] | None = None, n_values: int = 0) -> DataFrame:
    """``(block, p, found)``: what there is for the terms of each block, range by range of their hash.

    ``look(terms, df, others)`` gets the distinct terms of all blocks in a range, the number of rows
    that have each, and the pieces that ``values`` has there for the number of ranges it is given. It
    returns what a block is told of some of them, by their places.
    """
    parts = range_count(blocks, n_values)
    pieces = _pieces(blocks[0].table, parts)
    for more in [_pieces(b.table, parts) for b in blocks[1:]] + ([values(parts)] if values else []):
        pieces = pieces.unionByName(more)

    def task(batches: Iterable[pa.RecordBatch]):
        for p, own in _ranges(batches):
            others = [restored(piece) for block, piece in own if block < 0]
            cells = [(block, *restored(piece)) for block, piece in own if block >= 0]
            if not cells:
                continue
            coded = pa.chunked_array([strings_of(*text) for _, text, _ in cells]).combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy()
            df = np.bincount(codes, np.concatenate([d for *_, d in cells]), len(coded.dictionary)).astype(np.int64)
            tell = look(coded.dictionary, df, others)
            at = 0
            for block, _, d in cells:
                told = squeezed(tell(codes[at : at + len(d)]))
                at += len(d)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([p], pa.int32()), pa.array([told], pa.binary())], ["block", "p", "found"])

    return stored(_by_range(pieces, parts).mapInArrow(task, "block long, p int, found binary"), "found-terms")


def range_count(blocks: list[TermBlocks], more: int = 0) -> int:
    """Ranges of hashes: a task holds the terms of one, so their number grows with the blocks."""
    n_terms = more + sum(b.table.agg(F.sum("n_terms")).first()[0] or 0 for b in blocks)
    wanted = max(1, int(blocks[0].table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(wanted, -(-n_terms // FEW_TERMS)), -(-n_terms // MANY_TERMS))


def _by_range(pieces: DataFrame, parts: int) -> DataFrame:
    return pieces.repartitionById(parts, F.col("p")).sortWithinPartitions("p", "block")


def pieces_of(block: int, terms: pa.StringArray, parts: int, code: np.ndarray | None, *columns: np.ndarray, also=lambda a, z: ()) -> pa.RecordBatch:
    """Columns of terms in the order of their hash, cut by ranges: ``(p, block, piece)``.

    Cells are in the order of ``code``, the places of their terms; without it there is one for each term.
    Columns are numbers or ``planes``. ``also`` gives more of the terms from one place to another.
    """
    cuts = _cuts(terms, parts)
    ends = cuts if code is None else np.searchsorted(code, cuts)
    some = np.flatnonzero(np.diff(ends))
    cells = []
    for p in some.tolist():
        at = slice(ends[p], ends[p + 1])
        places = () if code is None else (planes(np.diff(code[at] - cuts[p], prepend=0)),)
        cells.append(squeezed((text_of(terms.slice(cuts[p], cuts[p + 1] - cuts[p])), *places, *[c[..., at] for c in columns], *also(cuts[p], cuts[p + 1]))))
    arrays = [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(cells, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["p", "block", "piece"])


PIECES = "p int, block long, piece binary"


def _pieces(table: DataFrame, parts: int) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                text, d = restored(data.as_py())
                yield pieces_of(block, strings_of(*text), parts, None, d)

    return table.select("block", "terms").mapInArrow(task, PIECES)


def met(blocks: TermBlocks, answers: DataFrame, schema: T.StructType | str, rows: Callable[[int, Block, list], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``rows(id, block, told)`` for each block, ``told`` being what was found, in the order of its terms."""
    docs = to_arrow_schema(blocks.schema)
    own = blocks.table.select("block", F.lit(-1).alias("p"), F.col("terms").alias("found"), "docs")
    told = answers.where(F.col("block").bitwiseAND(F.lit(1 << 31)) == blocks.number << 31).withColumn("docs", F.lit(None).cast("binary"))
    n = max(1, min(blocks.table.count(), int(blocks.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def task(batches: Iterable[pa.RecordBatch]):
        now, block, parts = None, None, []
        for b in batches:
            for i, p, data, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if p >= 0:
                    parts.append(restored(data.as_py()))
                    continue
                if block is not None:
                    yield from rows(now, block, parts)
                now, block, parts = i, Block(data.as_py(), payload.as_py(), docs), []
        if block is not None:
            yield from rows(now, block, parts)

    return own.unionByName(told).repartition(n, "block").sortWithinPartitions("block", "p").mapInArrow(task, schema)


def each_block(blocks: TermBlocks, schema: T.StructType | str, rows: Callable[[int, Block], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``rows(id, block)`` for each block, where it lies."""
    docs = to_arrow_schema(blocks.schema)

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i, terms, payload in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                yield from rows(i, Block(terms.as_py(), payload.as_py(), docs))

    return blocks.table.select("block", "terms", "docs").mapInArrow(task, schema)


def by_class(code: np.ndarray, classes: np.ndarray, *values: np.ndarray, largest: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Cells ``(code, class, *sums)`` in order, and a value that all entries of a class share."""
    distinct, which = np.unique(classes, return_inverse=True)
    key, first, inverse = np.unique(code * max(len(distinct), 1) + which, return_index=True, return_inverse=True)
    sums = [np.bincount(inverse, v, len(key)) for v in values]
    code, which = np.divmod(key, max(len(distinct), 1))
    return code, distinct[which], *sums, *([] if largest is None else [largest[first]])


def _merged(cells: list[tuple], sums: list[int]) -> tuple:
    """``(terms, places, classes, *columns)`` as one, a cell for each term and class; columns that are not summed up are equal in a cell."""
    coded = pa.chunked_array([c[0] for c in cells]).combine_chunks().dictionary_encode()
    ends = np.cumsum([0, *[len(c[0]) for c in cells]])
    code = coded.indices.to_numpy()[np.concatenate([c[1] + a for c, a in zip(cells, ends)])].astype(np.int64)
    classes, which = np.unique(np.concatenate([c[2] for c in cells]), return_inverse=True)
    key, first, inverse = np.unique(code * max(len(classes), 1) + which, return_index=True, return_inverse=True)
    columns = [np.concatenate(c) for c in zip(*[c[3:] for c in cells])]
    columns = [np.bincount(inverse, c, len(key)) if i in sums else c[first] for i, c in enumerate(columns)]
    code, which = np.divmod(key, max(len(classes), 1))
    return coded.dictionary, code, classes[which], *columns


def summed(pieces: DataFrame, parts: int, schema: T.StructType, sums: list[int], finish: Callable[..., Iterable[pa.RecordBatch]]) -> DataFrame:
    """``finish(terms, places, classes, *columns)`` of all pieces ``(terms, places, classes, *columns)`` of a range,
    the columns ``sums`` added up by term and class."""

    def task(batches: Iterable[pa.RecordBatch]):
        for _, own in _ranges(batches):
            held, n = [], 0
            for _, piece in own:
                text, code, classes, *columns = restored(piece)
                held.append((strings_of(*text), np.cumsum(from_planes(code), dtype=np.int64), from_planes(classes), *[from_planes(c) if c.ndim > 1 else c for c in columns]))
                n += len(held[-1][1])
                if n > MANY_TERMS and len(held) > 1:
                    held = [_merged(held, sums)]
                    n = len(held[0][1])
            yield from finish(*_merged(held, sums))

    return _by_range(pieces, parts).mapInArrow(task, schema)


def slices_of(columns: list[pa.Array], schema: pa.Schema) -> Iterable[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, schema=schema)
    return (whole.slice(a, OUT_ROWS) for a in range(0, len(whole), OUT_ROWS))


def postings_of(block: Block, row: np.ndarray, codes: np.ndarray, *columns: np.ndarray, names: list[str]) -> Iterable[pa.RecordBatch]:
    """``(*the row's columns, term, *columns)`` in batches of bounded size."""
    for a in range(0, len(row), OUT_ROWS):
        at = slice(a, a + OUT_ROWS)
        arrays = [c.take(pa.array(row[at])) for c in block.docs.columns]
        yield pa.RecordBatch.from_arrays([*arrays, block.terms.take(pa.array(codes[at])), *[pa.array(c[at]) for c in columns]], names)


def rows_having(terms: pa.StringArray, counts: np.ndarray, others: list) -> Callable:
    """What ``found`` tells blocks of their terms: the number of rows that have each."""
    return lambda codes: planes(counts[codes], np.int64)


def tfidf_entries(block: Block, told: list, n_docs: int, options: TermOptions, unit: bool) -> tuple[np.ndarray, ...]:
    """``(row, code, w, df)`` of a block's entries that count, scaled to unit length per row or not yet."""
    df = np.concatenate([from_planes(t) for t in told]) if told else np.empty(0, np.int64)
    known = (df >= options.min_df) & ((df <= options.max_df * n_docs) | (options.max_df >= 1.0))
    weight = np.log((n_docs + 1.0) / (df + 1.0)) + 1.0
    at = np.flatnonzero(known[block.codes])
    row, code = block.row[at], block.codes[at]
    tf = block.tfs[at].astype(float)
    w = (np.log(tf) + 1.0 if options.sublinear_tf else tf) * weight[code]
    if unit:
        w /= np.sqrt(np.bincount(row, w * w, len(block.counts)))[row]
    return row, code, w, df
