"""Sparse TF-IDF features: a fitted vocabulary, rows of indices and values, and blocks of rows.

Solvers read blocks, each of a bounded number of entries in one row of a cached table, so
that a pass over the data is a matrix operation per block and not a call per row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.weights import TermOptions, count_of, counted, idf, postings, term_stats, vocabulary
from shelfwise.session import shared_dir, stored

BLOCK_ROWS = 256
BLOCK_ENTRIES = 1 << 17


@dataclass(frozen=True)
class Features:
    """A fitted vocabulary ``(term, idx, weight)``: at most ``max_features`` rows."""

    terms: DataFrame
    size: int
    options: TermOptions
    prepare: Callable[[Column], Column]

    def transform(self, df: DataFrame, row_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
        """``(row_id, *keep, indices, values)``, unit length; a text without known terms has empty arrays.

        The vocabulary is bounded by ``max_features`` and goes to the rows, so vectors are
        made where the texts are read, without a shuffle.
        """
        texts = df.select(row_id, *keep, self.prepare(F.col(text)).alias("_text"))
        rows = counted(texts, row_id, "_text", self.options, keep)
        first = rows.columns[:-2]
        known = {r.term: (r.idx, r.weight) for r in self.terms.collect()}
        shared = shipped(df.sparkSession, known)
        sublinear = self.options.sublinear_tf
        fields = [
            *rows.schema.fields[:-2], T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
        ]

        def task(batches: Iterable[pa.RecordBatch]):
            known = shared()
            for b in batches:
                indices, values, ends = [], [], [0]
                for terms, tfs in zip(b.column(len(first)).to_pylist(), b.column(len(first) + 1).to_pylist()):
                    own = sorted((*known[t], tf) for t, tf in zip(terms, tfs) if t in known)
                    i, weight, tf = np.array(own, float).reshape(-1, 3).T
                    w = (np.log(tf) + 1.0 if sublinear else tf) * weight
                    indices.append(i.astype(np.int32))
                    values.append(w / np.sqrt((w * w).sum()) if len(w) else w)
                    ends.append(ends[-1] + len(w))
                ends = pa.array(ends, pa.int32())
                lists = [
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v) if v else np.empty(0), t))
                    for v, t in ((indices, pa.int32()), (values, pa.float64()))
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(first)], *lists], [*first, "indices", "values"])

        return rows.mapInArrow(task, T.StructType(fields))


def fit_features(
    df: DataFrame, row_id: str, text: str, options: TermOptions, prepare: Callable[[Column], Column]
) -> Features:
    """Vocabulary and weights of the training rows.

    Indices run in term order over at most ``max_features`` rows. The table is
    written to the shared folder once; fitting, training and scoring read it.
    """
    if options.max_features is None:
        raise ValueError("a model needs max_features: its size grows with the vocabulary")
    shared_dir(df.sparkSession)
    n_docs = count_of(df)
    texts = df.select(row_id, prepare(F.col(text)).alias("_text"))
    kept = vocabulary(term_stats(postings(texts, row_id, "_text", options)), n_docs, options)
    terms = kept.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"),
        idf(n_docs).alias("weight"),
    )
    terms = stored(terms, "features")
    return Features(terms, terms.count(), options, prepare)


@dataclass
class Rows:
    """Rows in compressed form: entry ``e`` of row ``r`` is at ``starts[r] <= e < starts[r + 1]``."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of(cls, indices: pa.Array, values: pa.Array) -> Rows:
        counts = np.array([len(x) for x in indices], np.int64)
        return cls(
            np.concatenate([[0], np.cumsum(counts)]),
            indices.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
            values.flatten().to_numpy(zero_copy_only=False).astype(np.float64),
        )

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def part(self, a: int, b: int) -> Rows:
        at = slice(self.starts[a], self.starts[b])
        return Rows(self.starts[a : b + 1] - self.starts[a], self.indices[at], self.values[at])

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The product with a matrix that has a row per feature."""
        out = np.zeros((len(self), dense.shape[1]))
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            out[full] = np.add.reduceat(dense[self.indices] * self.values[:, None], self.starts[full], axis=0)
        return out

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries by feature: their order, the features, and where each begins."""
        order = np.argsort(self.indices, kind="stable")
        features, begins = np.unique(self.indices[order], return_index=True)
        return order, features, begins

    def transposed_times(self, dense: np.ndarray, by_column) -> tuple[np.ndarray, np.ndarray]:
        """Features that occur, and the rows of the product of the transpose with a matrix that has a row per row."""
        order, features, begins = by_column
        if not len(features):
            return features, np.zeros((0, dense.shape[1]))
        cells = dense[self.row_of()[order]] * self.values[order, None]
        return features, np.add.reduceat(cells, begins, axis=0)


def slices(rows: Rows) -> Iterable[tuple[int, int]]:
    """Ranges of rows with a bounded number of entries each; a longer row is one of its own."""
    a = 0
    while a < len(rows):
        b = int(np.searchsorted(rows.starts, rows.starts[a] + BLOCK_ENTRIES, "right")) - 1
        b = max(a + 1, min(b, a + BLOCK_ROWS, len(rows)))
        yield a, b
        a = b


def blocks(rows: DataFrame, levels: Sequence[str], labels: dict[str, list[str]], row_id: str) -> DataFrame:
    """``(n, payload)``: rows in compressed form with ``codes`` and ``keys``, read by ``unpickled``.

    ``codes`` has a column per level: a label's place in its list, -1 for null. ``keys``
    are hashes of the row ids, for draws that do not depend on how rows were dealt.
    """
    shared = shipped(rows.sparkSession, [{v: i for i, v in enumerate(labels[level])} for level in levels])

    def task(batches: Iterable[pa.RecordBatch]):
        places = shared()
        for b in batches:
            x = Rows.of(b.column(0), b.column(1))
            keys = b.column(2).to_numpy()
            codes = np.empty((len(x), len(places)), np.int32)
            for j, place in enumerate(places):
                codes[:, j] = [place.get(v, -1) for v in b.column(3 + j).to_pylist()]
            for i, j in slices(x):
                own = x.part(i, j)
                payload = pickle.dumps((own.starts, own.indices, own.values, codes[i:j], keys[i:j]))
                yield pa.RecordBatch.from_arrays([pa.array([j - i], pa.int64()), pa.array([payload], pa.binary())], ["n", "payload"])

    spark = rows.sparkSession
    columns = ["indices", "values", F.xxhash64(F.col(row_id).cast("string")).alias("_key"), *[F.col(v).cast("string") for v in levels]]
    packed = stored(rows.select(*columns).mapInArrow(task, "n long, payload binary"), "blocks")
    # a table of one file is dealt out, a block at least to a task: passes are many and costly
    return packed.repartition(max(1, min(packed.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))))


def unpickled(batches: Iterable[pa.RecordBatch]):
    """``(Rows, codes, keys)`` of blocks, one at a time."""
    for b in batches:
        for payload in b.column(b.schema.get_field_index("payload")):
            starts, indices, values, codes, keys = pickle.loads(payload.as_py())
            yield Rows(starts, indices, values), codes, keys


def shipped(spark, value) -> Callable:
    """A function that returns ``value`` on a worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
