"""Costly text functions: embedding, translation, and the built-in encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.fixed_values import TRANSLATION_BATCH
from shelfwise.functions.vectors import l2_normalize
from shelfwise.operators.weights import TermOptions, term_codes, text_tokens, word_slices

HEAD_BYTES = 4  # of the term hash, which give the bucket; the next bit its sign


def apply_distinct(
    df: DataFrame,
    text: str,
    name: str,
    make_predict_fn: Callable,
    return_type: T.DataType,
    batch_size: int,
) -> DataFrame:
    """Apply a model to each distinct text once and join the result back.

    ``make_predict_fn`` loads the model on the executor, once per worker, and
    returns a function over a batch of texts. A text is known by its
    digest, so the join moves digests and results. They are unique on the result side, so a text that fills a third of the rows is one call, and its rows
    are split by AQE in the join.
    """
    apply = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size)
    keyed = df.withColumn("_digest", F.sha2(F.col(text), 256))
    results = (
        keyed.where(F.col(text).isNotNull())
        .select("_digest", text)
        .dropDuplicates(["_digest"])
        .select("_digest", apply(F.col(text)).alias(name))
    )
    return keyed.join(results, "_digest", "left").drop("_digest")


def embed_column(
    df: DataFrame, text: str, make_predict_fn: Callable, name: str = "embedding", batch_size: int = 32
) -> DataFrame:
    """Add the embedding of a text column."""
    return apply_distinct(df, text, name, make_predict_fn, T.ArrayType(T.FloatType()), batch_size)


def translate_column(
    df: DataFrame,
    text: str,
    make_predict_fn: Callable,
    name: str = "translated_name",
    batch_size: int = TRANSLATION_BATCH,
) -> DataFrame:
    """Add the translation of a text column."""
    return apply_distinct(df, text, name, make_predict_fn, T.StringType(), batch_size)


def hash_counts(
    df: DataFrame, row_id: str, text: str, dims: int = 64, options: TermOptions = TermOptions()
) -> DataFrame:
    """Signed hashed n-gram counts: ``(row_id, vector)``; every row has a vector.

    The sums of a text are complete where it is read; only rows that share an id are summed
    by a shuffle, which moves ``dims`` numbers of each row. A term is hashed once per slice.
    """
    rows = text_tokens(df, row_id, text, options)
    low, high = options.ngram_range
    schema = T.StructType([rows.schema[row_id], T.StructField("vector", T.ArrayType(T.LongType()))])

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i, j in word_slices(b.column(1)):
                terms, codes, tfs, starts = term_codes(b.column(1).slice(i, j - i), low, high)
                digests = b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in terms.cast(pa.binary()).to_pylist())
                digests = np.frombuffer(digests, np.uint8).reshape(-1, 16)
                bucket = np.ascontiguousarray(digests[:, :HEAD_BYTES]).view(">u4").ravel().astype(np.int64) % dims
                sign = np.where(digests[:, HEAD_BYTES] >= 0x80, -1, 1)
                cell = np.repeat(np.arange(j - i), np.diff(starts)) * dims + bucket[codes]
                sums = np.bincount(cell, sign[codes] * tfs, (j - i) * dims).astype(np.int64)
                ends = pa.array(np.arange(0, len(sums) + 1, dims), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(sums))], [row_id, "vector"])

    sums = [F.sum(F.col("vector")[i]).cast("double") for i in range(dims)]
    return rows.mapInArrow(task, schema).groupBy(row_id).agg(F.array(*sums).alias("vector"))


def hash_embed(
    df: DataFrame, row_id: str, text: str, dims: int = 64, options: TermOptions = TermOptions()
) -> DataFrame:
    """Unit vectors from ``hash_counts``: an encoder that needs no model."""
    return hash_counts(df, row_id, text, dims, options).withColumn("vector", l2_normalize("vector"))
