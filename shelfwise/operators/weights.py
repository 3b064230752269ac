"""Term statistics and weights over ``(doc, term, tf)`` postings.

The terms of a text are counted where it is read, in one row per document, so that no
text is shuffled and counts per document need no aggregate. Flows that read the postings
more than once write these rows and read them back; a text is tokenized once. Per-term
work is partially aggregated first, so a term that occurs in every document costs one row
per task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import prep_model_text
from shelfwise.functions.tokens import drop_stopwords, tokenize
from shelfwise.session import stored

WORDS = 1 << 17  # words counted at once
EPSILON = 1e-9  # fixed value: keeps logarithms and divisions finite


@dataclass(frozen=True)
class TermOptions:
    """Which terms count and how often."""

    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 1
    max_df: float = 1.0  # share of the documents
    max_features: int | None = None
    sublinear_tf: bool = False
    stopwords: tuple[str, ...] = ()


def term_codes(tokens: pa.ListArray, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and of each text: which it has, how often, and where its own begin.

    n-grams of ``low`` to ``high`` words are made of the flat words of all texts. Nulls have none.
    """
    sizes = tokens.value_lengths().fill_null(0).to_numpy()
    words = tokens.flatten().cast(pa.string())
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams, owners = [], []
    for n in range(low, high + 1):
        count = max(0, len(words) - n + 1)
        whole = np.flatnonzero(text[:count] == text[len(words) - count :])
        parts = [words.take(pa.array(whole + i)) for i in range(n)]
        grams.append(parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "))
        owners.append(text[whole])
    coded = pa.chunked_array(grams, pa.string()).combine_chunks().dictionary_encode()
    found = pa.table({"text": np.concatenate(owners), "code": coded.indices}).group_by(["text", "code"], use_threads=False)
    found = found.aggregate([([], "count_all")])
    text, codes, tfs = (found.column(c).to_numpy() for c in ("text", "code", "count_all"))
    order = np.argsort(text, kind="stable")
    return coded.dictionary, codes[order], tfs[order], np.searchsorted(text[order], np.arange(len(sizes) + 1))


def text_tokens(df: DataFrame, doc: str, text: str, options: TermOptions, keep: Iterable[str] = ()) -> DataFrame:
    """``(doc, *keep, _t)``: the words of each row's text that count."""
    return df.select(doc, *keep, drop_stopwords(tokenize(prep_model_text(text)), options.stopwords).alias("_t"))


def word_slices(tokens: pa.ListArray, at_most: int | None = None) -> Iterable[tuple[int, int]]:
    """Ranges of texts of at most ``at_most`` words, or ``WORDS``; a longer text is one of its own."""
    at_most = at_most or WORDS
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())
    a = 0
    while a < len(tokens):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + at_most, "right")))
        yield a, b
        a = b


def counted(df: DataFrame, doc: str, text: str, options: TermOptions = TermOptions(), keep: Iterable[str] = ()) -> DataFrame:
    """``(doc, *keep, terms, tfs)``: the terms of each row's text and how often each is there.

    Words come from column expressions; joining and counting them is columnar work over
    slices of a bounded number of words, so a task's memory does not grow with its rows.
    """
    keep = list(keep)
    low, high = options.ngram_range
    rows = text_tokens(df, doc, text, options, keep)
    first = rows.columns[:-1]
    fields = [
        *rows.schema.fields[:-1], T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ]

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i, j in word_slices(b.column(len(first))):
                own = b.slice(i, j - i)
                terms, codes, tfs, starts = term_codes(own.column(len(first)), low, high)
                starts = pa.array(starts, pa.int32())
                lists = [pa.ListArray.from_arrays(starts, v) for v in (terms.take(pa.array(codes)), pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(first)], *lists], [*first, "terms", "tfs"])

    return rows.mapInArrow(task, T.StructType(fields))


def exploded(rows: DataFrame, doc: str, keep: Iterable[str] = (), keep_empty: bool = False) -> DataFrame:
    """``(doc, *keep, term, tf)`` of counted rows; with ``keep_empty`` a row without terms has one with a null term."""
    each = F.inline_outer if keep_empty else F.inline
    cells = rows.select(doc, *keep, each(F.arrays_zip("terms", "tfs")))
    return cells.select(doc, *keep, F.col("terms").alias("term"), F.col("tfs").cast("long").alias("tf"))


def postings(
    df: DataFrame,
    doc: str,
    text: str,
    options: TermOptions = TermOptions(),
    keep: Iterable[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """``(doc, *keep, term, tf)``, the number of times a term is in a document."""
    keep = list(keep)
    return exploded(counted(df, doc, text, options, keep), doc, keep, keep_empty)


def count_of(df: DataFrame) -> Column:
    """Row count as a value usable in any expression."""
    return df.agg(F.count("*").alias("n")).scalar()


def term_stats(posted: DataFrame) -> DataFrame:
    """Documents, occurrences and squared occurrences per term."""
    return posted.groupBy("term").agg(
        F.count("*").alias("df"),
        F.sum("tf").alias("cf"),
        F.sum(F.col("tf") * F.col("tf")).alias("tf2"),
    )


def vocabulary(stats: DataFrame, n_docs: Column, options: TermOptions) -> DataFrame:
    """The terms the options admit: document limits first, then the most frequent."""
    kept = stats.where(F.col("df") >= options.min_df)
    if options.max_df < 1.0:
        kept = kept.where(F.col("df") <= options.max_df * n_docs)
    if options.max_features is not None:
        kept = kept.orderBy(F.desc("cf"), "term").limit(options.max_features)
    return kept


def idf(n_docs: Column) -> Column:
    """Smoothed inverse document frequency, plus one."""
    return F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0


def term_frequency(options: TermOptions) -> Column:
    tf = F.col("tf").cast("double")
    return F.log(tf) + 1.0 if options.sublinear_tf else tf


def icf_tdcb(n_docs: Column) -> Column:
    """Inverse class frequency times term distribution concentration.

    ``n_docs`` is the number of rows, as in the original weighting, although the
    name suggests the number of classes.
    """
    icf = F.log(n_docs / (F.col("df") + EPSILON))
    occurrences = F.col("cf") + EPSILON
    tdcb = 1.0 - F.col("tf2") / (occurrences * occurrences)
    return F.greatest(icf * tdcb, F.lit(EPSILON))


def icf_tdcb_weights(posted: DataFrame, n_docs: Column, min_df: int = 1) -> DataFrame:
    """``(term, weight)``."""
    stats = term_stats(posted).where(F.col("df") >= min_df)
    return stats.select("term", icf_tdcb(n_docs).alias("weight"))


def weighted_postings(posted: DataFrame, weights: DataFrame, options: TermOptions) -> DataFrame:
    """Postings of the weighted terms and ``w = tf * weight``, not normalized.

    The vocabulary grows with the texts, and its compressed size says little
    about its size in memory, so the sides meet by shuffle. A frequent term makes
    this skewed on the postings side only; terms are unique on the other, so AQE
    splits the hot partitions and no build side is ever large.
    """
    return posted.join(weights, "term").withColumn("w", term_frequency(options) * F.col("weight"))


def unit_postings(weighted: DataFrame, doc: str) -> DataFrame:
    """Weights scaled to unit length per document."""
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return weighted.withColumn("w", F.col("w") / length)


def tfidf(
    df: DataFrame, doc: str, text: str, options: TermOptions, keep: Iterable[str] = ()
) -> DataFrame:
    """L2-normalized TF-IDF: ``(doc, *keep, term, w)``. A text is counted once.

    Texts are weighted in blocks that are told of their terms. A bounded vocabulary
    (``max_features``) meets the postings instead.
    """
    from shelfwise.operators import termblocks as tb  # it counts with what is above

    keep = list(keep)
    if options.max_features is not None:
        posted = exploded(stored(counted(df, doc, text, options, keep), "counted"), doc, keep)
        n_docs = count_of(df)
        weights = vocabulary(term_stats(posted), n_docs, options).select("term", idf(n_docs).alias("weight"))
        return unit_postings(weighted_postings(posted, weights, options), doc).select(doc, *keep, "term", "w")
    blocks = tb.term_blocks(df, doc, text, options, keep)
    answers, n_docs = tb.found(blocks, tb.rows_having), df.count()
    names = [doc, *keep, "term", "w"]
    schema = T.StructType([*blocks[0].schema, T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])

    def rows(unit: bool):
        def of(_, block, told):
            row, code, w, _ = tb.tfidf_entries(block, told, n_docs, options, unit)
            return tb.postings_of(block, row, code, w, names=names)

        return of

    out = tb.met(blocks[0], answers, schema, rows(True))
    for again in blocks[1:]:
        out = out.unionByName(unit_postings(tb.met(again, answers, schema, rows(False)), doc))
    return out
