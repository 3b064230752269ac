"""Pairs of similar texts: an exact cosine join over sparse term vectors.

Only terms that some query has can add to a cosine; the others count in a text's length
alone. Vectors of the known terms are packed in blocks of a bounded number of cells, and
every block of items meets every block of queries: their products are summed up by an
inverted index of the queries of the block, where the item lies. No pair of texts is a row
before its cosine is known, and no text moves for a pair.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.operators.weights import TermOptions, count_of, counted, exploded, idf, term_frequency, term_stats, vocabulary
from shelfwise.session import stored

CELLS = 1 << 16  # of a block; a longer text is one of its own
PRODUCTS = 1 << 20  # products of cells held at a time


def known_vectors(rows: DataFrame, row_id: str, weights: DataFrame, options: TermOptions) -> DataFrame:
    """``(row_id, square, cells)`` of counted rows: the squared length of all terms, and ``(place, w)`` of those with a place.

    A row without such terms is left out, as is one without an id.
    """
    w = term_frequency(options) * F.col("weight")
    cells = exploded(rows.where(F.col(row_id).isNotNull()), row_id).join(weights, "term").select(row_id, "place", w.alias("w"))
    known = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "w")))
    return cells.groupBy(row_id).agg(F.sum(F.col("w") * F.col("w")).alias("square"), known.alias("cells")).where(F.size("cells") > 0)


def packed(vectors: DataFrame, side: str, largest: bool) -> DataFrame:
    """``(<side>_ids, <side>_rows, <side>_places, <side>_ws)``: blocks of unit vectors, cells by row and place.

    Texts that share an id are one vector. With ``largest`` a term that it has more than
    once counts by its largest weight, otherwise by all of them.
    """
    kinds = (T.ArrayType(vectors.schema.fields[0].dataType), *[T.BinaryType()] * 3)
    schema = T.StructType([T.StructField(f"{side}_{n}", t) for n, t in zip(("ids", "rows", "places", "ws"), kinds)])
    arrow = to_arrow_schema(schema)

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = flat.field("place").to_numpy()
        w = flat.field("w").to_numpy() / np.sqrt(b.column(1).to_numpy())[row]
        order = np.lexsort((w, place, row))
        row, place, w = row[order], place[order], w[order]
        if largest:
            last = np.append((np.diff(row) != 0) | (np.diff(place) != 0), True)
            row, place, w = row[last], place[last], w[last]
        cells = [b.column(0).to_pylist(), row.astype("<i8").tobytes(), place.astype("<i8").tobytes(), w.astype("<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow)], schema=arrow)

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            ends = np.cumsum(b.column(2).value_lengths().to_numpy())
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS, "right")))
                yield block(b.slice(i, j - i))
                i = j

    return vectors.mapInArrow(task, schema)


def products(item: tuple[np.ndarray, ...], query: tuple[np.ndarray, ...], n_items: int, n_queries: int) -> Iterable[tuple[int, np.ndarray]]:
    """Scores of a block of items with a block of queries, a range of items at a time: its first item and a dense matrix.

    Both are ``(rows, places, ws)``, those of the items in the order of rows.
    """
    order = np.argsort(query[1], kind="stable")
    q_row, q_w = query[0][order], query[2][order]
    places, begins, counts = np.unique(query[1][order], return_index=True, return_counts=True)
    row, place, w = item
    at = np.minimum(np.searchsorted(places, place), len(places) - 1)
    met = places[at] == place
    row, at, w = row[met], at[met], w[met]
    step = max(1, PRODUCTS // max(len(q_row), 1))
    for first in range(0, n_items, step):
        own = slice(*np.searchsorted(row, (first, first + step)))
        n = counts[at[own]]
        if not len(n):
            continue
        cell = np.repeat(begins[at[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair = np.repeat((row[own] - first) * n_queries, n) + q_row[cell]
        size = min(step, n_items - first)
        yield first, np.bincount(pair, np.repeat(w[own], n) * q_w[cell], size * n_queries).reshape(size, n_queries)


def _multiplied(met: DataFrame, schema: T.StructType, at_least: float) -> DataFrame:
    """``(item, query, score)`` of blocks that meet, from ``at_least`` on."""
    arrow = to_arrow_schema(schema)

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                sides = []
                for c in (0, 4):
                    cells = [np.frombuffer(b.column(c + j)[i].as_buffer(), t) for j, t in ((1, "<i8"), (2, "<i8"), (3, "<f8"))]
                    sides.append((b.column(c)[i].values, cells))
                (items, x), (queries, y) = sides
                for first, scores in products(x, y, len(items), len(queries)):
                    item, query = np.nonzero(scores >= at_least)
                    found = [items.take(pa.array(item + first)), queries.take(pa.array(query)), pa.array(scores[item, query])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, arrow)], schema=arrow)

    return met.mapInArrow(task, schema)


def similar_texts(
    items: DataFrame,
    queries: DataFrame,
    item_id: str,
    query_id: str,
    text: str,
    at_least: float,
    options: TermOptions = TermOptions((1, 1)),
) -> DataFrame:
    """``(item, query, score)`` of all pairs whose TF-IDF vectors have a cosine of ``at_least``.

    Weights are those of the items; terms that no item has do not count, so a text
    without known terms is in no pair. ``at_least`` is above 0.
    """
    if at_least <= 0:
        raise ValueError("at_least must be above 0: unrelated texts would be pairs")
    own = stored(counted(items, item_id, text, options), "counted")
    asked = stored(counted(queries, query_id, text, options), "counted-queries")
    stats = vocabulary(term_stats(exploded(own, item_id)), count_of(items), options)
    terms = exploded(asked, query_id).select("term").distinct().withColumn("known", F.lit(True))
    place = F.when(F.col("known"), F.monotonically_increasing_id())  # fixed once it is written
    weights = stats.join(terms, "term", "left").select("term", idf(count_of(items)).alias("weight"), place.alias("place"))
    weights = stored(weights, "weights")
    left = packed(known_vectors(own, item_id, weights, options), "item", True)
    right = packed(known_vectors(asked, query_id, weights.where("place IS NOT NULL"), options), "query", False)
    schema = T.StructType(
        [
            T.StructField("item", items.schema[item_id].dataType), T.StructField("query", queries.schema[query_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return _multiplied(stored(left, "item-blocks").crossJoin(stored(right, "query-blocks")), schema, at_least)
