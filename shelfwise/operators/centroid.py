"""Centroid classifiers over weighted n-grams.

A fitted model keeps for each term the classes whose unit centroids it weighs most in, at
most ``HEAD`` of them in order of impact, and the largest share any other class has in it;
the remaining shares are rows of their own. To find an item's best classes, its terms meet
their heads once. These give each class a score that it has at least and one that it
cannot exceed, which decides for nearly all items; only what is missing of the classes
still in question is looked up in the remaining shares. A term that all classes use is
thus never spread over all classes, and neither items and classes nor documents are paired.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.fixed_values import TOP_K
from shelfwise.functions.text import prep_model_text
from shelfwise.operators import termblocks as tb
from shelfwise.operators.sparse import shipped
from shelfwise.operators.weights import (
    EPSILON,
    TermOptions,
    count_of,
    counted,
    exploded,
    idf,
    postings,
    term_frequency,
    term_stats,
    unit_postings,
    vocabulary,
    weighted_postings,
)
from shelfwise.session import dropped, stored

SCORE_DIGITS = 9
HEAD = 64  # classes kept with a term
HELD = 1 << 20  # classes of heads looked at together
SLACK = 1e-8  # more than rounding can move a score
NO_CLASS = -(1 << 63)
RANGE_CELLS = 1 << 18
RANGES = T.StructType(
    [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("squares", T.ArrayType(T.DoubleType())), T.StructField("cells", T.BinaryType())]
)


def _cells(name: str, kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind), T.StructField("w", T.DoubleType())]))


@dataclass(frozen=True)
class CentroidModel:
    """``heads``: ``(term, weight, head array<struct<class_id, w>>, rest)``, ``rest`` being the
    largest share outside the head; ``tails``: ``(term, class_id, w)`` outside the heads;
    ``classes``: ``(class_id, class_name, length)``.

    A class is known by its first row, which orders classes as their running
    number would and needs no numbering. Shares are those of unit centroids.
    """

    heads: DataFrame
    tails: DataFrame
    classes: DataFrame
    options: TermOptions

    def save(self, path: str) -> None:
        self.heads.write.mode("overwrite").parquet(f"{path}/heads")
        self.tails.write.mode("overwrite").parquet(f"{path}/tails")
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        spark, text = self.heads.sparkSession, json.dumps(asdict(self.options))
        spark.range(1).select(F.lit(text).alias("options")).write.mode("overwrite").parquet(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CentroidModel:
        """The model with the options it was fitted with."""
        read = spark.read.parquet
        kept = json.loads(read(f"{path}/options").first()["options"])
        kept = {**kept, "ngram_range": tuple(kept["ngram_range"]), "stopwords": tuple(kept["stopwords"])}
        return cls(read(f"{path}/heads"), read(f"{path}/tails"), read(f"{path}/classes"), TermOptions(**kept))

    def shares(self) -> DataFrame:
        """``(term, class_id, w)`` of all classes."""
        return self.heads.select("term", F.inline("head")).unionByName(self.tails)

    def centroids(self) -> DataFrame:
        """Unit centroids: ``(class_name, term, w)``."""
        return self.shares().join(self.classes, "class_id").select("class_name", "term", "w")


def _labelled(df: DataFrame, row_id: str, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a class id, and the classes with their sizes.

    Names are prepared before they are compared.
    """
    named = df.select(row_id, text, prep_model_text(label).alias("class_name"))
    classes = stored(
        named.groupBy("class_name").agg(
            F.min(row_id).cast("long").alias("class_id"), F.count("*").alias("n_docs")
        ),
        "classes",
    )
    rows = named.join(classes, "class_name").select(row_id, text, "class_id", "n_docs")
    return rows, classes


def _model(shares: DataFrame, classes: DataFrame, options: TermOptions, head: int, stat: str, weight: Column) -> CentroidModel:
    """A model from ``(term, class_id, stat, w)``, ``weight`` being the term's weight by ``stat``.

    Fitting ends here: the tables are written to the shared folder, so scoring
    does not fit again, however often it reads them.
    """
    shares = stored(shares, "shares")
    lengths = shares.groupBy("class_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # a class whose documents have no term at all keeps a place, with length null
    known = stored(classes.select("class_id", "class_name").join(lengths, "class_id", "left"), "model-classes")
    unit = shares.join(known.select("class_id", "length"), "class_id").withColumn("w", F.col("w") / F.col("length"))
    by_impact = Window.partitionBy("term").orderBy(F.desc("w"), "class_id")
    placed = unit.select("term", "class_id", stat, "w", F.row_number().over(by_impact).alias("place"))
    # head and tail in one pass and one shuffle: the first places of a term are one row, each later one is its own
    cell = F.struct("place", "class_id", "w")
    later = F.greatest(F.col("place") - (head + 1), F.lit(0)).alias("later")
    rows = placed.groupBy("term", later).agg(F.max(stat).alias(stat), F.array_sort(F.collect_list(cell)).alias("first"))
    rows = stored(rows.select("term", "later", weight.alias("weight"), "first"), "centroids")
    dropped(shares)
    heads = rows.where("later = 0").select(
        "term",
        "weight",
        F.transform(F.slice("first", 1, head), lambda c: F.struct(c["class_id"].alias("class_id"), c["w"].alias("w"))).alias("head"),
        F.coalesce(F.get("first", F.lit(head))["w"], F.lit(0.0)).alias("rest"),
    )
    tails = rows.select("term", F.inline("first")).where(F.col("place") > head).select("term", "class_id", "w")
    return CentroidModel(heads, tails, known, options)


def fit_tfidf(
    df: DataFrame,
    row_id: str,
    text: str,
    label: str,
    options: TermOptions = TermOptions(max_df=0.95),
    head: int = HEAD,
) -> CentroidModel:
    """Centroids of L2-normalized TF-IDF vectors.

    A mean divides by all documents of the class, also those without any term.
    The texts are tokenized once. Their blocks are told of their terms and sum up each
    class's weights, and these sums meet by term.
    """
    rows, classes = _labelled(df, row_id, text, label)
    if options.max_features is not None:
        return _model(_bounded_shares(rows, count_of(df), row_id, text, options), classes, options, head, "df", idf(count_of(df)))
    n_docs = df.count()
    blocks = tb.term_blocks(rows, row_id, text, options, ["class_id", "n_docs"])
    answers = tb.found(blocks, tb.rows_having)
    parts = tb.range_count(blocks)

    def sums(block_id, block, told):
        row, code, w, df = tb.tfidf_entries(block, told, n_docs, options, True)
        classes, sizes = _classes(block)
        code, classes, w = tb.by_class(code, classes[row], w / sizes[row])
        yield tb.pieces_of(block_id, block.terms, parts, code, tb.planes(classes, np.int64), tb.planes(df[code], np.int64), w)

    pieces = tb.met(blocks[0], answers, tb.PIECES, sums)
    for again in blocks[1:]:
        # the rows of an id have one length, wherever they lie
        names = [*again.schema.names, "term", "w", "df"]
        schema = T.StructType([*again.schema, *[T.StructField(n, t) for n, t in zip(names[-3:], (T.StringType(), T.DoubleType(), T.LongType()))]])

        def raw(_, block, told):
            row, code, w, df = tb.tfidf_entries(block, told, n_docs, options, False)
            return tb.postings_of(block, row, code, w, df[code], names=names)

        unit = unit_postings(tb.met(again, answers, schema, raw), row_id)
        own = unit.groupBy("term", "class_id").agg(F.max("df").alias("df"), F.sum(F.col("w") / F.col("n_docs")).alias("w"))
        pieces = pieces.unionByName(_share_pieces(own, parts))
    ranges = stored(tb.summed(pieces, parts, RANGES, [1], _range_rows), "shares")
    for table in (answers, *[b.table for b in blocks]):
        dropped(table)
    return _model_of_ranges(ranges, classes, options, head, lambda df: np.log((n_docs + 1.0) / (df + 1.0)) + 1.0)


def _share_pieces(shares: DataFrame, parts: int) -> DataFrame:
    """Rows ``(term, class_id, df, w)`` cut by ranges as blocks are."""

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            order = np.argsort(tb.hashes(b.column(0)), kind="stable")
            terms, classes, df, w = (c.take(pa.array(order)) for c in b.columns)
            columns = tb.planes(pc.fill_null(classes, NO_CLASS).to_numpy(), np.int64), tb.planes(df.to_numpy(), np.int64), w.to_numpy()
            yield tb.pieces_of(-1, terms, parts, np.arange(len(order)), *columns)

    return shares.select("term", "class_id", "df", "w").mapInArrow(task, tb.PIECES)


def _range_rows(terms: pa.StringArray, code: np.ndarray, classes: np.ndarray, stat: np.ndarray, w: np.ndarray) -> Iterable[pa.RecordBatch]:
    """Shares of a range, a bounded number of cells in a row, with their squares by class. A term is in one row."""
    at = np.flatnonzero(classes != NO_CLASS)
    code, classes, stat, w = code[at], classes[at], stat[at], w[at]
    a = 0
    while a < len(code):
        b = int(np.searchsorted(code, code[min(a + RANGE_CELLS, len(code)) - 1], "right"))
        first, ids = int(code[a]), np.unique(classes[a:b], return_inverse=True)
        squares = np.bincount(ids[1], w[a:b] ** 2)
        own = tb.text_of(terms.slice(first, int(code[b - 1]) - first + 1))
        cells = tb.squeezed((own, tb.planes(np.diff(code[a:b], prepend=first)), tb.planes(classes[a:b], np.int64), stat[a:b], w[a:b]))
        arrays = [pa.array([ids[0]], pa.list_(pa.int64())), pa.array([squares], pa.list_(pa.float64())), pa.array([cells], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, RANGES.names)
        a = b


def _model_of_ranges(ranges: DataFrame, classes: DataFrame, options: TermOptions, head: int, weight: Callable) -> CentroidModel:
    """``_model`` from what ``_range_rows`` gives: a term's shares lie together, so none is moved."""
    squares = ranges.select(F.inline(F.arrays_zip("ids", "squares"))).groupBy("ids").agg(F.sqrt(F.sum("squares")).alias("length"))
    # a class whose documents have no term at all keeps a place, with length null
    known = stored(classes.select("class_id", "class_name").join(squares.withColumnRenamed("ids", "class_id"), "class_id", "left"), "model-classes")
    found = sorted((r.class_id, r.length) for r in known.select("class_id", "length").where("length IS NOT NULL").collect())
    shared = shipped(ranges.sparkSession, np.array(found, object).reshape(-1, 2))
    schema = T.StructType.fromDDL("term string, weight double, head array<struct<class_id: bigint, w: double>>, rest double, class_id long, w double")
    arrow = to_arrow_schema(schema)

    def task(batches: Iterable[pa.RecordBatch]):
        ids, lengths = (c.astype(t) for c, t in zip(shared().T, (np.int64, float)))
        for b in batches:
            for data in b.column(0):
                text, code, own, stat, w = tb.restored(data.as_py())
                terms, code, own = tb.strings_of(*text), np.cumsum(tb.from_planes(code), dtype=np.int64), tb.from_planes(own)
                w = w / lengths[np.searchsorted(ids, own)]
                order = np.lexsort((own, -w, code))
                code, own, stat, w = code[order], own[order], stat[order], w[order]
                some, first, sizes = np.unique(code, return_index=True, return_counts=True)
                place = np.arange(len(code)) - np.repeat(first, sizes)
                kept, more = np.flatnonzero(place < head), np.flatnonzero(place >= head)
                rest = np.zeros(len(some))
                longer = np.flatnonzero(sizes > head)
                rest[longer] = w[first[longer] + head]
                cells = _lists([own[kept], w[kept]], np.cumsum(np.minimum(sizes, head)), arrow.field("head").type)
                weights = pa.array(weight(stat[first]), pa.float64())
                none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.float64())]
                yield from tb.slices_of([terms.take(pa.array(some)), weights, cells, pa.array(rest), *none], arrow)
                none = [pa.nulls(len(more), arrow.field(i).type) for i in (1, 2, 3)]
                yield from tb.slices_of([terms.take(pa.array(code[more])), *none, pa.array(own[more]), pa.array(w[more])], arrow)

    rows = stored(ranges.select("cells").mapInArrow(task, schema), "centroids")
    dropped(ranges)
    heads = rows.where("head IS NOT NULL").select("term", "weight", "head", "rest")
    return CentroidModel(heads, rows.where("head IS NULL").select("term", "class_id", "w"), known, options)


def _bounded_shares(rows: DataFrame, n_docs: Column, row_id: str, text: str, options: TermOptions) -> DataFrame:
    """``(term, class_id, df, w)`` of a vocabulary of ``max_features`` terms."""
    keep = ["class_id", "n_docs"]
    posted = exploded(stored(counted(rows, row_id, text, options, keep), "counted"), row_id, keep)
    known = vocabulary(term_stats(posted), n_docs, options).select("term", "df")
    w = term_frequency(options) * idf(n_docs)
    length = F.sqrt(F.sum(w * w).over(Window.partitionBy(row_id)))
    # dealt before weights are worked out, as these would move, too
    moved = posted.join(known, "term").select(row_id, *keep, "term", "tf", "df").repartition(row_id)
    unit = moved.select("term", *keep, "df", (w / length).alias("w"))
    return unit.groupBy("term", "class_id").agg(F.max("df").alias("df"), F.sum(F.col("w") / F.col("n_docs")).alias("w"))


def _classes(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """The class of each row, ``NO_CLASS`` for null, and its number of rows."""
    return pc.fill_null(block.docs.column(1), NO_CLASS).to_numpy(), block.docs.column(2).to_numpy()


def fit_icf_tdcb(
    df: DataFrame, row_id: str, text: str, label: str, options: TermOptions = TermOptions(), head: int = HEAD
) -> CentroidModel:
    """Centroids of raw counts, weighted by ICF-TDCB.

    Everything is a sum per ``(term, class)``: blocks of texts are summed up where they lie,
    and only these sums are shuffled.
    """
    rows, classes = _labelled(df, row_id, text, label)
    n_docs = df.count()
    blocks = tb.TermBlocks(rows, row_id, text, options, ["class_id", "n_docs"])
    parts = tb.range_count([blocks])

    def sums(block_id, block):
        classes, sizes = _classes(block)
        tf = block.tfs.astype(float)
        code, classes, df, cf, tf2, n = tb.by_class(block.codes, classes[block.row], np.ones(len(tf)), tf, tf * tf, largest=sizes[block.row])
        yield tb.pieces_of(block_id, block.terms, parts, code, *[tb.planes(x, np.int64) for x in (classes, df, cf, tf2, n)])

    def shares_of(terms, code, classes, df, cf, tf2, n):
        of_term = lambda x: np.bincount(code, x, len(terms))
        total, occurrences = of_term(df), of_term(cf) + EPSILON
        weight = np.log(n_docs / (total + EPSILON)) * (1.0 - of_term(tf2) / (occurrences * occurrences))
        weight = np.maximum(weight, EPSILON)
        at = np.flatnonzero(total[code] >= options.min_df)
        own = weight[code[at]]
        yield from _range_rows(terms, code[at], classes[at], own, cf[at] / n[at] * own)

    ranges = stored(tb.summed(tb.each_block(blocks, tb.PIECES, sums), parts, RANGES, [0, 1, 2], shares_of), "shares")
    dropped(blocks.table)
    return _model_of_ranges(ranges, classes, options, head, lambda weight: weight)


def scores(model: CentroidModel, df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Cosine of each item to all the classes it shares terms with:
    ``(row_id, class_id, class_name, score)``.

    This is a row per item and class that share a term; ``best_classes`` finds the first few
    of an item without these.
    """
    posted = postings(df, row_id, text, model.options)
    weighted = weighted_postings(posted, model.heads.select("term", "weight"), model.options)
    unit = unit_postings(weighted, row_id)
    return (
        unit.join(model.shares().withColumnRenamed("w", "share"), "term")
        .groupBy(row_id, "class_id")
        .agg(F.sum(F.col("w") * F.col("share")).alias("score"))
        .join(model.classes, "class_id")
        .select(row_id, "class_id", "class_name", "score")
    )


def _bounded(model: CentroidModel, df: DataFrame, row_id: str, text: str, k: int) -> DataFrame:
    """``(row_id, found, asks, open)`` of the items that have known terms.

    ``found`` are classes that can be among the ``k`` best with what the heads give them, as
    unit scores. ``asks`` are the terms whose remaining shares they still need; with
    ``open`` a class outside of all heads can be among the best, too.
    """
    blocks = tb.term_blocks(df.select(row_id, text), row_id, text, model.options)
    schema = T.StructType(
        [
            blocks[0].schema[row_id],
            T.StructField("found", _cells("class_id", T.LongType())),
            T.StructField("asks", _cells("term", T.StringType())),
            T.StructField("open", T.BooleanType()),
        ]
    )
    arrow, sublinear = to_arrow_schema(schema), model.options.sublinear_tf
    answers = tb.found(blocks, _heads_told, lambda parts: _head_pieces(model.heads, parts), model.heads.count())

    def decided(_, block, told):
        known, weight, rest, sizes, ids, shares = (np.concatenate(x) for x in zip(*told)) if told else [np.empty(0)] * 6
        place = np.cumsum(known) - 1
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.flatnonzero(known[block.codes]) if len(block.codes) else np.empty(0, np.int64)
        row, code = block.row[at], block.codes[at]
        head = place[code]
        # items whose heads are of a bounded size together
        size = sizes[head].astype(np.int64)
        items, starts = np.unique(row, return_index=True)
        starts = np.append(starts, len(row))
        cells = np.concatenate([[0], np.cumsum(size)])[starts]
        i = 0
        while i < len(items):
            j = max(i + 1, int(np.searchsorted(cells, cells[i] + HELD, "right")) - 1)
            own = slice(starts[i], starts[j])
            n = size[own]
            of = np.arange(n.sum()) + np.repeat(ends[head[own]] - np.cumsum(n), n)
            cuts = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            tf = block.tfs[at[own]].astype(float)
            w = (np.log(tf) + 1.0 if sublinear else tf) * weight[head[own]]
            left = rest[head[own]]
            names = block.terms.take(pa.array(code[own]))
            columns = [
                block.docs.column(0).take(pa.array(row[own])), pa.array(w), pa.array(left),
                pa.ListArray.from_arrays(cuts, pa.array(ids[of])), pa.ListArray.from_arrays(cuts, pa.array(shares[of])),
                pc.if_else(pa.array(left > 0), names, pa.scalar(None, pa.string())),
            ]
            table = pa.table(columns, names=[row_id, "w", "rest", "ids", "ws", "term"])
            yield _decided(table, starts[i:j] - starts[i], k, arrow)
            i = j

    out = tb.met(blocks[0], answers, schema, decided)
    return out if len(blocks) == 1 else out.unionByName(_repeated(model, blocks[1], row_id, k, schema))


def _head_pieces(heads: DataFrame, parts: int) -> DataFrame:
    """The heads cut by ranges of their terms' hashes, without a block."""

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            order = pa.array(np.argsort(tb.hashes(b.column(0)), kind="stable"))
            terms, weight, rest, ids, ws = (c.take(order) for c in b.columns)
            columns = weight.to_numpy(), rest.to_numpy(), ids.value_lengths().to_numpy(), np.arange(len(terms))
            flat, starts = (ids.flatten().to_numpy(), ws.flatten().to_numpy()), np.concatenate([[0], np.cumsum(columns[2])])
            yield tb.pieces_of(-1, terms, parts, None, *columns[:3], also=lambda a, z: [x[starts[a] : starts[z]] for x in flat])

    columns = heads.select("term", "weight", "rest", F.col("head.class_id").alias("ids"), F.col("head.w").alias("ws"))
    return columns.mapInArrow(task, tb.PIECES)


def _heads_told(terms: pa.StringArray, df: np.ndarray, heads: list) -> Callable:
    """What ``found`` tells blocks: which of their terms the model knows, with what."""
    if not heads:
        return lambda codes: (np.zeros(len(codes), bool), np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    names = pa.chunked_array([tb.strings_of(*h[0]) for h in heads]).combine_chunks()
    weight, rest, sizes, ids, shares = (np.concatenate(x) for x in zip(*[h[1:] for h in heads]))
    ends = np.cumsum(sizes, dtype=np.int64)
    place = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy()

    def tell(codes):
        at = place[codes]
        own = at[at >= 0]
        n = sizes[own]
        of = np.arange(n.sum()) + np.repeat(ends[own] - np.cumsum(n), n)
        return at >= 0, weight[own], rest[own], n, ids[of], shares[of]

    return tell


def _repeated(model: CentroidModel, blocks: tb.TermBlocks, row_id: str, k: int, schema: T.StructType) -> DataFrame:
    """``_bounded`` of rows that share their ids: their terms meet the heads one by one and then by id."""
    names, arrow = [row_id, "term", "tf"], to_arrow_schema(schema)
    fields = T.StructType([blocks.schema[row_id], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    posted = tb.each_block(blocks, fields, lambda _, b: tb.postings_of(b, b.row, b.codes, b.tfs.astype(np.int64), names=names))
    w = (term_frequency(model.options) * F.col("weight")).alias("w")
    # a term that has no remaining shares is never asked for
    name = F.when(F.col("rest") > 0, F.col("term")).alias("term")
    met = posted.join(model.heads, "term").select(row_id, w, "rest", F.col("head.class_id").alias("ids"), F.col("head.w").alias("ws"), name)

    def task(batches: Iterable[pa.RecordBatch]):
        held = None  # the last item so far, which may go on
        for b in batches:
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if not table.num_rows:
                continue
            starts = _starts(table.column(0))
            last = int(starts[-1])
            if last:
                yield _decided(table.slice(0, last), starts[:-1], k, arrow)
            held = table.slice(last)
        if held is not None:
            yield _decided(held, np.array([0]), k, arrow)

    return met.repartition(row_id).sortWithinPartitions(row_id).mapInArrow(task, schema)


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where a new item begins in a sorted column."""
    ids = ids.combine_chunks()
    new = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _lists(values: list, ends: np.ndarray, kind: pa.ListType) -> pa.ListArray:
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, fields)]
    cells = pa.StructArray.from_arrays(arrays, fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), cells).cast(kind)


def _decided(table: pa.Table, starts: np.ndarray, k: int, arrow: pa.Schema) -> pa.RecordBatch:
    """Bounds of all classes of some items at once. An item's rows begin at its start."""
    table = table.combine_chunks()
    n = len(starts)
    item = np.repeat(np.arange(n), np.diff(np.append(starts, table.num_rows)))
    w, rest = table.column(1).to_numpy(), table.column(2).to_numpy()
    w = w / np.sqrt(np.bincount(item, w * w, n))[item]
    ids, shares = table.column(3).combine_chunks(), table.column(4).combine_chunks()
    sizes = ids.value_lengths().to_numpy()
    classes, code = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    pairs, place = np.unique(np.repeat(item, sizes) * len(classes) + code, return_inverse=True)
    owner, code = np.divmod(pairs, max(len(classes), 1))
    least = np.bincount(place, np.repeat(w, sizes) * shares.flatten().to_numpy(), len(pairs))
    # what a class may have in the terms whose heads it is not in
    outside = np.bincount(item, w * rest, n)
    most = least + outside[owner] - np.bincount(place, np.repeat(w * rest, sizes), len(pairs))
    order = np.lexsort((-least, owner))
    held = np.bincount(owner, minlength=n)
    first = np.cumsum(held) - held
    kth = np.zeros(n)
    enough = held >= k
    kth[enough] = least[order][first[enough] + k - 1]
    wanted = most >= kth[owner] - SLACK
    asking = np.bincount(owner[wanted & (most - least > SLACK)], minlength=n) > 0
    beyond = (outside >= kth - SLACK) & (np.bincount(item, rest > 0, n) > 0)
    asked = (rest > 0) & (asking | beyond)[item]
    terms = table.column(5).combine_chunks().take(pa.array(np.flatnonzero(asked)))
    return pa.RecordBatch.from_arrays(
        [
            table.column(0).combine_chunks().take(pa.array(starts)),
            _lists([classes[code[wanted]], least[wanted]], np.cumsum(np.bincount(owner[wanted], minlength=n)), arrow.field("found").type),
            _lists([terms, w[asked]], np.cumsum(np.bincount(item[asked], minlength=n)), arrow.field("asks").type),
            pa.array(beyond),
        ],
        schema=arrow,
    )


def best_classes(model: CentroidModel, df: DataFrame, row_id: str, text: str, k: int) -> DataFrame:
    """``(row_id, best array<struct<neg, class_id, score>>)``: at most ``k`` classes, best first, ties to the lowest id.

    Items without known terms have no row; classes with a score of 0 may be missing.
    """
    bounded = _bounded(model, df, row_id, text, k)
    cell = lambda c: F.struct(
        (-F.round(c["w"], SCORE_DIGITS)).alias("neg"), c["class_id"].alias("class_id"), c["w"].alias("score")
    )
    first = F.slice(F.array_sort(F.transform("found", cell)), 1, k).alias("best")
    if model.tails.isEmpty():
        return bounded.select(row_id, first)
    bounded = stored(bounded, "bounded")
    asking = bounded.where(F.size("asks") > 0)
    terms = asking.select(row_id, "open", "found", F.explode("asks").alias("a")).select(row_id, "open", "found", "a.term", F.col("a.w").alias("item_w"))
    closed = terms.where("NOT open").select(row_id, "term", "item_w", F.explode("found.class_id").alias("class_id"))
    rows = closed.join(model.tails, ["term", "class_id"]).unionByName(
        terms.where("open").select(row_id, "term", "item_w").join(model.tails, "term")
    )
    parts = rows.select(row_id, "class_id", (F.col("item_w") * F.col("w")).alias("w")).unionByName(
        asking.select(row_id, F.inline("found"))
    )
    sums = parts.groupBy(row_id, "class_id").agg(F.sum("w").alias("w"))
    looked_up = sums.groupBy(row_id).agg(F.collect_list(F.struct("class_id", "w")).alias("found"))
    decided = bounded.where(F.size("asks") == 0).select(row_id, "found")
    return decided.unionByName(looked_up).select(row_id, first)


def predict(
    model: CentroidModel, df: DataFrame, row_id: str, text: str, k: int = TOP_K
) -> DataFrame:
    """``(row_id, product_text, label, class_1_name, score_1, ... class_k_name, score_k)``.

    Classes that share no term with an item score 0 and rank by class id, and
    an item without any known term has all its scores 0, as a full matrix product
    would give. With fewer than ``k`` classes the last columns are null.
    """
    # an item that meets m < k classes fills its places with the lowest ids it
    # has not met; at most m of the k lowest ids are met, so these k suffice
    zero = F.struct(F.lit(0.0).alias("neg"), F.col("class_id"), F.lit(0.0).alias("score"))
    lowest = model.classes.orderBy("class_id").limit(k).agg(F.collect_list(zero)).scalar()
    placed = (
        df.select(row_id, prep_model_text(text).alias("product_text"))
        .join(best_classes(model, df, row_id, text, k), row_id, "left")
        .withColumn("_lowest", lowest)
        .withColumn("_met", F.coalesce("best", F.slice("_lowest", 1, 0)))
        .withColumn("_ids", F.transform("_met", lambda m: m["class_id"]))
        .withColumn("_unmet", F.filter("_lowest", lambda c: ~F.array_contains("_ids", c["class_id"])))
        .withColumn("_best", F.slice(F.array_sort(F.concat("_met", "_unmet")), 1, k))
    )
    columns = []
    for j in range(k):
        at = F.get("_best", F.lit(j))
        names = model.classes.select(F.col("class_id").alias(f"_class_{j}"), F.col("class_name").alias(f"class_{j + 1}_name"))
        placed = placed.withColumns({f"_class_{j}": at["class_id"], f"score_{j + 1}": at["score"]}).join(names, f"_class_{j}", "left")
        columns += [f"class_{j + 1}_name", f"score_{j + 1}"]
    return placed.select(row_id, "product_text", F.col("class_1_name").alias("label"), *columns)
