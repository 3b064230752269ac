"""Nearest classes by embedding.

The classes are indexed by balls: a bounded number of pivots that lie far from each other, and for each
the classes that are closest to it, with their number and the largest distance from it. An
item's products with the pivots bound its products with all classes of a ball, so that
some balls surely hold its ``k`` best and others none. Items are sent to the balls that
can matter, as blocks of vectors, and compared there by matrix products; what is skipped
is never moved. The classes of a ball come in blocks of bounded size. Whether these or the
items are shuffled for that is left to the optimizer, which knows the size of the written
index. There is one way for every size, and no pair rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.session import stored

PIVOTS = 1024  # balls at most
BALL = 64  # classes per ball, while there are fewer than PIVOTS
DRAWN = 4  # classes drawn for each ball
BLOCK = 4096  # classes compared at once
GATHERED = 1 << 16  # classes of a task that are sorted into balls together
ITEMS = 4096  # items bounded at once
MAX_SCORES = 4_000_000  # score cells held at a time
DISTANCE_DIGITS = 9  # ties are decided on rounded distances, lowest class id first
SLACK = 1e-8  # more than rounding can move a score
PART = 33  # bits of an item's number within its task


def mean_vectors(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """Mean vector per label: ``(label, vector)``.

    One fixed-width average per dimension keeps this a hash aggregate with
    partial sums, whatever the number of labels or the size of one. A vector of
    another length than ``dims`` is an error.
    """
    whole = F.when(F.size(vector) == dims, F.col(vector)).otherwise(
        F.raise_error(F.concat(F.lit(f"vectors must all have {dims} dimensions, one has "), F.size(vector).cast("string")))
    )
    sums = [F.avg(F.col("_v")[i].cast("double")) for i in range(dims)]
    return (
        df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
        .select(label, whole.alias("_v"))
        .groupBy(label)
        .agg(F.array(*sums).alias(vector))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(column)
    width = dims if dims is not None else (len(flat) // rows if rows else 0)
    if len(flat) != rows * width or np.isnan(flat).any():
        raise ValueError(f"vectors must all have {width} non-null dimensions")
    matrix = flat.reshape(rows, width)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best(items: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the ``k`` nearest rows of ``classes``."""
    k = min(k, len(classes))
    positions = np.empty((len(items), k), dtype=np.int64)
    distances = np.empty((len(items), k))
    step = max(1, MAX_SCORES // max(1, len(classes)))
    for start in range(0, len(items), step):
        distance = 1.0 - items[start : start + step] @ classes.T
        key = np.round(distance, DISTANCE_DIGITS)
        if k == 1:
            order = key.argmin(axis=1)[:, None]
        else:
            order = key.argsort(axis=1, kind="stable")[:, :k]
        positions[start : start + step] = order
        distances[start : start + step] = np.take_along_axis(distance, order, axis=1)
    return positions, distances


def _prepare(items, classes, item_id, class_id, vector):
    left = items.where(F.col(vector).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    right = classes.where(F.col(vector).isNotNull()).select(
        F.col(class_id).alias("class_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    return left, right


def _measure(classes: DataFrame) -> tuple[int, int]:
    """Rows and dimensions of the class side; unequal dimensions are an error."""
    found = classes.agg(
        F.count("*").alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")
    ).first()
    if found.n and found.lo != found.hi:
        raise ValueError(f"class vectors have {found.lo} to {found.hi} dimensions")
    return found.n, found.hi or 0


def _pivots(classes: DataFrame, count: int, dims: int, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` classes that lie far from each other.

    Of a few times as many classes, drawn by hash, each pivot is the one farthest from
    those before it, so that clusters do not share a ball.
    """
    n = min(most, -(-count // BALL))
    drawn = classes.orderBy(F.xxhash64("vector"), "class_id").limit(n * DRAWN).select("vector").toArrow()
    x = np.unique(_matrix(drawn.column("vector"), dims), axis=0)
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return x[chosen]


def _ball_blocks(classes: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """``(ball, n, radius, class_ids, vectors)``: classes sorted into balls where they lie, ids in order."""
    id_type = classes.schema["class_id"].dataType
    schema = T.StructType(
        [
            T.StructField("ball", T.LongType()), T.StructField("n", T.LongType()), T.StructField("radius", T.DoubleType()),
            T.StructField("class_ids", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    dims = pivots.shape[1]

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("class_id")
        x = _matrix(table.column("vector"), dims)
        ids = table.column("class_id").combine_chunks()
        ball = (x @ pivots.T).argmax(axis=1)
        far = np.linalg.norm(x - pivots[ball], axis=1)
        for g in np.unique(ball):
            own = np.flatnonzero(ball == g)
            for i in range(0, len(own), block):
                at = own[i : i + block]
                cells = [int(g), len(at), float(far[at].max()), ids.take(pa.array(at)).to_pylist(), x[at].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow)], schema=arrow)

    def task(batches: Iterable[pa.RecordBatch]):
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= GATHERED:
                yield from cut(pa.Table.from_batches(kept))
                kept, n = [], 0
        if n:
            yield from cut(pa.Table.from_batches(kept))

    return classes.mapInArrow(task, schema)


def _placed(items: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int) -> DataFrame:
    """``(ball, n, rows, item_ids, vectors)``: items with each ball that may hold one of their ``k`` best."""
    id_type = items.schema["item_id"].dataType
    schema = T.StructType(
        [
            T.StructField("ball", T.LongType()), T.StructField("n", T.LongType()), T.StructField("rows", T.BinaryType()),
            T.StructField("item_ids", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    sent = items.sparkSession.sparkContext.broadcast((pivots, sizes, radii))

    def task(batches: Iterable[pa.RecordBatch]):
        pivots, sizes, radii = sent.value
        first = TaskContext.get().partitionId() << PART
        for whole in batches:
            for i in range(0, whole.num_rows, ITEMS):
                b = whole.slice(i, ITEMS)
                x = _matrix(b.column(1), pivots.shape[1])
                middle = x @ pivots.T
                reach = radii * np.linalg.norm(x, axis=1)[:, None]
                # balls from the surest on, until they hold k classes: their least score is a bound
                order = np.argsort(reach - middle, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1) >= k
                at = np.take_along_axis(order, held.argmax(axis=1)[:, None], axis=1)
                least = np.where(held[:, -1], np.take_along_axis(middle - reach, at, axis=1)[:, 0], -np.inf)
                wanted = middle + reach >= least[:, None] - SLACK
                for g in np.flatnonzero(wanted.any(axis=0)):
                    own = np.flatnonzero(wanted[:, g])
                    cells = [int(g), len(own), (first + own).astype("<i8").tobytes(), b.column(0).take(pa.array(own)).to_pylist(), x[own].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow)], schema=arrow)
                first += b.num_rows

    return items.mapInArrow(task, schema)


def _compared(met: DataFrame, schema: T.StructType, dims: int, k: int) -> DataFrame:
    """The ``k`` best classes of a block for every item that meets it."""
    arrow = to_arrow_schema(schema)

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                rows, item_ids, vectors, class_ids, matrix = (b.column(j)[i] for j in range(5))
                x = np.frombuffer(vectors.as_py()).reshape(-1, dims)
                classes = np.frombuffer(matrix.as_py()).reshape(-1, dims)
                positions, distances = _best(x, classes, k)
                repeated = np.repeat(np.arange(len(x)), positions.shape[1])
                cells = [
                    np.frombuffer(rows.as_py(), "<i8")[repeated], item_ids.values.take(pa.array(repeated)),
                    class_ids.values.take(pa.array(positions.ravel())), distances.ravel(),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cells, arrow)], schema=arrow)

    columns = ("rows", "item_ids", "vectors", "class_ids", "matrix")
    return met.select(*columns).mapInArrow(task, schema)


def nearest_classes(
    items: DataFrame,
    classes: DataFrame,
    item_id: str,
    class_id: str,
    vector: str,
    k: int = 1,
    block: int = BLOCK,
    pivots: int = PIVOTS,
    seen: Observation | None = None,
) -> DataFrame:
    """``(item_id, class_id, distance)`` of the ``k`` nearest classes by cosine.

    Items without a vector have no nearest class and no row; items that repeat an id have
    rows of their own. ``block`` bounds the classes compared at once and ``pivots`` the
    balls. ``seen`` observes ``pairs``: how many pairs of an item and a class are compared.
    """
    left, right = _prepare(items, classes, item_id, class_id, vector)
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("item_id", left.schema["item_id"].dataType),
            T.StructField("class_id", right.schema["class_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    right = stored(right, "nearest-classes")  # measured, drawn from and indexed
    count, dims = _measure(right)
    if count == 0:
        return left.sparkSession.createDataFrame([], schema).drop("row")
    centres = _pivots(right, count, dims, pivots)
    index = stored(_ball_blocks(right, centres, block), "nearest-index")
    sizes, radii, blocks = np.zeros(len(centres)), np.zeros(len(centres)), 0
    # one row per ball
    for r in index.groupBy("ball").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.count("*").alias("blocks")).collect():
        sizes[r.ball], radii[r.ball], blocks = r.n, r.radius, blocks + r.blocks
    placed = _placed(left, centres, sizes, radii, k)
    met = placed.join(index.select("ball", F.col("n").alias("n_classes"), "class_ids", F.col("vectors").alias("matrix")), "ball")
    if seen is not None:
        met = met.observe(seen, F.sum(F.col("n") * F.col("n_classes")).alias("pairs"))
    found = _compared(met, schema, dims, k)
    if blocks > 1:  # an item's best of several blocks
        found = _merged(found, k)
    return found.drop("row")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` lowest distances per item, ties to the lowest class id."""
    order = Window.partitionBy("row").orderBy(_order_key(), "class_id")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def _order_key() -> Column:
    return F.round("distance", DISTANCE_DIGITS)


def ranked(nearest: DataFrame) -> DataFrame:
    """Number the classes of each item by distance, from 1."""
    order = Window.partitionBy("item_id").orderBy(_order_key(), "class_id")
    return nearest.withColumn("rank", F.row_number().over(order))


def similar(
    items: DataFrame,
    classes: DataFrame,
    item_id: str,
    class_id: str,
    vector: str,
    k: int,
    at_least: float = -1.0,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` most similar classes of each item: ``(item_id, class_id, score)``.

    Only similarities of ``at_least`` count, so the output is linear in the items.
    """
    best = nearest_classes(items, classes, item_id, class_id, vector, k, block)
    return best.select("item_id", "class_id", (F.lit(1.0) - F.col("distance")).alias("score")).where(F.col("score") >= at_least)


def cosine_argmax(
    items: DataFrame, classes: DataFrame, item_id: str, class_id: str, vector: str
) -> DataFrame:
    """Best class and its similarity: ``(item_id, class_id, confidence)``."""
    best = nearest_classes(items, classes, item_id, class_id, vector)
    return best.select("item_id", "class_id", (F.lit(1.0) - F.col("distance")).alias("confidence"))
