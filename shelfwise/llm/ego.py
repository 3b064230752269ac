"""Near-duplicate vectors by an epsilon grid order join.

Cosine c of unit vectors is a distance of sqrt(2 - 2c). Vectors are sorted by their
grid cells of that side on the leading principal dimensions, and the sorted sequence
is cut into blocks. Projections only shorten distances, so blocks whose boxes lie
farther apart than epsilon in any leading dimension are skipped; the others are
joined by halving both intervals, skipping distant halves, down to small matrix
products in double precision.

A pair of blocks gives one row per linked vector, its number of links and a vector it
is connected with: output is linear in the vectors, however dense a group is. Equal
vectors are one, with a count. Only the covariance, one number per pair of
dimensions, comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import connected
from shelfwise.llm.vectors import padded, usable
from shelfwise.session import stored

COSINE = 0.95
DIMS = 4  # leading principal dimensions that are gridded
BLOCK = 4096
TILE = 512
LEAST_TILES, TILE_PARTS = 8, 8  # tiles that share the blocks, and partitions of blocks in one of many


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, width: int) -> np.ndarray:
    """Leading principal axes of the unit vectors."""

    def task(batches):
        total = np.zeros((width + 1, width))
        for b in batches:
            if b.num_rows:
                x = np.zeros((b.num_rows, width))
                u = _unit(padded(b.column(0).to_pylist(), np.float64))
                x[:, : u.shape[1]] = u
                total[:width] += x.T @ x
                total[width] += x.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"]
        )

    sums = classes.select("v").mapInArrow(task, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    m = np.zeros((width + 1, width))
    for r in sums.collect():  # (width + 1) * width numbers
        m[r["i"], r["j"]] = r["s"]
    n = max(np.trace(m[:width]), 1.0)  # unit vectors: the trace is their number
    mean = m[width] / n
    _, vectors = np.linalg.eigh(m[:width] / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, :DIMS]


class _Forest:
    """Smallest position each position is connected with."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        low = self.low
        while True:
            x, y = low[a], low[b]
            if (x == y).all():
                break
            m = np.minimum(x, y)
            np.minimum.at(low, x, m)
            np.minimum.at(low, y, m)
            while True:
                again = low[low]
                if (again == low).all():
                    break
                low[:] = again


def join_blocks(u: np.ndarray, w: np.ndarray, mu: np.ndarray, mw: np.ndarray, pu, pw, same: bool, cosine=COSINE):
    """Links between two blocks of unit vectors (multiplicities m, projections p): counts, and connected positions."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9)
    nu, nw = np.zeros(len(u), np.int64), np.zeros(len(w), np.int64)
    forest = _Forest(len(u) if same else len(u) + len(w))

    def recurse(a0, a1, b0, b1):
        if same and a0 >= b1:
            return  # the mirror image is visited
        gap = np.maximum(pu[a0:a1].min(0) - pw[b0:b1].max(0), pw[b0:b1].min(0) - pu[a0:a1].max(0))
        if (gap > epsilon).any():
            return
        if a1 - a0 > TILE or b1 - b0 > TILE:
            am, bm = ((a0 + a1) // 2, (b0 + b1) // 2)
            for x in ((a0, am), (am, a1)) if a1 - a0 > TILE else ((a0, a1),):
                for y in ((b0, bm), (bm, b1)) if b1 - b0 > TILE else ((b0, b1),):
                    recurse(*x, *y)
            return
        close = u[a0:a1] @ w[b0:b1].T >= cosine
        if same:
            close &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if close.any():
            nu[a0:a1] += close @ mw[b0:b1]
            nw[b0:b1] += mu[a0:a1] @ close
            i, j = np.nonzero(close)
            forest.join(i + a0, j + b0 + (0 if same else len(u)))

    if len(u) and len(w):
        recurse(0, len(u), 0, len(w))
    return (nu + nw if same else np.concatenate([nu, nw])), forest.low


def links(vectors: DataFrame, id_col="vec_id", vec_col="embedding", cosine=COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing. Vectors of unequal length count as filled up with zeros. Rows that repeat
    an id are vectors of their own that share a component. Null ids link with nothing.
    """
    spark = vectors.sparkSession
    links_at_all = usable(vec_col) & F.exists(vec_col, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(links_at_all, F.col(vec_col)).alias("v"))
    classes = stored(
        rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "ego-classes"
    )
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    axes = _axes(classes, width) if n else np.zeros((width, DIMS))
    dims = axes.shape[1]
    kind = np.dtype("<f4") if dict(classes.dtypes)["v"] == "array<float>" else np.dtype("<f8")
    epsilon = math.sqrt(2 - 2 * cosine)

    def project(batches):
        for b in batches:
            raw = padded(b.column(0).to_pylist(), kind)
            x = np.zeros((b.num_rows, width), kind)
            x[:, : raw.shape[1]] = raw
            p = _unit(x.astype(np.float64)) @ axes if b.num_rows else np.zeros((0, dims))
            cells = np.floor(p / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array(cells.tolist(), pa.list_(pa.int64())), pa.array(p.tolist(), pa.list_(pa.float64()))],
                ["rep", "m", "x", "cells", "p"],
            )

    gridded = classes.select("v", "rep", "m").mapInArrow(
        project, "rep long, m long, x binary, cells array<bigint>, p array<double>"
    )
    parts = max(1, math.ceil(n / (2 * BLOCK)))
    ordered = gridded.repartitionByRange(parts, "cells", "rep").sortWithinPartitions("cells", "rep")

    def cut(batches):
        first = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        at = 0

        def out(rows):
            p = np.array([r[3] for r in rows])
            columns = (
                [first + at], [np.array([r[0] for r in rows], "<i8").tobytes()], [np.array([r[1] for r in rows], "<i8").tobytes()],
                [b"".join(r[2] for r in rows)], [p.astype("<f8").tobytes()], [p.min(0).tolist()], [p.max(0).tolist()],
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2))],
                ["block", "reps", "ms", "xs", "ps", "lo", "hi"],
            )

        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(4)))
            while len(held) >= BLOCK:
                yield out(held[:BLOCK])
                held, at = held[BLOCK:], at + 1
        if held:
            yield out(held)

    blocks = stored(
        ordered.select("rep", "m", "x", "p").mapInArrow(
            cut, "block long, reps binary, ms binary, xs binary, ps binary, lo array<double>, hi array<double>"
        ),
        "ego-blocks",
    )
    # pairs of blocks whose boxes are close, found by cells of the first dimension
    box = blocks.select("block", "lo", "hi")

    def by_cell(names, reach):
        last = F.floor((F.col("hi")[0] + reach) / epsilon)
        return box.select(
            F.struct("block", "lo", "hi").alias(names),
            F.explode(F.sequence(F.floor(F.col("lo")[0] / epsilon), last)).alias("cell"),
        )

    apart = F.exists(F.arrays_zip(F.col("i.lo").alias("a"), F.col("i.hi").alias("b"), F.col("j.lo").alias("c"), F.col("j.hi").alias("d")),
                     lambda z: (z["a"] - z["d"] > epsilon) | (z["c"] - z["b"] > epsilon))
    near = by_cell("i", epsilon).join(by_cell("j", epsilon), "cell").filter("i.block <= j.block").filter(~apart)
    # tiles of neighbouring blocks: a block moves once for each tile it meets, not for each block
    tiles = min(parts, max(LEAST_TILES, math.ceil(parts / TILE_PARTS)))

    def tile(c):
        return F.floor(F.shiftright(c, 32) * tiles / parts)

    near = near.select(F.col("i.block").alias("i"), F.col("j.block").alias("j")).distinct()
    near = stored(near.select(tile(F.col("i")).alias("ti"), tile(F.col("j")).alias("tj"), "i", "j"), "ego-near")
    met = near.groupBy("ti", "tj", F.col("i").alias("block")).agg(F.collect_list("j").alias("js"))
    met = met.unionByName(near.select("ti", "tj", F.col("j").alias("block"), F.array().cast("array<bigint>").alias("js")))
    met = met.groupBy("ti", "tj", "block").agg(F.flatten(F.collect_set("js")).alias("js"))
    pairs = met.join(blocks.select("block", "reps", "ms", "xs", "ps"), "block").select(
        "ti", "tj", "block", "js", *[F.col(c) for c in ("reps", "ms", "xs", "ps")]
    )
    tasks = max(1, near.select("ti", "tj").distinct().count())

    def joined(group):
        def side(r):
            reps = np.frombuffer(r[4].as_py(), "<i8")
            x = np.frombuffer(r[6].as_py(), kind).reshape(len(reps), -1)
            return reps, np.frombuffer(r[5].as_py(), "<i8"), x, np.frombuffer(r[7].as_py(), "<f8").reshape(len(reps), -1)

        held = {r[2].as_py(): side(r) for r in group}
        for r in group:
            i, js = r[2].as_py(), r[3].as_py()
            ri, mi, xi, pi = held[i]
            ui = _unit(xi.astype(np.float64)) if js else None
            for j in js:
                rj, mj, xj, pj = held[j]
                uj = ui if i == j else _unit(xj.astype(np.float64))
                count, low = join_blocks(ui, uj, mi, mj, pi, pj, i == j, cosine)
                reps = ri if i == j else np.concatenate([ri, rj])
                some = count > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[some]), pa.array(count[some]), pa.array(reps[low[some]])], ["rep", "n", "to"]
                )

    def join(batches):
        key, group = None, []
        for b in batches:
            for r in range(b.num_rows):
                row = [b.column(c)[r] for c in range(8)]
                own = (row[0].as_py(), row[1].as_py())
                if own != key:
                    yield from joined(group)
                    key, group = own, []
                group.append(row)
        yield from joined(group)

    linked = stored(
        pairs.repartition(tasks, "ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(join, "rep long, n long, to long"), "ego-linked"
    )
    found = connected(linked.select(F.col("rep").alias("a"), F.col("to").alias("b")), "ego-edges")
    counts = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    about = classes.join(counts, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.join(about, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
