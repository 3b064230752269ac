"""Centroid clustering with heap-ordered bounds.

After an exact scan a vector knows its distance to the nearest centroid (upper) and to
the second nearest one (lower). While centroids move, the gap between the two shrinks by
at most the drift of its own centroid plus the largest drift of another. Each cluster adds
up these drifts in one offset, and a vector enters the heap of its cluster with its gap
plus the offset of that time: the gap is used up when the offset has passed the key. So a
round pops the heaps while their top has expired, scans only those vectors exactly, and
pushes them with new keys.

The vectors are packed into blocks where they are read and stay there, cached and dealt by
block; what changes is a small written table with the heaps and the sums of each block's
clusters. A round shuffles that table only, and the driver sees k centroids and drifts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.vectors import compact, floored, usable
from shelfwise.session import stored

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SALT = "3:"
BLOCK = 4096  # vectors of a block
PART = 33  # bits of a block's number within its task
MOST = 2.0**27  # of a component: squared distances of DIMS components fit a long
WIDEN = 1 + 1e-9  # more than floats can be off

BLOCKS = "block long, n long, ids binary, bits int, ints binary"
STATE = "block long, heaps array<binary>, counts array<long>, sums array<long>, scanned long"


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(centroids).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < 2**52:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x.astype(np.int64) - c
        out[:, j] = (d * d).sum(axis=1)
    return out


def keys(gap: np.ndarray, offset: float, rows: np.ndarray) -> np.ndarray:
    """Heap entries: a gap plus an offset in the upper 32 bits, never rounded up, the row in the lower ones.

    Floats that are not negative sort as their bits do.
    """
    wide = np.maximum(gap + offset, 0)
    narrow = wide.astype(np.float32)
    narrow = np.where(narrow > wide, np.nextafter(narrow, np.float32(0)), narrow).astype(np.float32)
    return narrow.view(np.int32).astype(np.int64) << 32 | rows


def expired_below(offset: float) -> int:
    """The least entry that has not expired when a cluster's drifts add up to ``offset``."""
    narrow = np.float32(offset)
    if narrow < offset:
        narrow = np.nextafter(narrow, np.float32(np.inf))
    return (int(narrow.view(np.int32)) + 1) << 32


class Block:
    """The heaps of one block: every row is in the heap of its cluster."""

    def __init__(self, x: np.ndarray, k: int):
        self.x = x
        self.heaps: list[list[int]] = [[] for _ in range(k)]
        self.counts = np.zeros(k, np.int64)
        self.sums = np.zeros((k, x.shape[1]), np.int64)

    def scan(self, rows: np.ndarray, centroids: np.ndarray, offsets: np.ndarray) -> None:
        """Give rows that are in no heap to their nearest centroids; ties to the smaller number."""
        d = squares(self.x[rows], centroids)
        near = d.argmin(axis=1)
        first = np.sqrt(d[np.arange(len(d)), near].astype(np.float64))
        d[np.arange(len(d)), near] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(d), np.inf)
        gap = second * (2 - WIDEN) - first * WIDEN
        for j in np.unique(near):
            mine = near == j
            self.counts[j] += mine.sum()
            self.sums[j] += self.x[rows[mine]].sum(axis=0, dtype=np.int64)
            entries = keys(gap[mine], offsets[j], rows[mine]).tolist()
            if len(entries) > len(self.heaps[j]):
                self.heaps[j] += entries
                heapq.heapify(self.heaps[j])
            else:
                for entry in entries:
                    heapq.heappush(self.heaps[j], entry)

    def pop(self, offsets: np.ndarray) -> np.ndarray:
        """Take out the rows whose gap has expired."""
        out = []
        for j, heap in enumerate(self.heaps):
            bar, mine = expired_below(offsets[j]), []
            while heap and heap[0] < bar:
                mine.append(heapq.heappop(heap) & 0xFFFFFFFF)
            self.counts[j] -= len(mine)
            self.sums[j] -= self.x[mine].sum(axis=0, dtype=np.int64)
            out += mine
        return np.array(out, np.int64)

    def clusters(self) -> np.ndarray:
        out = np.empty(len(self.x), np.int64)
        for j, heap in enumerate(self.heaps):
            out[np.array(heap, np.int64) & 0xFFFFFFFF] = j
        return out


def _blocks(rows: DataFrame, dims: int, scale: float) -> DataFrame:
    """Vectors ``(id, v)`` packed where they are read."""

    def task(batches: Iterable[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << PART
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                x = compact(floored(b.column(1), scale, dims, MOST))
                ids = pa.array([b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([b.num_rows]), ids, pa.array([x.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                    ["block", "n", "ids", "bits", "ints"],
                )
                number += 1

    return rows.mapInArrow(task, BLOCKS)


def _unpacked(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["ints"], f"<i{row['bits']}").reshape(row["n"], dims)


def _restored(row: dict, dims: int, k: int) -> Block:
    out = Block(_unpacked(row, dims), k)
    if row["heaps"] is not None:
        out.heaps = [np.frombuffer(h, "<i8").tolist() for h in row["heaps"]]
        out.counts = np.array(row["counts"], np.int64)
        out.sums = np.array(row["sums"], np.int64).reshape(k, dims)
    return out


def _moved(block: Block, row: dict, centroids: np.ndarray, offsets: np.ndarray) -> int:
    """Assign every row of a block; how many were scanned."""
    rows = np.arange(row["n"]) if row["heaps"] is None else block.pop(offsets)
    if len(rows):
        block.scan(rows, centroids, offsets)
    return len(rows)


def _round(rows: DataFrame, centroids: np.ndarray, offsets: np.ndarray, dims: int) -> DataFrame:
    """Blocks with their state, assigned anew: the next state."""
    k = len(centroids)

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _restored(row, dims, k)
                scanned = _moved(block, row, centroids, offsets)
                heaps = [np.array(h, "<i8").tobytes() for h in block.heaps]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]]), pa.array([heaps], pa.list_(pa.binary())), pa.array([block.counts.tolist()], pa.list_(pa.int64())),
                        pa.array([block.sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned]),
                    ],
                    ["block", "heaps", "counts", "sums", "scanned"],
                )

    return rows.mapInArrow(task, STATE)


def _assigned(rows: DataFrame, centroids: np.ndarray, offsets: np.ndarray, dims: int) -> DataFrame:
    """``(id, cluster, distance)`` of every vector after the last assignment."""
    k = len(centroids)

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _restored(row, dims, k)
                _moved(block, row, centroids, offsets)
                cluster = block.clusters()
                distance = np.empty(len(cluster), np.int64)
                for j in range(k):
                    mine = np.flatnonzero(cluster == j)
                    distance[mine] = squares(block.x[mine], centroids[j : j + 1])[:, 0]
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return rows.mapInArrow(task, "id long, cluster int, distance long")


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[list[int]]]:
    """Count and sum of every cluster over all blocks: k * (dims + 1) numbers."""
    cells = state.select(F.posexplode(F.concat("counts", "sums")))
    found = {r.pos: int(r.total) for r in cells.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()}
    counts = [found[j] for j in range(k)]
    return counts, [[found[k + j * dims + i] for i in range(dims)] for j in range(k)]


def clustered(
    vectors: DataFrame, id_col="vec_id", vec_col="embedding", k=CLUSTERS, rounds=ROUNDS, dims=DIMS, scale=SCALE, salt=SALT, seen: list | None = None
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector.

    Components become floor(scale * x). Centroids start as the ``k`` vectors whose
    ``salt`` and id have the smallest SHA-256, in that order, ties by the vector; fewer
    vectors make fewer clusters. Each round assigns every vector to the nearest centroid,
    ties to the smaller number, and replaces a centroid that has vectors by the floor of
    their mean. After the last round vectors are assigned once more.

    Only vectors of ``dims`` components count, none of them null or not finite. Rows that
    repeat an id are vectors of their own; null ids keep their row (as id null) and never
    start a cluster. Components beyond ``MOST`` are cut back to it, so
    that squared distances fit a long. An inertia that does not fit a long is null. An empty table gives no rows.

    ``seen`` gets the number of vectors scanned in each round.
    """
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = vectors.filter(usable(vec_col) & (F.size(vec_col) == dims)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")
    )
    no_id = -(2**63)
    path = stored(_blocks(kept.withColumn("id", F.coalesce("id", F.lit(no_id))), dims, scale), "centroid-blocks")
    blocks = path.repartition(_tasks(spark, path), "block").persist()
    try:
        starts = kept.filter("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
        starts = starts.orderBy("h", "id", "v").limit(k).collect()
        if not starts:
            return spark.createDataFrame([], out)
        centroids = np.concatenate([floored(pa.array([r.v], pa.list_(pa.float64())), scale, dims, MOST) for r in starts])
        k = len(centroids)
        offsets = np.zeros(k)
        rows = blocks.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("heaps", "array<binary>"), ("counts", "array<long>"), ("sums", "array<long>"))])
        for _ in range(rounds):
            state = stored(_round(rows, centroids, offsets, dims), "centroid-state")
            if seen is not None:
                seen.append(state.agg(F.sum("scanned")).first()[0])
            counts, sums = _sums(state, k, dims)
            moved = np.array([[s // n for s in row] if n else list(c) for c, n, row in zip(centroids.tolist(), counts, sums)], np.int64)
            drift = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1)) * WIDEN
            others = np.array([max(np.delete(drift, j), default=0.0) for j in range(k)])
            offsets, centroids = (offsets + drift + others) * WIDEN, moved
            rows = blocks.join(state.drop("scanned").hint("shuffle_hash"), "block")
        last = stored(_assigned(rows, centroids, offsets, dims), "centroid-assigned")
    finally:
        blocks.unpersist()
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: r.d for r in last.groupBy("cluster").agg(total.alias("d")).collect()}
    fits = lambda d: int(d) if d < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = [(j, fits(d), fits(sum(inertia.values())), digest[j]) for j, d in inertia.items()]
    figures = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = last.select(F.when(F.col("id") != no_id, F.col("id")).alias("vec_id"), "cluster", "distance")
    return named.join(F.broadcast(figures), "cluster").select(*[c.split()[0] for c in out.split(", ")])


def _tasks(spark, blocks: DataFrame) -> int:
    """As many tasks as a shuffle has, but no more than there are blocks."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> str:
    """The same in SQL, a pair of tables per round."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, e AS c
  FROM (SELECT sha256('{salt}' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, e, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS place
  FROM (SELECT vec_id, e, cluster, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r})) WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN
  (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY cluster) n USING (cluster))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, a.cluster::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


ORACLE = oracle()
