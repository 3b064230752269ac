"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt over shards of bounded size. A shard's tree splits at the median of
the widest dimension and keeps the tight bounding box of every node. A query goes
through a tree best first, by the largest inner product its box allows, and stops
where that is below the k-th score. Shards are visited in waves, eight times as many
each time; the k-th score of a wave bounds the next ones, so later trees give back
only what can still count.

Queries and shards meet in blocks of bounded size; nothing is broadcast. Of equal
vectors only the k + 1 smallest ids can be among the best, a query's own being one of them,
and of the rows of one id only k, so a group of copies counts as few vectors.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.vectors import padded, usable
from shelfwise.session import stored

K = 20
EVERY = 20
SCALE = 64
SHARD = 20_000
BLOCK = 1_000  # queries that meet a shard at once
LEAF = 256
WAVE = 8


class Tree:
    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        lo, hi, span, kids = [], [], [], []

        def grow(a: int, b: int) -> int:
            at = self.order[a:b]
            x = v[at]
            low, high = x.min(axis=0), x.max(axis=0)
            me = len(lo)
            lo.append(low)
            hi.append(high)
            span.append((a, b))
            kids.append(None)
            widest = int((high - low).argmax()) if v.shape[1] else 0
            if b - a > leaf and v.shape[1] and high[widest] > low[widest]:
                m = (b - a) // 2
                self.order[a:b] = at[np.argpartition(x[:, widest], m)]
                kids[me] = (grow(a, a + m), grow(a + m, b))
            return me

        grow(0, len(ids))
        self.lo, self.hi, self.span, self.kids = np.array(lo), np.array(hi), span, kids
        self.ids, self.v = ids[self.order], v[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T

    def best(self, qid: int, q: np.ndarray, bound: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``, of scores of at least ``kth``, ties to smaller ids."""
        ids, scores = np.empty(0, np.int64), np.empty(0, self.v.dtype)
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= kth:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, e = self.span[node]
            s = self.v[a:e] @ q
            good = (s >= kth) & (self.ids[a:e] != qid)
            if good.any():
                ids = np.concatenate([ids, self.ids[a:e][good]])
                scores = np.concatenate([scores, s[good]])
                if len(ids) > k:
                    keep = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[keep], scores[keep]
                if len(ids) == k:
                    kth = max(kth, scores.min())
        return ids, scores


def _matrices(vectors: list, queries: list) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where sums of products stay exact in them, else as integers."""
    x = padded([*vectors, *queries], np.int64)
    top = float(np.abs(x).max(initial=0))
    if top * top * max(x.shape[1], 1) < 2**52:
        x = x.astype(np.float64)
    return x[: len(vectors)], x[len(vectors) :]


def _visit(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(shard) and len(queries):
        v, q = _matrices(list(shard["v"]), list(queries["v"]))
        tree = Tree(shard["id"].to_numpy(), v)
        bounds = tree.bounds(q)
        for i, (qid, kth) in enumerate(zip(queries["id"], queries["kth"])):
            start = -math.inf if pd.isna(kth) else kth
            ids, scores = tree.best(qid, q[i], bounds[i], k, start)
            found["query_id"] += [qid] * len(ids)
            found["vec_id"] += ids.tolist()
            found["score"] += [int(s) for s in scores]
    return pd.DataFrame(found).astype("int64")


def topk(vectors: DataFrame, id_col="vec_id", vec_col="embedding", k=K, every=EVERY, scale=SCALE, shard=SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for ids divisible by ``every``, the ``k`` best of all other rows.

    Components become floor(scale * x). Vectors that are null or hold null or
    non-finite components, and null ids, take no part. Vectors of unequal length count
    as filled up with zeros. Rows that repeat an id are never found by a query of that
    id. An empty table gives no rows.
    """
    whole = vectors.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = whole.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("rows"))
    ids = ids.withColumn("p", place).filter(F.col("p") <= k + 1)
    points = stored(ids.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")).drop("copy"), "topk-points")
    queries = whole.filter(F.col("id") % every == 0).distinct()
    n, nq = points.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(nq / BLOCK))
    points = points.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    best = None
    first = 0
    while first < shards:
        # wave: the next shards after each block's own, counted in a circle
        size = min(max(1, first * (WAVE - 1)), shards - first)
        offsets = F.explode(F.sequence(F.lit(first), F.lit(first + size - 1))).alias("o")
        asked = queries.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            full = best.filter(f"rank = {k}").select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            asked = queries.join(full, "id", "left")
        asked = asked.select("id", "v", "kth", "block", offsets).select(
            "id", "v", "kth", "block", F.pmod(F.col("block") + F.col("o"), F.lit(shards)).alias("shard")
        )
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
        placed = points.select("id", "v", "shard", block).filter(
            F.pmod(F.col("shard") - F.col("block"), F.lit(shards)).between(first, first + size - 1)
        )
        hits = placed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
            lambda s, q: _visit(s, q, k), "query_id long, vec_id long, score long"
        )
        if best is not None:
            hits = hits.unionByName(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = stored(ranked, "topk-best")
        first += size
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
