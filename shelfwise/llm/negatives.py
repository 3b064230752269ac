"""Hard-negative mining with rotated one-bit codes.

Every vector of whole numbers is stored as the signs of its rotated offset from the
mean of its block, with the length of the offset and its alignment: the inner product
of the unit offset and its code vector. An anchor is rotated too and cut into bit
planes, so that its product with a code vector is a sum of popcounts. The part of an
offset that the code does not explain is orthogonal to the code vector, so by
Cauchy-Schwarz its product with the anchor is at most the product of what remains of
both. That gives each score an interval that always holds it. Rows whose interval
cannot reach what counts are left out; the others are scored by integers.

The rows stay where they are read and become blocks of bounded size, sorted by label.
Blocks are dealt over shards, and blocks of anchors, a hundredth of the rows, are
copied to the shards: one pass finds the positives of each anchor, and a second one
their negatives. Each shard gives back a few rows per anchor.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.vectors import MOST, compact, floored, products, usable
from shelfwise.session import stored

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
FLOOR_PERCENT = 80
PLANES = 6  # bits of an anchor's rotated components
BLOCK = 1024  # vectors of a stored block, fewer if they are wide
BLOCK_VALUES = 1 << 20
GATHER = 16  # blocks whose rows are sorted by label together
ANCHORS = 256  # anchors that meet a block at once
SHARD_BYTES = 32 << 20
SLACK = 1e-9  # of the product of lengths: more than floats can be off
SEED = 11


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by random signs and a Walsh-Hadamard transform, three times; the width is a power of two."""
    n, d = x.shape
    x = x.astype(np.float64)
    for signs in np.random.default_rng(SEED).choice([-1.0, 1.0], (3, d)):
        x = x * signs
        step = 1
        while step < d:
            x = x.reshape(n, -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
            step *= 2
        x /= math.sqrt(d)
    return x


def _widened(x: np.ndarray) -> np.ndarray:
    """Filled up with zeros to a power of two of whole 64-bit words."""
    d = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encoded(x: np.ndarray) -> dict[str, np.ndarray]:
    """Codes of rows of whole numbers: ``centre, codes, norm, align``."""
    centre = x.mean(axis=0)
    r = rotated(_widened(x - centre))
    norm = np.linalg.norm(r, axis=1)
    bits = r >= 0
    # the code vector is the signs over sqrt(width)
    align = np.abs(r).sum(axis=1) / math.sqrt(r.shape[1]) / np.where(norm > 0, norm, 1)
    return {"centre": centre, "codes": _words(bits), "norm": norm, "align": np.minimum(align, 1.0)}


class Asked:
    """Anchors in bit planes."""

    def __init__(self, x: np.ndarray):
        self.x = x
        r = rotated(_widened(x))
        self.width = r.shape[1]
        low, high = r.min(axis=1), r.max(axis=1)
        self.low, self.step = low, (high - low) / (2**PLANES - 1)
        step = np.where(self.step > 0, self.step, 1)[:, None]
        u = np.rint((r - low[:, None]) / step).astype(np.uint8)
        self.planes = [_words((u >> p & 1).astype(bool)) for p in range(PLANES)]
        self.total = u.sum(axis=1, dtype=np.int64)
        q = low[:, None] + self.step[:, None] * u
        self.square = (q * q).sum(axis=1)
        self.off = np.linalg.norm(r - q, axis=1)  # what the planes leave out
        self.length = np.linalg.norm(x.astype(np.float64), axis=1)

    def intervals(self, block: dict) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner product of every anchor with every row of a block."""
        codes = block["codes"]
        count = np.zeros((len(self.x), len(codes)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                count += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << p
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        t = self.low[:, None] * (2 * ones - self.width) + self.step[:, None] * (2 * count - self.total[:, None])
        t /= math.sqrt(self.width)
        rest = np.sqrt(np.maximum(self.square[:, None] - t * t, 0)) * np.sqrt(1 - block["align"] ** 2)
        half = block["norm"] * (rest + self.off[:, None])
        centre = np.linalg.norm(block["centre"])
        half += SLACK * self.length[:, None] * (block["norm"] + centre) + SLACK
        middle = (self.x @ block["centre"])[:, None] + block["norm"] * block["align"] * t
        return np.clip(middle - half, -MOST, MOST), np.clip(middle + half, -MOST, MOST)

    def reach(self, block: dict) -> np.ndarray:
        """The most that any row of a block can score."""
        centre = np.linalg.norm(block["centre"])
        most = self.x @ block["centre"] + self.length * block["norm"].max(initial=0)
        return most + SLACK * self.length * (block["norm"].max(initial=0) + centre) + SLACK


class Best:
    """The first ``k`` rows of a list: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def _same(own: dict, block: dict) -> np.ndarray:
    """Which rows of a block have the label of which anchor."""
    places = {name: i for i, name in enumerate(block["names"])}
    here = np.array([places.get(name, -1) for name in own["names"]])
    return here[own["labels"]][:, None] == block["labels"][None, :]


def _positives(asked: Asked, own: dict, blocks: list[dict], k: int) -> list[Best]:
    best = [Best(k) for _ in own["ids"]]
    for b in blocks:
        same = _same(own, b)
        same &= own["ids"][:, None] != b["ids"][None, :]
        at = np.array([x.least for x in best])
        open_ = np.flatnonzero(same.any(axis=1) & (asked.reach(b) >= at))
        if not len(open_):
            continue
        part = _only(asked, open_)
        low, high = part.intervals(b)
        same, at = same[open_], at[open_]
        if same.shape[1] >= k:  # k rows surely reach the k-th lower bound
            sure = np.where(same, low, -np.inf)
            at = np.maximum(at, np.partition(sure, -k, axis=1)[:, -k])
        keep = same & (high >= at[:, None])
        cols = np.flatnonzero(keep.any(axis=0))
        exact = products(part.x, b["ints"][cols])
        for i, a in enumerate(open_):
            mine = keep[i, cols] & (exact[i] >= best[a].least)
            if mine.any():
                best[a].add(b["ids"][cols[mine]], exact[i, mine])
    return best


def _negatives(asked: Asked, own: dict, blocks: list[dict], k: int, percent: int) -> list[dict[int, Best]]:
    """For each anchor, the first rows for each distinct score of its positives."""
    best = [{int(p): Best(k) for p in ps} for ps in own["scores"]]
    top = np.array([max(b, default=-math.inf) for b in best])
    for b in blocks:
        other = ~_same(own, b) & (own["ids"][:, None] != b["ids"][None, :])
        # a row counts between the least score that any list still wants and its highest positive
        at = np.array([min((max(percent * p / 100, x.least) for p, x in mine.items()), default=math.inf) for mine in best])
        open_ = np.flatnonzero(other.any(axis=1) & (asked.reach(b) >= at) & (at <= top))
        if not len(open_):
            continue
        part = _only(asked, open_)
        low, high = part.intervals(b)
        keep = other[open_] & (high >= at[open_, None]) & (low <= top[open_, None])
        cols = np.flatnonzero(keep.any(axis=0))
        exact = products(part.x, b["ints"][cols])
        keep = keep[:, cols] & (exact >= at[open_, None]) & (exact <= top[open_, None])
        for i in np.flatnonzero(keep.any(axis=1)):
            ids, scores = b["ids"][cols[keep[i]]], exact[i, keep[i]]
            for p, x in best[open_[i]].items():
                mine = (100 * scores >= percent * p) & (scores <= p) & (scores >= x.least)
                if mine.any():
                    x.add(ids[mine], scores[mine])
    return best


def _only(asked: Asked, rows: np.ndarray) -> Asked:
    """Some of the anchors."""
    out = Asked.__new__(Asked)
    out.width = asked.width
    for name in ("x", "low", "step", "total", "square", "off", "length"):
        setattr(out, name, getattr(asked, name)[rows])
    out.planes = [p[rows] for p in asked.planes]
    return out


PACKED = "part long, place long, n long, payload binary"


def _packed(rows: DataFrame, width: int, scale: float, block: int, encode: bool) -> DataFrame:
    """``(part, place, n, payload)`` of ``(id, label, v[, scores])``: rows sorted by label, in blocks, where they are read."""
    names = rows.columns[3:]
    block = max(1, min(block, BLOCK_VALUES // max(width, 1)))

    def block_of(ids, labels, x, more) -> bytes:
        names, labels = np.unique(labels, return_inverse=True)
        out = {"ids": ids, "names": names, "labels": labels, "ints": compact(x), **more}
        return pickle.dumps(out | (encoded(x) if encode else {}))

    def cut(kept: list[tuple], place: int) -> Iterator[pa.RecordBatch]:
        ids, labels, x = (np.concatenate([k[i] for k in kept]) for i in range(3))
        more = [sum((k[3 + j] for k in kept), []) for j in range(len(names))]
        order = np.lexsort((ids, labels))
        for i in range(0, len(order), block):
            at = order[i : i + block]
            payload = block_of(ids[at], labels[at], x[at], {c: [m[k] for k in at] for c, m in zip(names, more)})
            values = [TaskContext.get().partitionId(), place + i // block, len(at), payload]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["part", "place", "n", "payload"])

    def task(batches: Iterable[pa.RecordBatch]):
        kept, held, place = [], 0, 0
        for whole in batches:
            for i in range(0, whole.num_rows, block):
                b = whole.slice(i, block)
                labels = np.array(b.column(1).to_pylist(), dtype=object)
                kept.append((
                    b.column(0).to_numpy(), labels.astype(str), floored(b.column(2), scale, width),
                    *[b.column(3 + j).to_pylist() for j in range(len(names))],
                ))
                held += b.num_rows
                if held >= GATHER * block:
                    yield from cut(kept, place)
                    kept, held, place = [], 0, place + GATHER + 1
        if kept:
            yield from cut(kept, place)

    return rows.mapInArrow(task, PACKED)


def _searched(blocks: DataFrame, anchors: DataFrame, shards: int, visit: Callable, schema: str) -> DataFrame:
    """Every block of anchors against the blocks of every shard."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]):
        now, held = None, []
        for batch in batches:
            for shard, kind, payload in zip(*(batch.column(i) for i in range(3))):
                if shard.as_py() != now:
                    now, held = shard.as_py(), []
                own = pickle.loads(payload.as_py())
                if kind.as_py() == 0:
                    held.append(own)
                elif held:
                    found = visit(Asked(own["ints"].astype(np.int64)), own, held)
                    columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    shard = F.pmod(F.xxhash64("part", "place"), F.lit(shards))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    placed = blocks.select(shard.alias("shard"), F.lit(0).alias("kind"), "payload")
    placed = placed.unionByName(anchors.select(every.alias("shard"), F.lit(1).alias("kind"), "payload"))
    # a number of its own: little data here is much work, which should not be put together for its size
    return placed.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(task, schema)


def mined(
    vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label",
    every=EVERY, scale=SCALE, positives=POSITIVES, negatives=NEGATIVES, percent=FLOOR_PERCENT,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. Components become
    floor(scale * x) and a row's score is its inner product with the anchor. The positives
    of an anchor are its first rows of the same label, its negatives for each positive the
    first rows of another label with a score from ``percent`` of the positive's score up to
    it; higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component take no
    part. Vectors of unequal length count as filled up with zeros. Rows that repeat an id
    are all candidates, though never for an anchor of that id; of anchors with one id, the
    one with the smallest label, then vector asks. Components beyond 2^53 and scores
    beyond 2^56 are cut back to these. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = vectors.filter(usable(vec_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v")
    )
    width = whole.agg(F.max(F.size("v"))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return spark.createDataFrame([], schema)
    blocks = stored(_packed(whole, width, scale, BLOCK, True), "negatives-blocks")
    first = F.min(F.struct("label", "v")).alias("a")
    anchors = stored(whole.filter(F.col("id") % every == 0).groupBy("id").agg(first).select("id", "a.label", "a.v"), "negatives-anchors")
    size = blocks.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    # a shard holds a bounded number of bytes; a small table has a shard for every core
    shards = max(math.ceil(size.n * (8 * width + 64) / SHARD_BYTES), min(spark.sparkContext.defaultParallelism, size.blocks))

    def nearest(asked, own, held):
        found = [], [], []
        for a, best in zip(own["ids"], _positives(asked, own, held, positives)):
            for c, x in zip(found, (np.full(len(best.ids), a), best.ids, best.scores)):
                c.append(x)
        return found

    packed = stored(_packed(anchors, width, scale, ANCHORS, False), "negatives-asked")
    near = _searched(blocks, packed, shards, nearest, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = stored(near, "negatives-positives")

    def hardest(asked, own, held):
        found = [], [], [], []
        for a, mine in zip(own["ids"], _negatives(asked, own, held, negatives, percent)):
            for p, best in mine.items():
                n = len(best.ids)
                for c, x in zip(found, (np.full(n, a), np.full(n, p), best.ids, best.scores)):
                    c.append(x)
        return found

    wanted = near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    asking = anchors.join(wanted, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "scores")
    packed = stored(_packed(asking, width, scale, ANCHORS, False), "negatives-asking")
    hard = _searched(blocks, packed, shards, hardest, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
