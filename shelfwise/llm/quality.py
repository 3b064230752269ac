"""Quality scores by voting of the nearest labelled documents in a latent space.

A text is described by how its words look (letters, case, digits, marks), by pairs
of neighbouring looks, by hashed words and by how much it repeats itself. The
latent space is the singular-value decomposition of the labelled rows. Every
document is compared with every labelled vector by blocked matrix products, and its
nearest neighbours vote, weighted by similarity.

The fit uses at most ``PER_LABEL`` labelled rows of each label, those of the smallest
hash of their id; that bounds what is sent to the workers (about 3 MB). A vote counts
as many rows as its label has per row drawn, so the draw does not shift the scores.
Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WORDS, shared_value

PER_LABEL = 3000
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8  # the power of the cosine that weights a vote
THRESHOLD = 0.7
LOOKS, PAIRS, BAGS, EXTRAS = 1024, 1024, 1024, 4
DIMS = LOOKS + PAIRS + BAGS + EXTRAS
BLOCK = 256
WEIGHTS = (1.0, 0.8, 0.25, 0.8)

_RUN = re.compile(r"(.)\1+", re.S)


def look(word: str) -> str:
    """A word's shape: runs of lower case x, upper case X, digits 9, other characters as they are."""
    if word.isalpha():  # the common cases
        if word.islower():
            return "x"
        if word[0].isupper() and word[1:].islower():
            return "Xx"
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", out)


class Describer:
    """Feature rows of texts. Keeps what it knows of words seen, up to a bound."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def _word(self, w: str) -> int:
        raw = w.encode("utf-8", "surrogatepass")
        code = zlib.crc32(raw) << 20 | (zlib.crc32(look(w).encode("utf-8", "surrogatepass")) % LOOKS)
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[w] = code
        return code

    def row(self, text: str | None, out: np.ndarray) -> None:
        """Fill ``out`` (zeros). An empty text has the extra of its own and nothing else."""
        words = WORDS(text or "")
        n = len(words)
        extras = out[-EXTRAS:]
        if not n:
            extras[0] = WEIGHTS[3]
            return
        known, learn = self.known, self._word
        codes = np.fromiter((known[w] if w in known else learn(w) for w in words), np.int64, n)
        looks, bags = codes & (LOOKS - 1), codes >> 20
        out[:LOOKS] = WEIGHTS[0] * np.sqrt(np.bincount(looks, minlength=LOOKS) / n)
        if n > 1:
            pairs = (looks[1:] * 769 + looks[:-1]) % PAIRS
            out[LOOKS : LOOKS + PAIRS] = WEIGHTS[1] * np.sqrt(np.bincount(pairs, minlength=PAIRS) / (n - 1))
            extras[1] = WEIGHTS[3] * np.sqrt((codes[1:] == codes[:-1]).mean())
            extras[2] = WEIGHTS[3] * np.sqrt((codes[2:] == codes[:-2]).mean()) if n > 2 else 0
            extras[3] = WEIGHTS[3] * np.sqrt(1 - len(np.unique(codes)) / n) / 2
        out[LOOKS + PAIRS : -EXTRAS] = WEIGHTS[2] * np.sqrt(np.bincount(bags % BAGS, minlength=BAGS) / n)

    def rows(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), DIMS), np.float32)
        for i, t in enumerate(texts):
            self.row(t, out[i])
        return out


class Model:
    """Latent axes and labelled vectors."""

    def __init__(self, axes: np.ndarray, mean: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.axes, self.mean, self.vectors = axes, mean, vectors
        self.labels, self.weights = labels, weights
        total = weights.sum()
        self.prior = float((weights * labels).sum() / total) if total else 0.5

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rank: int = RANK) -> Model:
        if not len(x):
            return cls(np.zeros((DIMS, 1), np.float32), np.zeros(DIMS, np.float32), np.zeros((0, 1), np.float32), labels, weights)
        mean = x.mean(axis=0)
        centred = x - mean
        k = min(rank, *x.shape)
        rng = np.random.default_rng(7)
        y = centred @ rng.standard_normal((x.shape[1], min(k + 10, x.shape[1])), dtype=np.float32)
        for _ in range(3):  # subspace iteration
            q, _ = np.linalg.qr(centred.T @ np.linalg.qr(y)[0])
            y = centred @ q
        _, _, vt = np.linalg.svd(np.linalg.qr(y)[0].T @ centred, full_matrices=False)
        axes = np.ascontiguousarray(vt[:k].T, dtype=np.float32)
        return cls(axes, mean, cls._unit(centred @ axes), labels, weights)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 1e-9).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours' votes; the prior where nothing is similar."""
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        cos = self._unit((x - self.mean) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS * self.weights[near]
        tiny = 1e-6
        return np.clip(((w * self.labels[near]).sum(1) + tiny * self.prior) / (w.sum(1) + tiny), 0, 1)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", per_label=PER_LABEL) -> Model:
    """Fit on labelled rows that are not held out. Labels other than 0 and 1, and ids without a text row, do not count."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id")
    )
    population = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("id"), "id")
    drawn = usable.filter("y = 0").orderBy(*order).limit(per_label).unionByName(
        usable.filter("y = 1").orderBy(*order).limit(per_label)
    )
    schema = pa.schema([("y", pa.int32()), ("x", pa.binary())])

    def describe(batches: Iterable[pa.RecordBatch]):
        d = Describer()
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x = d.rows(part.column(1).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], schema=schema
                )

    # the drawn ids are 2 * per_label rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "id")
    table = rows.select("y", "t").mapInArrow(describe, "y int, x binary").toArrow()
    y = np.asarray(table.column(0).to_pylist(), dtype=np.float64)
    x = np.zeros((len(y), DIMS), np.float32)
    for i, r in enumerate(table.column(1)):
        x[i] = np.frombuffer(zlib.decompress(r.as_py()), np.float16)
    order_rows = np.lexsort((*x[:, :8].T, x.sum(axis=1), y))  # whatever order the rows came in
    x, y = x[order_rows], y[order_rows]
    share = {c: population[c] / max((y == c).sum(), 1) for c in population}
    return Model.fit(x, y, np.asarray([share[c] for c in y]))


def scored(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with ``__score`` of every row; a null text counts as empty. The texts go through one pass."""
    shared = shared_value(docs.sparkSession, model)
    score_type = pa.float64()

    def task(batches):
        d, m = Describer(), shared()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                s = m.score(d.rows(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, score_type)], [*part.schema.names, "__score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    return docs.mapInArrow(task, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Null ids are not held out. Repeated rows each have their row. Without labelled
    rows every score is 0.5, the prior of no knowledge.
    """
    s = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return s.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold."""
    return scored(docs, fit(docs, labels)).filter(F.col("__score") >= THRESHOLD).drop("__score")
