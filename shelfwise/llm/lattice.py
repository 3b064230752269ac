"""Subword lattice likelihood of texts.

The pieces and scores of an existing subword vocabulary give every piece a weight; the
pieces of the training words sharpen it. A word's probability is the sum over all its
segmentations into pieces, found by a forward recursion in logarithms over the matches of
an automaton; bytes stand for what no piece covers. No piece spans two words, so a text's
probability is the product over its words, then the end. Every distinct word is scored
once, whatever the number of texts it is in.

Texts are packed into blocks where they are read: the distinct words of a block and, per
text, sorted places among these with counts, compressed. Words are counted and looked up
once per block they occur in, so that a frequent word is one row per block and not per
text, and the blocks get back the counts and scores of their own words. Vocabularies never
leave the shuffles; the fitted model has one number per piece.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import shared_value
from shelfwise.session import stored

HELD_OUT = 10
SMOOTH = 0.1  # added to the count of every word
PRIOR = 32_000.0  # piece counts that the vocabulary's own scores are worth
BLOCK_BYTES = 32 << 20  # of texts: larger blocks ask for a frequent word less often
PART = 33  # bits of a block's number within its task
SPACE = "▁"  # how the vocabulary writes the start of a word
UNUSED = -1e8  # pieces with such scores are in the file but never used
BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, starts array<long>, entries binary, words array<binary>, train array<long>"


def held_out(id_col: str, parts: int) -> Column:
    """Whether the id's remainder is 0; a null id's is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(True))


class Vocabulary:
    """Pieces of a vocabulary file, with the weight that their scores give them.

    Scores of a merge vocabulary are ranks, which Zipf's law turns into weights.
    """

    def __init__(self, path: str):
        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {i: int(model.id_to_piece(i)[3:-1], 16) for i in ids if model.is_byte(i)}
        usual = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {i: model.id_to_piece(i) for i in usual if model.get_score(i) > UNUSED}
        zipf = {i: 1.0 / (1.0 - model.get_score(i)) for i in self.pieces}
        rarest = min(zipf.values(), default=1.0)
        zipf |= {i: rarest for i in self.bytes}
        total = sum(zipf.values())
        self.weight = {i: z / total for i, z in zipf.items()}

    def segmenter(self) -> Callable[[list[str]], list[list[int]]]:
        """The vocabulary's own segmentation of words."""
        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return lambda words: model.encode(words, num_threads=1)


class Lattice:
    """Probabilities of words under weights of pieces, over all segmentations."""

    def __init__(self, vocabulary: Vocabulary, weight: dict[int, float], end: float):
        self.end = math.log10(end)
        log = {i: math.log(w) for i, w in weight.items() if w > 0}
        self.pieces = {p: log[i] for i, p in vocabulary.pieces.items() if i in log}
        self.bytes = [-math.inf] * 256
        for i, b in vocabulary.bytes.items():
            self.bytes[b] = log.get(i, -math.inf)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def score(self, raw: bytes) -> float:
        """log10 of the probability that the word's pieces spell it, in any way."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for p, w in self.pieces.items():
                self.automaton.add_word(p, (len(p), w))
            self.automaton.make_automaton()
        text = SPACE + raw.decode("utf-8", "surrogateescape")
        forward = [0.0] + [-math.inf] * len(text)
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for j, c in enumerate(text):
            spelled = sum(self.bytes[b] for b in c.encode("utf-8", "surrogateescape"))
            arcs = [forward[j] + spelled]
            while match is not None and match[0] == j:
                length, w = match[1]
                arcs.append(forward[j + 1 - length] + w)
                match = next(matches, None)
            top = max(arcs)
            if top > -math.inf:
                forward[j + 1] = top + math.log(sum(math.exp(a - top) for a in arcs))
        return forward[-1] / math.log(10)


def _blocks(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    types = [
        pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()),
        pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()),
    ]
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    class Packer:
        def __init__(self):
            self.place: defaultdict[bytes, int] = defaultdict()
            self.place.default_factory = self.place.__len__
            self.ids, self.held, self.tokens, self.at, self.tf, self.size = [], [], [], [], [], 0

        def add(self, key, held: bool, raw: bytes) -> None:
            found = raw.lower().split()  # of bytes: A-Z only, and at the six ASCII spaces only
            at, tf = np.unique(np.array(list(map(self.place.__getitem__, found)), np.int32), return_counts=True)
            self.ids.append(key)
            self.held.append(held)
            self.tokens.append(len(found) + 1)
            self.at.append(at)
            self.tf.append(tf.astype(np.int32))
            self.size += len(raw)

        def batch(self, number: int) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, self.at)])
            train = np.zeros(len(self.place), np.int64)
            for at, tf, held in zip(self.at, self.tf, self.held):
                if not held:
                    train[at] += tf
            cells = [number, self.ids, self.held, self.tokens, starts, _squeezed(self.at, self.tf), list(self.place), train]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

    def task(batches: Iterable[pa.RecordBatch]):
        number, packer = TaskContext.get().partitionId() << PART, Packer()
        for b in batches:
            for key, held, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                packer.add(key, held, raw.as_py() or b"")
                if packer.size >= BLOCK_BYTES:
                    yield packer.batch(number)
                    number, packer = number + 1, Packer()
        if packer.ids:
            yield packer.batch(number)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, parts).alias("held"), F.col(text_col).cast("binary").alias("raw")
    ).mapInArrow(task, BLOCKS)


def _squeezed(at: list[np.ndarray], tf: list[np.ndarray]) -> bytes:
    """Sorted places as steps from one to the next, then counts."""
    steps = [np.diff(x, prepend=np.int32(0)) for x in at]
    return zlib.compress(np.concatenate([np.empty(0, np.int32), *steps, *tf]).astype("<i4").tobytes(), 1)


def _loosened(entries: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, tf = np.split(np.frombuffer(zlib.decompress(entries), "<i4"), 2)
    upto = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    return upto[1:] - np.repeat(upto[starts[:-1]], np.diff(starts)), tf


def _piece_counts(words: DataFrame, vocabulary: Vocabulary) -> dict[int, int]:
    """How often the pieces are in the training words; a row per piece comes back."""
    shared = shared_value(words.sparkSession, vocabulary)

    def task(batches: Iterable[pa.RecordBatch]):
        segment, found = shared().segmenter(), Counter()
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            for ids, c in zip(segment(words), b.column(1).to_pylist()):
                for i in ids:
                    found[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["piece", "c"])

    counted = words.filter("c > 0").select("word", "c").mapInArrow(task, "piece long, c long")
    return {r.piece: r.c for r in counted.groupBy("piece").agg(F.sum("c").alias("c")).collect()}


def fitted(words: DataFrame, n_ends: int, vocabulary: Vocabulary, prior: float = PRIOR) -> Lattice:
    """A lattice whose weights are the vocabulary's, sharpened by the pieces of ``words(word, c)``."""
    found = _piece_counts(words, vocabulary)
    mass = {i: found.get(i, 0) + prior * w for i, w in vocabulary.weight.items()}
    ends = n_ends + 1.0
    total = sum(mass.values()) + ends
    return Lattice(vocabulary, {i: m / total for i, m in mass.items()}, ends / total)


def _scored_words(words: DataFrame, lattice: Lattice) -> DataFrame:
    """``(word, c, logp)``."""
    shared = shared_value(words.sparkSession, lattice)

    def task(batches: Iterable[pa.RecordBatch]):
        model = shared()
        for b in batches:
            logp = pa.array([model.score(w) for w in b.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), logp], ["word", "c", "logp"])

    return words.select("word", "c").mapInArrow(task, "word binary, c long, logp double")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, vocabulary_path: str, id_col="doc_id", text_col="text", parts=HELD_OUT, smooth=SMOOTH, prior=PRIOR) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Rows whose CRC-32 of the id has a remainder other than 0 are learned from; a null id
    counts as held out. Letters A-Z are lower-cased, tokens are the words and one end; a
    null or empty text has the end alone. ``base_score`` sums log10 of the smoothed shares
    of its tokens among the training tokens, ``score`` is log10 of the text's probability
    over all segmentations of its words. Rows that repeat an id are scored each. With no
    training rows the vocabulary's own weights hold. An empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = stored(_blocks(docs, id_col, text_col, parts), "lattice-blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("words", "train"))).select(
        "block", F.col("pos"), F.col("col.words").alias("word"), F.col("col.train").alias("train")
    )
    words = stored(asked.groupBy("word").agg(F.sum("train").alias("c")), "lattice-words")
    ends = blocks.select(F.explode("held_out").alias("held")).filter("NOT held").count()
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = size.n + ends, size.v + (ends > 0)
    lattice = fitted(words, ends, Vocabulary(vocabulary_path), prior)
    known = stored(_scored_words(words, lattice), "lattice-scores")
    found = asked.join(known, "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "c", "logp"))).alias("found"))
    rows = blocks.drop("words", "train").join(found, "block", "left").select(
        "doc_id", "held_out", "n_tokens", "starts", "entries", F.col("found.c").alias("c"), F.col("found.logp").alias("logp")
    )
    below = n + smooth * (v + 1)
    end = ends, math.log10((ends + smooth) / below), lattice.end
    names = [c.split()[0] for c in SCORES.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                ids, held, tokens, starts, entries, c, logp = (b.column(j)[i].as_py() for j in range(7))
                c, logp, starts = np.array(c or [], np.float64), np.array(logp or [], np.float64), np.array(starts)
                at, tf = _loosened(entries, starts)

                def sums(per_word: np.ndarray) -> np.ndarray:
                    """Per text, over its words."""
                    return np.array([math.fsum(x) for x in np.split(per_word[at] * tf, starts[1:-1])])

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.int64()),
                        pa.array(sums((c > 0).astype(float)).astype(np.int64) + (end[0] > 0)), pa.array([n] * len(ids), pa.int64()),
                        pa.array(sums(np.log10((c + smooth) / below)) + end[1]), pa.array(sums(logp) + end[2]),
                    ],
                    names,
                )

    return rows.mapInArrow(task, SCORES)
