"""Per-level supervised classifiers on sparse TF-IDF features.

The models of all levels are trained together: linear SVMs share their passes, and so do
the trees of forests.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import prep_ascii, prep_symbols
from shelfwise.operators import forest, svm
from shelfwise.operators.sparse import Features, Rows, blocks, fit_features, shipped, slices
from shelfwise.operators.weights import TermOptions
from shelfwise.session import stored


@dataclass(frozen=True)
class ForestOptions:
    """``min_split`` and ``min_leaf`` count the rows drawn into a tree, each once."""

    trees: int = 200
    depth: int = 20
    min_split: int = 5
    min_leaf: int = 2
    seed: int = 42


@dataclass(frozen=True)
class SvmOptions:
    """A class is solved when its gradient has shrunk to ``tol`` of that at zero;
    ``max_iter`` is a backstop on the passes."""

    c: float = 1.0
    tol: float = 1e-4
    max_iter: int = 1_000


def forest_terms(stopwords: Sequence[str]) -> TermOptions:
    return TermOptions((1, 3), 2, 0.95, 10_000, True, tuple(stopwords))


def svm_terms(stopwords: Sequence[str]) -> TermOptions:
    return TermOptions((1, 2), 2, 0.95, 15_000, True, tuple(stopwords))


class SvmScorer:
    """Weights of the classes of several levels, in groups of bounded size."""

    def __init__(self, groups: list[tuple[list[svm.Column], np.ndarray]]):
        self.groups = groups

    def codes(self, rows: Rows, level: int) -> np.ndarray:
        """The class with the largest margin, ties to the first."""
        best, out = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        for columns, w in self.groups:
            own = [i for i, c in enumerate(columns) if c.level == level]
            if not own:
                continue
            margin = np.round(rows.times(w[:-1, own]) + w[-1, own], 9)
            at = margin.argmax(axis=1)
            top = margin[np.arange(len(rows)), at]
            out = np.where(top > best, np.array([columns[i].code for i in own])[at], out)
            best = np.maximum(top, best)
        return out


@dataclass
class LevelModels:
    """A fitted model, or the constant label, per level."""

    features: Features
    models: dict[str, object] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    constants: dict[str, str | None] = field(default_factory=dict)
    places: dict[str, int] = field(default_factory=dict)

    def predict(self, df: DataFrame, row_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
        """``(row_id, *keep, predicted_<level> ...)``, one pass over the rows for all levels."""
        rows = self.features.transform(df, row_id, text, keep)
        first = rows.columns[:-2]
        levels = list(self.models)
        shared = shipped(df.sparkSession, (self.models, self.labels, self.places))

        def task(batches: Iterable[pa.RecordBatch]):
            models, labels, places = shared()
            for b in batches:
                x = Rows.of(b.column(len(first)), b.column(len(first) + 1))
                found = []
                for level in levels:
                    parts = [models[level].codes(x.part(i, j), places[level]) for i, j in slices(x)]
                    names = np.array(labels[level], dtype=object)
                    found.append(pa.array(names[np.concatenate(parts)] if parts else [], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(first)], *found], [*first, *[f"predicted_{v}" for v in levels]])

        fields = [*rows.schema.fields[: len(first)], *[T.StructField(f"predicted_{v}", T.StringType()) for v in levels]]
        out = rows.mapInArrow(task, T.StructType(fields)) if levels else rows
        out = out.withColumns({f"predicted_{v}": F.lit(label).cast("string") for v, label in self.constants.items()})
        return out.select(row_id, *keep, *[f"predicted_{v}" for v in [*self.models, *self.constants]])


def class_counts(rows: DataFrame, levels: Sequence[str]) -> dict[str, dict[str, int]]:
    """Labelled rows per class of each level, classes in order; a model has an entry per class anyway."""
    cells = [F.struct(F.lit(v).alias("level"), F.col(v).cast("string").alias("label")) for v in levels]
    counted = rows.select(F.inline(F.array(*cells))).where("label IS NOT NULL").groupBy("level", "label").agg(F.count("*").alias("n"))
    out: dict[str, dict[str, int]] = {level: {} for level in levels}
    for r in sorted(counted.collect(), key=lambda r: r.label):
        out[r.level][r.label] = r.n
    return out


def _train(train: DataFrame, row_id: str, text: str, levels: Sequence[str], features: Features, fit) -> LevelModels:
    """``fit(rows, blocks, trained, weights)`` gives a model per place in ``levels``; ``weights`` are balanced."""
    fitted = LevelModels(features)
    rows = stored(features.transform(train, row_id, text, levels), "supervised-rows")
    counts = class_counts(rows, levels)
    fitted.labels = {level: list(counts[level]) for level in levels}
    fitted.places = {level: i for i, level in enumerate(levels)}
    trained = [i for i, level in enumerate(levels) if len(counts[level]) > 1]
    for level in levels:
        if len(counts[level]) < 2:
            fitted.constants[level] = next(iter(counts[level]), None)
    if trained:
        weights = []
        for level in levels:
            n = np.array(list(counts[level].values()), float)
            weights.append(n.sum() / (len(n) * n) if len(n) else n)
        packed = blocks(rows, levels, fitted.labels, row_id).persist()
        try:
            found = fit(rows, packed, trained, weights)
        finally:
            packed.unpersist()
        fitted.models = {levels[i]: found[i] for i in trained}
    return fitted


def train_forest(
    train: DataFrame,
    row_id: str,
    text: str,
    levels: Sequence[str],
    stopwords: Sequence[str] = (),
    options: ForestOptions = ForestOptions(),
) -> LevelModels:
    """A random forest per level on 1- to 3-grams; a node looks at the square root of the features."""
    features = fit_features(train, row_id, text, forest_terms(stopwords), prep_ascii)

    def fit(rows, packed, trained, weights):
        cuts = forest.cut_points(rows, features.size)
        share = max(features.size, 1) ** -0.5
        growth = forest.Growth(options.trees, options.depth, options.min_split, options.min_leaf, share, options.seed)
        sizes = [len(w) for w in weights]
        model = forest.Voter(forest.grow(packed, cuts, sizes, weights, trained, growth), cuts, sizes)
        return dict.fromkeys(trained, model)

    return _train(train, row_id, text, levels, features, fit)


def train_svm(
    train: DataFrame,
    row_id: str,
    text: str,
    levels: Sequence[str],
    stopwords: Sequence[str] = (),
    options: SvmOptions = SvmOptions(),
    passes: list | None = None,
) -> LevelModels:
    """A one-vs-rest linear SVM with squared hinge loss per level on 1- and 2-grams.

    ``passes`` gets the number of passes over the rows.
    """
    features = fit_features(train, row_id, text, svm_terms(stopwords), prep_symbols)

    def fit(rows, packed, trained, weights):
        columns = []
        for i in trained:
            two = len(weights[i]) == 2
            columns += [svm.Column(i, j, w, weights[i][1 - j] if two else 1.0) for j, w in enumerate(weights[i])]
        solved = [
            (group, svm.solve(packed, features.size, group, options.c, options.tol, options.max_iter, passes))
            for group in svm.groups(features.size, columns)
        ]
        return dict.fromkeys(trained, SvmScorer(solved))

    return _train(train, row_id, text, levels, features, fit)
