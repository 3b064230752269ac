"""Supervised models learn what can be learned, and fall back where they must."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import baseline, forest, metrics, supervised, svm
from shelfwise.operators.sparse import Rows, blocks
from shelfwise.plans.supervised import Dataset, train_and_score

LEVELS = ("segment", "class")


@pytest.fixture(scope="module")
def parts(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("text"),
        F.lit("parts").alias("segment"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("class"),
    )


TRAINERS = {
    "forest": lambda rows, levels: supervised.train_forest(
        rows, "row_id", "text", levels, options=supervised.ForestOptions(trees=15, depth=8)
    ),
    "svm": lambda rows, levels: supervised.train_svm(rows, "row_id", "text", levels),
}


@pytest.mark.parametrize("kind", TRAINERS)
def test_better_than_the_baseline(parts, kind):
    split = baseline.stratified_split(parts, "row_id", "class")
    train, test = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    models = TRAINERS[kind](train, LEVELS)
    assert models.constants == {"segment": "parts"} and list(models.models) == ["class"]
    predicted = models.predict(test, "row_id", "text", LEVELS)
    assert predicted.count() == test.count()
    assert predicted.select("predicted_segment").distinct().first()[0] == "parts"
    learned = metrics.weighted_f1(predicted, "class", "predicted_class").first()[0]
    guess = baseline.baseline_predict(train, "class", test, "row_id", "most_frequent")
    guessed = metrics.weighted_f1(guess.join(test, "row_id"), "class", "label").first()[0]
    assert learned > 0.8 > guessed


def test_texts_without_known_terms_keep_their_row(spark, parts):
    models = TRAINERS["svm"](parts, ("class",))
    odd = spark.createDataFrame([(1, "qqq"), (2, ""), (3, None)], "row_id long, text string")
    assert models.predict(odd, "row_id", "text").count() == 3


def test_scores_per_dataset(parts):
    wide = parts.withColumns({"family": F.col("class"), "brick": F.col("class")})
    names = ["segment", "family", "class", "brick"]
    train = Dataset(wide, "row_id", "text", names)
    renamed = Dataset(
        wide.select(F.col("row_id").alias("k"), F.col("text").alias("n"), *[F.col(c).alias(f"x_{c}") for c in names]),
        "k",
        "n",
        [f"x_{c}" for c in names],
    )
    _, found = train_and_score(
        train, {"same": renamed}, lambda rows: TRAINERS["forest"](rows, ("segment", "family", "class", "brick"))
    )
    rows = found.collect()
    assert {(r.dataset, r.level) for r in rows} == {(d, v) for d in ("validation", "same") for v in names}
    assert all(r.weighted_f1 > 0.8 for r in rows)


def sparse_rows(spark, x, labels):
    """Rows of a dense matrix with their labels."""
    data = []
    for i, (r, y) in enumerate(zip(x, labels)):
        at = np.flatnonzero(r)
        data.append((i, [int(j) for j in at], [float(v) for v in r[at]], y))
    return spark.createDataFrame(data, "row_id long, indices array<int>, values array<double>, level string")


def random_rows(n=120, width=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.random((n, width)) * (rng.random((n, width)) < 0.3)
    x[5] = 0
    return x


def test_rows_multiply():
    x = random_rows()
    at = [np.flatnonzero(r) for r in x]
    rows = Rows.of(pa.array([a.tolist() for a in at]), pa.array([r[a].tolist() for a, r in zip(at, x)]))
    dense = np.random.default_rng(1).random((12, 4))
    assert np.allclose(rows.times(dense), x @ dense)
    wide = np.random.default_rng(2).random((len(x), 3))
    features, sums = rows.transposed_times(wide, rows.columns())
    whole = np.zeros((12, 3))
    whole[features] = sums
    assert np.allclose(whole, x.T @ wide)
    assert np.allclose(rows.part(3, 9).times(dense), x[3:9] @ dense)


@pytest.mark.parametrize("classes", [2, 4])
def test_svm_is_at_its_minimum(spark, classes):
    x = random_rows()
    labels = ["abcd"[i % classes] if x[i, 0] < 0.5 else "a" for i in range(len(x))]
    names = sorted(set(labels))
    rows = sparse_rows(spark, x, labels).repartition(3)
    packed = blocks(rows, ["level"], {"level": names}, "row_id")
    columns = [svm.Column(0, j, 1.0 + j, 0.5) for j in range(len(names))]
    passes = []
    w = svm.solve(packed, x.shape[1], columns, 1.0, 1e-8, 1000, passes)
    assert passes[0] < 200
    wide = np.hstack([x, np.ones((len(x), 1))])
    for j, name in enumerate(names):
        y = np.where(np.array(labels) == name, 1.0, -1.0)
        s = np.where(y > 0, 1.0 + j, 0.5)
        short = np.maximum(1 - y * (wide @ w[:, j]), 0)
        gradient = w[:, j] - 2 * wide.T @ (s * y * short)
        first = 2 * wide.T @ (s * y)
        assert np.linalg.norm(gradient) <= 1.1e-8 * np.linalg.norm(first)
    assert np.allclose(w, svm.solve(packed, x.shape[1], columns, 1.0, 1e-8, 1000), rtol=0, atol=0)  # reruns agree


def test_svm_jobs_do_not_grow_with_classes(spark, parts):
    """All classes of all levels share their passes."""
    passes = []
    models = supervised.train_svm(
        parts.withColumn("other", F.split_part("text", F.lit(" "), F.lit(2))), "row_id", "text", ("class", "other"), passes=passes
    )
    assert len(passes) == 1 and passes[0] < 200
    assert len(models.labels["class"]) + len(models.labels["other"]) > 10


def test_svm_groups_are_bounded(monkeypatch):
    columns = [svm.Column(0, j, 1.0, 1.0) for j in range(10)]
    monkeypatch.setattr(svm, "GROUP_BYTES", 8 * 101 * 4)
    assert [len(g) for g in svm.groups(100, columns)] == [4, 4, 2]
    assert [len(g) for g in svm.groups(10**6, columns)] == [1] * 10


def grown(spark, x, labels, **options):
    names = sorted(set(labels))
    rows = sparse_rows(spark, x, labels).repartition(3)
    packed = blocks(rows, ["level"], {"level": names}, "row_id")
    growth = forest.Growth(**{"trees": 6, "depth": 20, "min_split": 5, "min_leaf": 2, "share": 0.4, "seed": 42, **options})
    cuts = forest.cut_points(rows, x.shape[1])
    trees = forest.grow(packed, cuts, [len(names)], [np.ones(len(names))], [0], growth)
    return trees, cuts, names


def test_forest_limits(spark):
    x = random_rows(300)
    labels = ["abc"[int(r[0] > 0) + int(r[1] > 0.3)] for r in x]
    trees, cuts, names = grown(spark, x, labels)
    inner = np.flatnonzero(trees.feature >= 0)
    assert len(inner) > 6 and not trees.open.any()
    assert all(trees.n_rows[n] >= 5 for n in inner.tolist())  # no node below 5 rows splits
    for n in inner.tolist():
        left, right = int(trees.child[n]), int(trees.child[n]) + 1
        assert trees.n_rows[left] + trees.n_rows[right] == trees.n_rows[n]
        assert min(trees.n_rows[left], trees.n_rows[right]) >= 2
    larger, _, _ = grown(spark, x, labels, min_split=40)
    assert all(larger.n_rows[n] >= 40 for n in np.flatnonzero(larger.feature >= 0).tolist())
    flat, _, _ = grown(spark, x, labels, depth=2)
    assert flat.depth.max() == 2
    again, _, _ = grown(spark, x, labels)
    assert (again.feature == trees.feature).all() and (again.cut == trees.cut).all()
    # the rows of a node are those drawn into its tree that reach it
    bins, dense = forest.binned(Rows.of(*[pa.array(c) for c in zip(*[(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x])]), cuts)
    keys = np.array([r[0] for r in spark.range(300).select(F.xxhash64(F.col("id").cast("string"))).collect()])
    drawn = np.searchsorted(forest.DRAWS, forest.mixed(42, np.arange(6)[:, None], keys[None, :]), "right") > 0
    at = trees.reached(dense, np.arange(6))
    counts = np.bincount(at[drawn], minlength=len(trees.level))
    assert all(counts[n] == trees.n_rows[n] for n in np.flatnonzero(trees.feature < 0).tolist())


def test_forest_counts_a_node_twice_at_most(spark, monkeypatch):
    """Tries after the first one follow from one count of all features, and are what try after try gives."""
    x = random_rows(300)
    labels = ["abc"[int(r[0] > 0) + int(r[1] > 0.3)] for r in x]
    counted, splits = [], forest._splits
    monkeypatch.setattr(forest, "_splits", lambda *a: counted.append(splits(*a)) or counted[-1])
    trees, cuts, _ = grown(spark, x, labels, share=0.01)
    times = np.bincount([r.node for found in counted for r in found])
    assert times.max() == 2
    # after a failed try a node takes the first feature of its draw that can split it, at the try that shows it
    later = np.flatnonzero((trees.tries > 1) & (trees.feature >= 0))
    assert len(later) > 6
    entries = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x]
    _, dense = forest.binned(Rows.of(*[pa.array(c) for c in zip(*entries)]), cuts)
    keys = np.array([r[0] for r in spark.range(300).select(F.xxhash64(F.col("id").cast("string"))).collect()])
    up = {int(c) + side: n for n, c in enumerate(trees.child) if trees.feature[n] >= 0 for side in (0, 1)}
    for n in later.tolist():
        draw = forest.mixed(42, n, np.arange(x.shape[1]))
        assert 0.01 * 2.0 ** (trees.tries[n] - 1) <= draw[trees.feature[n]] < 0.01 * 2.0 ** trees.tries[n]
        path = [n]
        while path[-1] in up:
            path.append(up[path[-1]])
        mine = np.searchsorted(forest.DRAWS, forest.mixed(42, path[-1], keys), "right") > 0
        for child, node in zip(path, path[1:]):
            mine &= (dense[:, trees.feature[node]] > trees.cut[node]) == (child == trees.child[node] + 1)
        assert mine.sum() == trees.n_rows[n]
        low = [[min((dense[mine, j] <= c).sum(), (dense[mine, j] > c).sum()) for c in range(forest.BINS - 1)] for j in range(x.shape[1])]
        able = np.flatnonzero(np.max(low, axis=1) >= 2)
        assert trees.feature[n] == able[np.argmin(draw[able])]


def test_forest_blocks_are_counted_together(monkeypatch):
    """Joined blocks give the same counts, and a task adds its own up."""
    x = random_rows(90)
    rows = Rows.of(*[pa.array(c) for c in zip(*[(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x])])
    codes, keys = (x[:, :1] > 0).astype(np.int32), np.arange(90)
    cuts = np.tile(np.linspace(0.1, 0.9, forest.BINS - 2), (x.shape[1], 1))
    trees, growth = forest.Trees(np.zeros(5, np.int32)), forest.Growth(5, 9, 5, 2, 0.5, 1)
    found = []
    for together in (1, 1 << 24):
        monkeypatch.setattr(forest, "TOGETHER", together)
        parts = [(rows.part(i, i + 10), codes[i : i + 10], keys[i : i + 10]) for i in range(0, 90, 10)]
        whole = list(forest.gathered(parts, x.shape[1]))
        assert len(whole) == (9 if together == 1 else 1)
        cells = list(forest._summed(c for p in whole for c in forest._counted(*p, trees, trees.open, cuts, growth, 2)))
        assert len(cells) == 1
        found.append([c.tolist() for c in cells[0]])
    assert found[0] == found[1]


def test_best_split_is_the_best():
    rng = np.random.default_rng(5)
    x = random_rows(60, 4, 7)
    bins = np.ceil(x * 10).astype(int)
    y = rng.integers(0, 3, 60)
    weights = np.array([1.0, 2.0, 0.5])
    growth = forest.Growth(1, 9, 5, 2, 1.0, 1)
    cells: dict[tuple, int] = {}
    for r, c in zip(bins, y):
        for key in [(4, 0, c), *[(j, b, c) for j, b in enumerate(r) if b]]:
            cells[key] = cells.get(key, 0) + 1
    feature, b, label = (np.array(v) for v in zip(*sorted(cells)))
    n = np.array([cells[k] for k in sorted(cells)])
    found = forest.best_split(feature, b, label, n, n, 4, weights, growth, 0, True)
    best = None
    for j in range(4):
        for cut in range(forest.BINS - 1):
            left = bins[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= 2:
                sides = [np.bincount(y[m], minlength=3) * weights for m in (left, ~left)]
                gain = sum((s**2).sum() / s.sum() for s in sides)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, j, cut
    assert found[:2] == best[1:]


def test_levels_without_labels(spark, parts):
    rows = parts.withColumn("none", F.lit(None).cast("string")).withColumn("some", F.when(F.col("row_id") % 3 > 0, F.col("class")))
    for kind in TRAINERS:
        models = TRAINERS[kind](rows, ("none", "some"))
        assert models.constants == {"none": None} and list(models.models) == ["some"]
        predicted = models.predict(rows, "row_id", "text", ("class",))
        assert predicted.columns == ["row_id", "class", "predicted_some", "predicted_none"]
        assert predicted.where("predicted_some = class").count() > 0.9 * predicted.count()
