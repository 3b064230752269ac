"""Random forests grown level by level on binned sparse features.

All trees of all targets grow together. A pass reads the blocks once: every row goes down
the trees that it was drawn into and that have nodes to count, and what it adds to the
histograms of these nodes is counted by (node, feature, bin, class). Only features that a row has
are counted; absence is what is missing from a node's total. A task adds up its own counts,
they meet by node, and one row per node comes back with its best split. A row's draw into a
tree and a node's draw of features are hashes, so reruns and retries agree.

As usual in forests of this kind a node looks at a share of the features and goes on until
one of them can split it: a node that finds none tries again with twice the share, and so on.
Its tries follow from one more count, of all features: they are taken in the order of the
node's draw, which tells with what share the first able one is found. So a node is
counted twice at most, however many tries it makes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.sparse import Rows, shipped, unpickled

BINS = 16  # bin 0: the feature is absent; the others hold about as many values each
EXPANDED = 1 << 20  # entries looked at together
WALKED = 1 << 17  # entries that go down trees together: their arrays stay in the processor's cache
TOGETHER = 1 << 24  # cells of a dense matrix of the rows looked at together
MERGED = 1 << 21  # counts that a task holds to add them up
CELLS = 1 << 21  # histogram cells compared together
# a row is drawn k times into a tree with the chance of a Poisson variable of mean 1
DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 10)]))

SPLITS = (
    "node long, feature int, cut int, n_rows long, left_rows long, classes array<int>, left array<double>, right array<double>"
)


def stirred(*parts, h=np.uint64(0)) -> np.ndarray:
    """Whole numbers stirred into ``h``, one after the other."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = (np.asarray(p).astype(np.int64).view(np.uint64) ^ h) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def mixed(*parts, h=np.uint64(0)) -> np.ndarray:
    """Uniform draws from [0, 1) by whole numbers, one after the other."""
    return (stirred(*parts, h=h) >> np.uint64(11)) / float(2**53)


@dataclass(frozen=True)
class Growth:
    trees: int
    depth: int
    min_split: int
    min_leaf: int
    share: float  # of the features that a node looks at first
    seed: int


@dataclass
class Trees:
    """Nodes of all trees; node ``t`` is the root of tree ``t``.

    A node with a feature has its children at ``child`` (value in a bin up to ``cut``) and
    ``child + 1``; a leaf has class weights. The size grows with the number of nodes, at most
    ``2 ** (depth + 1)`` per tree.
    """

    level: np.ndarray
    tree: np.ndarray = field(default=None)
    feature: np.ndarray = field(default=None)
    cut: np.ndarray = field(default=None)
    child: np.ndarray = field(default=None)
    depth: np.ndarray = field(default=None)
    tries: np.ndarray = field(default=None)
    open: np.ndarray = field(default=None)
    leaves: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    n_rows: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        n = len(self.level)
        self.tree = np.arange(n, dtype=np.int32)
        self.feature = np.full(n, -1, np.int32)
        self.cut, self.child, self.depth, self.tries = (np.zeros(n, np.int32) for _ in range(4))
        self.open = np.ones(n, bool)
        self.roots, self.new = n, []

    def __getstate__(self):
        return self.__dict__ | {"leaves": {}, "n_rows": {}}  # workers go down the trees only

    def add(self, parent: int, n_rows: int, classes: np.ndarray, weights: np.ndarray, growth: Growth) -> int:
        """A node below another, there after ``settle``."""
        node, depth = len(self.level) + len(self.new), int(self.depth[parent]) + 1
        some = weights > 0
        leaf = n_rows < growth.min_split or depth >= growth.depth or some.sum() < 2
        self.new.append((self.level[parent], self.tree[parent], -1, 0, 0, depth, 0, not leaf))
        if leaf:
            self.leaves[node] = classes[some], weights[some]
        self.n_rows[node] = n_rows
        return node

    def settle(self) -> None:
        names = ("level", "tree", "feature", "cut", "child", "depth", "tries", "open")
        for name, values in zip(names, zip(*self.new)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.array(values, old.dtype)]))
        self.new = []

    def reached(self, dense: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Where rows of bins end up in some trees: ``(tree, row)``."""
        node = np.repeat(trees[:, None], len(dense), axis=1)
        rows = np.arange(len(dense))[None, :]
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            right = dense[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, self.child[node] + right, node)

    def down(self, dense: np.ndarray, trees: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where each row of bins ends up in a tree of its own; only those that are not there yet go on."""
        node = trees.astype(np.int64)
        on, at, first = np.arange(len(node)), node, rows * dense.shape[1]
        flat = dense.ravel()
        while len(on):
            f = self.feature.take(at)
            inner = np.flatnonzero(f >= 0)
            if len(inner) < len(on):
                on, at, f, first = on.take(inner), at.take(inner), f.take(inner), first.take(inner)
            at = self.child.take(at) + (flat.take(first + f) > self.cut.take(at))
            node[on] = at
        return node


def cut_points(rows: DataFrame, n_features: int) -> np.ndarray:
    """Quantiles of the values of each feature, ``(n_features, BINS - 2)``."""
    at = [F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)]
    cells = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e"))
    found = cells.groupBy(F.col("e.indices").alias("i")).agg(F.percentile_approx("e.values", F.array(*at), 1000).alias("cuts"))
    out = np.zeros((n_features, BINS - 2))
    for r in found.collect():
        out[r.i] = r.cuts
    return out


def binned(rows: Rows, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every entry, and a dense matrix of bins."""
    bins = 1 + (cuts[rows.indices] < rows.values[:, None]).sum(axis=1)
    dense = np.zeros((len(rows), max(len(cuts), 1)), np.uint8)
    dense[rows.row_of(), rows.indices] = bins
    return bins, dense


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts by key, those of a key added up."""
    key, *counts = (np.concatenate(c) for c in zip(*parts))
    key, inverse = np.unique(key, return_inverse=True)
    return key, *[np.bincount(inverse, c, len(key)).astype(np.int64) for c in counts]


def _joined(parts: list[tuple]) -> tuple:
    """Blocks as one."""
    rows, codes, keys = zip(*parts)
    sizes = np.concatenate([np.diff(r.starts) for r in rows])
    whole = Rows(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([r.indices for r in rows]), np.concatenate([r.values for r in rows]))
    return whole, np.concatenate(codes), np.concatenate(keys)


def gathered(found: Iterable[tuple], n_features: int) -> Iterable[tuple]:
    """Blocks joined while their dense matrix and their entries are bounded; a larger block is one of its own."""
    parts, n, entries = [], 0, 0
    for block in found:
        own, size = len(block[0]), int(block[0].starts[-1])
        if parts and ((n + own) * n_features > TOGETHER or entries + size > EXPANDED):
            yield _joined(parts)
            parts, n, entries = [], 0, 0
        parts.append(block)
        n, entries = n + own, entries + size
    if parts:
        yield _joined(parts)


def _counted(rows: Rows, codes, keys, trees: Trees, asked: np.ndarray, cuts, growth: Growth, k: int) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of (node, feature, bin, class) with draws and rows for the nodes asked; a node's totals are under one feature more."""
    n_features = len(cuts)
    bins, dense = binned(rows, cuts)
    counts = np.diff(rows.starts)
    nodes = np.flatnonzero(asked)
    place = np.zeros(len(asked), np.int64)
    place[nodes] = np.arange(len(nodes))
    # a node's own part of the draws of its features; on later tries all count
    begun = stirred(growth.seed, nodes)
    share = np.where(trees.tries[nodes] > 0, 1.0, min(growth.share, 1.0))
    node_size = (n_features + 1) * BINS * k
    grown = np.unique(trees.tree[nodes])
    step = max(1, WALKED // max(len(rows), int(rows.starts[-1])))
    for first in range(0, len(grown), step):
        some = grown[first : first + step]
        drawn = np.searchsorted(DRAWS, mixed(keys[None, :], h=stirred(growth.seed, some)[:, None]), "right")
        label = codes[:, trees.level[some]].T
        at, row = np.nonzero((drawn > 0) & (label >= 0))
        node = trees.down(dense, some[at], row)
        here = asked[node]
        at, row, node = at[here], row[here], node[here]
        if not len(at):
            continue
        drawn, label = drawn[at, row], label[at, row].astype(np.int64)
        total = node * node_size + n_features * BINS * k + label
        n = counts[row]
        pair = np.repeat(np.arange(len(row)), n)
        entry = np.arange(len(pair)) + np.repeat(rows.starts[row] - np.cumsum(n) + n, n)
        own = place[node][pair]
        chosen = np.flatnonzero(mixed(rows.indices[entry], h=begun[own]) < share[own])
        pair, entry = pair[chosen], entry[chosen]
        key = node[pair] * node_size + (rows.indices[entry].astype(np.int64) * BINS + bins[entry]) * k + label[pair]
        yield _added([(total, drawn, np.ones(len(total), np.int64)), (key, drawn[pair], np.ones(len(key), np.int64))])


def _summed(found: Iterable[tuple[np.ndarray, ...]]) -> Iterable[tuple[np.ndarray, ...]]:
    """Counts of a task, added up while a bounded number is held."""
    parts, n = [], 0
    for cells in found:
        parts.append(cells)
        n += len(cells[0])
        if n > MERGED:
            parts = [_added(parts)]
            n = len(parts[0][0])
            if n > MERGED // 2:
                yield parts[0]
                parts, n = [], 0
    if parts:
        yield _added(parts)


def best_split(feature, bins, label, drawn, n_rows, n_features: int, weights: np.ndarray, growth: Growth, node: int, first: bool):
    """``(feature, cut, rows, left rows, classes, left, right)`` from a node's counts; feature -1 if none can split.

    Splits are compared by Gini impurity, ties to the smaller feature and bin. On a
    node's later tries the first feature of its draw that can split is taken.
    """
    own = feature == n_features
    classes, place = np.unique(label, return_inverse=True)
    totals = np.bincount(place[own], drawn[own] * weights[label[own]], len(classes))
    all_rows = int(n_rows[own].sum())
    found = -1, 0, all_rows, 0, classes, totals, np.zeros(len(classes))
    features, which = np.unique(feature[~own], return_inverse=True)
    place, bins, value, n_rows = place[~own], bins[~own], (drawn * weights[label])[~own], n_rows[~own]
    if not len(features):
        return found
    order = np.arange(len(features)) if first else np.argsort(mixed(growth.seed, node, features), kind="stable")
    best = -np.inf
    step = max(1, CELLS // (BINS * len(classes)))
    for i in range(0, len(features), step):
        some = order[i : i + step]
        position = np.full(len(features), -1)
        position[some] = np.arange(len(some))
        mine = position[which] >= 0
        at = position[which[mine]] * BINS + bins[mine]
        shape = (len(some), BINS, len(classes))
        cells = np.bincount(at * len(classes) + place[mine], value[mine], np.prod(shape)).reshape(shape)
        rows = np.bincount(at, n_rows[mine], len(some) * BINS).reshape(shape[:2])
        cells[:, 0], rows[:, 0] = totals - cells.sum(axis=1), all_rows - rows.sum(axis=1)
        left, left_rows = np.cumsum(cells, axis=1)[:, :-1], np.cumsum(rows, axis=1)[:, :-1]
        right = np.maximum(totals - left, 0)
        valid = (left_rows >= growth.min_leaf) & (all_rows - left_rows >= growth.min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left**2).sum(axis=2) / left.sum(axis=2) + (right**2).sum(axis=2) / right.sum(axis=2)
        gain = np.where(valid, gain, -np.inf)
        if not first:  # in the order of the draw
            able = np.flatnonzero(valid.any(axis=1))
            if not len(able):
                continue
            gain[np.arange(len(some)) != able[0]] = -np.inf
        j, cut = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, cut] > best:
            best = gain[j, cut]
            found = int(features[some[j]]), int(cut), all_rows, int(left_rows[j, cut]), classes, left[j, cut], right[j, cut]
        if not first:
            break
    return found


def _splits(counts: DataFrame, trees: Trees, n_features: int, k: int, weights: list[np.ndarray], growth: Growth, n_nodes: int) -> list:
    """The best split of every open node that has rows."""
    node_size = (n_features + 1) * BINS * k
    shared = shipped(counts.sparkSession, (trees.level, trees.tries, weights, growth))

    def task(batches: Iterable[pa.RecordBatch]):
        level, tries, weights, growth = shared()

        def row(node, parts):
            key, drawn, n_rows = (np.concatenate(c) for c in zip(*parts))
            feature, rest = np.divmod(key - node * node_size, BINS * k)
            bins, label = np.divmod(rest, k)
            split = best_split(feature, bins, label, drawn, n_rows, n_features, weights[level[node]], growth, node, tries[node] == 0)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            cells = [node, *split[:4], *[x.tolist() for x in split[4:]]]
            names = [c.split()[0] for c in SPLITS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

        now, parts = None, []
        for b in batches:
            key, drawn, n_rows = (b.column(i).to_numpy() for i in (1, 2, 3))
            node = key // node_size
            edges = np.flatnonzero(np.diff(node)) + 1
            for own in np.split(np.arange(len(key)), edges):
                if not len(own):
                    continue
                if node[own[0]] != now:
                    if parts:
                        yield row(now, parts)
                    now, parts = int(node[own[0]]), []
                parts.append((key[own], drawn[own], n_rows[own]))
        if parts:
            yield row(now, parts)

    # a node's counts go to one task and are added up there; nodes cost by number, not by bytes
    n = max(1, min(n_nodes, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = counts.select(F.expr(f"key div {node_size}L").alias("node"), "key", "drawn", "n_rows").repartition(n, "node")
    merged = placed.groupBy("node", "key").agg(F.sum("drawn").alias("drawn"), F.sum("n_rows").alias("n_rows"))
    return merged.sortWithinPartitions("key").mapInArrow(task, SPLITS).collect()


def tries_of(share: float, draw: float) -> int:
    """The try at which a share that doubles is above a draw."""
    n = 0
    while min(share * 2.0**n, 1.0) <= draw:
        n += 1
    return n


def grow(blocks: DataFrame, cuts: np.ndarray, n_classes: list[int], weights: list[np.ndarray], levels: list[int], growth: Growth) -> Trees:
    """``growth.trees`` trees for each of ``levels``, places among the codes of the blocks.

    ``weights`` are those of the classes of every level.
    """
    trees = Trees(np.repeat(np.array(levels, np.int32), growth.trees))
    n_features, k = len(cuts), max([n_classes[level] for level in levels], default=1)
    waiting = {}  # splits found, by node, until the try that finds them: nodes are numbered by rounds
    while trees.open.any():
        asked = trees.open.copy()
        asked[list(waiting)] = False
        found = {}
        if asked.any():
            shared = shipped(blocks.sparkSession, (trees, asked, cuts, growth))

            def task(batches: Iterable[pa.RecordBatch]):
                trees, asked, cuts, growth = shared()
                parts = gathered(unpickled(batches), max(len(cuts), 1))
                for cells in _summed(c for p in parts for c in _counted(*p, trees, asked, cuts, growth, k)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["key", "drawn", "n_rows"])

            counts = blocks.mapInArrow(task, "key long, drawn long, n_rows long")
            found = {r.node: r for r in _splits(counts, trees, n_features, k, weights, growth, int(asked.sum()))}
        for node in np.flatnonzero(trees.open).tolist():
            r = found.get(node) if asked[node] else waiting[node]
            if r is None:  # no row was drawn
                trees.leaves[node], trees.open[node] = (np.empty(0, np.int64), np.empty(0)), False
                continue
            classes, left, right = np.array(r.classes, np.int64), np.array(r.left), np.array(r.right)
            trees.n_rows[node] = r.n_rows
            tries = int(trees.tries[node])
            small = r.n_rows < growth.min_split or len(classes) < 2 or trees.depth[node] >= growth.depth
            if r.feature >= 0 and not small and (tries == 0 or tries >= tries_of(growth.share, mixed(growth.seed, node, r.feature))):
                child = trees.add(node, r.left_rows, classes, left, growth)
                trees.add(node, r.n_rows - r.left_rows, classes, right, growth)
                trees.feature[node], trees.cut[node], trees.child[node], trees.open[node] = r.feature, r.cut, child, False
                waiting.pop(node, None)
            elif small or (r.feature < 0 and (tries > 0 or growth.share >= 1)):
                trees.leaves[node], trees.open[node] = (classes, left + right), False
            else:
                trees.tries[node] += 1
                if tries > 0:
                    waiting[node] = r
        trees.settle()
    return trees


class Voter:
    """Mean class shares of the leaves that rows reach."""

    def __init__(self, trees: Trees, cuts: np.ndarray, n_classes: list[int]):
        self.trees, self.cuts, self.n_classes = trees, cuts, n_classes
        sizes = np.zeros(len(trees.level) + 1, np.int64)
        for node, (classes, _) in trees.leaves.items():
            sizes[node + 1] = len(classes)
        self.starts = np.cumsum(sizes)
        order = sorted(trees.leaves)
        none = np.empty(0, np.int64)
        self.classes = np.concatenate([none, *[trees.leaves[n][0] for n in order]]).astype(np.int64)
        self.shares = np.concatenate([np.empty(0), *[trees.leaves[n][1] / max(trees.leaves[n][1].sum(), 1e-300) for n in order]])
        trees.leaves, trees.n_rows = {}, {}

    def codes(self, rows: Rows, level: int) -> np.ndarray:
        """The class of every row, ties to the first."""
        own = np.flatnonzero(self.trees.level[: self.trees.roots] == level)
        out = np.zeros(len(rows), np.int64)
        step = max(1, EXPANDED // max(1, len(self.cuts)))
        for a in range(0, len(rows), step):
            part = rows.part(a, min(a + step, len(rows)))
            node = self.trees.reached(binned(part, self.cuts)[1], own)
            n = (self.starts[node + 1] - self.starts[node]).ravel()
            at = np.repeat(self.starts[node].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.repeat(np.tile(np.arange(len(part)), len(own)), n)
            k = self.n_classes[level]
            total = np.bincount(row * k + self.classes[at], self.shares[at], len(part) * k).reshape(len(part), k)
            # equal but for rounding is a tie
            out[a : a + len(part)] = np.round(total, 9).argmax(axis=1)
        return out
