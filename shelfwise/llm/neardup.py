"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its five-word shingles, sampled by 128 min-hashes. Copies of
a set are one class. The trees of the join send a class down the paths its min-hashes
choose: a node of a tree is a sequence of (coordinate, value) pairs, and a class is
in it if it has these values. Nodes of one class end, small nodes are compared
exhaustively. A large node is cut into chunks that share a few of its members and are
compared by themselves, which joins a group of copies in linear work. If all but a few are one
component then, these few meet every chunk, which ends the node; if it holds several large
components, it branches by further coordinates, chosen by a hash of the path. A pair at the threshold agrees on two coordinates with a chance of 0.56, so it
shares no root of the 24 trees once in 4 * 10^8. Below a large node it agrees on the four
coordinates of a branch with a chance of 0.32; of four branches it takes more than one on
average, so that it stays together on some path with a chance of 0.49 however deep the
node is cut. Over 24 trees the recall at the threshold is at least 0.9995 at any depth,
and texts less alike than 0.7 enter less than one branch on average.

To compare a node is to find its clusters of close sketches (a pair at the threshold
is not close once in 10^7) and to confirm pairs on the full sets, closest first. Pairs
of one component are not compared: the trees go in waves, each from its roots to its
last branches, and nodes that earlier waves have joined into one component are dropped
before anything of them is moved. What is shuffled: ids, 128-byte sketches, and the sets
of classes in clusters, once per cluster that still holds several components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import connected
from shelfwise.llm.shingles import shingle_set, words
from shelfwise.session import stored

SHINGLE = 5
PERCENT = 75
TREES = 24
WAVES = (2, 24)  # trees done by the end of each wave
COORDINATES = 128
STEP = 2  # coordinates a root adds to a path
LIMIT = 1024  # classes compared exhaustively
BRANCHES = 4  # children a class may enter below a large node, of twice as many coordinates
DEPTH = 12  # below that, what is still mixed is compared in full, chunk by chunk
SKETCH_AT_LEAST = 0.55
LINKS = 1 << 20  # links between components that one task follows
CHUNK_ROWS = 512
TASK_PAIRS = 1 << 18  # pairs of clusters' members that one task confirms, or more where tasks are few

_RNG = np.random.default_rng(20240131)
_A = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)

DESCRIBED = "doc_id long, n long, f1 long, f2 long, sig binary, sketch binary"


def signature(s: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of 64-bit hashes: 32 bits for each coordinate."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), CHUNK_ROWS):
        np.minimum(low, (s[i : i + CHUNK_ROWS, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _set(raw: bytes | None) -> np.ndarray:
    return shingle_set(words((raw or b"").lower()), SHINGLE)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
        ("sig", pa.binary()), ("sketch", pa.binary()),
    ])

    def task(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            rows = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
                s = _set(raw.as_py())
                f = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                sig = signature(s)
                rows.append((key, len(s), int(f[0]), int(f[1]), sig.tobytes(), sig.astype(np.uint8).tobytes()))
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(columns, schema)], schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return d.mapInArrow(task, DESCRIBED)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: agreeing bytes, less those that agree by chance."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) * 256 / 255


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches with the same first column."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for _, own in groupby(rows, key=itemgetter(0)):
        yield list(own)


class _Union:
    def __init__(self, items):
        self.root = {x: x for x in items}

    def find(self, x):
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def _sketches(raw: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, COORDINATES)


def _close_pairs(x: np.ndarray, comps: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions with close sketches, closest first; none of one component or of sizes too far apart."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for k in range(len(x) - 1):
        low, high = np.minimum(n[k], n[k + 1 :]), np.maximum(n[k], n[k + 1 :])
        j = k + 1 + np.flatnonzero((comps[k + 1 :] != comps[k]) & (low * 100 >= percent * high))
        if len(j):
            close = _agreement(x[k], x[j])
            near = close >= SKETCH_AT_LEAST
            found.append((np.full(near.sum(), k), j[near], close[near]))
    i, j, close = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(-close, kind="stable")
    yield from zip(i[order].tolist(), j[order].tolist())


def _connected(x: np.ndarray) -> Iterator[np.ndarray]:
    """Positions that close sketches connect, group by group."""
    left = np.arange(len(x))
    while len(left):
        group, at = [left[:1]], 0
        left = left[1:]
        while at < len(group) and len(left):
            for k in group[at]:
                near = _agreement(x[k], x[left]) >= SKETCH_AT_LEAST
                if near.any():
                    group.append(left[near])
                    left = left[~near]
            at += 1
        yield np.concatenate(group)


def _clusters(rows: DataFrame) -> DataFrame:
    """``(cluster, rep)`` of lists ``(list, rep, component, sketch)``: connected by close sketches.

    Only clusters of several components come out. The same cluster of several lists is one.
    """

    def task(batches):
        out: list[tuple] = []
        for own in _groups(batches):
            _, reps, comps, sketches = zip(*own)
            for at in _connected(_sketches(sketches)):
                if len({comps[i] for i in at}) > 1:
                    ids = sorted({reps[i] for i in at})
                    digest = hashlib.blake2b(np.array(ids, "<i8").tobytes(), digest_size=8).digest()
                    cluster = int.from_bytes(digest, "little", signed=True)
                    out += [(cluster, r) for r in ids]
            if len(out) >= 10_000:
                yield _batch(out, ("cluster", "rep"))
                out = []
        yield _batch(out, ("cluster", "rep"))

    ordered = rows.select("list", "rep", "component", "sketch").repartition("list").sortWithinPartitions("list")
    return ordered.mapInArrow(task, "cluster long, rep long").distinct()


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))


def _confirmed(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Components ``(a, b)`` that links join, of clusters ``(cluster, rep, component, sketch, n, items)``.

    ``b`` is the smallest component that the links of a cluster lead ``a`` to.
    """

    def unpacked(raw: bytes) -> np.ndarray:
        x = np.zeros((len(raw) // 6, 8), np.uint8)
        x[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return x.view("<u8").ravel()

    def task(batches):
        out: list[tuple] = []
        for own in _groups(batches):
            _, reps, comps, sketches, n, items = zip(*own)
            joined, sets = _Union(comps), {}
            for i, j in _close_pairs(_sketches(sketches), np.array(comps), np.array(n), percent):
                if joined.find(comps[i]) == joined.find(comps[j]):
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = unpacked(items[k])
                both = np.concatenate([sets[i], sets[j]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (n[i] + n[j] - common):
                    joined.join(comps[i], comps[j])
            least: dict = {}
            for x in set(comps):
                root = joined.find(x)
                least[root] = min(x, least.get(root, x))
            out += [(x, least[joined.find(x)]) for x in set(comps) if least[joined.find(x)] != x]
            if len(out) >= 10_000:
                yield _batch(out, ("a", "b"))
                out = []
        yield _batch(out, ("a", "b"))

    # sets of copies are few bytes and much work: what is dealt out by bytes may all be one task
    by = ("cluster",) if tasks == 1 else (tasks, "cluster")
    ordered = rows.select("cluster", "rep", "component", "sketch", "n", "items").repartition(*by)
    return ordered.sortWithinPartitions("cluster").mapInArrow(task, "a long, b long")


def _followed(links: DataFrame) -> DataFrame:
    """``(id, component)`` of the ids in ``links(a, b)``: the smallest id reachable.

    Tasks first follow a bounded number of links each, which leaves one link per id; only
    if these are still too many for a task, they are joined over the cluster.
    """
    tasks = max(1, -(-links.count() // LINKS))

    def task(batches):
        pairs = [p for b in batches for p in zip(*(c.to_pylist() for c in b.columns))]
        for i in range(0, len(pairs), LINKS):
            some = pairs[i : i + LINKS]
            joined = _Union({x for p in some for x in p})
            for a, b in some:
                joined.join(max(a, b), min(a, b))
            least: dict[int, int] = {}
            for x in joined.root:
                root = joined.find(x)
                least[root] = min(x, least.get(root, x))
            yield _batch([(x, least[joined.find(x)]) for x in joined.root], ("id", "component"))

    found = links.select("a", "b").coalesce(tasks).mapInArrow(task, "id long, component long")
    if tasks == 1:
        return found
    return connected(stored(found.select(F.col("id").alias("a"), F.col("component").alias("b")), "near-followed"), "near-edges")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rep, n, items)``: the sets of some documents, each shingle by 48 of its bits."""

    def task(batches):
        for b in batches:
            sets = [_set(raw.as_py()) for raw in b.column(1)]
            items = [np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(items, pa.binary())], ["rep", "n", "items"]
            )

    d = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("raw"))
    return d.join(ids, "rep", "left_semi").mapInArrow(task, "rep long, n long, items binary")


def components(docs: DataFrame, id_col="doc_id", text_col="text", percent=PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    Texts without words, null texts and null ids link with nothing. Rows that repeat an
    id are one node. An empty table gives no rows.
    """
    spark = docs.sparkSession
    a = stored(described(docs, id_col, text_col), "near-described")
    linkable = a.filter("n > 0 AND doc_id IS NOT NULL")
    reps = stored(linkable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "near-classes")
    classes = stored(
        linkable.join(reps, ["f1", "f2"]).filter("doc_id = rep").select("rep", "sig", "sketch"), "near-reps"
    )
    sketches = classes.select("rep", "sketch")
    # false by a filter, these fall out of the plans they are part of
    found = spark.range(0).select(F.col("id").alias("rep"), F.col("id").alias("component")).filter("false")
    sets = spark.range(0).select(F.col("id").alias("rep"), F.col("id").alias("n"), F.lit(b"").alias("items")).filter("false")

    def with_component(rows):
        return rows.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def several(rows, key):
        """Rows of keys that hold several components."""
        open_ = rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        return rows.join(open_.select(key), key, "left_semi")

    def lists(inside, last):
        """Members of nodes, large ones in chunks that share four members; equal lists are one.

        On the last level every two chunks of a large node make a list.
        """
        large = F.col("size") > LIMIT
        chunks = F.when(large, F.ceil(F.col("size") / (LIMIT // 2))).otherwise(1)
        shared = F.array("p1", "p2", "p3", "p4")
        own = inside.select("key", "rep", F.pmod(F.xxhash64("rep"), chunks).alias("chunk"), chunks.alias("chunks"))
        if last:
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
            pairs = own.select("key", "rep", "chunk", every)
            rows = pairs.select("key", F.struct(F.least("chunk", "other"), F.greatest("chunk", "other")).alias("chunk"), "rep")
        else:
            first = inside.filter(large).groupBy("key").agg(
                F.first("size").alias("size"), *[F.first(c).alias(c) for c in ("p1", "p2", "p3", "p4")]
            )
            every = first.select("key", *("p1", "p2", "p3", "p4"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
            rows = own.select("key", "chunk", "rep").unionByName(every.select("key", "chunk", F.explode(shared).alias("rep")))
        grouped = rows.groupBy("key", "chunk").agg(F.array_sort(F.collect_set("rep")).alias("ids"))
        distinct = grouped.filter(F.size("ids") > 1).select("ids").distinct()
        return distinct.select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("rep"))

    def compare(listed):
        """Clusters of lists, confirmed.

        The lists are written first: what reads them twice would else make them twice, and
        the driver would hold the plans and broadcasts of both.
        """
        nonlocal sets
        listed = stored(with_component(listed).select("list", "rep", "component"), "near-lists")
        if listed.isEmpty():
            return
        clusters = stored(_clusters(several(listed, "list").join(sketches, "rep")), "near-clusters")
        pairs = clusters.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        if not pairs:
            return
        missing = stored(clusters.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti"), "near-missing")
        if not missing.isEmpty():
            sets = sets.unionByName(stored(_sets(docs, missing, id_col, text_col), "near-sets"))
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        confirm(clusters, min(-(-pairs // TASK_PAIRS), most))

    def few(mixed):
        """``(key, top, size, most)`` of nodes whose largest component ``top`` holds all but half a list."""
        parts = mixed.groupBy("key", "component").agg(F.count("*").alias("n"))
        nodes = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("size"))
        return nodes.filter(F.col("size") - F.col("most") <= LIMIT // 2).select("key", "top", "size", "most")

    def ended(mixed, ending):
        """Lists ``(list, rep)`` that end nodes: their few others with every chunk of the largest component.

        Trees find a large component again and again. Its nodes are one then, where all others
        with all members are no more pairs than the nodes have one by one.
        """
        half = LIMIT // 2
        own = mixed.join(ending, "key").select("key", "top", "rep", (F.col("component") == F.col("top")).alias("in_top"))
        own = stored(own, "near-own")
        member, other = (F.count_distinct(F.when(is_, F.col("rep"))) for is_ in (F.col("in_top"), ~F.col("in_top")))
        apart = ending.groupBy("top").agg(F.sum(F.col("most") * (F.col("size") - F.col("most"))).alias("pairs"))
        as_one = own.groupBy("top").agg((member * other).alias("all")).join(apart, "top").filter("all <= pairs")
        grouped = own.join(as_one.select("top", F.xxhash64(F.lit("top"), "top").alias("group")), "top", "left")
        grouped = stored(grouped.select(F.coalesce("group", "key").alias("group"), "rep", "in_top").distinct(), "near-grouped")
        sizes = grouped.groupBy("group").agg(
            F.ceil(F.count_if("in_top") / half).alias("chunks"), F.ceil(F.count_if(~F.col("in_top")) / half).alias("parts")
        )
        place = F.xxhash64("rep")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        placed = grouped.join(sizes, "group")
        lists = placed.filter("in_top").select("group", "rep", F.pmod(place, "chunks").alias("chunk"), every("parts").alias("part"))
        lists = lists.unionByName(
            placed.filter("NOT in_top").select("group", "rep", every("chunks").alias("chunk"), F.pmod(place, "parts").alias("part"))
        )
        return lists.select(F.xxhash64("group", "chunk", "part").alias("list"), "rep")

    def confirm(clusters, tasks):
        """Join the components of clusters whose links are confirmed."""
        nonlocal found
        rows = several(with_component(clusters), "cluster")
        new = stored(_confirmed(rows.join(sketches, "rep").join(sets, "rep"), percent, tasks), "near-links")
        if not new.isEmpty():
            # components, not documents, are what is linked from here on
            into = stored(_followed(new).select("id", F.col("component").alias("into")), "near-into")
            known = found.unionByName(into.join(found, F.col("id") == F.col("rep"), "left_anti").select(F.col("id").alias("rep"), F.col("id").alias("component")))
            moved = known.join(into, F.col("component") == F.col("id"), "left")
            found = stored(moved.select("rep", F.coalesce("into", "component").alias("component")), "near-components")

    def value(c):
        return F.substring("sig", c * 4 + 1, F.lit(4))

    def picked(child, i):
        return F.pmod(F.xxhash64("key", F.lit(child), F.lit(i)), F.lit(COORDINATES)).cast("int")

    paths = F.array(*[F.xxhash64("key", F.lit(j), *[value(picked(j, i)) for i in range(2 * STEP)]) for j in range(BRANCHES)])
    for first_tree, upto in zip((0, *WAVES), WAVES):
        roots = F.array(*[
            F.xxhash64(F.lit(t), *[value(F.lit(t * STEP + i)) for i in range(STEP)]) for t in range(first_tree, upto)
        ])
        members = classes.select("rep", F.explode(roots).alias("key"))
        for depth in range(DEPTH + 1):
            known = with_component(members)
            by_hash = F.xxhash64("rep")
            nodes = known.groupBy("key").agg(
                F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"),
                F.min("rep").alias("p1"), F.max("rep").alias("p2"), F.min_by("rep", by_hash).alias("p3"), F.max_by("rep", by_hash).alias("p4"),
            ).filter("lo <> hi").drop("lo", "hi")
            inside = stored(members.join(nodes, "key"), "near-inside")
            last = depth == DEPTH
            big = stored(with_component(inside.filter(F.col("size") > LIMIT).select("key", "rep")), "near-big")
            if big.isEmpty():
                compare(lists(inside, last))
                break
            ending, others = stored(few(big), "near-ending"), inside
            if ending.isEmpty():
                compare(lists(others, last))
            else:
                others = stored(inside.join(ending.select("key"), "key", "left_anti"), "near-others")
                compare(lists(others, last).unionByName(ended(big, ending)))
            large = others.filter(F.col("size") > LIMIT).select("key", "rep")
            if last or large.isEmpty():
                break
            mixed = stored(several(with_component(large), "key").select("key", "rep", "component"), "near-mixed")
            ending = stored(few(mixed), "near-ending")
            if not ending.isEmpty():
                compare(ended(mixed, ending))
                mixed = mixed.join(ending, "key", "left_anti")
            if mixed.isEmpty():
                break
            members = mixed.join(classes.select("rep", "sig"), "rep").select("rep", F.explode(paths).alias("key")).distinct()

    out = a.select("doc_id", "n", "f1", "f2").join(reps, ["f1", "f2"], "left").join(found, "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Rows with a null id stay."""
    kept = components(docs, id_col, text_col).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__near_id"))
    d = docs.withColumn("__near_id", F.coalesce(F.col(id_col).cast("long"), F.lit(None).cast("long")))
    d = d.join(stored(kept.distinct(), "near-kept"), "__near_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("__near_id").orderBy(F.xxhash64(text_col)))
    d = d.withColumn("__near_row", first).filter("__near_row = 1").select(*docs.columns)
    return d.unionByName(docs.filter(F.col(id_col).isNull()))
