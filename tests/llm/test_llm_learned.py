"""Hard negatives, centroid clusters and lattice scores against their definitions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import centroids, lattice, negatives
from shelfwise.llm.queries import PIECES
from shelfwise.llm.vectors import compact, floored, products

CLASH = "vec_id long, embedding array<float>, label int, shard long, place int, payload string, cluster int, block long, id string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def table(spark, own):
    return spark.createDataFrame([(i, e, y, 1, 2, "p", 3, 4, "x") for i, e, y in own], CLASH)


def numbers(n, dims, seed, spread=1.0, groups=6):
    """Vectors around a few centres, some equal to others."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dims))
    x = centre[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dims))
    x[: n // 10] = x[0]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


BAD = [None, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63]


# --- hard negatives ----------------------------------------------------------------


def brute_mined(own, every=100, k=5):
    pool = []
    width = max([len(e) for _, e, _ in own if e] or [0])
    for i, e, y in own:
        if i is not None and y is not None and e is not None and all(v is not None and np.isfinite(v) for v in e):
            pool.append((i, y, np.pad(np.floor(256 * np.array(e, float)), (0, width - len(e))).astype(int)))
    anchors = {}
    for i, y, x in sorted(pool, key=lambda r: (r[0], str(r[1]), r[2].tolist())):
        if i % every == 0:
            anchors.setdefault(i, (y, x))
    out = []
    for a, (y, x) in anchors.items():
        scored = sorted((-int(x @ v), i, z) for i, z, v in pool if i != a)
        for p, pid, _ in [r for r in scored if r[2] == y][:k]:
            hard = [r for r in scored if r[2] != y and 80 * -p <= 100 * -r[0] <= 100 * -p][:k]
            out += [(a, pid, rank + 1, n, -p, -s) for rank, (s, n, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("spread, block", [(0.2, 1024), (0.2, 7), (3.0, 64)])
def test_mined(spark, monkeypatch, spread, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    own = [(i, [float(v) for v in e], int(rng.integers(0, 3))) for i, e in enumerate(numbers(900, 20, 3, spread))]
    assert sorted(rows(negatives.mined(table(spark, own)))) == brute_mined(own)


def test_mined_odd_rows(spark):
    own = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(numbers(60, 64, 8))]
    own += [(100 + i, e, 1) for i, e in enumerate(BAD)] + [(None, [0.1] * 64, 0), (104, [0.1] * 64, None)]
    own += [(200, [], 0), (300, [5.0, 1.0], 1), (400, [0.0] * 64, 1), own[7], own[0], (0, [0.2] * 64, 9), (500, [1e6] * 3, 0)]
    assert sorted(rows(negatives.mined(table(spark, own)))) == brute_mined(own)
    assert rows(negatives.mined(table(spark, own).limit(0))) == []
    assert rows(negatives.mined(table(spark, [(100, None, 1)]))) == []
    assert negatives.mined(table(spark, [(100, [1e30] * 64, 1), (1, [1e30] * 64, 1), (2, [1e29] * 64, 0)])).count() == 1


@pytest.mark.parametrize("dims, spread, groups", [(5, 0.1, 6), (64, 1.0, 6), (100, 0.0, 6), (64, 0.1, 1)])
def test_intervals_hold_their_scores(dims, spread, groups):
    x = np.floor(256 * numbers(500, dims, 1, spread, groups)).astype(np.int64)
    block, asked = negatives.encoded(x), negatives.Asked(x[:40])
    low, high = asked.intervals(block)
    exact = products(x[:40], x)
    assert (low <= exact).all() and (exact <= high).all()
    assert (exact.max(axis=1) <= asked.reach(block)).all()
    if groups == 1:  # close to the block's mean the intervals are short
        assert np.median(high - low) < 0.2 * exact.max()


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((9, 64))
    assert np.allclose(negatives.rotated(x) @ negatives.rotated(x).T, x @ x.T)


def test_exact_whole_numbers():
    import pyarrow as pa

    x = floored(pa.array([[1e30, -1e30], [0.5, -0.26], [1.0]], pa.list_(pa.float64())), 4.0, 2)
    assert x[1].tolist() == [2, -2] and x[2].tolist() == [4, 0] and x[0, 0] == -x[0, 1]
    assert x[0, 0] == 2**53 and products(x, x)[0, 0] == 2**56
    assert products(x[1:], x[1:]).tolist() == [[8, 8], [8, 16]]
    assert (compact(x) == x).all() and compact(x[1:]).dtype == np.int8


# --- centroid clusters -------------------------------------------------------------


def brute_clusters(own, k=8, rounds=10):
    kept = [(i, np.floor(1024 * np.array(e, float)).astype(int)) for i, e in own if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    ids, x = [i for i, _ in kept], np.array([e for _, e in kept])
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, e.tolist()) for i, e in kept if i is not None)[:k]
    c = np.array([e for _, _, e in first])

    def nearest():
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        at, _ = nearest()
        for j in range(len(c)):
            if (at == j).any():
                c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)]
    at, d = nearest()
    digest = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted(((i, int(a), int(b), int(d[at == a].sum()), int(d.sum()), digest[a]) for i, a, b in zip(ids, at, d)), key=repr)


@pytest.mark.parametrize("spread, block", [(0.3, 4096), (2.0, 31)])
def test_clusters(spark, monkeypatch, spread, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    own = [(i, [float(v) for v in e]) for i, e in enumerate(numbers(700, 64, 6, spread))]
    seen = []
    found = centroids.clustered(table(spark, [(*r, 1) for r in own]).repartition(3), seen=seen)
    assert sorted(rows(found), key=repr) == brute_clusters(own)
    assert seen[0] == 700 and sum(seen[1:]) < 700 * 9  # later rounds scan what has expired


def test_clusters_spare_scans(spark):
    own = [(i, [float(v) for v in e]) for i, e in enumerate(numbers(2000, 64, 2, 0.05, 8))]
    seen = []
    centroids.clustered(table(spark, [(*r, 1) for r in own]), seen=seen)
    assert sum(seen[1:]) < 0.5 * 2000 * 9


def test_clusters_odd_rows(spark):
    own = [(i, [float(v) for v in e]) for i, e in enumerate(numbers(40, 64, 8))]
    own += [(100 + i, e) for i, e in enumerate(BAD)] + [(None, [0.1] * 64), (200, []), (300, [1.0] * 63), (400, [0.0] * 64), own[3], own[3]]
    assert sorted(rows(centroids.clustered(table(spark, [(*r, None) for r in own]))), key=repr) == brute_clusters(own)
    few = own[:3]
    assert sorted(rows(centroids.clustered(table(spark, [(*r, 1) for r in few]))), key=repr) == brute_clusters(few)
    assert rows(centroids.clustered(table(spark, [(1, None, 1)]))) == []
    huge = rows(centroids.clustered(table(spark, [(i, [(-1) ** i * 1e30] * 64, 1) for i in range(20)])))
    assert len(huge) == 20 and all(r[2] == 0 for r in huge)
    assert centroids.clustered(table(spark, [(None, [0.1] * 64, 1)])).count() == 0


def test_heap_entries():
    rng = np.random.default_rng(3)
    gap, offset = rng.random(1000) * 1e4, 1234.567
    entries = centroids.keys(gap, offset, np.arange(1000))
    bars = rng.random(1000) * 1e4
    for bar in bars:
        expired = entries < centroids.expired_below(bar)
        assert expired[gap + offset <= bar].all()  # none is missed
        assert not expired[gap + offset > bar * (1 + 1e-5)].any()
    assert (entries & 0xFFFFFFFF == np.arange(1000)).all()


# --- lattice scores ----------------------------------------------------------------

DOCS = "doc_id long, text string, block long, words string, word string, c int, pos int"


def documents(spark, own):
    return spark.createDataFrame([(*r, 1, "w", "x", 2, 3) for r in own], DOCS)


def brute_base(own):
    def tokens(t):
        low = (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        return [("w", w) for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + ["end"]

    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in own]
    c = Counter(w for (_, t), h in zip(own, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(own, held):
        own_tokens = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own_tokens)
        out.append((i, h, len(own_tokens), sum(c[w] > 0 for w in own_tokens), n, round(base, 6)))
    return sorted(out, key=repr)


def same_base(docs, own):
    found = [(*r[:5], round(r[5], 6)) for r in rows(lattice.scored(docs, PIECES))]
    assert sorted(found, key=repr) == brute_base(own)


def test_base_scores(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    own = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for size in (32 << 20, 3000):
        monkeypatch.setattr(lattice, "BLOCK_BYTES", size)
        same_base(docs, own)


def test_lattice_odd_rows(spark):
    own = [(1, "One two  TWO\tthree"), (2, None), (3, ""), (4, " \n "), (5, "È é 中文 \U0001f600 \x00 one"), (None, "one"), (None, None)]
    own += [(6, "one"), (6, "one"), (7, "a" * 50_000), (8, "w " * 40_000), (28, "unseen words"), (9, "w")]
    same_base(documents(spark, own), own)
    found = rows(lattice.scored(documents(spark, own), PIECES))
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in found)
    assert len({r[6] for r in found if r[0] == 6}) == 1
    assert rows(lattice.scored(documents(spark, own).limit(0), PIECES)) == []
    untrained = rows(lattice.scored(documents(spark, [(None, "one two")]), PIECES))
    assert untrained[0][1:6] == (True, 3, 0, 0, 0.0) and untrained[0][6] < 0


def spelled(model, word):
    """The sum over all segmentations, one by one."""
    text = "▁" + word
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(text) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            one = math.exp(model.pieces[text[a:b]]) if text[a:b] in model.pieces else 0.0
            if b - a == 1:
                one += math.exp(sum(model.bytes[x] for x in text[a:b].encode()))
            p *= one
        total += p
    return math.log10(total)


def test_lattice_sums_all_segmentations(spark):
    vocabulary = lattice.Vocabulary(PIECES)
    words = spark.createDataFrame([(b"hello", 5), (b"there", 3), (b"nobody", 0)], "word binary, c long")
    model = lattice.fitted(words, 4, vocabulary)
    for word in ("hello", "the", "naïve", "\U0001f600x", "zzz", "international"[:9]):
        assert abs(model.score(word.encode()) - spelled(model, word)) < 1e-9
    assert abs(sum(map(math.exp, model.pieces.values())) + sum(map(math.exp, model.bytes)) + 10**model.end - 1) < 1e-9
    plain = lattice.fitted(words.limit(0), 0, vocabulary)
    assert model.score(b"hello") > plain.score(b"hello")


def test_learning_helps_on_held_out_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    learned = {r[0]: r for r in rows(lattice.scored(docs, PIECES)) if r[1]}
    plain = {r[0]: r for r in rows(lattice.scored(docs, PIECES, prior=1e12)) if r[1]}
    assert sum(learned[i][6] for i in learned) > sum(plain[i][6] for i in learned)
