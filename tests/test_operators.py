"""Operators on small hand-made tables: edges, properties, brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import values
from shelfwise.functions import vectors
from shelfwise.functions.codes import path_key, type_name
from shelfwise.operators import baseline, centroid, enrich, lookup, metrics, nearest, rows, similarity, termblocks, validate, votes
from shelfwise.operators import taxonomy as tree
from shelfwise.operators import weights
from shelfwise.operators.weights import TermOptions, tfidf
from shelfwise.session import shared_dir
from shelfwise.sources import tables
from shelfwise.sources.state import processed_ids

# --- rows -------------------------------------------------------------------------------


def test_dedup_keeps_lowest_row(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (0, None, "w")], "i long, k string, v string")
    assert values(rows.dedup_keep_first(df, ["k"], "i")) == [(0, None, "w"), (1, "a", "y")]


def test_dedup_sorts_no_rows(spark):
    """The plan has hash aggregates and a hash join only, and a hot key is whole."""
    data = [(i, "hot" if i % 3 else f"k{i}", None if i % 2 else i, f"v{i}") for i in range(400)]
    df = spark.createDataFrame(data, "i long, k string, n long, v string").repartition(5)
    found = rows.dedup_keep_first(df, ["k", "n"], "i")
    best: dict = {}
    for r in data:
        best.setdefault((r[1], r[2]), r)
    assert values(found) == sorted(best.values(), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashJoin" in plan
    assert rows.dedup_keep_first(df.limit(0), ["k"], "i").count() == 0


def test_running_sum_of_many_classes(spark):
    counts = spark.range(100_000).select(F.concat(F.lit("c"), F.lpad("id", 6, "0")).alias("label"), (F.col("id") % 7).alias("n"))
    found = rows.with_running_sum(counts.repartition(8), "label", "n", "upto")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    total, wrong = 0, 0
    for r in sorted(found.collect()):
        total += r.n
        wrong += r.upto != total
    assert not wrong and total == sum(i % 7 for i in range(100_000))


def test_positions_over_gaps(spark):
    ids = random.Random(1).sample(range(10**12), 500) + [-5, 0]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    expected = [(v, p) for p, v in enumerate(sorted(ids))]
    assert sorted(values(rows.with_position(df, "id"))) == expected


def test_class_ids_and_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None), (4, "c")], "i long, c string")
    assert values(rows.class_ids(df, "c", "i")) == [(0, "b"), (1, "a"), (2, "c")]
    assert values(rows.label_codes(df, "c")) == [("a", 0), ("b", 1), ("c", 2)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i long, c string")
    assert rows.class_ids(df, "c", "i").count() == 0
    assert rows.batch_ids(df, "i", 10).count() == 0
    assert tuple(rows.progress_counts(df, df, "i").first()) == (0, 0, 0)
    assert metrics.weighted_f1(df.withColumn("p", F.col("c")), "c", "p").first()[0] == 0.0


def test_batches_and_quarantine(spark):
    df = spark.range(0, 25).withColumn("id", F.col("id") * 3)
    assert Counter(r.batch_id for r in rows.batch_ids(df, "id", 10).collect()) == {0: 10, 1: 10, 2: 5}
    checked = rows.quarantine(df, {"small": F.col("id") > 2, "even": F.col("id") % 2 == 0})
    assert Counter(r.error for r in checked.collect()) == {"small": 1, "even": 12, None: 12}


# --- lookups -----------------------------------------------------------------------------


def test_map_codes_nulls(spark):
    products = spark.createDataFrame([("p", 1), ("q", None), ("r", 9)], "n string, code int")
    catalog = spark.createDataFrame([(0, 1, "one"), (1, 1, "uno"), (2, None, "none")], "i long, c int, t string")
    plain = lookup.map_codes(products, catalog, "code", "c", ["t"], "i")
    assert values(plain, "n", "t") == [("p", "one"), ("q", None), ("r", None)]
    safe = lookup.map_codes(products, catalog, "code", "c", ["t"], "i", null_matches_null=True)
    assert values(safe, "n", "t") == [("p", "one"), ("q", "none"), ("r", None)]


def test_brand_ways_agree(spark):
    brands = spark.createDataFrame([("ab",), ("abc",), ("zz",), ("",)], "b string")
    df = spark.createDataFrame([(0, "xabcab"), (1, "ab ab"), (2, "none"), (3, "")], "i long, s string")
    from shelfwise.functions.text import strip_brand

    listed = F.array(*[F.lit(b) for b in ("abc", "ab", "zz")])
    by_array = df.select("i", strip_brand("s", listed).alias("o"))
    by_join = lookup.strip_brand_join(df, "i", "s", brands, "b").select("i", "stripped")
    assert values(by_array) == values(by_join) == [(0, "xab"), (1, " "), (2, "none"), (3, "")]


def test_brands_of_every_length(spark):
    brands = spark.createDataFrame([("acme",), ("zenith",)], "b string")
    df = spark.createDataFrame([(0, "zenith tv"), (1, "acme tv")], "i long, s string")
    assert values(lookup.strip_brand_join(df, "i", "s", brands, "b"), "i", "stripped") == [(0, " tv"), (1, " tv")]


def test_brands_in_pieces(spark):
    """The longest brand wins whichever piece of the dictionary it is in; no text becomes several rows."""
    rng = random.Random(4)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)} | {"é ü"}
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 20))) for _ in range(150)] + [None, "", "xé üx", "zz", "zz"]
    brands = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("ab",), ("ab",)], "b string")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").repartition(3)
    expected = []
    for i, t in enumerate(texts):
        inside = [n for n in names | {"ab"} if t and n in t]
        best = min(inside, key=lambda n: (-len(n), n)) if inside else None
        expected.append((i, t, t.replace(best, "") if best else t))
    for chars in (1 << 20, 50):
        found = lookup.strip_brand_join(df, "i", "s", brands, "b", chars)
        assert sorted(values(found)) == expected
    assert values(lookup.strip_brand_join(df, "i", "s", brands.limit(0), "b"), "i", "stripped") == values(df, "i", "s")


def test_a_million_brands(spark):
    """Pieces bound the automaton that a task holds; the dictionary has twelve of them."""
    brands = spark.range(1_000_000).select(F.format_string("brand %06d", "id").alias("b"))
    df = spark.createDataFrame([(0, "new brand 123456 and brand 000001"), (1, "brand"), (2, "brand 999999")], "i long, s string")
    found = lookup.strip_brand_join(df, "i", "s", brands, "b")
    assert values(found, "i", "stripped") == [(0, "new brand 123456 and "), (1, "brand"), (2, "")]
    largest, pieces = lookup._pieces(brands.withColumnRenamed("b", "_brand"), lookup.PIECE_CHARS)
    assert pieces == 12
    automaton = ahocorasick.Automaton()
    for b in largest.orderBy(F.size("brands").desc()).first().brands:
        automaton.add_word(b, b)
    automaton.make_automaton()
    assert automaton.get_stats()["total_size"] < 128 << 20


def test_glossary(spark):
    df = spark.createDataFrame([(0, "fish"), (1, "unknown")], "i long, c string")
    out = lookup.translate_terms(df, "c", lookup.class_names_ar(df))
    assert values(out, "i", "translated_name") == [(0, "الأسماك"), (1, "unknown")]


# --- nearest ------------------------------------------------------------------------------


def test_nearest_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(500, [0.0] * 6), (501, None)]
    classes = [(c, [rng.gauss(0, 1) for _ in range(6)]) for c in range(17)] + [(90, [0.0] * 6)]
    classes.append((91, classes[0][1]))  # a tie with class 0
    left = spark.createDataFrame(items, "i long, v array<double>")
    right = spark.createDataFrame(classes, "c int, v array<double>")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return 1.0 - (sum(x * y for x, y in zip(a, b)) / n if n else 0.0)

    for k in (1, 3, 50):
        expected = sorted(
            (i, c, round(d, 6))
            for i, v in items
            if v
            for d, c in sorted((round(cosine(v, w), 9), c) for c, w in classes)[:k]
        )
        for block, ball in ((1 << 20, 64), (4, 64), (4, 3)):
            monkeypatch.setattr(nearest, "BALL", ball)
            found = nearest.nearest_classes(left, right, "i", "c", "v", k, block)
            got = sorted((r.item_id, r.class_id, round(r.distance, 6)) for r in found.collect())
            assert got == expected, (k, block, ball)


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_skips_distant_balls(spark, k):
    """Clustered vectors: few pairs are compared, and the result is that of all pairs."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 8))
    x = centres[rng.integers(0, 12, 1500)] + 0.02 * rng.standard_normal((1500, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    left, right = frame.where("i < 600"), frame.where("i >= 600").withColumnRenamed("i", "c")
    seen = Observation()
    found = nearest.nearest_classes(left, right, "i", "c", "v", k, seen=seen)
    got = sorted((r.item_id, r.class_id) for r in found.collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(np.round(1 - u[:600] @ u[600:].T, 9), axis=1, kind="stable")[:, :k]
    assert got == sorted((i, 600 + int(c)) for i in range(600) for c in order[i])
    assert 0 < seen.get["pairs"] < 0.2 * 600 * 900


def test_nearest_keeps_repeated_items(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "i long, v array<double>")
    classes = spark.createDataFrame([(c, [1.0, 0.1 * c]) for c in range(9)], "c long, v array<double>")
    for block in (100, 2):
        found = nearest.nearest_classes(items, classes, "i", "c", "v", 1, block)
        assert values(found.select("item_id", "class_id")) == [(1, 0), (1, 8), (1, 8)]


def test_nearest_edges(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "i long, v array<double>")
    none = spark.createDataFrame([], "c long, v array<double>")
    assert nearest.nearest_classes(items, none, "i", "c", "v").count() == 0
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "c long, v array<double>")
    with pytest.raises(ValueError, match="dimensions"):
        nearest.nearest_classes(items, uneven, "i", "c", "v")


def test_similar_has_one_shape(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "i long, v array<double>")
    classes = spark.createDataFrame([(c, [1.0, float(c)]) for c in range(4)], "c long, v array<double>")
    whole, blocks = (values(nearest.similar(items, classes, "i", "c", "v", 2, 0.5, n)) for n in (1 << 20, 2))
    assert whole == blocks and len(whole) == 10 and all(r[2] >= 0.5 for r in whole)


def test_unequal_vectors_have_no_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "c long, v array<double>")
    with pytest.raises(Exception, match="dimensions"):
        nearest.mean_vectors(df, "c", "v", 2).collect()


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    got = row.select(
        vectors.l2_normalize("a"), vectors.l2_normalize("z"), vectors.cosine_distance("a", "z"),
        vectors.from_text(vectors.to_text("a")), vectors.norm("a"),
    ).first()
    assert tuple(got) == ([0.6, 0.8], [0.0, 0.0], 1.0, [3.0, 4.0], 5.0)
    wide = row.select(*vectors.to_wide("a", 2)).select(vectors.from_wide(2).alias("a"))
    assert wide.first().a == [3.0, 4.0]


# --- weights and centroids ------------------------------------------------------------------

DOCS = [
    (0, "Green tea green", "Tea"),
    (1, "black tea bag", "tea"),
    (2, "ground coffee bean", "coffee"),
    (3, "coffee bean bag bag", "Coffee "),
    (4, None, "coffee"),
    (5, "zzz qqq", "other"),
]


def grams(text, high):
    w = [t for t in (text or "").lower().split() if len(t) > 1]
    return Counter(" ".join(w[i : i + n]) for n in range(1, high + 1) for i in range(len(w) - n + 1))


def brute_tfidf(max_df=1.0, high=2):
    counts = {i: grams(t, high) for i, t, _ in DOCS}
    df = Counter(t for c in counts.values() for t in c)
    n = len(DOCS)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d <= max_df * n}
    unit = {}
    for i, c in counts.items():
        w = {t: k * idf[t] for t, k in c.items() if t in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {t: x / length for t, x in w.items()}
    return unit


def docs(spark):
    return spark.createDataFrame(DOCS, "i long, t string, c string")


def test_tfidf(spark):
    got = {(r.i, r.term): r.w for r in tfidf(docs(spark), "i", "t", TermOptions((1, 2))).collect()}
    expected = {(i, t): w for i, ws in brute_tfidf().items() for t, w in ws.items()}
    assert got == pytest.approx(expected)


def test_terms_of_many_texts_at_once(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(weights, "WORDS", 50)
    for low, high in ((1, 1), (1, 2), (2, 3), (3, 5)):
        texts = [None if rng.random() < 0.1 else rng.choices(["tea", "té", "茶", "x"], k=rng.choice([0, 1, 2, 9, 80])) for _ in range(60)]
        column = pa.array([["before"], *texts], pa.list_(pa.string())).slice(1)
        at = list(weights.word_slices(column))
        assert [i for i, _ in at] + [60] == [0] + [j for _, j in at]
        assert all(j == i + 1 or sum(len(t or []) for t in texts[i:j]) <= 50 for i, j in at)
        for i, j in at:
            terms, codes, tfs, starts = weights.term_codes(column.slice(i, j - i), low, high)
            for k, text in enumerate(texts[i:j]):
                own = slice(starts[k], starts[k + 1])
                got = list(zip(terms.take(pa.array(codes[own])).to_pylist(), tfs[own].tolist()))
                want = Counter(" ".join(text[a : a + n]) for n in range(low, high + 1) for a in range(len(text or []) - n + 1))
                assert len(got) == len(want) and dict(got) == want


def test_dealt_parts_are_bounded(spark, tmp_path):
    path = str(tmp_path / "one file")
    spark.range(20_000).coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "one file").glob("*.parquet"))
    few = tables.dealt(spark.read.parquet(path), size // 10 + 1)
    assert few.rdd.getNumPartitions() == 10 and few.count() == 20_000
    assert tables.dealt(spark.read.parquet(path)).rdd.getNumPartitions() == 4


def test_limits(spark):
    options = TermOptions((1, 1), min_df=2, max_features=2)
    kept = {r.term for r in tfidf(docs(spark), "i", "t", options).collect()}
    assert kept == {"bag", "bean"}  # of bag 3, tea 2, bean 2, coffee 2: the most frequent, then by text


# ids that repeat, none, and texts without terms
ODD_DOCS = [*DOCS, (1, "red tea bag", "tea"), (None, "green tea", "tea"), (None, "tea tea bag", None), (7, None, "tea"), (8, "", None)]


def test_texts_are_weighted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(termblocks, "FEW_TERMS", 3)
    df = spark.createDataFrame(ODD_DOCS, "i long, t string, c string").repartition(3)
    for options in (TermOptions((1, 2)), TermOptions((1, 2), 2, 0.3, None, True)):
        whole = replace(options, max_features=1_000)  # terms meet the postings
        got, want = (sorted((r.i or 0, r.term, round(r.w, 9)) for r in tfidf(df, "i", "t", o).collect()) for o in (options, whole))
        assert got == want and len(got) > 5
        models = [centroid.fit_tfidf(df, "i", "t", "c", o, head=2) for o in (options, whole)]
        got, want = (sorted((r.term, r.class_id, round(r.w, 9)) for r in m.shares().collect()) for m in models)
        assert got == want and len(got) > 5
        got, want = (sorted(map(str, centroid.predict(m, df, "i", "t").withColumn("score_1", F.round("score_1", 9)).select("i", "label", "score_1").collect())) for m in models)
        assert got == want
    alone = spark.createDataFrame(DOCS, "i long, t string, c string")
    plan = tfidf(alone, "i", "t", TermOptions((1, 2)))._jdf.queryExecution().toString()
    assert not re.search("Window|Join|Generate", plan)  # no term of a text is a row before it is weighted


def test_fitting_leaves_only_the_model(spark):
    at = Path(shared_dir(spark).removeprefix("file://")) / "shelfwise"
    before = {p.name for p in at.glob("*")}
    for fit in (centroid.fit_tfidf, centroid.fit_icf_tdcb):
        fit(docs(spark), "i", "t", "c")
    left = {p.name.rsplit("-", 1)[0] for p in at.glob("*") if p.name not in before}
    assert left == {"classes", "repeated-ids", "model-classes", "centroids"}


def test_pieces_of_terms_come_back_in_order():
    terms = pa.array(["", "a", "tea", "é茶", "x" * 300, *map(str, range(500))])
    order = np.argsort(termblocks.hashes(terms))
    terms = terms.take(pa.array(order))
    assert (termblocks.hashes(terms.slice(7, 90)) == termblocks.hashes(terms)[7:97]).all()
    counts = np.arange(len(terms))
    for parts in (1, 2, 7, 300):
        cells = termblocks.pieces_of(5, terms, parts, None, counts)
        back = [termblocks.restored(x.as_py()) for x in cells.column(2)]
        assert [t for text, _ in back for t in termblocks.strings_of(*text).to_pylist()] == terms.to_pylist()
        assert np.concatenate([d for _, d in back]).tolist() == counts.tolist()


def test_centroids(spark):
    unit = brute_tfidf()
    classes = defaultdict(list)
    for i, _, c in DOCS:
        classes[c.strip().lower()].append(i)
    names = list(classes)
    centroids = {}
    for c, members in classes.items():
        mean = Counter()
        for i in members:
            for t, w in unit[i].items():
                mean[t] += w / len(members)
        length = math.sqrt(sum(w * w for w in mean.values()))
        centroids[c] = {t: w / length for t, w in mean.items()}
    model = centroid.fit_tfidf(docs(spark), "i", "t", "c", TermOptions((1, 2)))
    got = {r.i: r for r in centroid.predict(model, docs(spark), "i", "t", k=4).collect()}
    for i, _, _ in DOCS:
        score = {c: sum(w * centroids[c].get(t, 0) for t, w in unit[i].items()) for c in names}
        order = sorted(names, key=lambda c: (-round(score[c], 9), names.index(c)))
        row = got[i]
        assert [row.class_1_name, row.class_2_name, row.class_3_name, row.class_4_name] == [*order, None]
        assert [row.score_1, row.score_2, row.score_3] == pytest.approx([score[c] for c in order])
        assert row.label == order[0] and row.score_4 is None


@pytest.mark.parametrize("head", [1, 2, 3, 1000])
def test_heads_decide_like_all_shares(spark, head):
    """Many classes that share terms: short heads give the result of all shares, from few of them."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(240):
        c = i % 40
        own = rng.choice(60, 6, p=np.roll(np.linspace(1, 3, 60), c) / np.linspace(1, 3, 60).sum())
        data.append((i, " ".join(["common", words[c], *[words[j] for j in own]]), f"class {c}"))
    docs = spark.createDataFrame(data, "i long, t string, c string")
    model = centroid.fit_tfidf(docs, "i", "t", "c", TermOptions((1, 1)), head=head)
    assert (model.tails.count() > 0) == (head < 40)
    whole = defaultdict(list)
    for r in centroid.scores(model, docs, "i", "t").collect():
        whole[r.i].append((-round(r.score, 9), r.class_id, r.score, r.class_name))
    got = {r.i: r for r in centroid.predict(model, docs, "i", "t", k=3).collect()}
    for i, found in whole.items():
        best = sorted(found)[:3]
        assert [got[i][f"class_{j}_name"] for j in (1, 2, 3)] == [b[3] for b in best]
        assert [got[i][f"score_{j}"] for j in (1, 2, 3)] == pytest.approx([b[2] for b in best])
    assert set(whole) == set(range(240))


def test_a_model_is_written_once(spark, monkeypatch):
    """Heads and tails come of one shuffle by term and one table; what goes back to documents are counts and no weights."""
    written, kept = {}, centroid.stored
    monkeypatch.setattr(centroid, "stored", lambda df, name: written.setdefault(name, df) and kept(df, name))
    data = [(i, f"common own{i % 30} two{i % 3}", f"class {i % 30}") for i in range(60)]
    docs = spark.createDataFrame(data, "i long, t string, c string")
    models = [centroid.fit_tfidf(docs, "i", "t", "c", TermOptions((1, 2)), head=h) for h in (2, 1000)]
    assert set(written) == {"classes", "counted", "shares", "model-classes", "centroids"}
    plan = lambda name: written[name]._jdf.queryExecution().executedPlan().toString()
    assert plan("centroids").count("Exchange hashpartitioning(term") == 1
    moved = plan("shares").split("Exchange hashpartitioning(i#")[1].split("Join")[0]
    assert "tf#" in moved and "ln(" not in moved.lower()
    first, second = (values(m.shares().select("term", "class_id", F.round("w", 9))) for m in models)
    assert first == second and models[0].tails.count() > 0 and models[1].tails.isEmpty()


def test_a_common_term_is_not_spread_over_all_classes(spark):
    """Classes with terms of their own and one in common: the heads leave one class in question, which is looked up."""
    data = [(i, f"common own{i % 300} own{i % 300}", f"class {i % 300}") for i in range(600)]
    docs = spark.createDataFrame(data, "i long, t string, c string")
    model = centroid.fit_tfidf(docs, "i", "t", "c", TermOptions((1, 1)), head=8)
    bounded = centroid._bounded(model, docs, "i", "t", 1)
    asked = bounded.agg(F.sum(F.size("asks") * F.size("found")), F.max(F.size("found")), F.max("open")).first()
    assert asked[0] <= 600 and tuple(asked)[1:] == (1, False)  # not 600 times the 300 classes that share a term
    assert set(values(centroid.predict(model, docs, "i", "t", k=1), "i", "label")) == {(i, f"class {i % 300}") for i in range(600)}


def test_saved_model(spark, tmp_path):
    options = TermOptions((1, 2))
    model = centroid.fit_icf_tdcb(docs(spark), "i", "t", "c", options)
    model.save(str(tmp_path))
    again = centroid.CentroidModel.load(spark, str(tmp_path))
    assert again.options == options
    first, second = (values(centroid.predict(m, docs(spark), "i", "t")) for m in (model, again))
    assert first == second
    assert {r[0]: r[2] for r in first} == {0: "tea", 1: "tea", 2: "coffee", 3: "coffee", 4: "tea", 5: "other"}


def test_similar_texts(spark):
    """The prefix filter loses no pair: all pairs, multiplied out one by one."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{j}" for j in rng.zipf(1.4, rng.integers(0, 25)) if j < 200) for _ in range(120)]
    items, queries = texts[:80] + [None, "", "qq"], texts[60:] + ["unknown words", None]
    left = spark.createDataFrame(list(enumerate(items)), "i long, t string")
    right = spark.createDataFrame(list(enumerate(queries)), "q long, t string")
    counts = [grams(t, 1) for t in items]
    df = Counter(t for c in counts for t in c)
    weight = {t: math.log((len(items) + 1) / (d + 1)) + 1 for t, d in df.items()}

    def unit(text):
        w = {t: n * weight[t] for t, n in grams(text, 1).items() if t in weight}
        length = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / length for t, v in w.items()}

    x, y = [unit(t) for t in items], [unit(t) for t in queries]
    every = {(i, q): sum(v * b[t] for t, v in a.items() if t in b) for i, a in enumerate(x) for q, b in enumerate(y)}
    for at_least in (0.2, 0.6, 0.95):
        found = {(r.item, r.query): r.score for r in similarity.similar_texts(left, right, "i", "q", "t", at_least).collect()}
        assert found == pytest.approx({p: s for p, s in every.items() if s >= at_least})
        assert found


def test_similar_texts_move_no_pairs(spark, monkeypatch):
    """Blocks meet, not pairs: as many rows whatever the number of pairs; small blocks and repeated ids change nothing."""
    words = [" ".join(f"w{(i * 7 + j * j) % 23}" for j in range(1, 6 + i % 3)) for i in range(60)]
    left = spark.createDataFrame([*enumerate(words), (3, words[3]), (None, words[0])], "i long, t string")
    right = spark.createDataFrame([*enumerate(words[:20]), (None, words[0])], "q long, t string")
    moved = []
    whole = similarity._multiplied
    monkeypatch.setattr(similarity, "_multiplied", lambda met, *a: moved.append(met.count()) or whole(met, *a))

    def found():
        rows = similarity.similar_texts(left.repartition(1), right.repartition(1), "i", "q", "t", 0.1).collect()
        assert len(rows) == len({(r.item, r.query) for r in rows})
        return {(r.item, r.query): r.score for r in rows}

    first = found()
    assert len(first) > 500 and all(r[0] is not None and r[1] is not None for r in first)
    assert first[5, 5] == pytest.approx(1) and first[3, 3] == pytest.approx(2**-0.5)
    assert sum(moved) <= 16  # blocks, at most one per shuffle partition and side
    monkeypatch.setattr(similarity, "CELLS", 9)
    monkeypatch.setattr(similarity, "PRODUCTS", 40)
    assert found() == pytest.approx(first) and moved[1] > 16


# --- metrics, votes, split ---------------------------------------------------------------------


def test_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c"), ("d", "a"), (None, "a")]
    df = spark.createDataFrame(pairs, "y string, p string")
    row = metrics.overall_metrics(df, "y", "p").first()
    assert row.n_rows == 6 and row.accuracy == pytest.approx(3 / 6)
    assert row.weighted_f1 == pytest.approx((2 * 0.5 + 1 * 0.5 + 2 * 2 / 3 + 0) / 6)
    labels = spark.createDataFrame([("a",), ("zz",)], "label string")
    assert values(metrics.class_metrics(df, "y", "p", labels), "label", "support") == [("a", 2), ("zz", 0)]
    perfect = df.where("y is not null").withColumn("p", F.col("y"))
    assert metrics.weighted_f1(perfect, "y", "p").first()[0] == 1.0


def test_majority_is_the_mode(spark):
    triples = [(a, b, c) for a in "xyz" for b in "xyz" for c in "xyz"]
    df = spark.createDataFrame(triples, "tfidf string, cosine string, answer string")
    for r in votes.ensemble(df).collect():
        top, n = Counter([r.tfidf, r.cosine, r.answer]).most_common(1)[0]
        assert (r.final, r.confidence) == ((top, n / 3) if n > 1 else (r.answer, 1.0))
    for r in votes.ensemble(df, "weighted").collect():
        scores = {}
        for label, w in ((r.tfidf, 0.3), (r.cosine, 0.4), (r.answer, 0.3)):
            scores[label] = round(scores.get(label, 0) + w, 9)
        assert (r.final, r.confidence) == (max(scores, key=scores.get), max(scores.values()))
    assert {r.final == r.answer for r in votes.ensemble(df, "answer").collect()} == {True}


def test_votes_that_are_missing(spark):
    one = spark.createDataFrame([(1, "x"), (2, None)], "i long, tfidf string")
    two = spark.createDataFrame([(1, "x"), (3, "z")], "i long, cosine string")
    three = spark.createDataFrame([(2, "y"), (3, "z")], "i long, answer string")
    joined = votes.join_votes("i", one, two, three)
    got = values(votes.ensemble(joined), "i", "final", "confidence")
    assert got == [(1, "x", 2 / 3), (2, "y", 1.0), (3, "z", 2 / 3)]
    assert values(votes.ensemble(joined, "weighted"), "i", "final", "confidence") == [(1, "x", 0.7), (2, "y", 0.3), (3, "z", 0.7)]


def test_labels_within_groups(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("h", "b", "a")], "g string, y string, p string")
    labels = spark.createDataFrame([("a",), ("c",)], "label string")
    got = values(metrics.class_metrics(df, "y", "p", labels, ["g"]), "g", "label", "tp")
    assert got == [("g", "a", 1), ("g", "c", 0), ("h", "a", 0), ("h", "c", 0)]


def test_split_is_exact_and_complete(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 100, "few"))
    split = baseline.stratified_split(df, "id", "c")
    sizes = {(r.c, r.is_test): r["count"] for r in split.groupBy("c", "is_test").count().collect()}
    totals = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    for c, n in totals.items():
        assert sizes[(c, True)] == math.floor(0.2 * n + 0.5) and sizes[(c, True)] + sizes[(c, False)] == n
    assert baseline.stratified_split(df, "id", None).where("is_test").count() == 600


def test_baseline(spark):
    train = spark.createDataFrame([("b",)] * 30 + [("a",)] * 30 + [("c",)] * 40 + [(None,)] * 99, "c string")
    items = spark.range(4000)
    assert baseline.baseline_predict(train, "c", items, "id", "prior").distinct().collect()[0].label == "c"
    drawn = baseline.baseline_predict(train, "c", items, "id", "stratified")
    share = Counter(r.label for r in drawn.collect())
    assert sum(share.values()) == 4000 and share["c"] / 4000 == pytest.approx(0.4, abs=0.04)
    even = Counter(r.label for r in baseline.baseline_predict(train, "c", items, "id", "uniform").collect())
    assert sum(even.values()) == 4000 and even["a"] / 4000 == pytest.approx(1 / 3, abs=0.04)
    with pytest.raises(ValueError):
        baseline.baseline_predict(train, "c", items, "id", "constant")


# --- taxonomy and validation ---------------------------------------------------------------------

TITLES = ("s", "f", "c", "b")
TREE = [
    (0, "Food", "Drinks", "Tea", "Green Tea"),
    (1, "Food", "Drinks", "Tea", "Black Tea"),
    (2, "Food", "Drinks", "Coffee", "Beans & Co"),
    (3, "Food", "Bakery", None, "Lost"),
    (4, "Home", None, "x", "y"),
    (5, None, "z", "z", "z"),
    (6, "Food", "Other", "Tea", "Green Tea"),
]


def tax(spark):
    return spark.createDataFrame(TREE, "i long, s string, f string, c string, b string")


def test_edges_stop_at_nulls(spark):
    edges = tree.edges(tax(spark), TITLES, "i")
    assert values(tree.sizes(edges)) == [("brick", 4), ("class", 3), ("family", 3), ("segment", 2)]
    kids = {(r.level, r.parent_path): r.labels for r in tree.children(edges).collect()}
    assert kids[(1, "")] == ["Food", "Home"]
    assert kids[(2, "Food")] == ["Drinks", "Bakery", "Other"]
    assert kids[(4, "Food::Drinks::Tea")] == ["Green Tea", "Black Tea"]
    assert (3, "Food::Bakery") not in kids


def test_descent_stops_without_children(spark):
    kids = tree.children(tree.edges(tax(spark), TITLES, "i"))
    answers = [
        (0, "Food", "drinks", "Tea", "the black tea"),
        (1, "Food", "Bakery", "Tea", "Tea"),
        (2, "nothing", "Drinks", "Tea", "Tea"),
        (3, "", "", "", ""),
    ]
    items = spark.createDataFrame(answers, "id long, r1 string, r2 string, r3 string, r4 string")
    out = tree.descend_answers(items, ["r1", "r2", "r3", "r4"], kids)
    got = {r.id: tuple(r[c] for c in out.columns if c.startswith("predicted")) for r in out.collect()}
    assert got == {
        0: ("Food", "Drinks", "Tea", "Black Tea"),
        1: ("Food", "Bakery", "", ""),
        2: ("nothing", "", "", ""),
        3: ("Food", "Drinks", "Tea", "Green Tea"),
    }


def test_validator_accepts_true_paths(spark):
    columns = ["ps", "pf", "pc", "pb"]
    predictions = tax(spark).where("i in (0, 1, 2)").toDF("i", *columns)
    spelled = spark.createDataFrame(
        [(7, "FOOD", "drinks ", "Tea", "beans and co"), (8, "Food", "Drinks", "Coffee", "Beans + Co"), (9, "a", "b", "c", None)],
        predictions.schema,
    )
    checked = validate.check_paths(predictions.unionByName(spelled), columns, tax(spark), TITLES, "i")
    got = {r.i: (r.match_type, r.class_match, r.all_match) for r in checked.collect()}
    assert got[0] == got[1] == got[2] == ("exact", True, True)
    assert got[7] == ("normalized", False, False) and got[8] == ("normalized", True, True)
    assert got[9] == ("missing", False, False)
    stats = validate.validation_stats(checked).first()
    assert (stats.total_rows, stats.brick_found, stats.all_match, stats.brick_not_found) == (6, 5, 4, 1)
    assert [r.i for r in validate.mismatch_samples(checked, "i").collect()] == [7]
    empty = validate.validation_stats(checked.where("false")).first()
    assert empty.total_rows == 0 and empty.valid_pct is None


def test_path_key(spark):
    row = spark.createDataFrame([("a", "b", None)], "x string, y string, z string")
    assert tuple(row.select(path_key("x", "y"), path_key("x", "z")).first()) == ("a::b", None)


# --- enrichment, sources ------------------------------------------------------------------------------


def test_model_sees_each_text_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        import numpy as np

        def predict(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return np.array([[float(len(t))] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(0, "aa"), (1, "b"), (2, "aa"), (3, None)], "i long, t string")
    got = {r.i: r.embedding for r in enrich.embed_column(df, "t", make).collect()}
    assert got == {0: [2.0], 1: [1.0], 2: [2.0], 3: None}
    assert sorted(open(log).read().split()) == ["aa", "b"]


def test_hash_embed_keeps_every_row(spark):
    df = spark.createDataFrame([(0, "green tea"), (1, ""), (2, None)], "i long, t string")
    got = {r.i: r.vector for r in enrich.hash_embed(df, "i", "t", 16).collect()}
    assert len(got) == 3 and set(got[1]) == set(got[2]) == {0.0}
    assert sum(x * x for x in got[0]) == pytest.approx(1.0)


def test_hash_counts_move_no_terms(spark):
    df = spark.createDataFrame([(1, "red red bolt"), (1, "nut"), (2, None), (None, "é nut")], "id int, text string")
    counts = enrich.hash_counts(df, "id", "text", 8)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    want = defaultdict(lambda: [0.0] * 8)
    for key, term in [(1, "red"), (1, "red"), (1, "bolt"), (1, "red red"), (1, "red bolt"), (1, "nut"), (None, "nut")]:
        digest = hashlib.md5(term.encode()).hexdigest()
        want[key][int(digest[:8], 16) % 8] += -1 if digest[8] >= "8" else 1
    assert {r.id: r.vector for r in counts.collect()} == {**want, 2: [0.0] * 8}


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, 'a "quoted", text\nin two lines'), (1, ""), (2, None), (3, "back\\slash;é")], "i long, t string"
    )
    for sep in (",", ";"):
        path = str(tmp_path / f"t{ord(sep)}.csv")
        tables.write_csv(df, path, sep)
        missing = df.withColumn("t", F.nullif("t", F.lit("")))
        assert values(tables.load_table(spark, path, df.schema, sep=sep, multi_line=True)) == values(missing)
    with pytest.raises(ValueError, match="xlsx"):
        tables.load_table(spark, "/x/taxonomy.xlsx")


def test_catalog_tables(spark):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    df.createOrReplaceTempView("described")
    assert values(tables.describe_columns(spark, ["described"])) == [
        ("described", "id", "bigint"),
        ("described", "name", "string"),
    ]
    shown = tables.describe_schema(spark, ["described"]).first()
    assert shown["sample"] == "1, x" and shown["columns"] == "id (bigint)\nname (string)"
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM {d}", d=df).first().n == 1


def test_type_names(spark):
    df = spark.createDataFrame([("CV ", 9), ("F", 5), ("D", 1), ("ZZ", 1)], "c string, n int")
    names = df.select(type_name(F.col("c"), F.col("n"), F.col("n"), F.lit(2))).collect()
    assert [r[0] for r in names] == ["VARCHAR(9)", "DECIMAL(5, 2)", "DATE", "ZZ"]


def test_progress_state(spark):
    text = '{"processed_ids": [3, 1, 3], "last_updated": "x", "total_processed": 2}'
    df = spark.createDataFrame([(text,), ("not json",)], "value string")
    assert values(processed_ids(df)) == [(1,), (3,)]
