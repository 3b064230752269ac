"""Vectors, packing, chat and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.llm import chat, ego, mixing, neardup, packing, quality, search, secrets, templates
from shelfwise.llm.queries import PROBE, TOKENIZER
from shelfwise.session import stored

VECTOR = "vec_id long, embedding array<float>, score long, rank int, v string, block long"


def rows(df):
    return [r.asDict() for r in df.collect()]


def near_vectors(n=300, dims=16, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(n // 3):  # near copies, chains and exact copies
        x[n - 1 - i] = x[i // 4] + 0.02 * (i % 4) * rng.standard_normal(dims)
    x[:6] = x[0]
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = near_vectors()
    data = [(i, [float(v) for v in r], 1, 1, "v", 2) for i, r in enumerate(x)]
    bad = [None, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [0.0] * 16, []]
    data += [(1000 + i, b, 1, 1, "v", 2) for i, b in enumerate(bad)] + [(None, [1.0] * 16, 1, 1, "v", 2)]
    data += [data[20], (2000, [5.0, 1.0], 1, 1, "v", 2)]
    return spark.createDataFrame(data, VECTOR)


def test_topk(vectors, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 5)
    pool = []
    for r in rows(vectors):
        e = r["embedding"]
        if r["vec_id"] is not None and e is not None and all(v is not None and np.isfinite(v) for v in e):
            pool.append((r["vec_id"], np.pad(np.floor(64 * np.array(e, float)), (0, 16 - len(e)))))
    want = []
    for q, x in {i: x for i, x in pool if i % 20 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in pool if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard in (10_000, 40):
        assert sorted(map(tuple, search.topk(vectors, shard=shard).collect())) == sorted(want)
    assert rows(search.topk(vectors.limit(0))) == []


def test_topk_of_repeated_ids(spark):
    """A query's own id may fill any number of rows; others with the same vector are still found."""
    near, far = [1.0, 0.0], [0.0, 1.0]
    data = [(20, near)] * 50 + [(i, near) for i in range(21, 26)] + [(40, near)] + [(i, far) for i in range(101, 140)] + [(30, near)] * 45
    df = spark.createDataFrame([(i, v, 1, 1, "v", 2) for i, v in data], VECTOR)
    want = []
    for q in (20, 40, 120):
        own = dict(data)[q]
        best = sorted((-4096 * int(v == own), i) for i, v in data if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, search.topk(df).collect())) == sorted(want)


def test_tree_is_exact_on_ties():
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (2000, 5)).astype(float)
    ids = rng.permutation(2000).astype(np.int64)
    tree = search.Tree(ids, v, leaf=16)
    q = rng.integers(-3, 4, (20, 5)).astype(float)
    for i, bound in enumerate(tree.bounds(q)):
        got, scores = tree.best(int(ids[i]), q[i], bound, 20, -np.inf)
        best = sorted((-s, k) for s, k in zip(v @ q[i], ids) if k != ids[i])[:20]
        assert sorted(zip(-scores, got)) == best


def brute_links(own):
    good = [(i, np.array(e, float)) for i, e in own if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    u = np.array([np.pad(e, (0, 16 - len(e))) for _, e in good])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    ids = [i for i, _ in good]
    root = {i: i for i, _ in own}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(close)):
        x, y = sorted((find(ids[a]), find(ids[b])))
        root[y] = x
    n = dict(zip(range(len(ids)), close.sum(1)))
    links = Counter()
    out = [(i, int(n[k]), find(i)) for k, i in enumerate(ids)]
    used = Counter(ids)
    for i, _ in own:
        if not used[i]:
            out.append((i, 0, None if i is None else find(i)))
        links[i] += 1
    return sorted([(i, k, c, i == c) for i, k, c in out], key=repr)


def test_ego(vectors, monkeypatch):
    want = brute_links([(r["vec_id"], r["embedding"]) for r in rows(vectors)])
    for block, tile in ((4096, 512), (32, 8)):
        monkeypatch.setattr(ego, "BLOCK", block)
        monkeypatch.setattr(ego, "TILE", tile)
        assert sorted(map(tuple, ego.links(vectors).collect()), key=repr) == want
    assert rows(ego.links(vectors.limit(0))) == []


def test_blocks_move_once_per_tile(spark, monkeypatch):
    """Links over many tiles of blocks equal brute force, whatever the tiles."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(0, s, (60, 5)) for c, s in zip(rng.normal(0, 1, (8, 5)), (0.05, 0.3) * 4)]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = ((u @ u.T >= ego.COSINE) & ~np.eye(len(u), dtype=bool)).sum(axis=1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ego, "BLOCK", 16)
    found = []
    for least, parts in ((8, 8), (1, 100), (3, 2)):
        monkeypatch.setattr(ego, "LEAST_TILES", least)
        monkeypatch.setattr(ego, "TILE_PARTS", parts)
        found.append(sorted(map(tuple, ego.links(vectors).collect())))
    assert [r[1] for r in found[0]] == links.tolist()
    assert found[0] == found[1] == found[2]


# --- packing -----------------------------------------------------------------------


def check_packed(docs, found):
    tok = Tokenizer.from_file(TOKENIZER[0])
    tok.encode_special_tokens = True
    want = Counter()
    for r in rows(docs):
        ids = tuple([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0])
        want[r["doc_id"], len(ids)] += len(ids)
    got, places = Counter(), {}
    for r in found:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    padded = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded == 0
    return tok


def test_pack_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = rows(packing.packed(docs, *TOKENIZER))
    tok = check_packed(docs, found)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d in rows(docs):
        ids, at = np.array([*tok.encode(d["text"], add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_pack_odd_rows(spark):
    data = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "x " * 3000), (4, "<|endoftext|> ༀあ \U0001f600")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("length", docs_lit())
    found = rows(packing.packed(docs, *TOKENIZER))
    check_packed(docs, found)
    assert rows(packing.packed(docs, TOKENIZER[0])) and rows(packing.packed(docs.limit(0), *TOKENIZER)) == []


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_both_tokenizers_agree(text):
    slow, fast = packing.encoder(TOKENIZER[0]), _fast()
    assert slow([text]) == fast([text])


def _fast(made=[]):  # noqa: B006
    if not made:
        made.append(packing.encoder(*TOKENIZER))
    return made[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_sum_of_squares(sizes):
    """Every placement is the best one by the definition, and every id is in one piece."""
    p = packing.Packer(16)
    out, levels = [], Counter()
    for key, n in enumerate(sizes):
        for start in range(0, n, 16):
            size = min(16, n - start)
            before = Counter({h: len(w) for h, w in enumerate(p.open) if h and w})
            out += p.place(key, start, np.arange(start, start + size, dtype="<u4"), n)
            after = Counter({h: len(w) for h, w in enumerate(p.open) if h and w})
            if size == 16:
                assert before == after
                continue
            options = []
            for h in [0, *before]:
                if h + size <= 16:
                    c = Counter(before)
                    c[h] -= h > 0
                    c[h + size] += h + size < 16
                    options.append(sum(v * v for v in c.values()))
            assert sum(v * v for v in after.values()) == min(options)
    out += p.close()
    fill = Counter()
    for _, _, ids, _, sequence, _ in out:
        fill[sequence] += len(ids)
    assert sum(fill.values()) == sum(sizes) and all(v == 16 or v & (v - 1) == 0 for v in fill.values())
    ids = sorted((key, int(i)) for key, _, ids, _, _, _ in out for i in ids)
    assert ids == [(k, i) for k, n in enumerate(sizes) for i in range(n)]


# --- chat --------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "s>", "/", "a", "\n", "é"]), max_size=12))
def test_escape(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat(spark):
    data = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "\\ [INST] " + "x" * 100_000), (1, 2, None, None), (2, 5, "assistant", ""),
        (2, 1, "sys\n<s>", "t"), (-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (None, 0, "user", "n"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"),
        (4, None, "assistant", "first"), (4, 0, "assistant", "second"),
    ]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("c", docs_lit())
    found = {r["conv_id"]: r for r in rows(chat.digests(turns))}
    own = {}
    for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(found) == set(own)
    for conv, said in own.items():
        loss = "".join(t for r, t in said if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in said)
        r = found[conv]
        assert r["n_turns"] == len(said) and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    text = "".join(r["formatted"] for r in sorted(rows(chat.formatted(turns)), key=lambda r: r["part"]) if r["conv_id"] == 2)
    assert text == "<|im_start|>sys\n<\\s><|im_sep|>t<|im_end|>\n<|im_start|>assistant<|im_sep|><|im_end|>\n"
    assert len(text) == found[2]["formatted_chars"] and rows(chat.digests(turns.limit(0))) == []


def text_of(source, filters=None, **names):
    return "".join(p for p, _ in templates.compiled(source, filters)(**names))


def test_templates():
    up = {"up": lambda s: (s or "").upper()}
    assert text_of("{% for m in ms %}{% if loop.first %}[{% endif %}{{ m.a | up }}{% endfor %}]", up, ms=[{"a": "x"}, {"a": "y"}]) == "[XY]"
    assert text_of("{% if a == 'x' and not b %}1{% elif b or a != 'x' %}2{% else %}3{% endif %}", a="x", b=False) == "1"
    assert text_of("{% if a == 1 %}1{% elif b %}2{% else %}3{% endif %}", a=2, b=True) == "2"
    tree = templates.fold(templates.parse("a{{ ('b' + 'c') | up }}{% if 1 == 2 %}no{% else %}d{% endif %}{{ x }}"), up)
    assert tree == ("block", [("out", ("const", "aBCd")), ("out", ("name", "x"))])
    pieces = list(templates.compiled("a{% generation %}{{ x }}{% endgeneration %}b")(x="y"))
    assert pieces == [("a", False), ("y", True), ("b", False)]
    for bad in ("{{ a.__class__ }}", "{{ f(1) }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a[0] }}", "{% import os %}", "{{ a | }}", "{{ (a }}"):
        with pytest.raises(templates.TemplateError):
            templates.compiled(bad)
    with pytest.raises(templates.TemplateError):
        templates.compiled("{{ a | nothing }}")


# --- the pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    """Each stage on what its predecessor kept, held against the operators' own figures."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources", "packing"]
    columns = docs.columns
    found = docs
    for (name, stage), i in zip(corpus_pipeline.STAGES, range(5)):
        before = found
        found = stored(stage(spark, before, small), f"test-{i}")
        if i < 4:
            assert found.columns == columns
        ids = Counter(r["doc_id"] for r in rows(found.select("doc_id")))
        if name == "quality classifier":
            good = {r["doc_id"] for r in rows(quality.report(before, labels)) if r["predicted"]}
            assert ids == Counter(good)
        elif name == "MinHash near-dedup":
            assert ids == Counter(r["doc_id"] for r in rows(neardup.components(before)) if r["kept"])
        elif name == "secret scans":
            assert ids == Counter(r["doc_id"] for r in rows(before))
            spans = {r["doc_id"]: r["spans"] for r in rows(secrets.report(before))}
            old = {r["doc_id"]: r["text"] for r in rows(before)}
            for r in rows(found):
                assert (r["text"] == old[r["doc_id"]]) == (not spans[r["doc_id"]])
        elif name == "mixing sources":
            assert ids == Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows(mixing.taken(before)) if r["taken"]})
        else:
            check_packed(before, rows(found))


def test_pipeline_empty(spark, small):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == []


def test_tokenizer_is_a_parameter():
    assert TOKENIZER[0] == public_tokenizers.path("byte_bpe_50k.json") and corpus_pipeline.ORACLE_SQL is None
