"""Votes of neighbours and the randomness battery against plain versions of their definitions."""

import math
import random
import re
import zlib

import numpy as np

from shelfwise.llm import quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- quality: latent vectors, neighbours and weighted votes ---------------------------


def brute_look(word):
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", out, flags=re.S)


def brute_description(text):
    x = np.zeros(3 * 1024 + 4)
    words = WORD.findall(text or "")
    n = len(words)
    if not n:
        x[-4] = 0.8
        return x
    looks = [zlib.crc32(brute_look(w).encode()) % 1024 for w in words]
    for look in looks:
        x[look] += 1 / n
    for a, b in zip(looks, looks[1:]):
        x[1024 + (b * 769 + a) % 1024] += 1 / (n - 1)
    for w in words:
        x[2048 + (zlib.crc32(w.encode()) % 1024)] += 1 / n
    x[:1024], x[1024:2048], x[2048:3072] = np.sqrt(x[:1024]), 0.8 * np.sqrt(x[1024:2048]), 0.25 * np.sqrt(x[2048:3072])
    if n > 1:
        kinds = [(w, look) for w, look in zip(words, looks)]
        x[-3] = 0.8 * math.sqrt(sum(a == b for a, b in zip(kinds, kinds[1:])) / (n - 1))
        x[-2] = 0.8 * math.sqrt(sum(a == b for a, b in zip(kinds, kinds[2:])) / (n - 2)) if n > 2 else 0
        x[-1] = 0.8 * math.sqrt(1 - len(set(kinds)) / n) / 2
    return x


def brute_scores(texts, labelled):
    """``labelled``: texts with 0 or 1, all of them drawn."""
    x = np.array([brute_description(t) for t, _ in labelled]).astype(np.float16).astype(float)
    y = np.array([v for _, v in labelled], float)
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    axes = vt[:48].T

    def latent(v):
        v = (v - mean) @ axes
        length = np.linalg.norm(v)
        return v / length if length > 1e-9 else v * 0

    known = np.array([latent(v) for v in x])
    out = []
    for t in texts:
        cos = known @ latent(brute_description(t))
        near = sorted(range(len(y)), key=lambda i: -cos[i])[:15]
        votes = [max(cos[i], 0) ** 8 for i in near]
        out.append((sum(v * y[i] for v, i in zip(votes, near)) + 1e-6 * y.mean()) / (sum(votes) + 1e-6))
    return out


def test_votes(spark):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(200)]

    def text(good):
        n = rng.randint(5, 60)
        if good:
            return " ".join(rng.choice(plain).capitalize() if i % 9 == 0 else rng.choice(plain) for i in range(n))
        return " ".join(rng.choice(["$$$", "BUY", "now!!", "99", rng.choice(plain)]) for _ in range(n))

    data = [(i, text(i % 2), 1) for i in range(90)] + [(100, "", 1), (101, None, 1), (102, "one", 1)]
    labels = [(i, i % 2) for i in range(72)] + [(None, 1), (3, 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    held = {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2}
    by_id = {i: t for i, t, _ in data}
    learned = [(by_id[i], y) for i, y in labels if i in by_id and y in (0, 1) and i not in held]
    assert 49 < len(learned) <= 58  # more rows than axes, and few enough for an exact decomposition
    want = dict(zip(by_id, brute_scores(by_id.values(), learned)))
    for r in rows(quality.report(docs, marks)):
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-3, r
        assert r["held_out"] == (r["doc_id"] in held) and r["predicted"] == (r["score"] >= 0.7)


# --- secrets: the battery and the bound -----------------------------------------------


def phi(z):
    return 1 / (1 + math.exp(min(700.0, -1.5976 * z - 0.07056 * z**3)))


ALPHABETS = (
    (r"[0-9]+", None, None), (r"[0-9a-f]+", "0123456789abcdef", 0.1), (r"[0-9A-F]+", "0123456789ABCDEF", 0.1),
    (r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.067),
    (r"[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.067),
)


def brute_chance(token):
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    alphabet, repeats = next((a, r) for p, a, r in ALPHABETS if re.fullmatch(p, body))
    if alphabet is None:
        return None
    x = [alphabet.index(c) for c in body]
    n, k = len(x), len(alphabet)
    expected = n / k
    chi = sum((x.count(v) - expected) ** 2 / expected for v in range(k))
    df = k - 1
    uniform = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    middle = (k - 1) / 2
    side = [v > middle for v in x]
    high, low = sum(side), n - sum(side)
    if 2 * high * low <= n:
        return 1.0
    runs = 1 + sum(a != b for a, b in zip(side, side[1:]))
    mean_runs = 2 * high * low / n + 1
    deviation = math.sqrt(2 * high * low * (2 * high * low - n) / (n * n * (n - 1)))
    mean = sum(x) / n
    around = sum((v - mean) ** 2 for v in x)
    # products of neighbours about the middle, less what the mean alone gives
    d = [v - middle for v in x]
    serial = (sum(a * b for a, b in zip(d, d[1:])) - n * (mean - middle) ** 2) / around
    if not (uniform < 3.29 and abs(runs - mean_runs) / deviation < 3.29 and abs(serial) * math.sqrt(n) < 3.29):
        return 1.0
    prose = k * (1 + (n - 1) * repeats) - n  # the chi-squared of text whose letters agree that often
    return phi((chi - prose) / math.sqrt(2 * (df + 2 * max(prose - df, 0))))


def brute_random(texts, rate=0.01):
    """Spans of all texts: candidates that meet no fixed format, bounded by class of length."""
    found = []
    for i, t in enumerate(texts):
        base = [m.span() for m in re.finditer(r"[0-9a-f]{24,}", t)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,6}", t):
            if any(a < m.end() and b > m.start() for a, b in base):
                continue
            p = brute_chance(m[0])
            if p is not None:
                size = min(int(math.log2(len(m[0]))) - 4, 7)
                found.append((i, m.span(), size, min(math.floor(-10 * math.log10(max(p, 1e-30))), 300)))
    cut = {}
    for size in {f[2] for f in found}:
        bins = sorted((f[3] for f in found if f[2] == size), reverse=True)
        for b in set(bins):
            if b and 10 ** (-b / 10) * len(bins) / sum(x >= b for x in bins) <= rate:
                cut[size] = min(b, cut.get(size, b))
    return {(i, *span) for i, span, size, b in found if size in cut and b >= cut[size]}


def test_battery_and_bound(spark):
    rng = random.Random(9)
    base64, base32 = ALPHABETS[4][1], ALPHABETS[3][1]
    texts = []
    for i in range(150):
        n = rng.choice([20, 24, 33, 50, 70, 140, 300])
        tokens = [
            "".join(rng.choice(base64) for _ in range(n)) + "=" * (i % 3),
            "".join(rng.choice(base32) for _ in range(n)),
            "".join(rng.choice("0123456789ABCDEF") for _ in range(n)),
            "_".join(rng.choice(["the", "quick", "brown", "foxes", "jump", "over"]) for _ in range(8)),
            "ab" * (n // 2 + 8), "1234567890" * 3, "é", "short", "x/" + "".join(sorted(rng.choice(base64) for _ in range(n))),
            "deadbeef" * 4,
        ]
        texts.append(" ".join(rng.sample(tokens, rng.randint(1, len(tokens)))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {
        (r["doc_id"], *map(int, s.split(":")[1:])) for r in rows(secrets.report(docs)) for s in r["spans"].split(",") if s.startswith("random")
    }
    assert got == brute_random(texts) and len(got) > 100
