"""Personal data: fixed formats, and boosted trees over the candidates of loose generators.

Fixed formats give the base spans. Generators with high recall propose further spans,
which may overlap: spelled-out mail addresses, digit groups, account numbers. Boosted
trees score a candidate by its format and its context. They are trained on the
candidates that also pass a fixed format, against all others; what defines the fixed
format (the leading plus, the check digit, the at sign) is no feature, so a candidate
like them in everything else scores high. As the others hold positives too, scores are
divided by the mean score of held-out positives. The threshold is the least at which
the held-out part reaches ``PRECISION`` by its own calibrated scores.

All candidates of all documents fit the trees: equal ones are counted, halves are drawn by a
hash of the document and the place, one to grow the trees, one to calibrate them. Tasks add up the
histograms of a level over their counts; a few thousand sums a task come back. The model is some
kB. Spans are found in a second pass over the texts, without a shuffle. Only a corpus with under
``LEAST_POSITIVE`` positives or no other candidate has no trees; then a warning says so, and
only base spans are found. ``fit`` is a model of a bounded draw for trials; nothing here uses it.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.boosting import UNIT, Boosted
from shelfwise.llm.common import shared_value
from shelfwise.session import stored

KINDS = ("email", "ip", "card", "phone", "found")
FIT_ROWS = 20_000  # of ``fit`` only
PRECISION = 0.95
LEAST_SCORE = 0.9
LEAST_POSITIVE = 50  # with fewer, nothing is added
COUNTED = 50_000  # distinct candidates that a task counts at a time
PART_ROWS = 1 << 16  # distinct candidates of a task that adds up histograms
CELLS = 1 << 15  # of scores, for the threshold

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_GENERATORS = (
    re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(](?:at|AT)[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,64})+"),
    re.compile(r"(?<![A-Za-z0-9])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![A-Za-z0-9])"),
    re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
)
_HINTS = tuple(
    re.compile(p, re.I)
    for p in (
        r"(?:tel|phone|call|mobile|fax|cell)\W*(?:\w+\W+)?$", r"(?:mail|contact|write|reach)\W*(?:\w+\W+){0,2}$",
        r"(?:card|visa|iban|account|pay)\W*(?:\w+\W+)?$", r"(?:\bip|host|server|addr\w*)\W*(?:\w+\W+)?$",
        r"(?:no|nr|number|id|#)\W*$", r"[$€£]\s*$",
    )
)
_AFTER = re.compile(r"\s*(?:%|kg|km|eur|usd|years?|pages?|items?)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of LOCAL+@DOMAIN; the local part is what stands before the sign and after the last match."""
    end = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            end = m.end()


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the fixed formats, per kind."""
    if not text:
        return [[], [], [], []]
    out: list[list[tuple[int, int]]] = [list(emails(text)) if "@" in text else []]
    out.append([m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))])
    cards = []
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            cards.append(m.span())
    out.append(cards)
    out.append([m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else [])
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans the generators propose, with the generator."""
    return sorted({(*m.span(), g) for g, p in enumerate(_GENERATORS) for m in p.finditer(text)})


def features(text: str, a: int, b: int, generator: int) -> list[float]:
    s = text[a:b].lstrip("+")
    before, after = text[max(0, a - 40) : a], text[b : b + 12]
    digits = _digits(s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    return [
        generator, len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"), sum(c.isalpha() for c in s),
        len(set(digits)), *[float(bool(h.search(before))) for h in _HINTS], float(bool(_AFTER.match(after))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()),
    ]


class Model:
    def __init__(self, trees: Boosted | None, scale: float = 1.0, threshold: float = 2.0):
        self.trees, self.scale, self.threshold = trees, scale, threshold

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seen: tuple[int, int] | None = None) -> Model:
        """Every second row of a class trains, the others calibrate.

        ``seen`` counts the negatives and positives that the rows were drawn from.
        """
        drawn = int((y == 0).sum()), int((y == 1).sum())
        seen = seen or drawn
        if drawn[1] < LEAST_POSITIVE or not drawn[0]:
            return cls.without_trees(seen)
        each = seen[0] / drawn[0], seen[1] / drawn[1]
        weight, train = np.where(y == 1, each[1], each[0]), np.zeros(len(y), bool)
        for label in (0, 1):
            train[np.flatnonzero(y == label)[::2]] = True
        trees = Boosted().fit(x[train], y[train])
        trees.start += float(np.log(each[1] / each[0]))
        p, own, weight = trees.predict(x[~train]), y[~train], weight[~train]
        scale = float(p[own == 1].mean())
        calibrated = np.minimum(p / scale, 1)
        order = np.argsort(-calibrated, kind="stable")
        precision = np.cumsum((weight * calibrated)[order]) / np.cumsum(weight[order])
        good = np.flatnonzero(precision >= PRECISION)  # the best is at the mean of positives or above: it counts as 1
        return cls(trees, scale, max(float(calibrated[order[good[-1]]]), LEAST_SCORE))

    @classmethod
    def without_trees(cls, seen: tuple[int, int]) -> Model:
        warnings.warn(f"no trees, only fixed formats: {seen[1]} positive and {seen[0]} other candidates", stacklevel=3)
        return cls(None)

    def spans(self, text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Added spans: candidates clear of base spans, best first where they overlap."""
        if self.trees is None or not text:
            return []
        taken = [s for kind in base for s in kind]
        free = [c for c in candidates(text) if not any(a < c[1] and b > c[0] for a, b in taken)]
        if not free:
            return []
        p = np.minimum(self.trees.predict(np.array([features(text, *c) for c in free])) / self.scale, 1)
        out: list[tuple[int, int]] = []
        for i in np.argsort(-p, kind="stable"):
            a, b, _ = free[i]
            if p[i] < self.threshold:
                break
            if not any(x < b and y > a for x, y in out):
                out.append((a, b))
        return sorted(out)


def fit(docs: DataFrame, id_col="doc_id", text_col="text") -> Model:
    """A trial model of at most ``FIT_ROWS`` candidates, half of them positives; ``fit_all`` leaves none out."""
    names, half = len(features("", 0, 0, 0)), FIT_ROWS // 2

    def task(batches):
        drawn, seen, bar = ([], []), [0, 0], [2**56, 2**56]
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = candidates(text)
                base = {s for kind in base_spans(text) for s in kind} if own else set()
                for a, e, g in own:
                    y = int((a, e) in base)
                    seen[y] += 1
                    k = int.from_bytes(hashlib.blake2b(f"{key}:{a}:{e}:{g}".encode(), digest_size=7).digest(), "little")
                    if k > bar[y]:
                        continue
                    drawn[y].append((k, features(text, a, e, g)))
                    if len(drawn[y]) >= 2 * half:
                        drawn[y].sort()
                        del drawn[y][half:]
                        bar[y] = drawn[y][-1][0]
        for y, rows in enumerate(drawn):
            rows = sorted(rows)[:half]
            if rows:
                columns = [k for k, _ in rows], [x for _, x in rows], [y] * len(rows), [seen[y]] + [0] * (len(rows) - 1)
                types = pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k", "x", "y", "n"])

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    found = stored(d.mapInArrow(task, "k long, x array<double>, y int, n long"), "candidates")
    seen = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    drawn = [found.filter(F.col("y") == y).orderBy("k", "x").limit(half).toArrow().column("x").to_pylist() for y in (0, 1)]
    x = np.array(drawn[0] + drawn[1], float).reshape(-1, names)
    return Model.fit(x, np.repeat([0.0, 1.0], list(map(len, drawn))), (seen.get(0, 0), seen.get(1, 0)))


def counted_candidates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(x, y, train, n)``: how often each distinct candidate is in ``docs``, by its half."""

    def batch(seen: Counter) -> pa.RecordBatch:
        columns = list(zip(*[(x, y, train, n) for (x, y, train), n in seen.items()])) or [[]] * 4
        types = pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["x", "y", "train", "n"])

    def task(batches):
        seen: Counter = Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = candidates(text)
                base = {s for kind in base_spans(text) for s in kind} if own else set()
                for a, e, g in own:
                    drawn = hashlib.blake2b(f"{key}:{a}:{e}:{g}".encode(), digest_size=1).digest()[0]
                    seen[tuple(map(float, features(text, a, e, g))), int((a, e) in base), drawn % 2 == 0] += 1
                if len(seen) >= COUNTED:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    found = d.mapInArrow(task, "x array<double>, y int, train boolean, n long")
    return found.groupBy("x", "y", "train").agg(F.sum("n").alias("n"))


def _added(rows: DataFrame, trees: Boosted, add: Callable) -> np.ndarray:
    """The sum of ``add(trees, x, y, n)``, arrays of whole numbers of one shape, over all rows."""
    names, shared = len(features("", 0, 0, 0)), shared_value(rows.sparkSession, trees)

    def task(batches):
        total, own = None, shared()
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(-1, names)
                found = add(own, x, b.column(1).to_numpy(), b.column(2).to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["s", "shape"])

    parts = rows.select("x", "y", "n").mapInArrow(task, "s binary, shape array<int>").collect()
    return sum(np.frombuffer(r.s, np.int64).reshape(r["shape"]) for r in parts)


def fit_all(docs: DataFrame, id_col="doc_id", text_col="text") -> Model:
    """The model of all candidates in ``docs``."""
    found = stored(counted_candidates(docs, id_col, text_col), "candidates")
    n, distinct = {}, 0
    for r in found.groupBy("y", "train").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():
        n[r.y, r.train] = r.n
        distinct += r.rows
    negatives, positives = (n.get((y, True), 0) + n.get((y, False), 0) for y in (0, 1))
    if positives < LEAST_POSITIVE or not negatives:
        return Model.without_trees((negatives, positives))
    found = found.coalesce(-(-distinct // PART_ROWS))
    train, held = found.filter("train"), found.filter("NOT train")
    if not (n.get((0, True)) and n.get((1, True)) and n.get((1, False))):  # rows of one id and place: no halves
        train = held = found
        n = {(0, True): negatives, (1, True): positives, (1, False): positives}

    trees, names = Boosted(), len(features("", 0, 0, 0))
    at = F.array(*map(F.lit, trees.quantiles()))
    cuts = train.agg(*[F.percentile(F.col("x")[j], at, F.col("n")).alias(f"f{j}") for j in range(names)]).first()
    edges = [np.unique(c) for c in cuts]

    def histograms(splits, level):
        return _added(train, trees, lambda own, x, y, n: own.histograms(x, y, n, splits, level))

    trees.grow(edges, n[0, True] + n[1, True], n[1, True], histograms)

    def scores(own, x, y, n):
        return np.array([(np.rint(own.predict(x) * UNIT).astype(np.int64) * n)[y == 1].sum()])

    scale = float(_added(held, trees, scores)[0] / UNIT / n[1, False])

    def cells(own, x, y, n):
        p = np.minimum(own.predict(x) / scale, 1)
        at, out = ((1 - p) * (CELLS - 1)).astype(np.int64), np.zeros((2, CELLS), np.int64)
        np.add.at(out[0], at, n)
        np.add.at(out[1], at, np.rint(p * UNIT).astype(np.int64) * n)
        return out

    counts, sums = _added(held, trees, cells)
    # the best is at the mean of positives or above: it counts as 1
    good = np.flatnonzero((counts > 0) & (np.cumsum(sums) / UNIT >= PRECISION * np.cumsum(counts)))
    return Model(trees, scale, max(1 - (int(good[-1]) + 1) / (CELLS - 1), LEAST_SCORE))


def report(docs: DataFrame, id_col="doc_id", text_col="text", model: Model | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row; null text is empty."""
    shared = shared_value(docs.sparkSession, model or fit_all(docs, id_col, text_col))
    schema = pa.schema([
        ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()),
    ])

    def task(batches):
        m = shared()
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                base = base_spans(text)
                named = [f"{k}:{a}:{e}" for k, own in zip(KINDS, base) for a, e in own]
                digest = hashlib.sha256(",".join(named).encode()).hexdigest()
                named += [f"{KINDS[4]}:{a}:{e}" for a, e in m.spans(text, base)]
                rows.append((key, *map(len, base), digest, ",".join(named)))
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return d.mapInArrow(
        task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, id_col="doc_id", text_col="text", mark: str = "[PII]") -> DataFrame:
    """``docs``, same columns, every span of a text replaced, spans that overlap as one. Null stays null."""
    shared = shared_value(docs.sparkSession, fit_all(docs, id_col, text_col))

    def task(batches):
        m = shared()
        for b in batches:
            at, out = b.schema.get_field_index(text_col), []
            for text in b.column(at):
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    parts, pos = [], 0
                    for a, e in sorted([s for own in base for s in own] + m.spans(text, base)):
                        if a >= pos:
                            parts += [text[pos:a], mark]
                        pos = max(pos, e)
                    text = "".join(parts) + text[pos:]
                out.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(task, docs.schema)
