"""Secret scans: fixed formats, and a battery of randomness tests for everything else.

Fixed formats give the base spans. Any other run of 20 or more characters of the
base64 alphabets is a candidate, with the equals signs that pad it; those before it end
a name, so the value of ``name=value`` is a candidate of its own. Its encoding is inferred (hex, base32, base64), and
three tests ask whether it looks drawn from that alphabet: chi-squared uniformity,
runs above and below the middle of the alphabet, and serial correlation. Those that
pass get the chance p that a token of prose, whose letters repeat as often as in a
natural language, looks that even at this length. A Benjamini-Hochberg bound on p,
per class of length over the whole corpus, controls false discoveries: short tokens,
on which the tests have little power, must be far more extreme.

Everything is a column expression over one row; only counts of p by class and bin are
shuffled, at most ``CLASSES * BINS`` rows, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import whole
from shelfwise.session import stored

# a candidate is only sought where a run begins, a name at a letter that begins one: neither changes what matches
ASSIGN = (
    r"(?=[PSTApsta])((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 characters or more
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,6}"  # base32 pads with up to six
KINDS = ("assign", "access", "hex", "random")

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
# name, pattern, alphabet, chance that two characters of an ordinary token agree
ENCODINGS = (
    ("decimal", r"^[0-9]+$", None, None),  # numbers are no encoding of a secret
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef", 0.1),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.1),
    ("base32", r"^[A-Z2-7]+$", LETTERS + "234567", 0.067),
    ("base64", r"^[A-Za-z0-9+/]+$", LETTERS + LETTERS.lower() + DIGITS + "+/", 0.067),
)
ALPHA_Z = 3.29  # two-sided 0.001
FDR = 0.01
CLASSES, BINS = 8, 300  # lengths by power of two from 16; p in tenths of its decimal logarithm


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often and in whatever lambda it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array. Chunks of the root of its length keep the appending cheap."""
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def chunked(values):
        size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), size)
        return F.transform(starts, lambda i: F.slice(values, i, size))

    def running(xs, first):
        return F.aggregate(
            xs, F.struct(first.alias("t"), empty.alias("a")),
            lambda acc, x: F.struct(
                (acc["t"] + x).alias("t"), F.concat(acc["a"], F.array(acc["t"] + x)).alias("a")
            ),
        )["a"]

    def summed(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
        return let(
            F.concat(F.array(zero), running(totals, zero)),
            lambda offsets: F.flatten(F.transform(chunks, lambda c, i: running(c, F.get(offsets, i)))),
        )

    return let(values, lambda v: let(chunked(v), summed))


def spans(text: Column, hits: Column, pattern: str) -> Column:
    """Start and end, in code points, of the ``hits`` of ``pattern``: lengths of what lies between add up.

    The text is split once, not once for each hit.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(hits, gaps, lambda h, g: (F.length(g) + F.length(h)).cast("bigint"))
    found = F.zip_with(
        hits, prefix_sums(steps), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    return F.when(F.size(hits) > 0, found).otherwise(none)


def _phi(z: Column) -> Column:
    """Normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def chance(token: Column) -> Column:
    """p of a token: small if it passes the battery and prose of its length would not look so even.

    1 if a test fails, null for a decimal number.
    """
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    out = F.lit(1.0)
    for _, pattern, alphabet, repeats in reversed(ENCODINGS):
        p = F.lit(None).cast("double") if alphabet is None else _battery(body, alphabet, repeats)
        out = F.when(body.rlike(pattern), p).otherwise(out)
    return out


def _battery(body: Column, alphabet: str, repeats: float) -> Column:
    k = float(len(alphabet))
    chars = F.split(body, "")
    n = F.length(body).cast("double")
    squares = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))
    )
    chi = squares * k / n - n
    df = k - 1
    uniform_z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(-1.0).alias("last"), zero.alias("high"), zero.alias("runs"), zero.alias("s"), zero.alias("ss"), zero.alias("sp")
    )
    centre = (k - 1) / 2

    def step(a, c):
        x = F.instr(F.lit(alphabet), c) - 1.0
        first = a["last"] < 0
        flips = ((x > centre) != (a["last"] > centre)) | first
        d = x - centre
        return F.struct(
            x.alias("last"),
            (a["high"] + (x > centre).cast("double")).alias("high"),
            (a["runs"] + flips.cast("double")).alias("runs"),
            (a["s"] + d).alias("s"),
            (a["ss"] + d * d).alias("ss"),
            (a["sp"] + F.when(first, 0.0).otherwise(d * (a["last"] - centre))).alias("sp"),
        )

    def verdict(r):
        pairs = 2 * r["high"] * (n - r["high"])
        runs_z = F.abs(r["runs"] - 1 - pairs / n) / F.sqrt(pairs * (pairs - n) / (n * n * (n - 1)))
        mean = r["s"] / n
        serial_z = F.abs((r["sp"] - n * mean * mean) / (r["ss"] - n * mean * mean)) * F.sqrt(n)
        passes = (pairs > n) & (uniform_z < ALPHA_Z) & (runs_z < ALPHA_Z) & (serial_z < ALPHA_Z)
        prose = k * (1 + (n - 1) * repeats) - n
        p = _phi((chi - prose) / F.sqrt(2 * (df + 2 * F.greatest(prose - df, F.lit(0.0)))))
        return F.when(F.coalesce(passes, F.lit(False)), p).otherwise(1.0)

    return F.aggregate(chars, start, step, verdict)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(BINS)).cast("int")


def _class(length: Column) -> Column:
    return F.least(F.floor(F.log2(length.cast("double"))) - 4, F.lit(CLASSES - 1)).cast("int")


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__base`` spans (start, kind, end) and ``__cand`` (start, end, cls, bin, of other tokens)."""
    d = docs.withColumn("__t", whole(text_col))
    d = d.withColumns({
        f"__h{i}": F.regexp_extract_all("__t", F.lit(p), F.lit(0)) for i, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))
    })
    d = d.withColumns({
        f"__s{i}": spans(F.col("__t"), F.col(f"__h{i}"), p) for i, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))
    })
    long_enough = F.filter("__s0", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)

    def kind(found, i):
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    d = d.withColumn("__base", F.array_sort(F.concat(kind(long_enough, 0), kind(F.col("__s1"), 1), kind(F.col("__s2"), 2))))
    # formats 1 and 2 lie within a candidate's run; only format 0 goes beyond one
    d = d.withColumn("__assigned", F.filter("__base", lambda b: b["kind"] == 0))
    free = F.filter(
        "__s3",
        lambda x: ~x["hit"].rlike(f"{ACCESS}|{HEX}")
        & ~F.exists("__assigned", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])),
    )
    tested = F.transform(
        free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), chance(x["hit"]).alias("p"))
    )
    d = d.withColumn("__tested", tested)
    judged = F.transform(
        F.filter("__tested", lambda x: x["p"].isNotNull()),
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            _class(x["end"] - x["start"]).alias("cls"), _bin(x["p"]).alias("bin"),
        ),
    )
    return d.withColumn("__cand", judged).select(*docs.columns, "__base", "__cand")


def cutoffs(docs: DataFrame, text_col: str = "text", rate: float = FDR) -> dict[int, int]:
    """Least bin that counts as random, by class of length (Benjamini-Hochberg over all candidates)."""
    return _cuts(scanned(docs.select(text_col), text_col), rate)


def _cuts(found: DataFrame, rate: float) -> dict[int, int]:
    found = found.select(F.explode("__cand").alias("c"))
    counts = found.groupBy("c.cls", "c.bin").count().collect()  # at most CLASSES * (BINS + 1) rows
    cuts = {}
    for cls in {r["cls"] for r in counts}:
        own = sorted(((r["bin"], r["count"]) for r in counts if r["cls"] == cls), reverse=True)
        total, above = sum(c for _, c in own), 0
        for b, c in own:
            above += c
            if b and 10 ** (-b / 10) * total / above <= rate:
                cuts[cls] = b
    return cuts


def _random(cuts: dict[int, int]) -> Column:
    """The candidates at or above the cut of their class, as spans."""

    def bar_of(cls):
        out = F.lit(None).cast("int")
        for c, b in cuts.items():
            out = F.when(cls == c, b).otherwise(out)
        return out

    return F.transform(
        F.filter("__cand", lambda x: F.coalesce(x["bin"] >= bar_of(x["cls"]), F.lit(False))),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )


def with_secrets(docs: DataFrame, text_col: str = "text", rate: float = FDR) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``, arrays of (start, kind, end) by start, then kind."""
    cuts = cutoffs(docs, text_col, rate)
    d = scanned(docs, text_col)
    return d.withColumn("__spans", F.array_sort(F.concat("__base", _random(cuts)))).select(*docs.columns, "__base", "__spans")


def written(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row; null text is empty.

    Repeated rows each have their row; an empty table gives none.
    """
    d = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    d = stored(d.select("doc_id", "__base", "__cand"), "secret-spans")  # texts are scanned once
    d = d.withColumn("__spans", F.array_sort(F.concat("__base", _random(_cuts(d, FDR)))))

    def n(i):
        return F.size(F.filter("__base", lambda x: x["kind"] == i)).cast("long")

    return d.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, same columns, with every span of the text replaced; spans that overlap as one. Null stays null."""
    d = with_secrets(docs, text_col)
    t = F.col(text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(a, x):
        gap = F.substring(t, (a["pos"] + 1).cast("int"), (x["start"] - a["pos"]).cast("int"))
        return F.struct(
            F.greatest(a["pos"], x["end"]).alias("pos"),
            F.when(x["start"] >= a["pos"], F.concat(a["parts"], F.array(gap, F.lit(mark)))).otherwise(a["parts"]).alias("parts"),
        )

    clean = F.aggregate(
        "__spans", start, step,
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, (a["pos"] + 1).cast("int"), F.length(t))),
    )
    d = d.withColumn("__clean", F.when(F.size("__spans") > 0, clean).otherwise(t))
    return d.select(*[F.col("__clean").alias(c) if c == text_col else c for c in docs.columns])
