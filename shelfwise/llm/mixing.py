"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target over
size. The fractions are rounded in pairs: words of mass move from one document to
the other, at random with the expectation kept, until one of the two has a whole
number of copies. The pair's words stay the same, so a source ends within one
document of its target, whatever its sizes are.

The pairing is a reduction tree: a bucket of about ``fan_in`` documents is folded in
one row, its one unresolved document goes to the next level, and there are
log(n) levels. A hot source has as many more buckets; only (id, source, size) is
shuffled, never a text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import NULL_ID, n_words, uniform
from shelfwise.session import stored

WEIGHTS = (3, 1, 2)  # of the sources in order of code points, repeating, null last
SHARE = 1.5  # of all words
LIMIT = 2.0  # times a source's or a document's own words
FAN_IN = 64
SEED = 20240131
EPS = 1e-9


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """``(source, source_size, units, target)`` from ``(source, source_size, units)``.

    Resharing the excess by weight ends where every target is the smaller of its cap
    and weight * level. With the sources by cap over weight, the level is the largest
    of (words left after the caps before) / (weights from here on). The windows run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.lit(limit) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(after))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select(
        "source", "source_size", "units", F.least("cap", F.col("w") * F.col("level")).alias("target")
    )


def _fold(items, level: int):
    """Rounds the items of a bucket: ``done`` holds the resolved, ``c`` the one left (f < 0: none)."""
    unit = "struct<id:bigint,size:bigint,n:bigint,base:bigint,f:double>"
    none = F.lit(None).cast("bigint")
    start = F.struct(
        F.struct(
            none.alias("id"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("n"),
            F.lit(0).cast("bigint").alias("base"), F.lit(-1.0).alias("f"),
        ).cast(unit).alias("c"),
        F.array().cast(f"array<{unit}>").alias("done"),
    )

    def with_f(item, f):
        return F.struct(
            item["id"].alias("id"), item["size"].alias("size"), item["n"].alias("n"), item["base"].alias("base"),
            f.cast("double").alias("f"),
        ).cast(unit)

    def snapped(f):
        return F.when(f < EPS, 0.0).when(f > 1 - EPS, 1.0).otherwise(f)

    def step(acc, x):
        c = acc["c"]
        cm, xm = c["f"] * c["size"], x["f"] * x["size"]
        up = F.least(c["size"] - cm, xm)  # words that c may gain from x
        down = F.least(cm, x["size"] - xm)
        gains = uniform(F.lit(SEED), F.lit(level), c["id"], c["size"], x["id"], x["size"]) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        c2 = with_f(c, snapped((cm + moved) / c["size"]))
        x2 = with_f(x, snapped((xm - moved) / x["size"]))
        whole_c, whole_x = c2["f"].isin(0.0, 1.0), x2["f"].isin(0.0, 1.0)
        idle = with_f(c, F.lit(-1.0))
        paired = F.struct(
            F.when(~whole_x, x2).when(~whole_c, c2).otherwise(idle).alias("c"),
            F.concat(
                acc["done"],
                F.when(whole_x & whole_c, F.array(c2, x2)).when(whole_c, F.array(c2)).otherwise(F.array(x2)),
            ).alias("done"),
        )
        first = F.struct(x.alias("c"), acc["done"].alias("done"))
        return F.when(c["f"] < 0, first).otherwise(paired)

    return F.aggregate(items, start, step)


def mix(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source",
    weights=WEIGHTS, share=SHARE, limit=LIMIT, fan_in=FAN_IN,
) -> DataFrame:
    """``(doc_id, source, size, n, copies, source_size, target)``: copies to take of ``n`` equal rows.

    ``size`` is the number of words. Rows with the same id, source and size form one
    unit of ``n`` rows and share ``copies``, at most ``limit`` each. A null text is
    empty; a document without words takes no copies, as it cannot change the mix. A
    null id or source is a value like others (source: the last). Draws are hashes of
    ids, so reruns agree. An empty table gives no rows.
    """
    spark = docs.sparkSession
    units = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")
    ).groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    units = stored(units, "mix-units")
    sources = stored(
        targets(
            units.groupBy("source").agg(
                F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units")
            ),
            weights, share, limit,
        ),
        "mix-targets",
    )
    most = sources.agg(F.max("units")).first()[0] or 0
    mass = F.when(F.col("size") > 0, F.col("target") / F.col("source_size") * F.col("n")).otherwise(0.0)
    u = (
        units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("mass", mass)
        .withColumn("base", F.floor(F.col("mass") + EPS))
        .withColumn("f", F.greatest(F.col("mass") - F.col("base"), F.lit(0.0)))
    )
    same = ("source", "source_size", "target")
    kept = ("id", "size", "n", "base", "f")
    done = [u.filter(f"f < {EPS}").select(*same, *kept[:4], F.lit(0).alias("up"))]
    buckets = F.ceil(F.col("units") / fan_in)
    level, rows = 0, u.filter(f"f >= {EPS}").select(
        *same, *kept, F.pmod(F.xxhash64(F.lit(SEED), "id", "size"), buckets).alias("bucket")
    )
    left = math.ceil(most / fan_in)
    while True:
        one = F.struct(*kept)
        # largest first, so that the unresolved one tends to be small
        order = F.array_sort(
            F.collect_list(one),
            lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1))
            .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
        )
        folded = rows.groupBy(*same, "bucket").agg(_fold(order, level).alias("r"))
        folded = stored(folded.select(*same, "bucket", "r.c", "r.done"), "mix-level")
        done.append(
            folded.select(*same, F.explode("done").alias("d"))
            .select(*same, *[f"d.{k}" for k in kept[:4]], F.col("d.f").cast("int").alias("up"))
        )
        rows = folded.filter("c.f >= 0").select(
            *same, *[f"c.{k}" for k in kept], F.floor(F.col("bucket") / fan_in).alias("bucket")
        )
        if left <= 1:
            break
        level, left = level + 1, math.ceil(left / fan_in)
    draw = uniform(F.lit(SEED), F.lit(-1), F.col("id"), F.col("size")) < F.col("f")
    done.append(rows.select(*same, *kept[:4], draw.cast("int").alias("up")))
    return reduce(DataFrame.unionByName, done).select(
        F.col("id").alias("doc_id"), "source", "size", "n", (F.col("base") + F.col("up")).alias("copies"),
        "source_size", "target",
    )


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``(doc_id, size, source_size, target, taken)``, words taken with repeats."""
    m = mix(docs, **options)
    extra = (F.col("k") <= F.col("copies") % F.col("n")).cast("long")
    return m.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.floor(F.col("copies") / F.col("n")) + extra)).alias("taken"),
    )


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as it is taken."""
    m = mix(docs, id_col, text_col, source_col)

    def key(d, i, s):
        return d.withColumns({
            "__mix_key": F.xxhash64(F.col(i), F.col(s), F.col("__mix_size")),
            "__mix_id": F.coalesce(F.col(i).cast("long"), F.lit(NULL_ID)),
        })

    keys = ["__mix_key", "__mix_id", "__mix_size"]
    m = key(m.withColumnRenamed("size", "__mix_size"), "doc_id", "source").select(
        *keys, F.col("n").alias("__mix_n"), F.col("copies").alias("__mix_copies")
    )
    d = key(docs.withColumn("__mix_size", n_words(text_col)), id_col, source_col)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__mix_id"))
    n, copies = F.col("__mix_n"), F.col("__mix_copies")
    times = F.floor(copies / n) + (place <= copies % n).cast("long")
    j = d.join(m, keys).withColumn("__mix_times", times)
    j = j.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_times").cast("int"))))
    return j.select(*docs.columns)
