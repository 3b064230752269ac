"""What the operators share: words, hashed draws and links between rows."""

from __future__ import annotations

import pickle
import re

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import stored

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD).findall

NULL_ID = -(2**63)


def whole(c: str) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(c), F.lit(""))


def n_words(c: str) -> Column:
    return F.regexp_count(whole(c), F.lit(WORD)).cast("long")


def uniform(*cols: Column) -> Column:
    """A draw from [0, 1) that is a function of its arguments, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def shared_value(spark: SparkSession, value):
    """A function that returns ``value`` on a worker; for fitted models of bounded size."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """``(id, component)`` of the ids in ``edges(a, b)``: the smallest id reachable.

    Large-star and small-star steps in turn: every node hangs its larger, then its
    smaller neighbours below the smallest one it knows. Each step is a minimum per
    node, combined before its shuffle, and a join that AQE may split at a hot node.
    The edges of each round are written to the shared folder.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        step = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().observe(
            seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        )
        e = stored(step, name)
        now = (seen.get["n"], seen.get["h"])
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
