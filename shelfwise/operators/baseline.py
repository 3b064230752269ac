"""Baseline classifier and the stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.fixed_values import SPLIT_SEED, TEST_SHARE
from shelfwise.functions.codes import hash_hex, hash_unit
from shelfwise.operators.rows import with_running_sum
from shelfwise.session import stored

STRATEGIES = ("most_frequent", "prior", "stratified", "uniform")
HASH_PREFIX = 3  # hex digits: 4096 slices of each class
SLOTS = 4096  # ranges of class shares: an item meets the classes of one range only


def _shares(counts: DataFrame) -> DataFrame:
    """Class counts with the running count up to and including each class."""
    return stored(with_running_sum(counts, "label", "n", "upto"), "shares")


def baseline_predict(
    train: DataFrame, label: str, items: DataFrame, row_id: str, strategy: str, seed: int = SPLIT_SEED
) -> DataFrame:
    """``(row_id, label)`` without looking at the items.

    ``most_frequent`` and ``prior`` give the largest class (ties: smallest
    label), ``stratified`` draws by class share, ``uniform`` evenly.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    counts = train.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if strategy in ("most_frequent", "prior"):
        largest = counts.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label")))).scalar()
        return items.select(row_id, largest.alias("label"))
    # a class takes the positions from ``upto - n`` to ``upto``; an item draws one
    shares = _shares(counts if strategy == "stratified" else counts.withColumn("n", F.lit(1)))
    total = shares.agg(F.max("upto")).scalar()
    width = F.greatest(F.lit(1), F.ceil(F.col("_total") / SLOTS))
    start = F.col("upto") - F.col("n")
    slots = shares.withColumn("_total", total).select(
        "label",
        start.alias("_from"),
        F.col("upto").alias("_to"),
        F.explode(F.sequence(F.floor(start / width), F.floor((F.col("upto") - 1) / width))).alias("_slot"),
    )
    at = F.floor(hash_unit(seed, F.col(row_id)) * F.col("_total"))
    drawn = (
        items.select(row_id)
        .withColumn("_total", total)
        .select(row_id, at.alias("_at"), F.floor(at / width).alias("_slot"))
    )
    hit = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    return drawn.join(slots, "_slot").where(hit).select(row_id, "label")


def stratified_split(
    df: DataFrame, row_id: str, label: str | None, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``is_test``: the first ``round(share * n)`` rows of each class by hash.

    Exact and repeatable. Rows are not ranked: each class is cut into slices by
    the first hash digits, the slice that holds the cut is the only one sorted,
    and every row is then compared with the cut of its class. A class that holds
    a third of all rows is therefore never sorted as a whole. Without a label
    the whole table is one class.
    """
    stratum = F.col(label) if label else F.lit("all")
    digest = hash_hex(seed, F.col(row_id))
    keyed = df.select(
        F.coalesce(stratum.cast("string"), F.lit("")).alias("_c"),
        stratum.isNull().alias("_null"),
        digest.alias("_h"),
        F.substring(digest, 1, HASH_PREFIX).alias("_s"),
    )
    group = ["_c", "_null"]
    slices = keyed.groupBy(*group, "_s").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    located = slices.select(
        *group,
        "_s",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.col("_n"),
        F.round(F.sum("_n").over(whole) * F.lit(test_share)).cast("long").alias("_take"),
    ).where((F.col("_before") < F.col("_take")) & (F.col("_take") <= F.col("_before") + F.col("_n")))
    located = stored(located, "slices")
    # the hash of the last test row: rank the rows of the located slices only
    rank = Window.partitionBy(*group, "_s").orderBy("_h")
    cuts = (
        keyed.join(located, [*group, "_s"])
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") == F.col("_take") - F.col("_before"))
        .select(*group, F.col("_h").alias("_cut"))
    )
    cuts = stored(cuts, "cuts")
    return (
        df.withColumn("_c", F.coalesce(stratum.cast("string"), F.lit("")))
        .withColumn("_null", stratum.isNull())
        .join(cuts, group, "left")
        .withColumn("is_test", F.coalesce(digest <= F.col("_cut"), F.lit(False)))
        .drop("_c", "_null", "_cut")
    )


def constant_prediction(train: DataFrame, label: str) -> Column:
    """The label of a level that has only one class, else null."""
    found = train.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return found.select(F.when(F.col("lo") == F.col("hi"), F.col("lo"))).scalar()
