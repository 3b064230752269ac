"""Row operators: nulls, dedup, numbering, batches, unions, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.codes import hash_hex
from shelfwise.session import stored


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def fill_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def cast_all_string(df: DataFrame) -> DataFrame:
    """Every column as text; a null stays null."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def with_id(df: DataFrame, row_id: str, name: str = "product_id") -> DataFrame:
    """``id`` where the schema has it, else the row number column."""
    return df.withColumn(name, F.col("id" if "id" in df.columns else row_id))


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_keep_first(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The row with the lowest ``row_id`` per key; null keys count as equal.

    ``row_id`` tells the rows of a key apart. The lowest number of a key is a hash aggregate with
    partial sums, so a key that holds a third of all rows sends one number per task. Rows
    then meet these numbers by key and number: almost every pair of these is another hash,
    so the hot key does not meet in one task, and no row is sorted.
    """
    first = df.groupBy(*[F.col(k).alias(f"_first_{i}") for i, k in enumerate(keys)]).agg(F.min(row_id).alias("_first"))
    same = F.col(row_id).eqNullSafe(F.col("_first"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_first_{i}"))
    return df.join(first.hint("shuffle_hash"), same, "left_semi")


def with_position(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """0-based rank by a unique column.

    The rows are sorted by ranges that follow their real distribution and written to
    the shared folder with their slot; a rank is the slot plus the rows of the
    partitions before. The position is read off the written layout, which a re-run of
    the sort need not repeat.
    """
    ordered = stored(df.orderBy(order).withColumn("_slot", F.monotonically_increasing_id()), "positions")
    # fixed layout of monotonically_increasing_id: partition above bit 33, row below
    part = F.shiftright("_slot", 33)
    slot = F.col("_slot").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        ordered.withColumn("_part", part)
        .join(stored(starts, "starts"), "_part")
        .withColumn(name, (F.col("_start") + slot).cast("long"))
        .drop("_part", "_slot", "_start")
    )


def with_running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of a whole-number column up to and including each row, by a unique column.

    Two levels: rows are sorted by ranges that follow their real distribution and written
    with their partition; the sums before each partition, one number per task of the sort,
    are added up on the driver, and a window runs within a partition only.
    """
    spark = df.sparkSession
    ordered = stored(df.orderBy(order).withColumn("_slot", F.monotonically_increasing_id()), "sums")
    ordered = ordered.withColumn("_part", F.shiftright("_slot", 33))
    before, total = [], 0
    for r in sorted(ordered.groupBy("_part").agg(F.sum(value).alias("n")).collect()):
        before.append((r[0], total))
        total += r.n or 0
    starts = spark.createDataFrame(before, "_part long, _start long")
    own = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_start") + F.sum(value).over(own)
    return ordered.join(starts, "_part").withColumn(name, upto).drop("_part", "_slot", "_start")


def class_ids(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Distinct non-null labels numbered by first appearance."""
    firsts = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("class_name"))
        .agg(F.min(row_id).alias("first_row"))
    )
    return with_position(firsts, "first_row", "class_id").select("class_id", "class_name")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels numbered in sorted order: ``(label, code)``."""
    labels = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return with_position(labels, "label", "code").select("label", "code")


def batch_ids(df: DataFrame, row_id: str, size: int) -> DataFrame:
    """Batch number of each row when rows go out in order, ``size`` at a time."""
    return with_position(df, row_id, "_position").select(
        *df.columns, F.floor(F.col("_position") / size).cast("long").alias("batch_id")
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def combine(left: DataFrame, right: DataFrame, constants: dict[str, str] | None = None) -> DataFrame:
    """Concatenate frames whose columns differ; ``constants`` are added to the right one."""
    right = right.withColumns({c: F.lit(v) for c, v in (constants or {}).items()})
    return left.unionByName(right, allowMissingColumns=True)


def union_ids(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def next_batch(df: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """The first ``size`` unprocessed rows."""
    return unprocessed(df, done, key).orderBy(key).limit(size)


def progress_counts(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Total, processed and remaining rows as one row."""
    marked = df.select(key).join(
        done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left"
    )
    return marked.agg(
        F.count("*").alias("total"),
        F.count("_done").alias("processed"),
        (F.count("*") - F.count("_done")).alias("remaining"),
    )


def sample_n(df: DataFrame, n: int, key: Column | str | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows: the same ones each time with a key, else any."""
    if key is None:
        return df.orderBy(F.rand(seed)).limit(n)
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(hash_hex(seed, key), key).limit(n)


def quarantine(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``error``: the name of the first failed check, null for a good row.

    A row that cannot be processed keeps its place and its reason instead of
    being dropped or marked as done.
    """
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return df.withColumn("error", F.coalesce(*failed))
