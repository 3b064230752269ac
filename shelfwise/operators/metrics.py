"""Confusion counts, per-class and overall scores.

Every figure derives from the counts per (actual, predicted) pair; that
aggregate is the only one that sees the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, actual, predicted, n)`` over the rows that have both labels."""
    return (
        df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_metrics(
    df: DataFrame,
    actual: str,
    predicted: str,
    labels: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a ratio is undefined.

    ``labels`` (one column ``label``) fixes the list of reported labels.
    """
    n = F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), hit.alias("tp"), n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")),
    )
    counts = (
        confusion(df, actual, predicted, by)
        .select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    if labels is not None:
        wanted = labels.crossJoin(counts.select(*by).distinct()) if by else labels
        counts = wanted.join(counts, [*by, "label"], "left").na.fill(0, ["tp", "support", "predicted"])
    tp, support, predicted_n = F.col("tp"), F.col("support"), F.col("predicted")
    return counts.select(
        *by,
        "label",
        "tp",
        "support",
        "predicted",
        _ratio(tp, predicted_n).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted_n).alias("f1"),
    )


def overall_metrics(
    df: DataFrame, actual: str, predicted: str, labels: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and the micro, macro and weighted averages, one row per group."""
    per_class = class_metrics(df, actual, predicted, labels, by)
    tp, support, predicted_n = F.sum("tp"), F.sum("support"), F.sum("predicted")
    weighted = {
        f"weighted_{m}": _ratio(F.sum(F.col("support") * F.col(m)), support)
        for m in ("precision", "recall", "f1")
    }
    figures = {
        "n_rows": support,
        "accuracy": _ratio(tp, support),
        "micro_precision": _ratio(tp, predicted_n),
        "micro_recall": _ratio(tp, support),
        "micro_f1": _ratio(2 * tp, support + predicted_n),
        "macro_precision": F.avg("precision"),
        "macro_recall": F.avg("recall"),
        "macro_f1": F.avg("f1"),
        **weighted,
    }
    return per_class.groupBy(*by).agg(*[c.alias(name) for name, c in figures.items()])


def weighted_f1(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 per label averaged by support; 0 where undefined."""
    return overall_metrics(df, actual, predicted, by=by).select(*by, "weighted_f1")


def long_levels(
    df: DataFrame, dataset: str, levels: dict[str, tuple[str, str]]
) -> DataFrame:
    """One row per level from ``{level: (actual column, predicted column)}``."""
    cells = [
        F.struct(F.lit(level).alias("level"), F.col(a).alias("actual"), F.col(p).alias("predicted"))
        for level, (a, p) in levels.items()
    ]
    return df.select(F.lit(dataset).alias("dataset"), F.inline(F.array(*cells)))


def f1_by_level(frames: Sequence[DataFrame], not_in_mean: Sequence[str] = ()) -> DataFrame:
    """Weighted F1 per dataset and level of ``long_levels`` frames.

    ``dataset_f1`` is the mean over a dataset's levels, ``mean_f1`` the mean over
    the datasets but those of ``not_in_mean``. The means are windows over the result,
    a row per dataset and level, so the frames are read once.
    """
    rows = reduce(lambda a, b: a.unionByName(b), frames)
    per_level = weighted_f1(rows, "actual", "predicted", ["dataset", "level"])
    own = Window.partitionBy("dataset")
    per_set = per_level.withColumns(
        {"dataset_f1": F.avg("weighted_f1").over(own), "_n": F.count("*").over(own)}
    )
    counted = F.when(F.col("dataset").isin(list(not_in_mean)), 0.0).otherwise(1.0) / F.col("_n")
    everything = Window.partitionBy()
    mean = F.sum(F.col("dataset_f1") * counted).over(everything) / F.sum(counted).over(everything)
    return per_set.withColumn("mean_f1", mean).drop("_n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)``: ``(label, n, weight)``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    share = totals.select(F.col("rows") / F.col("classes")).scalar()
    return counts.withColumn("weight", share / F.col("n"))


def classes_per_level(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct classes per level and whether a model can be trained at all."""
    counted = df.agg(*[F.count_distinct(level).alias(level) for level in levels])
    cells = [F.struct(F.lit(v).alias("level"), F.col(v).alias("n_classes")) for v in levels]
    return counted.select(F.inline(F.array(*cells))).withColumn("is_constant", F.col("n_classes") < 2)


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, as one row."""
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
