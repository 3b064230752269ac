"""Validation of predicted paths against the taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import LEVELS
from shelfwise.functions.text import match_key, strip
from shelfwise.session import stored

UPPER = LEVELS[:3]
MISMATCH_SAMPLES = 5


def _clean(c: str) -> Column:
    return F.coalesce(strip(F.col(c).cast("string")), F.lit(""))


def brick_paths(taxonomy: DataFrame, titles: Sequence[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """First path per brick title, and first path per brick match key."""
    segment, family, cls, brick = titles
    path = F.struct(*[_clean(t).alias(level) for level, t in zip(UPPER, (segment, family, cls))])
    exact = stored(
        taxonomy.where(F.col(brick).isNotNull())
        .groupBy(_clean(brick).alias("brick"))
        .agg(F.min_by(path, row_id).alias("exact_path"), F.min(row_id).alias("first_row")),
        "bricks",
    )
    by_key = exact.groupBy(match_key("brick").alias("brick_key")).agg(
        F.min_by("exact_path", "first_row").alias("key_path")
    )
    return exact.select("brick", "exact_path"), by_key


def check_paths(
    predictions: DataFrame,
    predicted: Sequence[str],
    taxonomy: DataFrame,
    titles: Sequence[str],
    row_id: str,
) -> DataFrame:
    """Add ``match_type``, the taxonomy's titles and a flag per level.

    A brick is looked up by its title, else by its match key; the upper three
    levels are then compared on match keys.
    """
    exact, by_key = brick_paths(taxonomy, titles, row_id)
    brick = predicted[3]
    found = (
        predictions.withColumns({"brick": _clean(brick), "brick_key": match_key(_clean(brick))})
        .join(exact, "brick", "left")
        .join(by_key, "brick_key", "left")
        .withColumn("_path", F.coalesce("exact_path", "key_path"))
    )
    match_type = (
        F.when(F.col("exact_path").isNotNull(), "exact")
        .when(F.col("key_path").isNotNull(), "normalized")
        .otherwise("missing")
    )
    known = F.col("_path").isNotNull()
    flags = {
        f"{level}_match": known
        & F.coalesce(match_key(_clean(p)) == match_key(F.col(f"_path.{level}")), F.lit(False))
        for level, p in zip(UPPER, predicted)
    }
    titles_found = {f"taxonomy_{level}": F.col(f"_path.{level}") for level in UPPER}
    checked = found.withColumns({"match_type": match_type, **titles_found, **flags})
    all_match = F.col("segment_match") & F.col("family_match") & F.col("class_match")
    return checked.withColumn("all_match", all_match).drop(
        "brick", "brick_key", "exact_path", "key_path", "_path"
    )


def valid_rows(checked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose whole path holds, with the input's columns."""
    return checked.where("all_match").select(*columns)


def validation_stats(checked: DataFrame) -> DataFrame:
    """The counters and their percentages as one row; null where nothing was counted."""

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    kind = F.col("match_type")
    counts = checked.agg(
        F.count("*").alias("total_rows"),
        n(kind == "exact").alias("brick_found_exact"),
        n(kind == "normalized").alias("brick_found_normalized"),
        n(kind == "missing").alias("brick_not_found"),
        n(F.col("segment_match")).alias("segment_match"),
        n(F.col("family_match")).alias("family_match"),
        n(F.col("class_match")).alias("class_match"),
        n(F.col("all_match")).alias("all_match"),
    )

    def percent(part: Column, whole: Column) -> Column:
        return F.round(F.try_divide(part * 100.0, whole.cast("double")), 1)

    total = F.col("total_rows")
    bricks = F.col("brick_found_exact") + F.col("brick_found_normalized")
    of_total = ("brick_found_exact", "brick_found_normalized", "brick_not_found")
    of_found = ("segment_match", "family_match", "class_match", "all_match")
    return counts.select(
        *counts.columns,
        bricks.alias("brick_found"),
        percent(bricks, total).alias("brick_found_pct"),
        *[percent(F.col(c), total).alias(f"{c}_pct") for c in of_total],
        *[percent(F.col(c), bricks).alias(f"{c}_pct") for c in of_found],
        percent(F.col("all_match"), total).alias("valid_pct"),
    )


def mismatch_samples(checked: DataFrame, row_id: str, n: int = MISMATCH_SAMPLES) -> DataFrame:
    """The first ``n`` rows with a known brick and a wrong upper level."""
    wrong = (F.col("match_type") != "missing") & ~F.col("all_match")
    return checked.where(wrong).orderBy(row_id).limit(n)
