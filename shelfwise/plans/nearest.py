"""The embedding flow: nearest class, report and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.metrics import weighted_f1
from shelfwise.operators.nearest import nearest_classes
from shelfwise.operators.rows import drop_nulls


def nearest_class(items: DataFrame, classes: DataFrame, item_id: str, class_id: str, vector: str) -> DataFrame:
    """``(item_id, closest_category_id, cosine_distance)``."""
    best = nearest_classes(items, classes, item_id, class_id, vector)
    return best.select(
        "item_id",
        F.col("class_id").alias("closest_category_id"),
        F.col("distance").alias("cosine_distance"),
    )


def results(scored: DataFrame, products: DataFrame, classes: DataFrame, actual: DataFrame) -> DataFrame:
    """``(product_id, product_name, predicted_class, actual_class, similarity_score)``.

    ``products(id, product_name)`` and ``actual(product_id, class_name)`` join on
    the item first and share its partitioning; the classes come last.
    """
    truth = actual.select("product_id", F.col("class_name").alias("actual_class"))
    names = classes.select(
        F.col("class_id").alias("closest_category_id"), F.col("class_name").alias("predicted_class")
    )
    return (
        scored.withColumnRenamed("item_id", "product_id")
        .join(products.withColumnRenamed("id", "product_id"), "product_id")
        .join(truth, "product_id")
        .join(names, "closest_category_id")
        .select(
            "product_id",
            "product_name",
            "predicted_class",
            "actual_class",
            F.col("cosine_distance").alias("similarity_score"),
        )
    )


def score(reported: DataFrame) -> DataFrame:
    """Weighted F1 over the rows without nulls."""
    return weighted_f1(drop_nulls(reported), "actual_class", "predicted_class")
