"""Taxonomy edges, texts and the level-by-level descent."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import LEVELS
from shelfwise.functions.codes import path_key
from shelfwise.functions.text import drop_repeated_words, join_non_empty, resolve_label
from shelfwise.session import stored

ROOT = ""


def edges(taxonomy: DataFrame, titles: Sequence[str], row_id: str) -> DataFrame:
    """``(level, parent_path, label, first_row)``; a null title ends its path."""
    steps = []
    for depth, title in enumerate(titles):
        parent = path_key(*titles[:depth]) if depth else F.lit(ROOT)
        step = F.struct(
            F.lit(depth + 1).alias("level"), parent.alias("parent_path"), F.col(title).alias("label")
        )
        steps.append(F.when(parent.isNotNull() & F.col(title).isNotNull(), step))
    return (
        taxonomy.select(F.col(row_id).alias("_row"), F.explode(F.array(*steps)).alias("e"))
        .where(F.col("e").isNotNull())
        .groupBy("e.level", "e.parent_path", "e.label")
        .agg(F.min("_row").alias("first_row"))
    )


def children(edge_table: DataFrame) -> DataFrame:
    """``(level, parent_path, labels)``, labels in order of first appearance.

    A row holds the distinct children of one node, never its products. The table
    is stored: each level of a descent, and each batch of a stream, reads it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("first_row", "label")))
    kids = edge_table.groupBy("level", "parent_path").agg(
        F.transform(ordered, lambda e: e["label"]).alias("labels")
    )
    return stored(kids, "children")


def sizes(edge_table: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Number of nodes per level."""
    names = F.element_at(F.array(*[F.lit(v) for v in levels]), F.col("level"))
    return (
        edge_table.groupBy("level").agg(F.count("*").alias("n_nodes")).select(names.alias("level"), "n_nodes")
    )


def taxonomy_text(
    taxonomy: DataFrame,
    titles: tuple[str, str, str, str],
    includes: str,
    excludes: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Class name from the four titles, without repeated words, and description.

    A missing segment or brick reads as empty; a missing family or class gives
    a null name.
    """
    segment, family, cls, brick = titles
    name = F.concat(
        F.coalesce(F.col(segment), F.lit("")),
        F.lit(" "),
        F.col(family),
        F.lit(" "),
        F.col(cls),
        F.lit(" "),
        F.coalesce(F.col(brick), F.lit("")),
    )
    return taxonomy.select(
        *keep,
        name.alias("class_name"),
        drop_repeated_words(name).alias("class_name_cleaned"),
        join_non_empty(includes, excludes).alias("description"),
    )


Choice = Callable[[int, Column], Column]


def _descend(items: DataFrame, kids: DataFrame, choose: Choice, levels: Sequence[str]) -> DataFrame:
    """Choose a label among the children of the node reached, level by level.

    An item meets one row per level, the children of its node, so it is compared
    with those alone. The root is a value, not a join: all items share it.
    """
    root = kids.where((F.col("level") == 1) & (F.col("parent_path") == ROOT)).select("labels").scalar()
    current = items.withColumn("_labels", root)
    for depth, level in enumerate(levels):
        if depth:
            at_level = kids.where(F.col("level") == depth + 1).select(
                F.col("parent_path").alias("_path"), F.col("labels").alias("_labels")
            )
            current = current.drop("_labels").join(at_level, "_path", "left")
        chosen = F.when(F.size("_labels") > 0, choose(depth, F.col("_labels")))
        predicted = f"predicted_{level}"
        current = current.withColumn(predicted, F.coalesce(chosen, F.lit("")))
        reached = F.col(predicted)
        path = reached if depth == 0 else path_key("_path", predicted)
        current = current.withColumn("_path", F.when(reached != "", path))
    return current.drop("_labels", "_path")


def descend_answers(
    items: DataFrame, answers: Sequence[str], kids: DataFrame, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Descent by free-text answers, one column per level."""
    return _descend(items, kids, lambda d, labels: resolve_label(answers[d], labels)["label"], levels)


def answers_wide(answers: DataFrame, item: str, level: str, raw: str, n_levels: int = 4) -> DataFrame:
    """``(item, level, raw)`` rows to one row per item with ``raw_1`` ... ``raw_n``."""
    picked = answers.groupBy(item).pivot(level, list(range(1, n_levels + 1))).agg(F.min(raw))
    return picked.withColumnsRenamed({str(i): f"raw_{i}" for i in range(1, n_levels + 1)})


def descend_scores(
    items: DataFrame,
    score: Callable[[Column], Column],
    kids: DataFrame,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """Descent to the child with the highest score, ties to the first child.

    ``score`` gives the score of a label Column against the row's own columns.
    """

    def choose(_: int, labels: Column) -> Column:
        scored = F.transform(
            labels, lambda label, at: F.struct(score(label).alias("s"), (-at).alias("at"), label.alias("label"))
        )
        return F.array_max(scored)["label"]

    return _descend(items, kids, choose, levels)


def result_views(df: DataFrame, key: str, levels: Sequence[str] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The full result and its clean view: name and predictions only."""
    return df, df.select(key, *[f"predicted_{v}" for v in levels])
