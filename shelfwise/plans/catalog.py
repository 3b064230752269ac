"""Catalog flows: loading, cleaning, mapping and combining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import TAXONOMY_COLUMNS_CLEANED, TAXONOMY_COLUMNS_DROPPED
from shelfwise.functions.text import clean_space, unicode_clean
from shelfwise.operators.lookup import map_codes, unmapped_codes
from shelfwise.operators.rows import cast_all_string, combine, dedup_keep_first, drop_nulls


def load_products(df: DataFrame, title: str, row_id: str) -> DataFrame:
    """``(id, product_name)``: first row per title, no null titles, Unicode-cleaned.

    Titles are compared before cleaning, and the id is the original row number.
    """
    named = df.select(F.col(row_id).alias("id"), F.col(title).alias("product_name"))
    first = dedup_keep_first(drop_nulls(named, ["product_name"]), ["product_name"], "id")
    return first.select("id", unicode_clean("product_name").alias("product_name"))


def actual_classes(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Truth per row, nulls kept."""
    return df.select(F.col(row_id).alias("product_id"), F.col(label).alias("class_name"))


def load_taxonomy(df: DataFrame, row_id: str) -> DataFrame:
    """Distinct rows as text with the number of their first occurrence as ``id``."""
    columns = [c for c in df.columns if c != row_id]
    distinct = df.groupBy(*columns).agg(F.min(row_id).alias("id"))
    return cast_all_string(distinct.select("id", *columns)).withColumn("id", F.col("id").cast("long"))


def clean_columns(df: DataFrame, columns: Sequence[str], clean=clean_space) -> DataFrame:
    """Rewrite columns with a cleaning function; the result goes to a new table."""
    return df.withColumns({c: clean(c) for c in columns})


def prepare_taxonomy(
    df: DataFrame,
    drop: Sequence[str] = TAXONOMY_COLUMNS_DROPPED,
    clean: Sequence[str] = TAXONOMY_COLUMNS_CLEANED,
) -> DataFrame:
    """Drop the code and attribute columns, clean titles and definitions."""
    return clean_columns(df.drop(*drop), clean)


def map_products(
    products: DataFrame,
    catalog: DataFrame,
    product_code: str,
    catalog_code: str,
    name: str,
    titles: Sequence[str],
    row_id: str,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Mapped products (name and titles) and the report of unmapped codes."""
    mapped = map_codes(products, catalog, product_code, catalog_code, list(titles), row_id)
    return (
        mapped.select(*keep, F.col(name).alias("Name"), *titles),
        unmapped_codes(products, catalog, product_code, catalog_code),
    )


def combine_sources(mapped: DataFrame, other: DataFrame, leaf: str = "BrickTitle") -> DataFrame:
    """Mapped products followed by a source without the leaf level."""
    return combine(mapped, other, {leaf: ""})
