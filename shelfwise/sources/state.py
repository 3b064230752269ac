"""State and property records kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROGRESS_SCHEMA = "processed_ids array<bigint>, last_updated string, total_processed bigint"


def parse_json(c: Column | str, schema: str) -> Column:
    """Typed record; malformed text gives null fields."""
    return F.from_json(c, schema)


def render_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def processed_ids(states: DataFrame, column: str = "value") -> DataFrame:
    """Ids of progress records (text), one row each."""
    record = parse_json(column, PROGRESS_SCHEMA)
    return states.select(F.explode(record["processed_ids"]).alias("id")).distinct()
