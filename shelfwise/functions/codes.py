"""Small codes: catalog type names, stable draws, path keys, run stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.fixed_values import PATH_SEPARATOR, RUN_STAMP_FORMAT


def type_name(code: Column, length: Column, digits: Column, scale: Column) -> Column:
    """SQL type text for a warehouse type code; an unknown code passes through."""
    code = F.trim(code)
    return (
        F.when(code == "CV", F.format_string("VARCHAR(%s)", length))
        .when(code == "CF", F.format_string("CHAR(%s)", length))
        .when(code == "D", F.lit("DATE"))
        .when(code == "I", F.lit("INTEGER"))
        .when(code == "F", F.format_string("DECIMAL(%s, %s)", digits, scale))
        .when(code == "BO", F.lit("BLOB"))
        .otherwise(code)
    )


def path_key(*titles: Column | str) -> Column:
    """Taxonomy path; null when any title is."""
    first, *rest = [F.col(t) if isinstance(t, str) else t for t in titles]
    parts = [first]
    for title in rest:
        parts += [F.lit(PATH_SEPARATOR), title]
    return F.concat(*parts)


def hash_hex(seed: int | str, key: Column) -> Column:
    """Hash of a key that is the same on every run, engine and retry."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_unit(seed: int | str, key: Column) -> Column:
    """Uniform draw in [0, 1) that depends on the key alone.

    ``rand`` depends on partition order, so a retried task could draw anew.
    """
    return F.conv(F.substring(hash_hex(seed, key), 1, 8), 16, 10).cast("double") / float(2**32)


def run_stamp(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, RUN_STAMP_FORMAT)
