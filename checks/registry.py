"""Registry of queries and helpers shared by their wiring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin if it has one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


def joined(array) -> F.Column:
    return F.array_join(array, "|")


# --- stand-in for taxonomy rows: part -----------------------------------------

TITLES = ("SegmentTitle", "FamilyTitle", "ClassTitle", "BrickTitle")


def word(c: str, n: int):
    return F.split_part(F.col(c), F.lit(" "), F.lit(n))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, SegmentTitle, FamilyTitle, ClassTitle, BrickTitle)``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_type").alias("SegmentTitle"),
        F.col("p_brand").alias("FamilyTitle"),
        word("p_name", 1).alias("ClassTitle"),
        word("p_name", 2).alias("BrickTitle"),
    )


TAXONOMY_SQL = """SELECT p_partkey AS row_id, p_type AS SegmentTitle, p_brand AS FamilyTitle,
  split_part(p_name, ' ', 1) AS ClassTitle, split_part(p_name, ' ', 2) AS BrickTitle FROM part"""

# --- SQL spellings of the text functions -----------------------------------------

SP = r"\t\n\x0b\f\r\x1c-\x20\x{85}\p{Z}"
W = r"\p{L}\p{N}_"


def sub(c: str, pattern: str, to: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def sql_collapse(c: str) -> str:
    return f"trim({sub(c, f'[{SP}]+', ' ')})"


def sql_strip(c: str) -> str:
    return sub(c, f"^[{SP}]+|[{SP}]+$", "")


def sql_words(c: str) -> str:
    return f"list_filter(string_split({sql_collapse(c)}, ' '), lambda w: w <> '')"


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[{W}]{{2,}}')"


def sql_prep(c: str) -> str:
    return sql_collapse(f"lower(coalesce({c}, ''))")


def sql_match_key(c: str) -> str:
    spelled = f"replace(replace(lower({c}), '&', 'and'), '+', 'and')"
    return f"coalesce({sql_collapse(sub(f'''translate({spelled}, '/-_', '   ')''', f'[^{W}{SP}]', ''))}, '')"


def sql_grams(tokens: str, high: int) -> str:
    """List of 1- to ``high``-grams of a list column."""
    parts = [tokens]
    for n in range(2, high + 1):
        chain = " || ' ' || ".join(f"{tokens}[i + {k}]" for k in range(n))
        parts.append(f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {chain})")
    return parts[0] if high == 1 else f"list_concat({', '.join(parts)})"


def sql_postings(source: str, doc: str, text: str, keep: Sequence[str] = (), high: int = 2) -> str:
    """CTEs ``toks`` and ``p(doc, *keep, term, tf)``."""
    k = "".join(f", {c}" for c in keep)
    return f"""toks AS (SELECT {doc}{k}, {sql_tokens(sql_prep(text))} AS t FROM {source}),
grams AS (SELECT {doc}{k}, unnest({sql_grams('t', high)}) AS term FROM toks),
p AS (SELECT {doc}{k}, term, count(*) AS tf FROM grams GROUP BY ALL)"""


def sql_resolve(answer: str, labels: str) -> str:
    """The label a free-text answer stands for."""
    lines = f"list_filter(list_transform(string_split({answer}, chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')"
    bare = f"list_transform({lines}, lambda s: {sql_strip('''replace(s, '```', '')''')})"
    exact = f"list_filter({bare}, lambda s: list_contains({labels}, s))[1]"
    inside = f"list_filter({labels}, lambda s: contains(lower({answer}), lower(s)))[1]"
    first = f"coalesce({labels}[1], '')"
    return (
        f"CASE WHEN {answer} IS NULL OR {answer} = '' THEN {first} "
        f"ELSE coalesce({exact}, {inside}, ({bare})[1], {first}) END"
    )


def sql_resolve_kind(answer: str, labels: str) -> str:
    lines = f"list_filter(list_transform(string_split({answer}, chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')"
    bare = f"list_transform({lines}, lambda s: {sql_strip('''replace(s, '```', '')''')})"
    return (
        f"CASE WHEN {answer} IS NULL OR {answer} = '' THEN 'empty' "
        f"WHEN len(list_filter({bare}, lambda s: list_contains({labels}, s))) > 0 THEN 'exact' "
        f"WHEN len(list_filter({labels}, lambda s: contains(lower({answer}), lower(s)))) > 0 THEN 'contained' "
        f"WHEN len({bare}) > 0 THEN 'first_line' ELSE 'empty' END"
    )
