"""Text functions over the whole texts of documents and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    SP,
    TAXONOMY_SQL,
    TITLES,
    W,
    joined,
    query,
    sql_collapse,
    sql_grams,
    sql_match_key,
    sql_prep,
    sql_resolve,
    sql_resolve_kind,
    sql_strip,
    sql_tokens,
    sql_words,
    sub,
    table,
    taxonomy,
)
from checks.tables import sql_clean_space
from shelfwise.fixed_values import PROMPT_LABELS_SLOT, PROMPT_NAME_SLOT
from shelfwise.functions import text as tx
from shelfwise.functions.tokens import ngrams, tokenize
from shelfwise.operators import lookup, taxonomy as tree

STRINGS = ["red", "bolt", "e"]
STOPWORDS = ["the", "and", "of", "la", "de", "und", "der", "can", "in"]


def over_documents(name, fn, sql):
    """A text function over ``documents.text``; ``sql`` is its twin, if any."""
    oracle = f"SELECT doc_id, {sql} AS cleaned FROM documents" if sql else None

    @query(name, oracle)
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", fn(F.col("text")).alias("cleaned"))


STRIP_DIGITS = sub(sql_collapse("text"), r"\p{Nd}+", "")
STRIP_PUNCT = f"trim({sub('text', f'[^{W}]+', ' ')})"
CLEAN_TEXT = f"lower({sql_collapse(sub(STRIP_PUNCT, chr(92) + 'p{Nd}+', ''))})"

over_documents("clean_delete", tx.clean_delete, f"lower(trim({sub('text', '[[:digit:][:punct:]]+', '')}))")
over_documents("clean_space", tx.clean_space, sql_clean_space("text"))
over_documents(
    "clean_class",
    tx.clean_class,
    f"lower(trim({sub(sub('text', f'[^{W}{SP}]', ' '), '[-_/|]', ' ')}))",
)
over_documents(
    "unicode_clean", tx.unicode_clean, sql_strip(sub("nfc_normalize(text)", r"\p{C}", ""))
)
over_documents(
    "dedup_words",
    tx.drop_repeated_words,
    f"(SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest({sql_words('text')}) AS w,"
    f" generate_subscripts({sql_words('text')}, 1) AS i) GROUP BY w))",
)
over_documents("strip_digits", tx.strip_digits, STRIP_DIGITS)
over_documents(
    "drop_digit_tokens",
    tx.drop_digit_words,
    f"array_to_string(list_filter({sql_words('text')}, lambda w: NOT regexp_matches(w, '\\p{{Nd}}')), ' ')",
)
over_documents(
    "strip_stopwords",
    lambda c: tx.strip_stopwords(c, STOPWORDS),
    f"array_to_string(list_filter({sql_words('text')}, lambda w: NOT list_contains({STOPWORDS}, w) OR w = 'can'), ' ')",
)
over_documents("strip_punct", tx.strip_punctuation, STRIP_PUNCT)
over_documents("strip_separators", tx.strip_separators, f"lower({sql_collapse(sub('text', '[-_/|' + chr(92) * 2 + ']', ' '))})")
over_documents("collapse_ws", tx.collapse_spaces, sql_collapse("text"))
over_documents("clean_text", tx.clean_text, CLEAN_TEXT)
over_documents("match_key", tx.match_key, sql_match_key("text"))
over_documents("prep_ascii", tx.prep_ascii, f"coalesce(trim({sub('lower(text)', '[^a-z0-9]+', ' ')}), '')")
over_documents(
    "prep_symbols", tx.prep_symbols, f"coalesce(trim({sub('lower(text)', '[^a-z0-9+/.-]+', ' ')}), '')"
)
over_documents("prep_model_text", tx.prep_model_text, sql_prep("text"))
over_documents(
    "prefix_text", lambda c: tx.prefix_text(c, "passage: {text}"), "'passage: ' || text"
)
over_documents("tokenize", lambda c: joined(tokenize(c)), f"array_to_string({sql_tokens('text')}, '|')")
over_documents(
    "ngrams",
    lambda c: joined(ngrams(tokenize(c), 1, 3)),
    f"(SELECT array_to_string({sql_grams('t', 3)}, '|') FROM (SELECT {sql_tokens('text')} AS t))",
)


@query(
    "strip_brand",
    """WITH b AS (SELECT DISTINCT p_brand AS brand FROM part),
    t AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_brand AS title FROM part),
    m AS (SELECT p_partkey, arg_min(brand, (-length(brand), brand)) AS brand
          FROM t JOIN b ON contains(title, brand) GROUP BY p_partkey)
    SELECT p_partkey, replace(title, coalesce(brand, chr(1)), '') AS cleaned FROM t LEFT JOIN m USING (p_partkey)""",
)
def strip_brand(spark, sf):
    part = table(spark, sf, "part")
    title = F.concat_ws(" ", "p_brand", "p_name", "p_brand")
    titled = part.select("p_partkey", title.alias("title"))
    return lookup.strip_brand_join(titled, "p_partkey", "title", part, "p_brand").select(
        "p_partkey", F.col("stripped").alias("cleaned")
    )


@query(
    "strip_brand_join",
    """WITH b AS (SELECT DISTINCT p_type AS brand FROM part),
    t AS (SELECT p_partkey, lower(p_brand) || p_type || p_name AS title FROM part),
    m AS (SELECT p_partkey, arg_min(brand, (-length(brand), brand)) AS brand
          FROM t JOIN b ON contains(title, brand) GROUP BY p_partkey)
    SELECT p_partkey, replace(title, coalesce(brand, chr(1)), '') AS cleaned FROM t LEFT JOIN m USING (p_partkey)""",
)
def strip_brand_join(spark, sf):
    part = table(spark, sf, "part")
    titles = part.select("p_partkey", F.concat(F.lower("p_brand"), "p_type", "p_name").alias("title"))
    return lookup.strip_brand_join(titles, "p_partkey", "title", part, "p_type").select(
        "p_partkey", F.col("stripped").alias("cleaned")
    )


@query(
    "strip_strings",
    "SELECT p_partkey, replace(replace(replace(p_name, 'red', ''), 'bolt', ''), 'e', '') AS cleaned FROM part",
)
def strip_strings(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.strip_strings("p_name", STRINGS).alias("cleaned"))


@query(
    "join_non_empty",
    f"""SELECT doc_id, concat_ws(' ', nullif({sql_strip('lang')}, ''), nullif({sql_strip('quality::VARCHAR')}, ''),
    nullif({sql_strip('source')}, '')) AS joined FROM documents LEFT JOIN labels USING (doc_id)""",
)
def join_non_empty(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source")
    both = documents.join(table(spark, sf, "labels"), "doc_id", "left")
    return both.select("doc_id", tx.join_non_empty("lang", "quality", "source").alias("joined"))


@query(
    "taxonomy_text",
    f"""SELECT row_id, SegmentTitle || ' ' || FamilyTitle || ' ' || ClassTitle || ' ' || BrickTitle AS class_name,
    array_to_string(list_filter([SegmentTitle, FamilyTitle, ClassTitle,
      CASE WHEN BrickTitle <> ClassTitle THEN BrickTitle ELSE '' END], lambda w: w <> ''), ' ') AS class_name_cleaned,
    concat_ws(' ', nullif(trim(SegmentTitle), ''), nullif(trim(p_size::VARCHAR), '')) AS description
    FROM ({TAXONOMY_SQL}) JOIN part ON row_id = p_partkey""",
)
def taxonomy_text(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_size")
    rows = taxonomy(spark, sf).join(sizes, "row_id")
    return tree.taxonomy_text(rows, TITLES, "SegmentTitle", "p_size", keep=["row_id"])


TEMPLATE = f"Product: {PROMPT_NAME_SLOT}\nLabels:\n{PROMPT_LABELS_SLOT}\nAnswer:"


@query(
    "render_prompt",
    f"""WITH k AS (SELECT SegmentTitle, string_agg(FamilyTitle, chr(10) ORDER BY first_row) AS labels FROM
      (SELECT SegmentTitle, FamilyTitle, min(row_id) AS first_row FROM ({TAXONOMY_SQL}) GROUP BY ALL) GROUP BY 1)
    SELECT p_partkey, 'Product: ' || p_name || chr(10) || 'Labels:' || chr(10) || labels || chr(10) || 'Answer:' AS prompt
    FROM part JOIN k ON p_type = SegmentTitle""",
)
def render_prompt(spark, sf):
    kids = tree.children(tree.edges(taxonomy(spark, sf), TITLES, "row_id")).where("level = 2")
    part = table(spark, sf, "part").join(kids, F.col("p_type") == F.col("parent_path"))
    return part.select("p_partkey", tx.render_prompt(TEMPLATE, F.col("p_name"), F.col("labels")).alias("prompt"))


ANSWER_SQL = """CASE WHEN p_size <= 10 THEN '```' || chr(10) || p_brand || chr(10) || '```'
 WHEN p_size <= 20 THEN 'I choose ' || upper(p_brand) || '.'
 WHEN p_size <= 30 THEN '  Sure:' || chr(10) || '  ' || p_brand || '  '
 WHEN p_size <= 40 THEN '``` ' || p_name WHEN p_size <= 45 THEN '' WHEN p_size = 46 THEN NULL ELSE ' ' || chr(10) || ' ' END"""


def answer():
    """Free-text answers derived from a part's own columns."""
    return F.expr(ANSWER_SQL)


@query(
    "resolve_label",
    f"""WITH k AS (SELECT SegmentTitle, list(FamilyTitle ORDER BY first_row) AS labels FROM
      (SELECT SegmentTitle, FamilyTitle, min(row_id) AS first_row FROM ({TAXONOMY_SQL}) GROUP BY ALL) GROUP BY 1),
    a AS (SELECT p_partkey, p_type, {ANSWER_SQL} AS answer FROM part)
    SELECT p_partkey, {sql_resolve('answer', 'labels')} AS label, {sql_resolve_kind('answer', 'labels')} AS match_kind
    FROM a JOIN k ON p_type = SegmentTitle""",
)
def resolve_label(spark, sf):
    kids = tree.children(tree.edges(taxonomy(spark, sf), TITLES, "row_id")).where("level = 2")
    part = table(spark, sf, "part").withColumn("answer", answer())
    resolved = part.join(kids, F.col("p_type") == F.col("parent_path")).select(
        "p_partkey", tx.resolve_label("answer", "labels").alias("r")
    )
    return resolved.select("p_partkey", "r.label", "r.match_kind")

