"""Sources, sinks, schema changes, joins, dedup, numbering, unions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import (
    TABLES,
    TAXONOMY_SQL,
    TITLES,
    query,
    r6,
    sql_collapse,
    sub,
    table,
    taxonomy,
    word,
)
from shelfwise.fixed_values import CLASS_NAMES_AR, LABELLING_BATCH, UPLOAD_BATCH
from shelfwise.functions import codes, vectors
from shelfwise.functions.text import prep_model_text
from shelfwise.operators import lookup, metrics, rows
from shelfwise.plans import catalog
from shelfwise.session import new_path
from shelfwise.sources import state, tables
from shelfwise.sources.versions import VersionedTable

PART_SCHEMA = (
    "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
)

# --- scans, sources, sinks ---------------------------------------------------------


@query("scan_csv", "SELECT * FROM part")
def scan_csv(spark, sf):
    path = new_path(spark, "scan_csv")
    tables.write_csv(table(spark, sf, "part"), path)
    return tables.read_csv(spark, path, PART_SCHEMA)


@query("scan_csv_semicolon", "SELECT p_partkey, p_name, p_brand FROM part")
def scan_csv_semicolon(spark, sf):
    path = new_path(spark, "scan_csv_semicolon")
    tables.write_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), path, sep=";")
    return tables.read_csv(spark, path, "p_partkey bigint, p_name string, p_brand string", sep=";")


@query(
    "load_by_ext",
    "SELECT ext, p_partkey, p_name, p_size FROM part, (VALUES ('csv'), ('parquet'), ('json'), ('orc')) AS e(ext)",
)
def load_by_ext(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    base, frames = new_path(spark, "load_by_ext"), []
    for ext in ("csv", "parquet", "json", "orc"):
        part.write.format(ext).option("header", True).save(f"{base}/part.{ext}")
        frames.append(
            tables.load_table(spark, f"{base}/part.{ext}", part.schema).select(F.lit(ext).alias("ext"), "*")
        )
    return rows.union_all(*frames)


@query("scan_table", "SELECT p_partkey, p_name FROM part")
def scan_table(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("shelfwise_part")
    return tables.scan_table(spark, "shelfwise_part").select("p_partkey", "p_name")


@query("sql_select_all", "SELECT * FROM customer")
def sql_select_all(spark, sf):
    return tables.run_sql(spark, "SELECT * FROM {customer}", customer=table(spark, sf, "customer"))


@query("sink_replace", "SELECT p_partkey, upper(p_name) AS p_name, p_size FROM part")
def sink_replace(spark, sf):
    """A table is replaced by what is read from it."""
    versions = VersionedTable(spark, new_path(spark, "sink_replace"))
    versions.replace(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    versions.replace(versions.read().withColumn("p_name", F.upper("p_name")))
    return versions.read()


@query("sink_append", "SELECT * FROM part")
def sink_append(spark, sf):
    """Batches under a key: one that is written again adds nothing."""
    versions = VersionedTable(spark, new_path(spark, "sink_append"))
    part = table(spark, sf, "part")
    for low, high in ((0, 25), (25, 40), (25, 40), (40, 1_000)):
        versions.append(part.where((F.col("p_size") > low) & (F.col("p_size") <= high)), key=f"size {low}")
    return versions.read()


@query("insert_select", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def insert_select(spark, sf):
    """The result of a query appended to a catalog table, columns matched by name."""
    path, name = new_path(spark, "insert_select"), f"insert_select_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (p_partkey BIGINT, p_name STRING, p_size INT) USING parquet LOCATION '{path}'")
    part = table(spark, sf, "part")
    tables.insert_into(part.where("p_size > 25").select("p_size", "p_name", "p_partkey"), name)
    tables.insert_into(part.where("p_size > 10 AND p_size <= 25").select("p_name", "p_partkey", "p_size"), name)
    spark.sql(f"DROP TABLE {name}")  # the rows stay in their folder
    return spark.read.parquet(path)


@query("sink_csv", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def sink_csv(spark, sf):
    path = new_path(spark, "sink_csv")
    tables.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return tables.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")


@query(
    "vector_text_roundtrip",
    """SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total,
    round(embedding[1]::DOUBLE, 6) AS first_dim FROM embeddings""",
)
def vector_text_roundtrip(spark, sf):
    path = new_path(spark, "vector_text")
    wide = F.col("embedding").cast("array<double>")
    tables.write_csv(
        table(spark, sf, "embeddings").select("vec_id", vectors.to_text(wide).alias("embedding")), path
    )
    back = tables.read_csv(spark, path, "vec_id bigint, embedding string")
    parsed = back.select("vec_id", vectors.from_text("embedding").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return parsed.select(
        "vec_id",
        F.size("e").cast("long").alias("dims"),
        F.round(total, 6).alias("total"),
        F.round(F.get("e", F.lit(0)), 6).alias("first_dim"),
    )


@query("describe_schema")
def describe_schema(spark, sf):
    for name in TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)
    return tables.describe_schema(spark, TABLES)


@query(
    "sample_n",
    "SELECT p_partkey, p_name FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 10",
)
def sample_n(spark, sf):
    return rows.sample_n(table(spark, sf, "part").select("p_partkey", "p_name"), 10, "p_partkey")


@query(
    "type_code_name",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'VARCHAR(' || p_size || ')'
    WHEN 'SMALL' THEN 'CHAR(' || p_size || ')' WHEN 'MEDIUM' THEN 'DATE' WHEN 'LARGE' THEN 'INTEGER'
    WHEN 'STANDARD' THEN 'DECIMAL(' || p_size || ', 2)' ELSE p_brand END AS type_name FROM part""",
)
def type_code_name(spark, sf):
    kind = F.col("p_type")
    code = (
        F.when(kind == "ECONOMY", "CV")
        .when(kind == "SMALL", "CF")
        .when(kind == "MEDIUM", " D ")
        .when(kind == "LARGE", "I")
        .when(kind == "STANDARD", "F")
        .otherwise(F.col("p_brand"))
    )
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", codes.type_name(code, size, size, F.lit(2)).alias("type_name")
    )


# --- projection, filter, schema change ------------------------------------------------


@query("rename_cols", "SELECT p_partkey AS id, p_name AS product_name, p_brand AS brand FROM part")
def rename_cols(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return rows.rename(part, {"p_partkey": "id", "p_name": "product_name", "p_brand": "brand"})


@query("project", "SELECT p_partkey, p_name FROM part")
def project(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name")


@query("drop_cols", "SELECT p_partkey, p_name, p_brand FROM part")
def drop_cols(spark, sf):
    return table(spark, sf, "part").drop("p_type", "p_size", "p_retailprice")


LABELLED_SQL = "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"


def labelled(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return documents.join(table(spark, sf, "labels"), "doc_id", "left")


@query("drop_nulls", f"SELECT * FROM ({LABELLED_SQL}) WHERE quality IS NOT NULL")
def drop_nulls(spark, sf):
    return rows.drop_nulls(labelled(spark, sf), ["quality"])


@query(
    "fill_empty",
    f"SELECT doc_id, lang, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic FROM ({LABELLED_SQL})",
)
def fill_empty(spark, sf):
    return rows.fill_empty(
        rows.cast_all_string(labelled(spark, sf)).withColumn("doc_id", F.col("doc_id").cast("long")),
        ["quality", "toxic"],
    )


@query(
    "cast_all_string",
    f"SELECT doc_id::VARCHAR AS doc_id, lang, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM ({LABELLED_SQL})",
)
def cast_all_string(spark, sf):
    return rows.cast_all_string(labelled(spark, sf))


def sql_clean_space(c: str) -> str:
    return f"lower(trim({sub(sub(c, '[[:digit:]]+', ''), '[[:punct:]]', ' ')}))"


@query(
    "clean_titles",
    f"SELECT doc_id, {sql_clean_space('text')} AS text, {sql_clean_space('source')} AS source FROM documents",
)
def clean_titles(spark, sf):
    """Columns rewritten in place."""
    versions = VersionedTable(spark, new_path(spark, "clean_titles"))
    versions.replace(table(spark, sf, "documents").select("doc_id", "text", "source"))
    versions.update(lambda rows: catalog.clean_columns(rows, ["text", "source"]))
    return versions.read()


@query(
    "vector_to_wide",
    "SELECT vec_id, "
    + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS embed_{i}" for i in range(64))
    + " FROM embeddings",
)
def vector_to_wide(spark, sf):
    wide = table(spark, sf, "embeddings").select("vec_id", *vectors.to_wide("embedding", 64))
    return wide.select("vec_id", *[F.round(F.col(f"embed_{i}").cast("double"), 6).alias(f"embed_{i}") for i in range(64)])


@query(
    "vector_truncate",
    """SELECT vec_id, len(embedding[1:16]) AS dims,
    round(list_sum((embedding[1:16])::DOUBLE[]), 6) AS total FROM embeddings""",
)
def vector_truncate(spark, sf):
    short = F.col("e").cast("array<double>")
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", vectors.truncate("embedding", 16).alias("e"))
        .select(
            "vec_id",
            F.size("e").cast("long").alias("dims"),
            F.round(F.aggregate(short, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        )
    )


@query("with_id", "SELECT p_partkey AS product_id, p_name FROM part")
def with_id(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    return rows.with_id(part, "row_id").select("product_id", "p_name")


# --- joins ------------------------------------------------------------------------------


@query(
    "map_to_taxonomy",
    f"""SELECT l_orderkey, l_linenumber, l_returnflag AS Name, SegmentTitle, FamilyTitle, ClassTitle, BrickTitle
    FROM lineitem LEFT JOIN ({TAXONOMY_SQL}) ON l_partkey = row_id""",
)
def map_to_taxonomy(spark, sf):
    products = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    codes_of = taxonomy(spark, sf).withColumn("BrickCode", F.col("row_id"))
    mapped, _ = catalog.map_products(
        products, codes_of, "l_partkey", "BrickCode", "l_returnflag", TITLES, "row_id",
        keep=["l_orderkey", "l_linenumber"],
    )
    return mapped


@query(
    "unmapped_codes",
    """SELECT doc_id, count(*) AS n_products FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""",
)
def unmapped_codes(spark, sf):
    return lookup.unmapped_codes(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query(
    "unprocessed_batch",
    f"""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    ORDER BY doc_id LIMIT {LABELLING_BATCH}""",
)
def unprocessed_batch(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return rows.next_batch(documents, table(spark, sf, "labels"), "doc_id", LABELLING_BATCH)


GLOSSARY_VALUES = ", ".join(f"('{en}', '{ar}')" for en, ar in CLASS_NAMES_AR.items())
CLASS_LIST = ", ".join(f"'{en}'" for en in CLASS_NAMES_AR)


@query(
    "glossary_translate",
    f"""WITH g(term, translation) AS (VALUES {GLOSSARY_VALUES}),
    named AS (SELECT p_partkey, coalesce(([{CLASS_LIST}])[p_size], lower(p_type)) AS class_name FROM part)
    SELECT p_partkey, class_name, coalesce(translation, class_name) AS translated_name
    FROM named LEFT JOIN g ON term = class_name""",
)
def glossary_translate(spark, sf):
    names = F.array(*[F.lit(en) for en in CLASS_NAMES_AR])
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.coalesce(F.get(names, F.col("p_size") - 1), F.lower("p_type")).alias("class_name"),
    )
    return lookup.translate_terms(part, "class_name", lookup.class_names_ar(part)).select(
        "p_partkey", "class_name", "translated_name"
    )


# --- aggregation, dedup, numbering ---------------------------------------------------------


@query(
    "taxonomy_cardinality",
    f"""SELECT count(DISTINCT SegmentTitle) AS n_SegmentTitle, count(DISTINCT FamilyTitle) AS n_FamilyTitle,
    count(DISTINCT ClassTitle) AS n_ClassTitle, count(DISTINCT BrickTitle) AS n_BrickTitle,
    count(DISTINCT p_size) AS n_p_size, count(DISTINCT row_id) AS n_row_id
    FROM ({TAXONOMY_SQL}) JOIN part ON row_id = p_partkey""",
)
def taxonomy_cardinality(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_type").alias("SegmentTitle"),
        F.col("p_brand").alias("FamilyTitle"),
        word("p_name", 1).alias("ClassTitle"),
        word("p_name", 2).alias("BrickTitle"),
        "p_size",
        F.col("p_partkey").alias("row_id"),
    )
    return metrics.cardinalities(part, [*TITLES, "p_size", "row_id"])


@query("dedup_rows", "SELECT DISTINCT p_name, p_brand, p_type FROM part")
def dedup_rows(spark, sf):
    return rows.dedup_rows(table(spark, sf, "part").select("p_name", "p_brand", "p_type"))


@query(
    "dedup_keep_first",
    """SELECT min(doc_id) AS doc_id, text, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
    FROM documents GROUP BY text""",
)
def dedup_keep_first(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return rows.dedup_keep_first(documents, ["text"], "doc_id")


@query(
    "class_ids",
    """SELECT row_number() OVER (ORDER BY min(p_partkey)) - 1 AS class_id, p_name AS class_name
    FROM part WHERE p_name IS NOT NULL GROUP BY p_name""",
)
def class_ids(spark, sf):
    return rows.class_ids(table(spark, sf, "part"), "p_name", "p_partkey")


@query("actual_classes", f"SELECT doc_id AS product_id, quality AS class_name FROM ({LABELLED_SQL})")
def actual_classes(spark, sf):
    return catalog.actual_classes(labelled(spark, sf), "quality", "doc_id")


@query(
    "label_codes",
    "SELECT DISTINCT p_name AS label, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part",
)
def label_codes(spark, sf):
    return rows.label_codes(table(spark, sf, "part"), "p_name")


@query(
    "batch_ids",
    f"""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {UPLOAD_BATCH} AS batch_id FROM orders""",
)
def batch_ids(spark, sf):
    return rows.batch_ids(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", UPLOAD_BATCH)


@query(
    "progress_counts",
    """SELECT count(*) AS total, count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS remaining
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
)
def progress_counts(spark, sf):
    return rows.progress_counts(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "class_weights",
    """SELECT p_type, count(*) AS n,
    round((SELECT count(*) FROM part) / ((SELECT count(DISTINCT p_type) FROM part) * count(*)::DOUBLE), 6) AS weight
    FROM part GROUP BY p_type""",
)
def class_weights(spark, sf):
    return metrics.class_weights(table(spark, sf, "part"), "p_type").select("p_type", "n", r6("weight"))


@query(
    "classes_per_level",
    " UNION ALL ".join(
        f"SELECT '{t}' AS level, count(DISTINCT {t}) AS n_classes, count(DISTINCT {t}) < 2 AS is_constant FROM ({TAXONOMY_SQL})"
        for t in TITLES
    ),
)
def classes_per_level(spark, sf):
    return metrics.classes_per_level(taxonomy(spark, sf), TITLES)


# --- unions ----------------------------------------------------------------------------------


@query("union_splits", "SELECT p_partkey, p_name FROM part")
def union_splits(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    splits = part.where("p_size <= 10"), part.where("p_size between 11 and 30"), part.where("p_size > 30")
    return rows.union_all(*splits).drop("p_size")


@query(
    "combine_sources",
    f"""SELECT ClassTitle AS Name, SegmentTitle, FamilyTitle, ClassTitle, BrickTitle, NULL::INTEGER AS s_nationkey
    FROM ({TAXONOMY_SQL}) UNION ALL
    SELECT s_name, NULL, NULL, NULL, '', s_nationkey FROM supplier""",
)
def combine_sources(spark, sf):
    mapped = taxonomy(spark, sf).select(F.col("ClassTitle").alias("Name"), *TITLES)
    other = table(spark, sf, "supplier").select(F.col("s_name").alias("Name"), "s_nationkey")
    return catalog.combine_sources(mapped, other)


@query("union_ids", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_ids(spark, sf):
    return rows.union_ids(*[table(spark, sf, t).select("doc_id") for t in ("documents", "labels")])


# --- state, stamps, errors ----------------------------------------------------------------------


@query(
    "json_state",
    """SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k,
    '{"event_id":' || event_id || ',"k":' || (props::JSON ->> '$.k') || '}' AS state FROM events""",
)
def json_state(spark, sf):
    parsed = table(spark, sf, "events").select(
        "event_id", state.parse_json("props", "k bigint")["k"].alias("k")
    )
    return parsed.withColumn("state", state.render_json("event_id", "k"))


@query("run_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def run_stamp(spark, sf):
    return table(spark, sf, "events").select("event_id", codes.run_stamp(F.col("ts")).alias("stamp"))


@query(
    "quarantine_rows",
    f"""SELECT doc_id, lang, CASE WHEN {sql_collapse("lower(coalesce(text, ''))")} = '' THEN 'blank text'
    WHEN quality IS NULL THEN 'no label' WHEN toxic <> 0 THEN 'toxic' END AS error
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def quarantine_rows(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    checks = {
        "blank text": prep_model_text("text") != "",
        "no label": F.col("quality").isNotNull(),
        "toxic": F.col("toxic") == 0,
    }
    return rows.quarantine(documents.join(table(spark, sf, "labels"), "doc_id", "left"), checks).select(
        "doc_id", "lang", "error"
    )


# --- loading flows -----------------------------------------------------------------------------------


@query(
    "load_products",
    f"""SELECT min(doc_id) AS id, {sub(sub("nfc_normalize(text)", r"\p{C}", ""), r"^\p{Z}+|\p{Z}+$", "")} AS product_name
    FROM documents WHERE text IS NOT NULL GROUP BY text""",
)
def load_products(spark, sf):
    return catalog.load_products(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "load_taxonomy",
    f"""SELECT min(row_id) AS id, SegmentTitle, FamilyTitle, ClassTitle, BrickTitle FROM ({TAXONOMY_SQL})
    GROUP BY ALL""",
)
def load_taxonomy(spark, sf):
    return catalog.load_taxonomy(taxonomy(spark, sf), "row_id")


DEFINITIONS = {
    "SegmentTitle": ("p_type", "p_type"),
    "SegmentDefinition": ("concat_ws(' - ', p_type, p_brand, p_size)", "concat_ws(' - ', p_type, p_brand, p_size)"),
    "FamilyTitle": ("p_brand", "p_brand"),
    "FamilyDefinition": ("concat_ws('/', p_brand, p_name)", "concat_ws('/', p_brand, p_name)"),
    "ClassTitle": ("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
    "ClassDefinition": ("concat_ws(', ', p_name, p_size)", "concat_ws(', ', p_name, p_size)"),
    "BrickTitle": ("split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 2)"),
    "BrickDefinition_Includes": ("concat_ws(' & ', p_name, p_type)", "concat_ws(' & ', p_name, p_type)"),
    "BrickDefinition_Excludes": ("concat_ws('|', p_type, p_size)", "concat_ws('|', p_type, p_size)"),
}


@query(
    "prepare_taxonomy",
    "SELECT p_partkey AS id, "
    + ", ".join(f"{sql_clean_space(sql)} AS {c}" for c, (_, sql) in DEFINITIONS.items())
    + " FROM part",
)
def prepare_taxonomy(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").alias("BrickCode"),
        F.col("p_size").alias("AttributeCode"),
        *[F.expr(e).alias(c) for c, (e, _) in DEFINITIONS.items()],
    )
    return catalog.prepare_taxonomy(raw)

