"""Joins against code tables, dictionaries and catalogs.

No join here carries a broadcast hint. A lookup side below
``spark.sql.autoBroadcastJoinThreshold`` (as measured by AQE) is broadcast, a
larger one is shuffled; its keys are unique, so AQE can split a hot key of the
fact side without touching the result.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.fixed_values import CLASS_NAMES_AR
from shelfwise.operators.rows import dedup_keep_first
from shelfwise.session import stored

PIECE_CHARS = 1 << 20  # of a dictionary that is searched for at once
TEXTS = 1024  # sent together


def map_codes(
    products: DataFrame,
    catalog: DataFrame,
    product_code: str,
    catalog_code: str,
    titles: list[str],
    row_id: str,
    null_matches_null: bool = False,
) -> DataFrame:
    """Left join products to the first catalog row of their code.

    ``null_matches_null`` gives the dataframe-library rule under which a missing
    code meets a missing code; the default is SQL equality.
    """
    first = dedup_keep_first(
        catalog.select(catalog_code, row_id, *titles), [catalog_code], row_id
    ).select(F.col(catalog_code).alias("_code"), *titles)
    left = F.col(product_code)
    match = left.eqNullSafe(F.col("_code")) if null_matches_null else left == F.col("_code")
    return products.join(first, match, "left").drop("_code")


def unmapped_codes(
    products: DataFrame, catalog: DataFrame, product_code: str, catalog_code: str
) -> DataFrame:
    """Codes without a catalog row, with the number of products that use them."""
    known = catalog.select(F.col(catalog_code).alias(product_code)).distinct()
    return (
        products.groupBy(product_code)
        .agg(F.count("*").alias("n_products"))
        .join(known, product_code, "left_anti")
    )


def class_names_ar(df: DataFrame) -> DataFrame:
    """The built-in glossary as ``(term, translation)``; literal rows, so that its size is known."""
    pairs = [F.struct(F.lit(a).alias("term"), F.lit(b).alias("translation")) for a, b in CLASS_NAMES_AR.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*pairs)))


def translate_terms(
    df: DataFrame, column: str, glossary: DataFrame, name: str = "translated_name"
) -> DataFrame:
    """Replace terms found in a ``(term, translation)`` table, keep the others.

    The glossary is written first: its measured size lets Spark broadcast a small one
    instead of shuffling the rows by what may be a hot term.
    """
    terms = stored(
        glossary.groupBy(F.col("term").alias(column)).agg(F.min("translation").alias("_translation")), "glossary"
    )
    return (
        df.join(terms, column, "left")
        .withColumn(name, F.coalesce("_translation", column))
        .drop("_translation")
    )


def _pieces(known: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """``(piece, brands)`` and the number of pieces: the dictionary in pieces of about ``chars`` characters, dealt by hash."""
    total = known.agg(F.coalesce(F.sum(F.length("_brand")), F.lit(0))).first()[0]
    pieces = max(1, -(-total // chars))
    piece = F.pmod(F.xxhash64("_brand"), F.lit(pieces)).alias("piece")
    return known.groupBy(piece).agg(F.collect_list("_brand").alias("brands")), pieces


def _blocks_of_texts(df: DataFrame) -> DataFrame:
    """``(block, texts)``: distinct texts of a batch, packed where they are read."""

    def task(batches: Iterable[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            distinct = b.column(0).drop_null().unique()
            for i in range(0, len(distinct), TEXTS):
                cells = [pa.array([number], pa.int64()), pa.array([distinct.slice(i, TEXTS).to_pylist()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cells, ["block", "texts"])
                number += 1

    return df.mapInArrow(task, "block long, texts array<string>")


def found_brands(df: DataFrame, text: str, brands: DataFrame, column: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(text, brand)``: the longest brand that each distinct text holds, ties by brand.

    The dictionary is cut into pieces of bounded size. A task builds the automaton of one
    piece at a time, a trie with failure links, and scans each text once per piece, so
    the dictionary may have any size. Texts are packed into blocks where they are read and
    sent once per piece; only texts that hold a brand come back.
    """
    spark = df.sparkSession
    known = brands.select(F.col(column).alias("_brand")).where(F.length("_brand") > 0).distinct()
    dictionary, pieces = _pieces(stored(known, "brands"), piece_chars)
    blocks = _blocks_of_texts(df.select(F.col(text).cast("string")))
    # each piece is built by as many tasks as a shuffle has, whatever the number of texts
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece")
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).alias("lane")
    all_lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane")
    sent = blocks.select(every, lane, F.lit(1).alias("kind"), "texts").unionByName(
        dictionary.select("piece", all_lanes, F.lit(0).alias("kind"), F.col("brands").alias("texts"))
    )

    def task(batches: Iterable[pa.RecordBatch]):
        now, held, automaton = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                piece, lane, kind = (b.column(j)[i].as_py() for j in range(3))
                texts = b.column(3)[i].as_py()
                if (piece, lane) != now:
                    now, held, automaton = (piece, lane), [], None
                if kind == 0:
                    held += texts
                    continue
                if automaton is None:  # for the first texts: a lane without any builds nothing
                    automaton = ahocorasick.Automaton()
                    for brand in held:
                        automaton.add_word(brand, brand)
                    automaton.make_automaton()
                found = []
                for t in texts:
                    inside = {brand for _, brand in automaton.iter(t)} if held else ()
                    if inside:
                        found.append((t, min(inside, key=lambda v: (-len(v), v))))
                columns = list(zip(*found)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["text", "brand"])

    placed = sent.repartition("piece", "lane").sortWithinPartitions("piece", "lane", "kind")
    found = placed.mapInArrow(task, "text string, brand string")
    # the same text may come from several blocks and pieces
    best = Window.partitionBy("text").orderBy(F.length("brand").desc(), "brand")
    return found.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def strip_brand_join(
    df: DataFrame, key: str, text: str, brands: DataFrame, column: str, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """Remove the longest brand a text holds, ties by text: ``(key, text, stripped)``.

    Null texts stay null; rows with equal texts are scanned once per batch.
    """
    found = found_brands(df, text, brands, column, piece_chars).withColumnRenamed("text", "_text")
    return df.join(found, F.col(text) == F.col("_text"), "left").select(
        key,
        text,
        F.when(F.col("brand").isNull(), F.col(text)).otherwise(F.replace(F.col(text), F.col("brand"), F.lit(""))).alias("stripped"),
    )
