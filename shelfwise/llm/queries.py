"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from shelfwise.llm import (
    centroids, chat, ego, lattice, mixing, neardup, negatives, oracles, packing, personal, quality, search, secrets, substrings,
)
from shelfwise.llm.oracles import PROBE
from shelfwise.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


# a tokenizer, its vocabulary as ranks, and its pattern
TOKENIZER = (
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
)
# pieces with scores
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op3_mix_sources")
def op3(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op7_pack_sequences")
def op7(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), *TOKENIZER)


@query("op9_chat_format", oracles.CHAT)
def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -7L conv_id, 0L turn, 'user' role, '{PROBE}' text UNION ALL SELECT -7L, 1L, 'assistant', '{PROBE}'")
    return chat.digests(turns.unionByName(probe))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_minhash_neardup", oracles.NEAR)
def op10(spark, sf_dir):
    return neardup.components(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup", oracles.PASSAGES)
def op8(spark, sf_dir):
    return substrings.digests(table(spark, sf_dir, "documents"))


@query("op1_kdtree_topk", search.ORACLE)
def op1(spark, sf_dir):
    return search.topk(table(spark, sf_dir, "embeddings"))


@query("op4_embedding_neardup", ego.ORACLE)
def op4(spark, sf_dir):
    return ego.links(table(spark, sf_dir, "embeddings"))


@query("op6_personal_data")
def op6(spark, sf_dir):
    return personal.report(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", negatives.ORACLE)
def op11(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query("op12_centroid_clusters", centroids.ORACLE)
def op12(spark, sf_dir):
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query("op13_lattice_score")
def op13(spark, sf_dir):
    return lattice.scored(table(spark, sf_dir, "documents"), PIECES)
