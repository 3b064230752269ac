"""Nearest class, term weights, centroids, votes, taxonomy, validation, metrics,
supervised models, encoders and streams."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from checks.registry import (
    TAXONOMY_SQL,
    TITLES,
    joined,
    query,
    r6,
    sql_match_key,
    sql_postings,
    sql_prep,
    sql_resolve,
    sql_tokens,
    table,
    taxonomy,
)
from shelfwise.fixed_values import LEVELS, TOP_K
from shelfwise.functions import vectors
from shelfwise.operators import baseline, centroid, enrich, metrics, nearest, similarity, supervised, validate, votes, weights
from shelfwise.operators import taxonomy as tree
from shelfwise.operators.weights import TermOptions
from shelfwise.plans import nearest as nearest_plan
from shelfwise.plans import supervised as supervised_plan
from shelfwise.session import new_path, stored
from shelfwise.sources import tables
from shelfwise.streaming import labelling

DIMS = 64

# --- nearest class -----------------------------------------------------------------------

NEAREST_SQL = f"""WITH dims AS (SELECT label, unnest(range(1, {DIMS + 1})) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY ALL),
classes AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
pairs AS (SELECT vec_id, c.label AS class_id, list_cosine_distance(embedding::DOUBLE[], v) AS distance
          FROM embeddings, classes c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), class_id) AS rank FROM pairs)"""


def class_vectors(spark, sf):
    return nearest.mean_vectors(table(spark, sf, "embeddings"), "label", "embedding", DIMS)


def nearest_rows(spark, sf, k=1, **kw):
    items = table(spark, sf, "embeddings")
    return nearest.nearest_classes(items, class_vectors(spark, sf), "vec_id", "label", "embedding", k, **kw)


@query(
    "nearest_class",
    f"""{NEAREST_SQL} SELECT vec_id AS item_id, class_id AS closest_category_id,
    round(distance, 6) AS cosine_distance FROM ranked WHERE rank = 1""",
)
def nearest_class(spark, sf):
    best = nearest_plan.nearest_class(
        table(spark, sf, "embeddings"), class_vectors(spark, sf), "vec_id", "label", "embedding"
    )
    return best.select("item_id", "closest_category_id", r6("cosine_distance"))


@query(
    "nearest_class_blocks",
    f"""{NEAREST_SQL} SELECT vec_id AS item_id, class_id, round(distance, 6) AS distance FROM ranked WHERE rank = 1""",
)
def nearest_class_blocks(spark, sf):
    """Classes in many balls and blocks: here of 4 classes at most."""
    found = nearest_rows(spark, sf, block=4)
    return found.select("item_id", "class_id", r6("distance"))


TOP3_SQL = f"{NEAREST_SQL} SELECT vec_id AS item_id, rank, class_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 3"


@query("nearest_class_window", TOP3_SQL)
def nearest_class_window(spark, sf):
    top = nearest.ranked(nearest_rows(spark, sf, k=TOP_K))
    return top.select("item_id", F.col("rank").cast("long").alias("rank"), "class_id", r6("distance"))


@query(
    "cluster_topk",
    f"""{NEAREST_SQL}, vecs AS (SELECT label, v FROM classes),
    cp AS (SELECT a.label AS cluster_id, b.label AS class_id, list_cosine_distance(a.v, b.v) AS d FROM vecs a, vecs b),
    cr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(d, 9), class_id) AS rank FROM cp)
    SELECT cluster_id, string_agg(class_id::VARCHAR, '|' ORDER BY rank) AS classes FROM cr WHERE rank <= 3 GROUP BY 1""",
)
def cluster_topk(spark, sf):
    clusters = class_vectors(spark, sf).withColumnRenamed("label", "cluster_id")
    top = nearest.nearest_classes(
        clusters, clusters.withColumnRenamed("cluster_id", "label"), "cluster_id", "label", "embedding", TOP_K
    )
    in_order = F.array_sort(F.collect_list(F.struct("rank", F.col("class_id").cast("string").alias("c"))))
    return (
        nearest.ranked(top)
        .groupBy(F.col("item_id").alias("cluster_id"))
        .agg(joined(F.transform(in_order, lambda s: s["c"])).alias("classes"))
    )


@query(
    "cosine_argmax",
    f"""{NEAREST_SQL} SELECT vec_id AS item_id, class_id, round(1 - distance, 6) AS confidence FROM ranked WHERE rank = 1""",
)
def cosine_argmax(spark, sf):
    best = nearest.cosine_argmax(
        table(spark, sf, "embeddings"), class_vectors(spark, sf), "vec_id", "label", "embedding"
    )
    return best.select("item_id", "class_id", r6("confidence"))


@query(
    "similarity_pairs",
    f"""{NEAREST_SQL} SELECT vec_id AS item_id, class_id, round(1 - distance, 6) AS score
    FROM ranked WHERE rank <= 3 AND 1 - distance >= 0.05""",
)
def similarity_pairs(spark, sf):
    found = nearest.similar(
        table(spark, sf, "embeddings"), class_vectors(spark, sf), "vec_id", "label", "embedding", TOP_K, 0.05
    )
    return found.select("item_id", "class_id", r6("score"))


@query(
    "l2_normalize",
    """SELECT vec_id, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_dim,
    round(list_sum(embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS total
    FROM embeddings""",
)
def l2_normalize(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", vectors.l2_normalize("embedding").alias("e"))
    return unit.select(
        "vec_id",
        F.round(F.get("e", F.lit(0)), 6).alias("first_dim"),
        F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


RESULTS_SQL = f"""{NEAREST_SQL}, res AS (SELECT r.vec_id AS product_id, p_name AS product_name, 'class ' || r.class_id AS predicted_class,
  'class ' || e.label AS actual_class, r.distance AS similarity_score
  FROM ranked r JOIN part ON r.vec_id = p_partkey JOIN embeddings e ON e.vec_id = r.vec_id WHERE rank = 1)"""


def reported(spark, sf):
    name = F.concat(F.lit("class "), F.col("label"))
    vecs = table(spark, sf, "embeddings")
    classes = stored(class_vectors(spark, sf), "class_vectors")
    scored = nearest_plan.nearest_class(vecs, classes, "vec_id", "label", "embedding")
    products = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"))
    actual = vecs.select(F.col("vec_id").alias("product_id"), name.alias("class_name"))
    return nearest_plan.results(
        scored, products, classes.select(F.col("label").alias("class_id"), name.alias("class_name")), actual
    )


@query(
    "classification_results",
    f"{RESULTS_SQL} SELECT * REPLACE (round(similarity_score, 6) AS similarity_score) FROM res",
)
def classification_results(spark, sf):
    return reported(spark, sf).withColumn("similarity_score", r6("similarity_score"))


def sql_class_metrics(source: str, actual: str, predicted: str, by: str = "") -> str:
    """CTEs up to ``cm``: one row per (``by``, label)."""
    b, using = (f"{by}, ", f"USING ({by}, label)") if by else ("", "USING (label)")
    return f"""act AS (SELECT {b}{actual} AS label, count(*) AS support, count(*) FILTER ({actual} = {predicted}) AS tp
  FROM {source} WHERE {actual} IS NOT NULL AND {predicted} IS NOT NULL GROUP BY ALL),
prd AS (SELECT {b}{predicted} AS label, count(*) AS predicted FROM {source}
  WHERE {actual} IS NOT NULL AND {predicted} IS NOT NULL GROUP BY ALL),
cnt AS (SELECT {b}label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
  FROM act FULL JOIN prd {using}),
cm AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS "precision",
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, 2 * tp / (support + predicted) AS f1 FROM cnt)"""


@query(
    "nearest_class_f1",
    f"""{RESULTS_SQL}, {sql_class_metrics('res', 'actual_class', 'predicted_class')}
    SELECT round(sum(support * f1) / sum(support), 6) AS weighted_f1 FROM cm""",
)
def nearest_class_f1(spark, sf):
    return nearest_plan.score(reported(spark, sf)).select(r6("weighted_f1"))


# --- term weights --------------------------------------------------------------------------

BIGRAMS = TermOptions((1, 2))
UNIGRAMS = TermOptions((1, 1))


def documents(spark, sf):
    return tables.dealt(table(spark, sf, "documents").select("doc_id", "text", "lang"))


def document_postings(spark, sf, options=BIGRAMS):
    return weights.postings(documents(spark, sf), "doc_id", "text", options)


def sql_stats(high: int = 2) -> str:
    return f"""WITH {sql_postings('documents', 'doc_id', 'text', ['lang'], high)},
st AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, sum(tf * tf)::BIGINT AS tf2 FROM p GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents)"""


@query("term_stats", f"{sql_stats()} SELECT * FROM st")
def term_stats(spark, sf):
    return weights.term_stats(document_postings(spark, sf))


@query("vocab_df_filter", f"{sql_stats()} SELECT term, df, cf FROM st, nd WHERE df >= 2 AND df <= 0.95 * n")
def vocab_df_filter(spark, sf):
    options = TermOptions((1, 2), min_df=2, max_df=0.95)
    stats = weights.term_stats(document_postings(spark, sf, options))
    return weights.vocabulary(stats, weights.count_of(documents(spark, sf)), options).select("term", "df", "cf")


@query(
    "vocab_topn",
    f"""{sql_stats()} SELECT term, df, cf FROM st, nd WHERE df >= 2 AND df <= 0.95 * n
    ORDER BY cf DESC, term LIMIT 10000""",
)
def vocab_topn(spark, sf):
    options = TermOptions((1, 2), min_df=2, max_df=0.95, max_features=10_000)
    stats = weights.term_stats(document_postings(spark, sf, options))
    return weights.vocabulary(stats, weights.count_of(documents(spark, sf)), options).select("term", "df", "cf")


def sql_tfidf(high: int, tf: str = "tf", max_df: float = 0.95) -> str:
    return f"""{sql_stats(high)},
wt AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS weight FROM st, nd WHERE df <= {max_df} * n),
wp AS (SELECT doc_id, lang, term, {tf} * weight AS w FROM p JOIN wt USING (term)),
un AS (SELECT doc_id, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wp)"""


@query("tfidf", f"{sql_tfidf(2)} SELECT doc_id, term, round(w, 6) AS w FROM un")
def tfidf(spark, sf):
    options = TermOptions((1, 2), max_df=0.95)
    return weights.tfidf(documents(spark, sf), "doc_id", "text", options).select("doc_id", "term", r6("w"))


@query("tfidf_sublinear", f"{sql_tfidf(2, '(1 + ln(tf))')} SELECT doc_id, term, round(w, 6) AS w FROM un")
def tfidf_sublinear(spark, sf):
    options = TermOptions((1, 2), max_df=0.95, sublinear_tf=True)
    return weights.tfidf(documents(spark, sf), "doc_id", "text", options).select("doc_id", "term", r6("w"))


ICF_SQL = f"""{sql_stats()},
iw AS (SELECT term, greatest(ln(n / (df + 1e-9::DOUBLE)) * (1 - tf2 / ((cf + 1e-9::DOUBLE) * (cf + 1e-9::DOUBLE))), 1e-9::DOUBLE) AS weight
  FROM st, nd)"""


@query("icf_tdcb_weights", f"{ICF_SQL} SELECT term, round(weight, 6) AS weight FROM iw")
def icf_tdcb_weights(spark, sf):
    found = weights.icf_tdcb_weights(document_postings(spark, sf), weights.count_of(documents(spark, sf)))
    return found.select("term", r6("weight"))


# --- centroid classifiers --------------------------------------------------------------------

CLASSES_SQL = """cls AS (SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS class_id, count(*) AS size
  FROM documents GROUP BY lang)"""


def sql_rank(unit: str) -> str:
    """CTEs ``cent``, ``prod``, ``rk`` from unit postings and centroids ``c0(lang, term, w)``."""
    return f"""{CLASSES_SQL},
cent AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang)) AS w FROM c0),
prod AS (SELECT u.doc_id, c.lang, sum(u.w * c.w) AS score FROM {unit} u JOIN cent c USING (term) GROUP BY ALL),
rk AS (SELECT d.doc_id, cls.lang, coalesce(score, 0) AS score,
  row_number() OVER (PARTITION BY d.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, class_id) AS rank
  FROM documents d CROSS JOIN cls LEFT JOIN prod ON prod.doc_id = d.doc_id AND prod.lang = cls.lang)"""


def sql_tfidf_rank(high: int) -> str:
    return f"""{sql_tfidf(high)},
cs AS (SELECT lang AS l, count(*) AS size FROM documents GROUP BY lang),
c0 AS (SELECT lang, term, sum(w) / any_value(size) AS w FROM un JOIN cs ON lang = l GROUP BY lang, term),
{sql_rank('un')}"""


TOPK_COLUMNS = ", ".join(
    f"max(lang) FILTER (rank = {j}) AS class_{j}_name, round(max(score) FILTER (rank = {j}), 6) AS score_{j}"
    for j in range(1, TOP_K + 1)
)


@query("tfidf_centroids", f"{sql_tfidf_rank(2)} SELECT lang AS class_name, term, round(w, 6) AS w FROM cent")
def tfidf_centroids(spark, sf):
    model = centroid.fit_tfidf(documents(spark, sf), "doc_id", "text", "lang")
    return model.centroids().withColumn("w", r6("w"))


@query(
    "tfidf_predict",
    f"""{sql_tfidf_rank(2)} SELECT doc_id, max(lang) FILTER (rank = 1) AS label,
    round(max(score) FILTER (rank = 1), 6) AS score_1 FROM rk GROUP BY doc_id""",
)
def tfidf_predict(spark, sf):
    docs = documents(spark, sf)
    model = centroid.fit_tfidf(docs, "doc_id", "text", "lang")
    return centroid.predict(model, docs, "doc_id", "text", k=1).select("doc_id", "label", r6("score_1"))


@query("tfidf_topk", f"{sql_tfidf_rank(2)} SELECT doc_id, {TOPK_COLUMNS} FROM rk GROUP BY doc_id")
def tfidf_topk(spark, sf):
    docs = documents(spark, sf)
    model = centroid.fit_tfidf(docs, "doc_id", "text", "lang")
    places = [c for j in range(1, TOP_K + 1) for c in (f"class_{j}_name", r6(f"score_{j}"))]
    return centroid.predict(model, docs, "doc_id", "text").select("doc_id", *places)


@query(
    "icf_tdcb_predict",
    f"""{ICF_SQL}, iu0 AS (SELECT doc_id, lang, term, tf * weight AS w FROM p JOIN iw USING (term)),
    iu AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM iu0),
    cs AS (SELECT lang AS l, count(*) AS size FROM documents GROUP BY lang),
    c0 AS (SELECT lang, term, sum(w) / any_value(size) AS w FROM iu0 JOIN cs ON lang = l GROUP BY lang, term),
    {sql_rank('iu')}
    SELECT doc_id, max(lang) FILTER (rank = 1) AS label, {', '.join(
        f'round(max(score) FILTER (rank = {j}), 6) AS score_{j}' for j in range(1, TOP_K + 1))} FROM rk GROUP BY doc_id""",
)
def icf_tdcb_predict(spark, sf):
    docs = documents(spark, sf)
    model = centroid.fit_icf_tdcb(docs, "doc_id", "text", "lang")
    scores = [r6(f"score_{j}") for j in range(1, TOP_K + 1)]
    return centroid.predict(model, docs, "doc_id", "text").select("doc_id", "label", *scores)


# --- votes: a part's own type, the first type of its name, the first type of its brand ---------

FIRST_SQL = """n AS (SELECT p_name, arg_min(p_type, p_partkey) AS by_name FROM part GROUP BY p_name),
b AS (SELECT p_brand, arg_min(p_type, p_partkey) AS by_brand FROM part GROUP BY p_brand),
v AS (SELECT p_partkey, p_type AS own, by_name, by_brand FROM part JOIN n USING (p_name) JOIN b USING (p_brand))"""
# every fifth item has no vote by name, every seventh a null vote by brand
GAPS_SQL = f"""{FIRST_SQL}, g AS (SELECT p_partkey, own, CASE WHEN p_partkey % 5 > 0 THEN by_name END AS by_name,
CASE WHEN p_partkey % 7 > 0 THEN by_brand END AS by_brand FROM v)"""


def first_of(part, key, value, name):
    return part.groupBy(key).agg(F.min_by(value, "p_partkey").alias(name))


def vote_columns(spark, sf, gaps=False):
    part = table(spark, sf, "part")
    ids = part.select("p_partkey", "p_name", "p_brand")
    by_name = ids.join(first_of(part, "p_name", "p_type", "by_name"), "p_name").select("p_partkey", "by_name")
    by_brand = ids.join(first_of(part, "p_brand", "p_type", "by_brand"), "p_brand").select("p_partkey", "by_brand")
    if gaps:
        by_name = by_name.where("p_partkey % 5 > 0")
        by_brand = by_brand.withColumn("by_brand", F.when(F.col("p_partkey") % 7 > 0, F.col("by_brand")))
    return votes.join_votes("p_partkey", part.select("p_partkey", F.col("p_type").alias("own")), by_name, by_brand)


@query(
    "ensemble_vote",
    f"""WITH {GAPS_SQL} SELECT *, CASE WHEN own = by_name OR own = by_brand THEN own WHEN by_name = by_brand THEN by_name
      ELSE by_brand END AS final,
    round(CASE WHEN own = by_name AND own = by_brand THEN 1 WHEN own = by_name OR own = by_brand OR by_name = by_brand
      THEN 2.0 / 3 ELSE 1 END, 6) AS confidence FROM g""",
)
def ensemble_vote(spark, sf):
    return votes.ensemble(vote_columns(spark, sf, True), "majority", "own", "by_name", "by_brand").withColumn(
        "confidence", r6("confidence")
    )


@query(
    "ensemble_weighted",
    f"""WITH {GAPS_SQL}, e AS (
      SELECT p_partkey, own AS label, 0.3 AS w, 0 AS pos FROM g UNION ALL
      SELECT p_partkey, by_name, 0.4, 1 FROM g UNION ALL SELECT p_partkey, by_brand, 0.3, 2 FROM g),
    s AS (SELECT p_partkey, label, sum(w) AS score, min(pos) AS pos FROM e WHERE label IS NOT NULL GROUP BY ALL)
    SELECT p_partkey, arg_min(label, (-score, pos)) AS final, round(max(score), 6)::DOUBLE AS confidence FROM s GROUP BY 1""",
)
def ensemble_weighted(spark, sf):
    voted = votes.ensemble(vote_columns(spark, sf, True), "weighted", "own", "by_name", "by_brand")
    return voted.select("p_partkey", "final", r6("confidence"))


# --- metrics: own type against the first type of the name ----------------------------------------


@query(
    "confusion_matrix",
    f"WITH {FIRST_SQL} SELECT own AS actual, by_name AS predicted, count(*) AS n FROM v GROUP BY ALL",
)
def confusion_matrix(spark, sf):
    return metrics.confusion(vote_columns(spark, sf), "own", "by_name")


METRICS_SQL = f"WITH {FIRST_SQL}, {sql_class_metrics('v', 'own', 'by_name')}"


@query(
    "class_metrics",
    f"""{METRICS_SQL} SELECT label, tp, support, predicted, round("precision", 6) AS "precision",
    round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cm""",
)
def class_metrics(spark, sf):
    labels = table(spark, sf, "part").select(F.col("p_type").alias("label")).distinct()
    found = metrics.class_metrics(vote_columns(spark, sf), "own", "by_name", labels)
    return found.select("label", "tp", "support", "predicted", r6("precision"), r6("recall"), r6("f1"))


@query(
    "overall_metrics",
    f"""{METRICS_SQL} SELECT sum(support)::BIGINT AS n_rows, round(sum(tp) / sum(support), 6) AS accuracy,
    round(sum(tp) / sum(predicted), 6) AS micro_precision, round(sum(tp) / sum(support), 6) AS micro_recall,
    round(2 * sum(tp) / (sum(support) + sum(predicted)), 6) AS micro_f1,
    round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
    round(sum(support * "precision") / sum(support), 6) AS weighted_precision,
    round(sum(support * recall) / sum(support), 6) AS weighted_recall,
    round(sum(support * f1) / sum(support), 6) AS weighted_f1 FROM cm""",
)
def overall_metrics(spark, sf):
    found = metrics.overall_metrics(vote_columns(spark, sf), "own", "by_name")
    return found.select("n_rows", *[r6(c) for c in found.columns if c != "n_rows"])


@query("weighted_f1", f"{METRICS_SQL} SELECT round(sum(support * f1) / sum(support), 6) AS weighted_f1 FROM cm")
def weighted_f1(spark, sf):
    return metrics.weighted_f1(vote_columns(spark, sf), "own", "by_name").select(r6("weighted_f1"))


LEVELS_SQL = (
    f"WITH tx AS ({TAXONOMY_SQL}), lv AS ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, '{level}' AS level, {title} AS actual,
        first_value({title}) OVER (PARTITION BY {key} ORDER BY row_id) AS predicted FROM tx"""
        for name, key in (("by_class", "ClassTitle"), ("by_family", "FamilyTitle"))
        for level, title in zip(LEVELS, TITLES)
    )
    + f"""), lk AS (SELECT dataset || '/' || level AS g, actual, predicted FROM lv),
    {sql_class_metrics('lk', 'actual', 'predicted', 'g')},
    f AS (SELECT split_part(g, '/', 1) AS dataset, split_part(g, '/', 2) AS level, sum(support * f1) / sum(support) AS w
      FROM cm GROUP BY g), s AS (SELECT dataset, avg(w) AS m FROM f GROUP BY dataset)
    SELECT dataset, level, round(w, 6) AS weighted_f1, round(m, 6) AS dataset_f1,
    round((SELECT avg(m) FROM s), 6) AS mean_f1 FROM f JOIN s USING (dataset)"""
)


@query("f1_by_level", LEVELS_SQL)
def f1_by_level(spark, sf):
    tax = taxonomy(spark, sf)
    pairs = {level: (title, f"first_{title}") for level, title in zip(LEVELS, TITLES)}
    frames = []
    for name, key in (("by_class", "ClassTitle"), ("by_family", "FamilyTitle")):
        firsts = tax.groupBy(key).agg(*[F.min_by(t, "row_id").alias(f"first_{t}") for t in TITLES])
        frames.append(metrics.long_levels(tax.join(firsts, key), name, pairs))
    found = metrics.f1_by_level(frames)
    return found.select("dataset", "level", r6("weighted_f1"), r6("dataset_f1"), r6("mean_f1"))


# --- baseline and split ----------------------------------------------------------------------------


@query(
    "dummy_most_frequent",
    """SELECT doc_id, (SELECT arg_min(lang, (-n, lang)) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)) AS label
    FROM documents""",
)
def dummy_most_frequent(spark, sf):
    docs = table(spark, sf, "documents")
    return baseline.baseline_predict(docs, "lang", docs, "doc_id", "most_frequent")


def sql_drawn(size: str) -> str:
    return f"""WITH c AS (SELECT lang, {size} AS n FROM documents GROUP BY lang),
    u AS (SELECT lang, sum(n) OVER (ORDER BY lang) AS upto FROM c), t AS (SELECT max(upto) AS total FROM u),
    d AS (SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * total AS spot FROM documents, t)
    SELECT doc_id, arg_min(lang, upto) AS label FROM d JOIN u ON spot < upto GROUP BY doc_id"""


@query("dummy_stratified", sql_drawn("count(*)"))
def dummy_stratified(spark, sf):
    docs = table(spark, sf, "documents")
    return baseline.baseline_predict(docs, "lang", docs, "doc_id", "stratified")


@query("dummy_uniform", sql_drawn("1"))
def dummy_uniform(spark, sf):
    docs = table(spark, sf, "documents")
    return baseline.baseline_predict(docs, "lang", docs, "doc_id", "uniform")


@query(
    "stratified_split",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS rank,
      count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, rank <= round(0.2 * n) AS is_test FROM r""",
)
def stratified_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return baseline.stratified_split(docs, "doc_id", "lang")


# --- taxonomy -----------------------------------------------------------------------------------------

EDGES_SQL = f"""tx AS ({TAXONOMY_SQL}),
e1 AS (SELECT '' AS parent_path, SegmentTitle AS label, min(row_id) AS first_row FROM tx GROUP BY ALL),
e2 AS (SELECT SegmentTitle AS parent_path, FamilyTitle AS label, min(row_id) AS first_row FROM tx GROUP BY ALL),
e3 AS (SELECT SegmentTitle || '::' || FamilyTitle AS parent_path, ClassTitle AS label, min(row_id) AS first_row FROM tx GROUP BY ALL),
e4 AS (SELECT SegmentTitle || '::' || FamilyTitle || '::' || ClassTitle AS parent_path, BrickTitle AS label,
  min(row_id) AS first_row FROM tx GROUP BY ALL)"""


def edge_table(spark, sf):
    return tree.edges(taxonomy(spark, sf), TITLES, "row_id")


@query(
    "taxonomy_edges",
    f"WITH {EDGES_SQL} " + " UNION ALL ".join(f"SELECT {i} AS level, parent_path, label, first_row FROM e{i}" for i in (1, 2, 3, 4)),
)
def taxonomy_edges(spark, sf):
    return edge_table(spark, sf)


@query(
    "taxonomy_sizes",
    f"WITH {EDGES_SQL} "
    + " UNION ALL ".join(f"SELECT '{level}' AS level, count(*) AS n_nodes FROM e{i + 1}" for i, level in enumerate(LEVELS)),
)
def taxonomy_sizes(spark, sf):
    return tree.sizes(edge_table(spark, sf))


# answers an item gets on its way down, derived from its own columns
ANSWERS = (
    "CASE WHEN p_size = 50 THEN 'no idea' WHEN p_size <= 40 THEN lower(p_type) END",
    "'```' || chr(10) || p_brand || chr(10) || '```'",
    "'The best label is ' || split_part(p_name, ' ', 1) || '.'",
    "CASE WHEN p_size > 25 THEN '' ELSE upper(split_part(p_name, ' ', 2)) END",
)


def sql_descent(choose) -> str:
    """CTEs ``k1..k4`` and ``d0..d4``; ``choose(depth)`` is the label expression over ``labels``."""
    ctes = [f"WITH {EDGES_SQL}"]
    for i in (1, 2, 3, 4):
        ctes.append(f"k{i} AS (SELECT parent_path, list(label ORDER BY first_row) AS labels FROM e{i} GROUP BY 1)")
    columns = ", ".join(f"{a} AS raw_{i + 1}" for i, a in enumerate(ANSWERS))
    ctes.append(f"d0 AS (SELECT p_partkey, p_name, {columns}, '' AS path FROM part)")
    for i, level in enumerate(LEVELS, start=1):
        path = f"coalesce(nullif(path, '') || '::', '') || predicted_{level}"
        ctes.append(
            f"c{i} AS (SELECT d{i - 1}.* EXCLUDE (path), path, CASE WHEN labels IS NULL THEN '' ELSE {choose(i)} END AS predicted_{level}"
            f" FROM d{i - 1} LEFT JOIN k{i} ON parent_path = path)"
        )
        ctes.append(
            f"d{i} AS (SELECT * REPLACE (CASE WHEN predicted_{level} <> '' THEN {path} END AS path) FROM c{i})"
        )
    return ",\n".join(ctes)


PREDICTED = ", ".join(f"predicted_{level}" for level in LEVELS)
DESCENT_SQL = sql_descent(lambda i: sql_resolve(f"raw_{i}", "labels"))
SCORE_DESCENT_SQL = sql_descent(
    lambda i: "list_reduce([{'s': -levenshtein(p_name, lower(x)), 'x': x} for x in labels], "
    "lambda a, b: CASE WHEN b.s > a.s THEN b ELSE a END).x"
)


def item_answers(spark, sf):
    """One row per item and level, then one row per item."""
    part = table(spark, sf, "part")
    cells = [F.struct(F.lit(i + 1).alias("level"), F.expr(a).alias("raw")) for i, a in enumerate(ANSWERS)]
    long = part.select("p_partkey", F.inline(F.array(*cells)))
    return tree.answers_wide(long, "p_partkey", "level", "raw")


def assigned(spark, sf):
    items = table(spark, sf, "part").select("p_partkey", "p_name").join(item_answers(spark, sf), "p_partkey", "left")
    kids = tree.children(edge_table(spark, sf))
    return tree.descend_answers(items, [f"raw_{i}" for i in (1, 2, 3, 4)], kids)


@query("hierarchical_assign", f"{DESCENT_SQL} SELECT p_partkey, {PREDICTED} FROM d4")
def hierarchical_assign(spark, sf):
    return assigned(spark, sf).select("p_partkey", *[f"predicted_{level}" for level in LEVELS])


def edit_score(label):
    return -F.levenshtein(F.col("p_name"), F.lower(label))


def scored_items(items, kids):
    found = tree.descend_scores(items.select("p_partkey", "p_name"), edit_score, kids)
    return found.select("p_partkey", *[f"predicted_{level}" for level in LEVELS])


@query("hierarchical_scores", f"{SCORE_DESCENT_SQL} SELECT p_partkey, {PREDICTED} FROM d4")
def hierarchical_scores(spark, sf):
    return scored_items(table(spark, sf, "part"), tree.children(edge_table(spark, sf)))


@query("result_views", f"{DESCENT_SQL} SELECT p_name, {PREDICTED} FROM d4")
def result_views(spark, sf):
    base = new_path(spark, "result_views")
    full, clean = tree.result_views(assigned(spark, sf), "p_name")
    full.write.parquet(f"{base}/full")
    spark.read.parquet(f"{base}/full").select(*clean.columns).write.parquet(f"{base}/clean")
    return spark.read.parquet(f"{base}/clean")


# --- validation: each part's own path, its brick respelled by size ---------------------------------------

BRICK_SQL = """CASE WHEN p_size <= 10 THEN upper(split_part(p_name, ' ', 2)) WHEN p_size <= 15
 THEN '(' || split_part(p_name, ' ', 2) || ')' WHEN p_size > 45 THEN 'other ' || split_part(p_name, ' ', 2)
 WHEN p_size = 45 THEN NULL ELSE split_part(p_name, ' ', 2) END"""
PATHS = {
    "predicted_segment": "CASE WHEN p_size <= 30 THEN lower(p_type) ELSE p_type END",
    "predicted_family": "CASE WHEN p_size <= 40 THEN replace(p_brand, '#', '') ELSE replace(p_brand, '#', '# ') END",
    "predicted_class": "split_part(p_name, ' ', 1)",
    "predicted_brick": BRICK_SQL,
}
PATH_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in PATHS.items())


def _key(c: str) -> str:
    return sql_match_key(f"coalesce({c}, '')")


VALIDATE_SQL = f"""WITH tx AS ({TAXONOMY_SQL}), pr AS (SELECT p_partkey, {PATH_COLUMNS} FROM part),
ex AS (SELECT BrickTitle AS brick, min(row_id) AS f, arg_min(SegmentTitle, row_id) AS s, arg_min(FamilyTitle, row_id) AS fa,
  arg_min(ClassTitle, row_id) AS c FROM tx GROUP BY 1),
bk AS (SELECT {sql_match_key('brick')} AS bkey, arg_min(s, f) AS s2, arg_min(fa, f) AS fa2, arg_min(c, f) AS c2 FROM ex GROUP BY 1),
ck AS (SELECT pr.*, CASE WHEN brick IS NOT NULL THEN 'exact' WHEN bkey IS NOT NULL THEN 'normalized' ELSE 'missing' END AS match_type,
  coalesce(s, s2) AS taxonomy_segment, coalesce(fa, fa2) AS taxonomy_family, coalesce(c, c2) AS taxonomy_class
  FROM pr LEFT JOIN ex ON brick = coalesce(predicted_brick, '') LEFT JOIN bk ON bkey = {_key('predicted_brick')}),
fl AS (SELECT *, match_type <> 'missing' AND {_key('predicted_segment')} = {_key('taxonomy_segment')} AS segment_match,
  match_type <> 'missing' AND {_key('predicted_family')} = {_key('taxonomy_family')} AS family_match,
  match_type <> 'missing' AND {_key('predicted_class')} = {_key('taxonomy_class')} AS class_match FROM ck),
al AS (SELECT *, segment_match AND family_match AND class_match AS all_match FROM fl)"""


def predictions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in PATHS.items()])


def checked_paths(spark, sf):
    return validate.check_paths(predictions(spark, sf), list(PATHS), taxonomy(spark, sf), TITLES, "row_id")


@query("validate_paths", f"{VALIDATE_SQL} SELECT * FROM al")
def validate_paths(spark, sf):
    return checked_paths(spark, sf)


@query("valid_rows", f"{VALIDATE_SQL} SELECT p_partkey, {', '.join(PATHS)} FROM al WHERE all_match")
def valid_rows(spark, sf):
    return validate.valid_rows(checked_paths(spark, sf), ["p_partkey", *PATHS])


def _pct(part: str, whole: str, name: str) -> str:
    return f"round({part} * 100.0::DOUBLE / nullif({whole}, 0), 1) AS {name}"


@query(
    "validation_stats",
    f"""{VALIDATE_SQL}, ct AS (SELECT count(*) AS total_rows, count(*) FILTER (match_type = 'exact') AS brick_found_exact,
    count(*) FILTER (match_type = 'normalized') AS brick_found_normalized, count(*) FILTER (match_type = 'missing') AS brick_not_found,
    count(*) FILTER (segment_match) AS segment_match, count(*) FILTER (family_match) AS family_match,
    count(*) FILTER (class_match) AS class_match, count(*) FILTER (all_match) AS all_match FROM al),
    bf AS (SELECT *, brick_found_exact + brick_found_normalized AS brick_found FROM ct)
    SELECT *, {', '.join(_pct(c, 'total_rows', f'{c}_pct') for c in
        ('brick_found', 'brick_found_exact', 'brick_found_normalized', 'brick_not_found'))},
    {', '.join(_pct(c, 'brick_found', f'{c}_pct') for c in ('segment_match', 'family_match', 'class_match', 'all_match'))},
    {_pct('all_match', 'total_rows', 'valid_pct')} FROM bf""",
)
def validation_stats(spark, sf):
    return validate.validation_stats(checked_paths(spark, sf))


@query(
    "validation_mismatches",
    f"{VALIDATE_SQL} SELECT * FROM al WHERE match_type <> 'missing' AND NOT all_match ORDER BY p_partkey LIMIT 5",
)
def validation_mismatches(spark, sf):
    return validate.mismatch_samples(checked_paths(spark, sf), "p_partkey")


@query("validate_empty", f"SELECT p_partkey, {PATH_COLUMNS} FROM part WHERE false")
def validate_empty(spark, sf):
    """No prediction has a known brick: the written result still has its columns."""
    path = new_path(spark, "validate_empty")
    unknown = predictions(spark, sf).withColumn("predicted_brick", F.concat(F.lit("no "), F.col("p_partkey")))
    checked = validate.check_paths(unknown, list(PATHS), taxonomy(spark, sf), TITLES, "row_id")
    validate.valid_rows(checked, unknown.columns).write.parquet(path)
    return spark.read.parquet(path)


# --- supervised -------------------------------------------------------------------------------------------


# titles that name all four levels, each by a word of two characters or more, so that each can be learned
TITLE_SQL = "concat(p_name, ' ', p_type, ' brand', lpad(split_part(p_brand, '#', 2), 2, '0'))"


def standard_parts(spark, sf):
    rows = taxonomy(spark, sf).toDF("row_id", *LEVELS)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.expr(TITLE_SQL).alias("text"))
    return rows.join(names, "row_id")


def english():
    return StopWordsRemover.loadDefaultStopWords("english")


def _train_and_predict(spark, sf, train):
    split = baseline.stratified_split(standard_parts(spark, sf), "row_id", "segment")
    models = train(split.where("not is_test"), "row_id", "text", LEVELS, english())
    return models.predict(split.where("is_test"), "row_id", "text", LEVELS)


# a trained model gets words of the title right
LEARNED_SQL = f"""WITH tx AS ({TAXONOMY_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY SegmentTitle ORDER BY md5('42:' || row_id)) AS rank,
  count(*) OVER (PARTITION BY SegmentTitle) AS n FROM tx)
SELECT row_id, {', '.join(f'{t} AS {v}, {t} AS predicted_{v}' for v, t in zip(LEVELS, TITLES))} FROM r WHERE rank <= round(0.2 * n)"""


@query("rf_levels")  # a forest may miss a row that SQL reads off the title: its splits and limits are tested in test_supervised
def rf_levels(spark, sf):
    return _train_and_predict(spark, sf, supervised.train_forest)


@query("svm_levels", LEARNED_SQL)
def svm_levels(spark, sf):
    return _train_and_predict(spark, sf, supervised.train_svm)


# two test sets whose columns have other names; some labels of the second one are another row's
MAPPED = ("Name", *TITLES)
CHECKED = ("translated_name", *[f"predicted_{v}" for v in LEVELS])
WRONG = {"SegmentTitle": "p_partkey % 10 = 3", "FamilyTitle": "p_size = 7", "ClassTitle": "p_partkey % 4 = 1", "BrickTitle": "p_size > 45"}
LABELS = dict(zip(TITLES, ("p_type", "p_brand", "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)")))
OTHERS = {t: f"CASE WHEN {WRONG[t]} THEN (SELECT min({e}) FROM part) ELSE {e} END" for t, e in LABELS.items()}


def _report_cells(dataset: str, source: str, labels: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}/{level}' AS g, {e} AS actual, {LABELS[t]} AS predicted FROM {source}"
        for level, (t, e) in zip(LEVELS, labels.items())
    )


REPORT_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('42:' || p_partkey)) AS rank,
  count(*) OVER (PARTITION BY p_type) AS n FROM part), held AS (SELECT * FROM r WHERE rank <= round(0.2 * n)),
lk AS ({_report_cells('validation', 'held', LABELS)} UNION ALL {_report_cells('mapped', 'part', LABELS)}
  UNION ALL {_report_cells('checked', 'part', OTHERS)}),
{sql_class_metrics('lk', 'actual', 'predicted', 'g')},
f AS (SELECT split_part(g, '/', 1) AS dataset, split_part(g, '/', 2) AS level, sum(support * f1) / sum(support) AS w FROM cm GROUP BY g),
s AS (SELECT dataset, avg(w) AS m FROM f GROUP BY dataset)
SELECT dataset, level, round(w, 6) AS weighted_f1, round(m, 6) AS dataset_f1,
  round((SELECT avg(m) FROM s WHERE dataset <> 'validation'), 6) AS mean_f1 FROM f JOIN s USING (dataset)"""


@query("supervised_report", REPORT_SQL)
def supervised_report(spark, sf):
    part = table(spark, sf, "part")
    firsts = {t: part.agg(F.min(F.expr(e))).first()[0] for t, e in LABELS.items()}
    title = F.expr(TITLE_SQL)
    mapped = part.select("p_partkey", title.alias(MAPPED[0]), *[F.expr(e).alias(c) for c, e in zip(MAPPED[1:], LABELS.values())])
    wrong = [F.when(F.expr(WRONG[t]), F.lit(firsts[t])).otherwise(F.expr(e)) for t, e in LABELS.items()]
    checked = part.select("p_partkey", title.alias(CHECKED[0]), *[e.alias(c) for c, e in zip(CHECKED[1:], wrong)])
    _, found = supervised_plan.train_and_score(
        supervised_plan.Dataset(standard_parts(spark, sf), "row_id", "text", LEVELS),
        {
            "mapped": supervised_plan.Dataset(mapped, "p_partkey", MAPPED[0], MAPPED[1:]),
            "checked": supervised_plan.Dataset(checked, "p_partkey", CHECKED[0], CHECKED[1:]),
        },
        lambda rows: supervised.train_svm(rows, "row_id", "text", LEVELS, english()),
    )
    return found.select("dataset", "level", r6("weighted_f1"), r6("dataset_f1"), r6("mean_f1"))


@query("constant_level", "SELECT p_partkey, 'part' AS predicted_table, NULL::VARCHAR AS predicted_type FROM part")
def constant_level(spark, sf):
    part = table(spark, sf, "part").withColumn("table", F.lit("part"))
    return part.select(
        "p_partkey",
        baseline.constant_prediction(part, "table").alias("predicted_table"),
        baseline.constant_prediction(part, "p_type").alias("predicted_type"),
    )


# --- encoders ------------------------------------------------------------------------------------------------


def sql_hash(source: str, doc: str, tag: str) -> str:
    """CTE ``h<tag>(doc, v)``: signed hashed counts in bucket order."""
    return f"""tk{tag} AS (SELECT {doc}, {'regexp_extract_all(lower(text), ' + chr(39) + '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}' + chr(39) + ')'} AS t FROM {source}),
gr{tag} AS (SELECT {doc}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk{tag}),
bk{tag} AS (SELECT {doc}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIMS} AS b,
  CASE WHEN substr(md5(term), 9, 1) >= '8' THEN -1 ELSE 1 END AS s FROM gr{tag}),
sm{tag} AS (SELECT {doc}, b, sum(s) AS x FROM bk{tag} GROUP BY ALL),
h{tag} AS (SELECT d.{doc}, list(coalesce(x, 0)::DOUBLE ORDER BY g.b) AS v FROM {source} d
  CROSS JOIN (SELECT unnest(range({DIMS})) AS b) g LEFT JOIN sm{tag} ON sm{tag}.{doc} = d.{doc} AND sm{tag}.b = g.b GROUP BY 1)"""


@query(
    "hash_embed",
    f"""WITH {sql_hash('documents', 'doc_id', '1')} SELECT doc_id,
    array_to_string(list_transform(v, lambda x: x::BIGINT), '|') AS counts,
    round(sqrt(list_inner_product(v, v)), 6) AS length FROM h1""",
)
def hash_embed(spark, sf):
    counts = enrich.hash_counts(documents(spark, sf), "doc_id", "text", DIMS)
    return counts.select(
        "doc_id",
        joined(F.col("vector").cast("array<bigint>").cast("array<string>")).alias("counts"),
        F.round(vectors.norm("vector"), 6).alias("length"),
    )


@query(
    "text_similarity_pairs",
    f"""WITH {sql_hash('documents', 'doc_id', '1')}, {sql_hash('benchmark', 'item_id', '2')},
    s AS (SELECT h1.doc_id, h2.item_id, CASE WHEN list_inner_product(h1.v, h1.v) * list_inner_product(h2.v, h2.v) = 0 THEN 0
      ELSE list_cosine_similarity(h1.v, h2.v) END AS score FROM h1, h2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(1 - score, 9), item_id) AS rank FROM s)
    SELECT doc_id AS item_id, item_id AS query_id, round(score, 6) AS score FROM r WHERE rank <= 3 AND score >= 0.05""",
)
def text_similarity_pairs(spark, sf):
    queries = enrich.hash_embed(table(spark, sf, "benchmark"), "item_id", "text", DIMS)
    items = enrich.hash_embed(documents(spark, sf), "doc_id", "text", DIMS)
    found = nearest.similar(
        items, queries.withColumnRenamed("item_id", "query_id"), "doc_id", "query_id", "vector", TOP_K, 0.05
    )
    return found.select("item_id", F.col("class_id").alias("query_id"), r6("score"))


@query(
    "text_similarity_terms",
    f"""{sql_stats(1)},
    wt AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS weight FROM st, nd),
    x0 AS (SELECT doc_id, term, tf * weight AS w FROM p JOIN wt USING (term)),
    x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x0),
    q0 AS (SELECT item_id, unnest({sql_tokens(sql_prep('text'))}) AS term FROM benchmark),
    q1 AS (SELECT item_id, term, count(*) * any_value(weight) AS w FROM q0 JOIN wt USING (term) GROUP BY ALL),
    q AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM q1)
    SELECT doc_id AS item_id, item_id AS query_id, round(sum(x.w * q.w), 6) AS score FROM x JOIN q USING (term)
    GROUP BY doc_id, item_id HAVING sum(x.w * q.w) >= 0.3""",
)
def text_similarity_terms(spark, sf):
    """All pairs of a document and a benchmark text at or above a cosine of term vectors."""
    found = similarity.similar_texts(documents(spark, sf), table(spark, sf, "benchmark"), "doc_id", "item_id", "text", 0.3)
    return found.select(F.col("item").alias("item_id"), F.col("query").alias("query_id"), r6("score"))


def text_measures():
    """A stand-in model: characters, words and distinct words of each text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        found = [(len(t), len(t.split()), len(set(t.split()))) for t in texts]
        return np.array(found, dtype=np.float32).reshape(len(texts), 3)

    return predict


@query(
    "embed_distinct_join",
    """SELECT doc_id, length(text) AS n_chars, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM
    (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""",
)
def embed_distinct_join(spark, sf):
    embedded = enrich.embed_column(table(spark, sf, "documents").select("doc_id", "text"), "text", text_measures)
    names = ("n_chars", "n_words", "n_distinct")
    return embedded.select(
        "doc_id", *[F.get("embedding", F.lit(i)).cast("long").alias(c) for i, c in enumerate(names)]
    )


def upper_model():
    """A stand-in translator."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([t.upper() for t in texts], dtype=object)

    return predict


@query("translate_distinct", "SELECT p_partkey, p_name, upper(p_name) AS translated_name FROM part")
def translate_distinct(spark, sf):
    return enrich.translate_column(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", upper_model)


# --- streams -----------------------------------------------------------------------------------------------------


@query("stream_classify", f"{SCORE_DESCENT_SQL} SELECT p_partkey, {PREDICTED} FROM d4")
def stream_classify(spark, sf):
    base = new_path(spark, "stream_classify")
    kids = tree.children(edge_table(spark, sf))
    stream = labelling.file_stream(spark, sf, table(spark, sf, "part").schema, "part.parquet")

    def start():
        return labelling.start_labelling(
            stream, lambda batch: scored_items(batch, kids), f"{base}/out", f"{base}/checkpoint"
        )

    labelling.drain(start)
    return labelling.labelled_rows(spark, f"{base}/out").drop("batch_id")


@query(
    "stream_batch_counts",
    "SELECT event_id % 4 AS batch_id, count(*) AS n_rows FROM events GROUP BY 1",
)
def stream_batch_counts(spark, sf):
    """One file per batch; the stream stops after the first two and starts again."""
    base = new_path(spark, "stream_batch_counts")
    events = table(spark, sf, "events")

    def start():
        stream = labelling.file_stream(spark, f"{base}/in", events.schema, files_per_batch=1)
        return labelling.start_labelling(
            stream, lambda batch: batch.select("event_id", "event_type"), f"{base}/out", f"{base}/checkpoint"
        )

    for last in (2, 4):
        for i in range(last - 2, last):
            events.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
        labelling.drain(start)
    return labelling.batch_counts(spark, f"{base}/out")


@query(
    "stream_progress",
    "SELECT event_id % 3 AS batch_id, count(*) AS n_rows FROM events GROUP BY 1",
)
def stream_progress(spark, sf):
    """The progress log of a stream that is started three times, with a file more each time."""
    base = new_path(spark, "stream_progress")
    events = table(spark, sf, "events")

    def start():
        stream = labelling.file_stream(spark, f"{base}/in", events.schema, files_per_batch=1)
        return labelling.start_labelling(stream, lambda batch: batch.select("event_id"), f"{base}/out", f"{base}/checkpoint")

    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
        with labelling.ProgressLog(spark, f"{base}/progress"):
            labelling.drain(start)
    return labelling.logged_progress(spark, f"{base}/progress").select("batch_id", "n_rows")
