"""Ensemble of three label columns: centroid, embedding and an answer column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import VOTE_WEIGHTS

STRATEGIES = ("majority", "weighted")


def join_votes(row_id: str, tfidf: DataFrame, cosine: DataFrame, answer: DataFrame) -> DataFrame:
    """The three predictions side by side; an item that lacks some has null votes there."""
    return tfidf.join(cosine, row_id, "full").join(answer, row_id, "full")


def ensemble(
    votes: DataFrame,
    strategy: str = "majority",
    tfidf: str = "tfidf",
    cosine: str = "cosine",
    answer: str = "answer",
) -> DataFrame:
    """Add ``final`` and ``confidence``.

    ``majority``: the label with two or more votes, else the answer with
    confidence 1. ``weighted``: the label with the largest sum of vote weights,
    ties to the earlier vote. A null vote agrees with no other and has no weight. Any other strategy takes the answer.
    """
    a, b, c = F.col(tfidf), F.col(cosine), F.col(answer)
    if strategy == "majority":
        agreed = F.when((a == b) | (a == c), a).when(b == c, b)
        n_equal = sum(F.coalesce((x == y).cast("int"), F.lit(0)) for x, y in ((a, b), (a, c), (b, c)))
        confidence = F.when(n_equal == 3, 1.0).when(n_equal == 1, 2.0 / 3.0).otherwise(1.0)
        return votes.withColumns({"final": F.coalesce(agreed, c), "confidence": confidence})
    if strategy != "weighted":
        return votes.withColumns({"final": c, "confidence": F.lit(1.0)})
    cast_votes = [(a, VOTE_WEIGHTS["tfidf"]), (b, VOTE_WEIGHTS["cosine"]), (c, VOTE_WEIGHTS["answer"])]
    # a label's score is the sum of the weights of the votes equal to it
    ranked = [
        F.when(
            label.isNotNull(),
            F.struct(
                F.round(sum(F.when(label == other, w).otherwise(0.0) for other, w in cast_votes), 9).alias("score"),
                F.lit(-place).alias("place"),
                label.alias("label"),
            ),
        )
        for place, (label, _) in enumerate(cast_votes)
    ]
    best = F.greatest(*ranked)
    return votes.withColumns({"final": best["label"], "confidence": best["score"]})
