"""Tokens and word n-grams as arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import WORD


def tokenize(c: Column | str) -> Column:
    """Lower-case words of two or more word characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def drop_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    stop = sorted(set(stopwords))
    return F.filter(tokens, lambda w: ~w.isin(stop)) if stop else tokens


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """Word n-grams of ``low`` to ``high`` words.

    Neighbours are lined up with ``slice`` and zipped, which needs no index
    arithmetic and gives an empty array when there are too few words.
    """

    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        grams = F.slice(tokens, F.lit(1), count)
        for shift in range(1, n):
            grams = F.zip_with(
                grams,
                F.slice(tokens, F.lit(shift + 1), count),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        return grams

    sizes = [of_size(n) for n in range(low, high + 1)]
    return sizes[0] if len(sizes) == 1 else F.concat(*sizes)
