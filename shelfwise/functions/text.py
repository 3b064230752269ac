"""Title cleaning, match keys, prompts and answer resolution as Columns.

Python's ``\\w``, ``\\d`` and ``\\s`` are Unicode-aware, Java's are not, and
Java's Unicode mode keeps combining marks that Python drops; hence the explicit
classes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.fixed_values import PREFIX_TEXT_SLOT, PROMPT_LABELS_SLOT, PROMPT_NAME_SLOT

# --- fixed values: character classes -------------------------------------------
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
ASCII_DIGITS = "0123456789"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

NORMALIZED = 64  # texts normalized at once

_SPACES = f"[{SPACE}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_spaces(c: Column | str) -> Column:
    """Whitespace runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), _SPACES, " "))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; an empty text gives an empty array."""
    return F.array_remove(F.split(collapse_spaces(c), " "), "")


# --- catalog cleaning -----------------------------------------------------------


def clean_delete(c: Column | str) -> Column:
    """Delete ASCII digits and punctuation; words around a separator fuse."""
    return F.lower(F.trim(F.translate(_col(c), ASCII_PUNCTUATION + ASCII_DIGITS, "")))


def clean_space(c: Column | str) -> Column:
    """Delete ASCII digits, turn each punctuation mark into one space.

    ``translate`` drops the characters that have no counterpart, so the digits
    go and the marks become spaces in a single pass.
    """
    return F.lower(
        F.trim(
            F.translate(
                _col(c), ASCII_PUNCTUATION + ASCII_DIGITS, " " * len(ASCII_PUNCTUATION)
            )
        )
    )


def clean_class(c: Column | str) -> Column:
    """Punctuation and separators to spaces, digits stay."""
    return F.lower(F.trim(F.regexp_replace(_col(c), rf"[^\p{{L}}\p{{N}}{SPACE}]", " ")))


@F.arrow_udf(T.StringType())
def _nfkc(c: pa.Array) -> pa.Array:
    def normalized(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    # some texts at a time: Python's strings take several times their bytes
    parts = [normalized(c.slice(i, NORMALIZED)) for i in range(0, len(c), NORMALIZED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def unicode_clean(c: Column | str) -> Column:
    """NFKC, without control and format characters, stripped.

    Spark has no NFKC. ASCII text is its own NFKC form, so only the other rows
    carry their text to the Arrow worker; the rest send a null.
    """
    c = _col(c)
    normalized = F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)
    return strip(F.regexp_replace(normalized, r"\p{C}", ""))


def drop_repeated_words(c: Column | str) -> Column:
    return F.array_join(F.array_distinct(words(c)), " ")


def strip_brand(c: Column | str, brands: Column) -> Column:
    """Remove every occurrence of the first brand found in the text.

    ``brands`` is an array column; ``operators.lookup.strip_brand_join`` takes a table.
    """
    c = _col(c)
    found = F.get(F.filter(brands, lambda b: F.contains(c, b)), F.lit(0))
    return F.when(found.isNull(), c).otherwise(F.replace(c, found, F.lit("")))


def strip_strings(c: Column | str, strings: Iterable[str] | Column) -> Column:
    """Remove each string in turn; a list folds into plain ``replace`` calls."""
    c = _col(c)
    if isinstance(strings, Column):
        return F.aggregate(strings, c, lambda text, s: F.replace(text, s, F.lit("")))
    return reduce(lambda text, s: F.replace(text, F.lit(s), F.lit("")), strings, c)


def strip_digits(c: Column | str) -> Column:
    """Delete digits inside words; an emptied word leaves its space behind."""
    return F.regexp_replace(collapse_spaces(c), f"{DIGIT}+", "")


def drop_digit_words(c: Column | str) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.rlike(DIGIT)), " ")


def strip_stopwords(c: Column | str, stopwords: Iterable[str]) -> Column:
    """Drop stopwords, except ``can``, which is also a container."""
    stop = sorted(set(stopwords) - {"can"})
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(stop)), " ")


def strip_punctuation(c: Column | str) -> Column:
    """Everything but word characters becomes single spaces."""
    return F.trim(F.regexp_replace(_col(c), f"[^{WORD}]+", " "))


def strip_separators(c: Column | str) -> Column:
    r"""``- _ / \ |`` and whitespace to single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(_col(c), rf"[-_/\\|{SPACE}]+", " ")))


def clean_text(c: Column | str) -> Column:
    """Punctuation, digits and extra spaces removed, lower case."""
    return F.lower(collapse_spaces(strip_digits(strip_punctuation(c))))


def join_non_empty(*parts: Column | str) -> Column:
    """The non-blank parts, stripped, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(strip(_col(p).cast("string")), F.lit("")) for p in parts])


def match_key(c: Column | str) -> Column:
    """Key under which two spellings of one title are equal; null gives ''."""
    spelled = F.lower(_col(c))
    for sign in ("&", "+"):
        spelled = F.replace(spelled, F.lit(sign), F.lit("and"))
    spaced = F.translate(spelled, "/-_", "   ")
    kept = F.regexp_replace(spaced, rf"[^{WORD}{SPACE}]", "")
    return F.coalesce(collapse_spaces(kept), F.lit(""))


# --- model text -------------------------------------------------------------------


def prep_ascii(c: Column | str) -> Column:
    """Lower case ASCII letters and digits, single spaces; null gives ''."""
    return F.coalesce(
        F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")), F.lit("")
    )


def prep_symbols(c: Column | str) -> Column:
    """As ``prep_ascii`` but keeps ``+ - / .``."""
    return F.coalesce(
        F.trim(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9+\-/.]+", " ")), F.lit("")
    )


def prep_model_text(c: Column | str) -> Column:
    """Lower case, single spaces; null gives ''."""
    return collapse_spaces(F.lower(F.coalesce(_col(c), F.lit(""))))


def prefix_text(c: Column | str, template: str) -> Column:
    return F.replace(F.lit(template), F.lit(PREFIX_TEXT_SLOT), _col(c))


def render_prompt(template: Column | str, name: Column, labels: Column) -> Column:
    """Fill a template (text, or a Column) with a product name and an array of labels."""
    template = F.lit(template) if isinstance(template, str) else template
    named = F.replace(template, F.lit(PROMPT_NAME_SLOT), name)
    return F.replace(named, F.lit(PROMPT_LABELS_SLOT), F.array_join(labels, "\n"))


def resolve_label(answer: Column | str, labels: Column | str) -> Column:
    """Turn a free-text answer into ``struct(label, match_kind)``.

    An answer is, in order: one of its lines (``exact``), the first label it
    contains (``contained``), its first line (``first_line``). A blank one gives
    the first label (``empty``).
    """
    answer, labels = _col(answer), _col(labels)
    first_label = F.coalesce(F.get(labels, F.lit(0)), F.lit(""))
    folded = F.lower(answer)
    lines = F.filter(
        F.transform(F.split(answer, "\n"), strip), lambda line: line != F.lit("")
    )
    bare = F.transform(lines, lambda line: strip(F.replace(line, F.lit("```"), F.lit(""))))
    exact = F.get(F.filter(bare, lambda line: F.array_contains(labels, line)), F.lit(0))
    contained = F.get(
        F.filter(labels, lambda label: F.contains(folded, F.lower(label))), F.lit(0)
    )
    first_line = F.get(bare, F.lit(0))
    blank = answer.isNull() | (answer == F.lit(""))

    def result(label: Column, kind: str) -> Column:
        return F.struct(label.alias("label"), F.lit(kind).alias("match_kind"))

    return (
        F.when(blank, result(first_label, "empty"))
        .when(exact.isNotNull(), result(exact, "exact"))
        .when(contained.isNotNull(), result(contained, "contained"))
        .when(first_line.isNotNull(), result(first_line, "first_line"))
        .otherwise(result(first_label, "empty"))
    )
