"""Column builders for text: words, tokens, sentences, counts and rounding as the analyzers need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores in any script.
WORD_RUN = r"[\p{L}\p{N}_]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def tokens(text: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))


def with_pairs(words: Column) -> Column:
    """An array of words and the pairs of words that follow each other in it. The array is read often: bind it."""
    n = F.size(words) - 1
    pairs = F.when(n > 0, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def latin_words(text: Column, least: int = 2) -> Column:
    """Lower-cased words that are wholly of unaccented letters, `least` or more."""
    run = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{run})[a-z]{{{least},}}+(?!{run})"), F.lit(0))


def letter_runs(text: Column) -> Column:
    """Lower-cased runs of three unaccented letters or more, wherever they stand."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed sentences, cut at white space after a full stop, exclamation or question mark; none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def half_even(x: Column, digits: int = 0) -> Column:
    """x as a double, rounded; ties go to the even digit. What a double can't tell from a tie (53.35 as 53.349999999999994) is one, as with DuckDB's round_even."""
    p = F.lit(10.0**digits)
    return F.rint(x.cast("double") * p) / p


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
