"""Text rewards and tokens as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special markers first, then words, then single symbols.
TOKEN_PATTERN = r"<\|[a-z]+\|>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERM_PATTERN = r"[\p{L}\p{N}]+"


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def terms(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased search terms, without the stop words."""
    words = tokens(F.lower(text), TERM_PATTERN)
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def unique_letters(text: Column) -> Column:
    """Number of distinct letters, case ignored."""
    letters = F.regexp_replace(F.lower(text), r"\P{L}+", "")
    return F.when(letters == "", 0).otherwise(F.size(F.array_distinct(F.split(letters, ""))))


def title_of(document: Column) -> Column:
    """The part of a corpus entry before the first space-bar-space."""
    return F.substring_index(document, " | ", 1)


def distinct_titles(facts: Column) -> Column:
    """The different ``key`` values of a claim's supporting facts."""
    return F.array_distinct(F.transform(facts, lambda fact: fact["key"]))


def title_recall(gold: Column, retrieved: Column) -> Column:
    """Distinct gold titles among the titles of the retrieved entries, over the gold list length."""
    titles = F.transform(retrieved, title_of)
    return F.try_divide(F.size(F.array_intersect(gold, titles)), F.size(gold))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (predicted == gold).cast("double")
