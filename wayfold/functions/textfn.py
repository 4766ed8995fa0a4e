"""Cells of count files, tokens and sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquoted(cell: Column) -> Column:
    return F.when(cell.startswith('"'), F.regexp_replace(cell, '^"(.*)"$', "$1")).otherwise(cell)


def is_integer(cell: Column) -> Column:
    """An optional minus and digits, nothing else."""
    return F.coalesce(cell.rlike("^-?[0-9]+$"), F.lit(False))


def is_count(cell: Column) -> Column:
    return F.coalesce(cell.rlike("^[0-9]+$"), F.lit(False))


def clean_counts(cells: Column) -> Column:
    """Cells that are no whole non-negative number become `0`; null if no cell is one."""
    bare = F.transform(F.transform(cells, unquoted), lambda c: F.when(is_count(c), c))  # each cell is judged once
    return F.element_at(F.transform(F.array(bare), lambda b: F.when(F.exists(b, lambda c: c.isNotNull()), F.transform(b, lambda c: F.coalesce(c, F.lit("0"))))), 1)


def sentiment_score(grade: Column) -> Column:
    """A grade of 0 to 4 as -1, 0 or 1: 2 and what is outside count 0."""
    return F.when(grade.isin(3, 4), 1).when(grade.isin(0, 1), -1).otherwise(0)


def sentences(text: Column) -> Column:
    """Trimmed, not empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would get the index as what to trim


def longest_sentence(text: Column) -> Column:
    """The first of the longest; null without sentences."""
    found = sentences(text)
    return F.aggregate(found, F.lit(None).cast("string"), lambda best, s: F.when(best.isNull() | (F.length(s) > F.length(best)), s).otherwise(best))


def lemma_set(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct lower-case words in order of appearance, without stop words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}']+"), lambda w: w != "")
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(stop)) if stop else words)


def with_tokens(old: Column, new: Column) -> Column:
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), new)


def text_sentiment(text: Column, grader: Callable[[Column], Column]) -> Column:
    """The score of the longest sentence by a grader of sentences; a text without one is graded 0."""
    found = longest_sentence(text)
    return sentiment_score(F.when(found.isNull(), 0).otherwise(grader(found)))


def id_of(fid: Column, kind: str = "tweet") -> Column:
    """A feature id of the kind, else null."""
    return F.when(F.split_part(fid, F.lit("-"), F.lit(1)) == kind, fid)
