"""The corpus pipeline: stages over documents, each one of the llm operators.

A stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import packing, personal, queries, simhash, substrings, toxicity
from wayfold.sources.shared import keep


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with `n_chars`, where it has that column, counted again."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the models know labels of the training rows only.

    Null and empty texts are judged as empty ones, rows of null or repeated ids
    each by its text; all columns stay.  No documents in, none out.
    """
    labels = queries.table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.train(docs, queries.training_labels(labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Null and empty texts are copies of each other; rows without an id stay, of
    rows that share an id one stays; all columns stay.  Empty in, empty out.
    """
    return simhash.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of earlier ones; those that repeat nothing keep their text as it is, null too.

    Rows without an id keep and take nothing; rows that share an id take
    nothing from each other; all columns stay.  Empty in, empty out.
    """
    return measured(substrings.without_repeats(docs))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; null texts stay null, all rows and columns stay.  Empty in, empty out."""
    found = personal.with_surrogates(docs, queries.SURROGATE_KEY)
    return measured(found).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training sequences; a null or empty text is its end alone, ids may be null or repeated.  Empty in, empty out."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substrings", drop_repeated_passages),
    ("personal", replace_personal),
    ("packing", pack_sequences),
]

#: SQL cannot express the toxicity models or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
