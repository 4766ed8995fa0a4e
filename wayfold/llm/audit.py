"""Filter interaction audit: who survives every subset of filters, and in which order each filter removes what.

Each document gets a mask with one bit for each filter that it fails.  Counts
per part and mask are all that the audit needs: the subset-zeta transform turns
them into the documents that survive each subset of filters (those whose mask
lies inside the complement), and what a step of an order removes is the
difference between two neighbouring subsets.  Labelled documents are counted
and transformed likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import bounded_batches, emit, rows, thrifty
from wayfold.sources.shared import keep

CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


@dataclass
class Text:
    """What the filters look at; words are maximal runs of bytes other than 0x20 and 0x09-0x0D."""

    text: str

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()


#: Filters by letter: is a text to be removed?
FILTERS: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: len(t.words) < 200,
    "B": lambda t: 100 * len(set(t.words)) < 50 * len(t.words),
    "C": lambda t: 100 * (len(t.data) - len(t.data.translate(None, CAPITALS))) > 2 * len(t.text),
    "D": lambda t: len(t.data.translate(None, SIGNS)) < len(t.data),
}
#: The letter of the filter for texts that a smaller doc_id has too.
REPEAT = "E"


def masks(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", filters: dict[str, Callable[[Text], bool]] = FILTERS) -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails; bit k is the k-th filter's, the last bit stands for a repeated text.

    A text is a repeat if any row with a smaller doc_id has the same one,
    whether a filter removes that row or not; texts are compared by SHA-256.
    Rows without a doc_id are neither repeats nor make any.  Null texts count
    as empty, null parts as the empty string; repeated rows stay repeated.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])
    tests = list(filters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked() -> Iterator[tuple]:
            for doc, part, text in rows(batches, "doc_id", "part", "text"):
                t = Text(text or "")
                yield doc, part, hashlib.sha256(t.data).digest(), sum(test(t) << k for k, test in enumerate(tests))

        yield from emit(marked(), schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    marked = keep(own.mapInArrow(thrifty(run), "doc_id long, part string, digest binary, mask int"), "masks")
    named = marked.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("digest").alias("own"))
    # the first of its text is found by doc_id, as thousands of rows may share a digest; a doc_id has one row here for each of its texts that it is first of
    repeat = F.when(F.col("own").isNull(), F.lit(1 << len(tests))).otherwise(F.lit(0))
    judged = named.join(first.withColumn("digest", F.col("own")), ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + repeat).alias("mask"))
    return judged.unionByName(marked.where("doc_id is null").select("doc_id", "part", "mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled quality=1 and toxic=1, with each mask.

    A doc_id that `labels` holds several times is good or toxic if any of its
    rows says so; other values, nulls and rows without a doc_id say nothing.
    """
    told = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(told("quality").alias("good"), told("toxic").alias("toxic"))
    both = masked.where("doc_id is not null").join(known, "doc_id", "left").unionByName(masked.where("doc_id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}))
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Counts by mask to survivors by subset of filters, both 2**k numbers.

    The zeta transform adds, for one filter after the other, the count without
    its bit to that with it, after which entry U holds all masks inside U;
    those who survive a subset are the masks inside its complement.
    """
    k = (len(counts) - 1).bit_length()
    inside = counts.reshape((2,) * k)
    for axis in range(k):
        inside = np.cumsum(inside, axis=axis)
    return inside.ravel()[::-1]  # the complement of F is 2**k - 1 - F


def steps(counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """Rows of interactions(), without the part, from a part's counts by measure (n, good, toxic) and mask."""
    k, size = len(letters), counts.shape[1]
    left = np.stack([survivors(c) for c in counts])
    subset = np.arange(size)
    before = np.array([s.bit_count() for s in range(size)])
    fails, shapley = [], []
    for f in range(k):
        without = subset[subset >> f & 1 == 0]
        fails.append(int(counts[0].sum() - counts[0][without].sum()))
        orders = np.array([factorial(b) * factorial(k - 1 - b) for b in before[without].tolist()], dtype=object)  # that have this subset before filter f
        shapley.append(int((orders * (left[0][without] - left[0][without | 1 << f])).sum()))
    for order in permutations(range(k)):
        name, was = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            now = was | 1 << f
            kept, (removed, good, toxic) = int(left[0][now]), (left[:, was] - left[:, now]).tolist()
            yield name, step, kept, removed, fails[f] - removed, int(counts[0][1 << f]), good, toxic, shapley[f]
            was = now


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """For each part and order of the filters one row a step: what its filter removes and what it costs.

    `counts` is (part, mask, n, good, toxic).  Columns: part, filter_order,
    step (from 1), kept (after the step), removed (by it), redundant (failing
    its filter, removed earlier), unique_fails (failing its filter alone),
    good_lost, toxic_lost (labelled documents it removes), shapley (removed by
    its filter, summed over all orders).  A part has all its rows, zeros
    included; no counts, no rows.
    """
    size, measures = 1 << len(letters), ("n", "good", "toxic")
    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((n, pa.int64()) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for part, by_mask in rows(batches, "part", "by_mask"):
                own = np.zeros((len(measures), size), dtype=np.int64)
                for x in by_mask:
                    own[:, x["mask"]] = [x[m] for m in measures]
                for step in steps(own, letters):
                    yield part, *step

        yield from emit(found(), schema)

    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("by_mask"))  # at most 2**k entries
    return gathered.mapInArrow(run, kinds)


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", filters: dict[str, Callable[[Text], bool]] = FILTERS, repeat: str = REPEAT) -> DataFrame:
    """interactions() of `filters` and of removing repeated texts, named `repeat`; see masks() for odd rows.  Empty in, empty out."""
    return interactions(mask_counts(masks(docs, part_col, id_col, text_col, filters), labels, id_col), "".join(filters) + repeat)
