"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range, so
the sketch of a union is the union of sketches, and the share of one sketch
found in another estimates containment however unequal the documents are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import U64, Rolling, bounded_batches, emit, rows, thrifty, word_hashes

SHINGLE, KEPT = 5, 1 / 2


class Sketcher:
    def __init__(self, shingle: int = SHINGLE, fraction: float = KEPT) -> None:
        self.shingle, self.below, self.rolling = shingle, U64(int(fraction * 2**64) - 1), Rolling(0x9E3779B97F4A7C15)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The digest of the text and the retained hashes, ascending; a text of fewer words is one shingle."""
        data = text.encode()
        words = data.split()
        h = self.rolling(word_hashes(words), min(self.shingle, len(words))) if words else np.zeros(0, dtype=U64)
        return xxhash.xxh3_128_digest(data), np.unique(h[h <= self.below])


def written(sketch: tuple[bytes, np.ndarray]) -> str:
    """32 hex digits of the text's digest, a colon, 16 for each retained hash."""
    return f"{sketch[0].hex()}:{sketch[1].astype('>u8').tobytes().hex()}"


def read(fingerprint: str) -> tuple[bytes, np.ndarray]:
    digest, _, hashes = fingerprint.partition(":")
    return bytes.fromhex(digest), np.frombuffer(bytes.fromhex(hashes), dtype=">u8").astype(U64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def shared(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[float, float]:
    """Containment of the smaller sketch in the larger and resemblance, both 0 to 1.

    Equal texts have 1 for both; else a sketch that retained nothing has 0.  Of
    n different shingles none is retained once in 2**n, so few texts are that short.
    """
    if a[0] == b[0]:
        return 1.0, 1.0
    x, y = a[1], b[1]
    if not len(x) or not len(y):
        return 0.0, 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / min(len(x), len(y)), both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text counts as empty, repeated rows stay repeated."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        yield from emit(((doc, written(sketcher(text or ""))) for doc, text in rows(batches, "doc_id", "text")), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(thrifty(run), "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt in ranges of doc_id, each range led by the document before its first.

    Rows (bucket, doc_id, text, led), sorted within partitions by bucket, led
    first, then doc_id.  The smallest document is led by the largest.  A range
    holds about as many rows as any other; one row a range is doubled.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(own.stat.approxQuantile("place", [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    ids = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ids, place.to_numpy().astype(np.float64)).astype(np.int32))

    bucket = range_of("place")
    lasts = own.select("place", bucket.alias("bucket")).groupBy("bucket").agg(F.max("place").alias("place")).orderBy("bucket").collect()
    # one row a range at most: its last document also leads the next range that has rows
    leads = [(int(a["place"]), int(b["bucket"])) for a, b in zip(lasts, lasts[1:] + lasts[:1], strict=True)]
    lead = spark.createDataFrame(leads, "place long, leads int") if leads else spark.createDataFrame([], "place long, leads int")
    rows_of = own.withColumn("bucket", bucket).join(F.broadcast(lead), "place", "left")
    dealt = rows_of.select(
        "place", "doc_id", "text",
        F.explode(F.when(F.col("leads").isNull(), F.array(F.struct("bucket", F.lit(False).alias("led")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("led")), F.struct(F.col("leads").alias("bucket"), F.lit(True).alias("led"))))).alias("at"),
    ).select("at.bucket", "at.led", "place", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", F.col("led").desc(), "place", F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and that of its edited text, and how like they and the next document are.

    The next document is the one with the next smaller doc_id, after the
    smallest the largest; the edited text has the last floor(n_chars / 2) code
    points replaced by the first as many (or all) of the next document.
    Columns: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next (containment of the smaller sketch), alike_edited,
    alike_next (resemblance).  A null text counts as empty; null doc_ids come
    before all others; rows that share a doc_id are taken in order of a hash of
    their texts.  A single document is next to itself; empty in, empty out.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("alike_edited", pa.float64()), ("alike_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()

        def found() -> Iterator[tuple]:
            before, sketch_before = "", None
            for led, doc, text in rows(batches, "led", "doc_id", "text"):
                own = sketcher(text)
                if not led:
                    n = len(text)
                    edited = text[: n - n // 2] + before[: n // 2]
                    other = sketcher(edited)
                    near, alike = shared(own, other)
                    near_next, alike_next = shared(own, sketch_before)
                    yield doc, n, edited, written(own), written(other), near, near_next, alike, alike_next
                before, sketch_before = text, own

        yield from emit(found(), schema)

    kinds = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited double, alike_next double"
    return with_next(docs, id_col, text_col).select("led", "doc_id", "text").mapInArrow(thrifty(run), kinds)
