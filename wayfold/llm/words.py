"""Words, shingles and window hashes shared by the text operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what
`bytes.split()` returns; `bytes.lower()` changes A-Z only.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import SparkSession

U64 = np.uint64
#: Rows and bytes of texts that Spark hands to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets texts go to Python workers in batches that stay small when texts are long; a smaller setting of the session's own is kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns memory that this process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, after which the worker, which lives on idle, gives back the memory it no longer uses."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return running


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The named columns of each row as Python values, some hundred rows at a time."""
    for batch in batches:
        own = batch.select(list(columns))
        for k in range(0, own.num_rows, 500):
            yield from zip(*(c.to_pylist() for c in own.slice(k, 500).columns), strict=True)


def emit(found: Iterator[tuple], schema: pa.Schema, at_most: int = 20_000, mb: int = 16) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches of bounded length and bytes (of the text and binary cells)."""
    wide = [k for k, f in enumerate(schema) if pa.types.is_binary(f.type) or pa.types.is_string(f.type)]
    held: list[tuple] = []
    weight = 0
    for row in found:
        held.append(row)
        weight += sum(len(row[k] or b"") for k in wide)
        if len(held) >= at_most or weight > mb << 20:
            yield batch_of(held, schema)
            held, weight = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words) if not seed else (xxhash.xxh64_intdigest(w, seed) for w in words), dtype=U64, count=len(words))


#: Making one costs more than a small cell.
SQUEEZE, OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers by byte planes, of which all but the lowest are nearly empty."""
    return SQUEEZE.compress(np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T))


def opened(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(OPEN.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit numbers."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Rolling:
    """Hashes of every run of consecutive words, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def grown(self, n: int) -> None:
        if len(self.powers) < n:
            m = max(n, 2 * len(self.powers))
            for name, by in (("powers", self.base), ("inverses", self.inverse)):
                x = np.full(m, by, dtype=U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def __call__(self, h: np.ndarray, width: int) -> np.ndarray:
        """One hash for each start of `width` consecutive entries of `h`; none if `h` is shorter."""
        n = len(h)
        if n < width:
            return np.zeros(0, dtype=U64)
        self.grown(n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(h * self.powers[:n], out=total[1:])
        return mixed((total[width:] - total[: n - width + 1]) * self.inverses[: n - width + 1])
