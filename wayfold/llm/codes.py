"""Token ids in files that give any of them without decoding a block: directly addressable codes.

An id is cut into chunks of bits, lowest first, one for each level of a
segment.  A level holds the chunks of the ids that reach it, packed one after
the other, and a bitmap that tells which of them go on in the next level.  The
place of an id's next chunk is the number of ones before it in the bitmap,
which a directory of counts every BLOCK bits gives at once.  The widths of the
levels are those that need the fewest bits for the segment's ids.

A file is Parquet with one row for each segment of consecutive documents, which
may be on any file system that Spark reads: columns of the levels, and which
documents it holds from where.  Files are in ascending order of doc_id by
`shard`, the rows of one by `segment`.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.words import bounded_batches, emit, thrifty
from wayfold.sources.shared import keep

#: Ids after which a segment ends with its document; bits between two counts of a directory.
SEGMENT, BLOCK = 1 << 18, 512
#: Bits of a level but the last, at least: narrower levels take more time than they save space.
LEAST_WIDTH = 5
#: Different words that a worker remembers from one batch or task to the next.
REMEMBERED = 700_000

LEVELS = "array<struct<width: int, chunks: binary, more: binary, ranks: binary>>"
FILE = f"shard int, segment int, first long, n long, doc_ids array<long>, starts array<long>, levels {LEVELS}"
LEVEL_TYPE = pa.struct([("width", pa.int32()), ("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
FILE_SCHEMA = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL_TYPE))])


def widths(ids: np.ndarray) -> list[int]:
    """Bits of each level so that all take the fewest: a chunk costs its bits, and one more unless it is in the last level."""
    length = np.frexp(ids.astype(np.float64))[1]
    reach = len(ids) - np.cumsum(np.bincount(length, minlength=33))  # ids that have a bit at k or above
    reach = [len(ids), *(int(n) for n in reach[1:])]
    top = max(1, int(length.max(initial=0)))
    best: dict[int, tuple[int, list[int]]] = {top: (0, [])}
    for k in reversed(range(top)):
        best[k] = min((reach[k] * (end - k + (end < top)) + best[end][0], [end - k, *best[end][1]]) for end in range(k + 1, top + 1) if end == top or end - k >= LEAST_WIDTH and top - end >= LEAST_WIDTH)
    return best[0][1]


def packed(values: np.ndarray, width: int) -> bytes:
    used = -(-width // 8)
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :used]), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpacked(data: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Chunks `begin` to `end`; only their bytes are looked at."""
    if end <= begin:
        return np.zeros(0, dtype=np.uint32)
    low, used = begin * width // 8, -(-width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[low : -(-end * width // 8)], bitorder="little")[begin * width - 8 * low :][: (end - begin) * width]
    whole = np.zeros((end - begin, 8 * used), dtype=np.uint8)
    whole[:, :width] = bits.reshape(-1, width)
    out = np.zeros((end - begin, 4), dtype=np.uint8)
    out[:, :used] = np.packbits(whole, axis=1, bitorder="little")
    return out.view("<u4").ravel()


def written(ids: np.ndarray) -> list[dict]:
    """The levels of a segment."""
    levels, shape = [], widths(ids)
    for k, width in enumerate(shape):
        level = {"width": width, "chunks": packed(ids & ((1 << width) - 1), width), "more": b"", "ranks": b""}
        ids = ids >> width
        if k + 1 < len(shape):
            on = ids > 0
            sums = np.add.reduceat(on, np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, dtype=np.int64)
            level |= {"more": np.packbits(on, bitorder="little").tobytes(), "ranks": np.concatenate(([0], np.cumsum(sums)))[:-1].astype("<u4").tobytes() if len(on) else b""}
            ids = ids[on]
        levels.append(level)
    return levels


class Codes:
    """Ids of a segment by their places."""

    def __init__(self, levels: list[dict]) -> None:
        self.levels = levels

    @staticmethod
    def rank(level: dict, at: int) -> int:
        """How many ids before place `at` of a level go on."""
        block = at // BLOCK
        if 4 * block >= len(level["ranks"]):  # just after the last
            block -= 1
        if block < 0:
            return 0
        known = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        begin = block * BLOCK // 8
        own = int.from_bytes(level["more"][begin : -(-at // 8)], "little") & ((1 << at - block * BLOCK) - 1)
        return known + own.bit_count()

    def at(self, place: int) -> int:
        """One id: a chunk and a rank for each of its levels."""
        value, shift = 0, 0
        for level in self.levels:
            width = level["width"]
            low = place * width
            own = int.from_bytes(level["chunks"][low // 8 : -(-(low + width) // 8)], "little") >> low % 8
            value |= (own & ((1 << width) - 1)) << shift
            shift += width
            if not level["more"] or not level["more"][place // 8] >> place % 8 & 1:
                break
            place = self.rank(level, place)
        return value

    def between(self, begin: int, end: int) -> np.ndarray:
        """The ids at `begin` to `end`, from their own chunks alone."""
        found = np.zeros(max(0, end - begin), dtype=np.uint32)
        here, shift = np.arange(len(found)), 0
        for level in self.levels:
            found[here] |= unpacked(level["chunks"], level["width"], begin, end) << np.uint32(shift)
            shift += level["width"]
            if not level["more"] or end <= begin:
                break
            here = here[unpacked(level["more"], 1, begin, end) > 0]
            begin, end = self.rank(level, begin), self.rank(level, end)
        return found


#: How byte-level vocabularies write bytes: printable ones as themselves, the others by number from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER_OF = dict(zip((b for b in range(256) if b not in PRINTED), range(256, 512), strict=False))


class WordEncoder:
    """Ids of texts by a tokenizer of the `tokenizers` library that lower-cases, drops white space and takes no piece across it.

    Texts are cut at ASCII white space and between a letter and an ASCII sign
    other than the apostrophe, where the tokenizer's own rule cuts too, and
    each different word goes to the library once.  A word of letters up to
    U+00FF, or of such signs alone, is one piece by that rule and goes to the
    library's model; every other goes through its whole chain, and so do whole texts that may
    hold an added token, before anything is lower-cased.
    """

    SIGNS = r"[!-&(-/:-@\[-`{-~]"
    LETTERS = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+|{SIGNS}+")
    CUT = f"([A-Za-zÀ-ÖØ-öø-ÿ])({SIGNS})"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = {}
        self.ends, self.ids = array("q", [0]), array("I")

    def learn(self, words: list[str]) -> None:
        """Puts words that aren't known yet behind those that are."""
        whole, tokenize, places, ends, ids = self.LETTERS.fullmatch, self.model.tokenize, self.places, self.ends, self.ids
        odd = []
        for word in words:
            if whole(word):
                places[word] = len(ends) - 1
                ids.extend([t.id for t in tokenize(word if word.isascii() else word.lower().encode().decode("latin-1").translate(LETTER_OF))])
                ends.append(len(ids))
            else:
                odd.append(word)
        for k in range(0, len(odd), 10_000):
            own = odd[k : k + 10_000]
            for word, found in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                places[word] = len(ends) - 1
                ids.extend(found.ids)
                ends.append(len(ids))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's end) of a column of texts; null is empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if not special.any():
            return self.plain(texts)
        ids, ends = self.plain(pc.if_else(pa.array(special), "", texts))
        at = np.flatnonzero(special)
        own = [e.ids for e in self.tokenizer.encode_batch_fast([texts[int(k)].as_py() for k in at], add_special_tokens=False)]
        where = np.repeat(ends[at], [len(x) for x in own])
        sizes = np.diff(ends)
        sizes[at] = [len(x) for x in own]
        return np.insert(ids, where, np.array([i for x in own for i in x], dtype=np.uint32)), np.concatenate(([0], np.cumsum(sizes)))

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > REMEMBERED:
            self.reset()
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), self.CUT, r"\1 \2"))
        offsets = words.offsets.to_numpy()
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        different, places = coded.dictionary.to_pylist(), self.places
        self.learn([w for w in different if w not in places])
        place = np.array([places[w] for w in different], dtype=np.int64)
        of_word = coded.indices.to_numpy()
        begins, sizes = (x[place][of_word].astype(np.int32) for x in (np.array(self.ends)[:-1], np.diff(np.array(self.ends))))
        stops = np.cumsum(sizes, dtype=np.int64)
        total = int(stops[-1]) if len(stops) else 0
        step = np.ones(total, dtype=np.int32)  # from each id to the next among those known
        some = np.flatnonzero(sizes)
        if len(some):
            first, last = begins[some], begins[some] + sizes[some] - 1
            step[(stops - sizes)[some]] = first - np.concatenate(([0], last[:-1]))
        found = np.array(self.ids, dtype=np.uint32)[np.cumsum(step, dtype=np.int32)] if total else np.zeros(0, dtype=np.uint32)
        return found, np.concatenate(([0], stops))[offsets - offsets[0]]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder, with the words that it remembers."""
    return WordEncoder(path)


def encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments (see FILE) of the ids of all documents, `end` after each, in ascending order of doc_id.

    Null texts count as empty; null doc_ids come first; rows that share a
    doc_id are in order of a hash of their texts.  A document lies in one
    segment.  Empty in, empty out.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # rows without an id or with a common one are dealt too
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer), TaskContext.get().partitionId()
        segment = first = n = 0
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        starts: list[int] = []

        def done() -> pa.RecordBatch:
            row = {"shard": shard, "segment": segment, "first": first, "n": n, "doc_ids": ids, "starts": starts, "levels": written(np.concatenate(held))}
            return pa.RecordBatch.from_pylist([row], schema=FILE_SCHEMA)

        for batch in batches:
            found, at = encoder(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                ids.append(doc)
                starts.append(n)
                held += [found[a:b], np.array([end], dtype=np.uint32)]
                n += b - a + 1
                if n >= SEGMENT:
                    yield done()
                    segment, first, n, held, ids, starts = segment + 1, first + n, 0, [], [], []
        if n:
            yield done()

    return dealt.mapInArrow(thrifty(run), FILE)


def write_codes(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files; see encoded()."""
    encoded(docs, tokenizer, end, id_col, text_col).write.option("compression", "uncompressed").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(path)


def with_start(segments: DataFrame) -> DataFrame:
    """Segments with `start`, the ids of all segments before them; what goes to every task is one row a shard."""
    shards = keep(segments.groupBy("shard").agg(F.sum("n").alias("n")), "shards")
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    known = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return segments.join(F.broadcast(known), "shard").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of every document of rows (start, n, doc_ids, starts, levels)."""
    for batch in batches:
        for row in range(batch.num_rows):
            start, n, docs, starts, levels = (c[row].as_py() for c in batch.select(["start", "n", "doc_ids", "starts", "levels"]).columns)
            every = Codes(levels).between(0, n)
            for doc, a, b in zip(docs, starts, [*starts[1:], n], strict=True):
                yield doc, start + a, every[a:b]


def _mapped(segments: DataFrame, name: str, kind: pa.DataType, of_ids: Callable[[np.ndarray], object]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(((doc, start, len(ids), of_ids(ids)) for doc, start, ids in _documents(batches)), schema)

    own = with_start(segments).select("start", "n", "doc_ids", "starts", "levels")
    return own.mapInArrow(thrifty(run), f"doc_id long, start long, n_tokens long, {name} {'binary' if pa.types.is_binary(kind) else 'long'}")


def documents_of(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the segments, with the ids of all documents before it counted in `start`; ids are little-endian unsigned 32-bit integers."""
    return _mapped(segments, "ids", pa.binary(), lambda ids: ids.astype("<u4").tobytes())


def digests_of(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): documents_of() with CRC-32 of the ids in their place."""
    return _mapped(segments, "ids_crc32", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def tokens_at(segments: DataFrame, places: DataFrame, column: str = "place") -> DataFrame:
    """(place, id): the id at each of the different places among all ids; places that none has go.

    Places meet segments by number of SEGMENT ids, of which a segment covers
    two or, with a very long document, more; only chunks of the ids asked for
    are read.
    """
    own = with_start(segments).where("n > 0")
    covered = F.sequence(F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("n") - 1) / SEGMENT))
    index = own.select("shard", "segment", "start", "n", F.explode(covered).alias("bin"))
    asked = places.select(F.col(column).cast("long").alias("place")).where("place >= 0").distinct().withColumn("bin", F.floor(F.col("place") / SEGMENT))
    met = asked.join(index, "bin").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n")))
    gathered = met.groupBy("shard", "segment", "start").agg(F.collect_list(F.col("place") - F.col("start")).alias("places"))  # at most the ids of a segment

    @F.pandas_udf("array<long>")
    def looked_up(levels: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([[codes.at(k) for k in own] for codes, own in zip((Codes(list(x)) for x in levels), at, strict=True)])

    read = gathered.join(segments.select("shard", "segment", "levels"), ["shard", "segment"]).select("start", "places", looked_up("levels", "places").alias("ids"))
    return read.select("start", F.explode(F.arrays_zip("places", "ids")).alias("x")).select((F.col("start") + F.col("x.places")).alias("place"), F.col("x.ids").alias("id"))
