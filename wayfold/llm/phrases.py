"""Phrases whose words keep together: collocations of two words and more.

1. Sketch.  Each task counts the phrases of its texts, as hashes, in a
   count-min sketch; the sketches are merged by adding their counters.  One bit
   a slot tells where a phrase may occur often enough: an upper bound, so none
   that does is lost.
2. Scan.  A task takes its texts in runs of bounded size.  The different
   phrases of a run that the sketch lets through, with all phrases inside them,
   are its candidates; they are compiled into Aho-Corasick automata, each
   phrase between delimiters, so that only whole words match and nothing
   matches across the end of a piece.  The automata count all overlapping
   matches in the run.
3. A run's counts are dealt to buckets by the phrases' hashes and sent as
   compressed parcels, one for each bucket.  A bucket's parcels are opened one
   after another, the counts summed and thresholds applied; what the sketch
   let through in error goes here.  Scores are joins of counted phrases.

The sketch is sized by the corpus up to MAX_SLOTS; beyond that it fills up and
lets more phrases through to step 2, which stays exact and bounded by its run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.words import U64, bounded_batches, emit, mixed, opened, rows, squeezed, thrifty, word_hashes
from wayfold.sources.shared import keep

UNKNOWN = "und"
#: A-Z to a-z, the ends of pieces to a line feed, tab to space.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + 9 * b"\n" + b" ")
BREAK = b"\n"
#: Bytes of text in a run, of all runs that a task is gathering, and letters of the candidates in one automaton.
RUN, GATHERED, LETTERS = 4 << 20, 8 << 20, 1_000_000
#: Slots of the sketch: one bit of each goes to every task, 64 MB at most.  Segments that are merged on their own.
MIN_SLOTS, MAX_SLOTS, SEGMENTS = 1 << 16, 1 << 29, 256
FLUSH = 8_000_000
#: Counts of a bucket that are opened before they are summed.
OPENED = 1_000_000


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) with BREAK after each piece, in runs of about RUN bytes; a run ends with a piece."""
    held: dict[str, tuple[list[bytes], int]] = {}
    total = 0
    for lang, text in rows(batches, "lang", "text"):
        words, size = held.get(lang, ([], 0))
        for piece in (text or "").encode().translate(PLAIN).split(BREAK):
            if own := piece.split():
                words += own
                words.append(BREAK)
                size += len(piece)
                total += len(piece)
                if size >= RUN:
                    yield lang, words
                    words, size, total = [], 0, total - size
        held[lang] = words, size
        if total >= GATHERED:  # many languages at once: the largest goes first
            most = max(held, key=lambda x: held[x][1])
            words, size = held.pop(most)
            yield most, words
            total -= size
    for lang, (words, _) in held.items():
        if words:
            yield lang, words


class Run:
    """The phrases of a run: entry w - 1 of each list is about phrases of w words, by where they begin."""

    def __init__(self, lang: str, words: list[bytes], most: int) -> None:
        coded = pa.array(words, type=pa.binary()).dictionary_encode()
        self.words, self.ids = words, coded.indices.to_numpy().astype(np.int64)
        different = coded.dictionary.to_pylist()
        h = word_hashes(different, xxhash.xxh64_intdigest(lang) | 1)[self.ids]
        inside = self.ids != different.index(BREAK)
        self.whole, self.hashes = [inside], [mixed(h)]
        for w in range(1, most):
            n = len(words) - w
            self.whole.append(self.whole[-1][:n] & inside[w:] if n > 0 else np.zeros(0, dtype=bool))
            self.hashes.append(mixed(self.hashes[-1][:n] * U64(0x9E3779B97F4A7C15) + h[w:]) if n > 0 else np.zeros(0, dtype=U64))

    def candidates(self, known: Sketch) -> Iterator[tuple[bytes, int]]:
        """The different phrases that may be frequent, as their parts then are too, with their hashes."""
        before, key = None, np.zeros(len(self.ids), dtype=np.int64)
        for w, (whole, h) in enumerate(zip(self.whole, self.hashes, strict=True)):
            n = len(whole)
            at = np.flatnonzero(whole if before is None else whole & before[:n] & before[1 : n + 1])
            at = at[known.often(h[at])]
            likely = np.zeros(n, dtype=bool)
            likely[at] = True
            before = np.append(likely, False)
            # equal phrases by their words' numbers, made dense after each word
            key = key[:n] * np.int64(len(self.ids) + 1) + self.ids[w : w + n]
            _, first, dense = np.unique(key[at], return_index=True, return_inverse=True)
            key = np.zeros(n, dtype=np.int64)
            key[at] = dense
            for k, own in zip(at[first].tolist(), h[at[first]].tolist(), strict=True):
                yield b" ".join(self.words[k : k + w + 1]), own


def slots_for(letters: int, most: int) -> int:
    """A power of two, about two for each phrase of several words that so many letters can hold, within the bounds."""
    need = max(MIN_SLOTS, letters // 6 * (most - 1))
    return min(MAX_SLOTS, 1 << (need - 1).bit_length())


def gaps(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ascending places and counts (at most 255) as bytes: low and high bytes of the gaps between places, which compress well apart, and counts.

    A gap of 65,535 or more is filled up with places that count 0.
    """
    gap = np.diff(at, prepend=0)
    fill = gap // 65535
    if fill.any():
        n = np.insert(n, np.repeat(np.arange(len(n)), fill), 0)
        gap = np.insert(gap % 65535, np.repeat(np.arange(len(gap)), fill), 65535)
    return (gap & 255).astype(np.uint8).tobytes(), (gap >> 8).astype(np.uint8).tobytes(), n.astype(np.uint8).tobytes()


def places(low: bytes, high: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What gaps() was given; places that fill up count 0."""
    gap = np.frombuffer(low, np.uint8) + (np.frombuffer(high, np.uint8).astype(np.int64) << 8)
    return np.cumsum(gap), np.frombuffer(n, np.uint8)


def _sketch(batches: Iterator[pa.RecordBatch], most: int, slots: int) -> Iterator[pa.RecordBatch]:
    """This task's counters that aren't zero: (segment, low, high, n), see gaps()."""
    schema, held, size = pa.schema([("segment", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())]), [], 0
    width = slots // SEGMENTS

    def flush() -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        at, n = every[first], np.minimum(np.diff(first, append=len(every)), 255).astype(np.uint8)
        ends = np.searchsorted(at, np.arange(SEGMENTS + 1) * width).tolist()
        yield from emit(((k, *gaps(at[a:b].astype(np.int64) - k * width, n[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a), schema)

    for lang, words in runs(batches):
        run = Run(lang, words, most)
        for whole, h in zip(run.whole, run.hashes, strict=True):
            if whole.any():
                held.append((h[whole] & U64(slots - 1)).astype(np.uint32))
                size += len(held[-1])
        if size > FLUSH:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def _merged(batches: Iterator[pa.RecordBatch], least: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Adds the counters of each segment, whose rows follow each other; per segment one bit a slot, packed: may a phrase occur `least` times?

    A task's counter stops at 255, which is as good as more for a `least` up to there.
    """
    schema = pa.schema([("segment", pa.int64()), ("often", pa.binary())])

    def added() -> Iterator[tuple]:
        now, total = None, None
        done = lambda: (now, zlib.compress(np.packbits(total >= min(least, 255)).tobytes(), 1))
        for segment, *own in rows(batches, "segment", "low", "high", "n"):
            if segment != now:
                if now is not None:
                    yield done()
                now, total = segment, np.zeros(slots // SEGMENTS, dtype=np.uint32)
            at, n = places(*own)
            total[at[n > 0]] += n[n > 0]
        if now is not None:
            yield done()

    yield from emit(added(), schema)


class Sketch:
    """The merged sketch's answer: may a phrase be frequent?"""

    def __init__(self, slots: int, segments: list[tuple[int, bytes]]) -> None:
        self.slots, self.bits = slots, np.zeros(slots // 8, dtype=np.uint8)
        size = slots // SEGMENTS // 8
        for segment, often in segments:
            self.bits[segment * size : (segment + 1) * size] = np.frombuffer(zlib.decompress(often), np.uint8)

    def often(self, h: np.ndarray) -> np.ndarray:
        s = (h & U64(self.slots - 1)).astype(np.int64)
        return (self.bits[s >> 3] >> (7 - (s & 7)) & 1).astype(bool)


def matches(text: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs in a text whose words all stand between single spaces, overlaps included."""
    automaton = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", k)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), dtype=np.int64), minlength=len(phrases))


PARCELS = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])
PARCEL_KINDS = "bucket int, lang string, phrases binary, counts binary"


def _scan(batches: Iterator[pa.RecordBatch], most: int, buckets: int, sketch) -> Iterator[pa.RecordBatch]:
    """Parcels of the candidates of each run with their matches, and of the empty phrase with the run's words."""

    def found() -> Iterator[tuple]:
        for lang, words in runs(batches):
            run = Run(lang, words, most)
            yield from parcels(lang, [""], [0], run.whole[0].sum(keepdims=True), buckets)
            text, held, hashes, size = f" {b' '.join(words).decode()} ", [], [], 0
            for phrase, h in run.candidates(sketch.value):
                held.append(phrase.decode())
                hashes.append(h)
                size += len(held[-1])
                if size >= LETTERS:
                    yield from parcels(lang, held, hashes, matches(text, held), buckets)
                    held, hashes, size = [], [], 0
            if held:
                yield from parcels(lang, held, hashes, matches(text, held), buckets)

    yield from emit(found(), PARCELS)


def parcels(lang: str, phrases: list[str], hashes: list[int], n: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, lang, phrases, counts): phrases are apart by line feeds, which none holds, and stay in their order, in which many begin like the one before."""
    bucket = (np.array(hashes, dtype=U64) >> U64(32)) % U64(buckets)
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1):
        yield int(bucket[own[0]]), lang, zstandard.compress("\n".join(phrases[k] for k in own.tolist()).encode(), 3), squeezed(n[own], "<i8")


def unpacked(phrases: bytes, counts: bytes) -> pa.Table:
    """(phrase, n) of a parcel."""
    said, n = np.frombuffer(zstandard.decompress(phrases), np.uint8), opened(counts, "<i8")
    ends = np.append(np.flatnonzero(said == ord("\n")), len(said)) - np.arange(len(n))
    offsets = np.append(0, ends).astype(np.int32)
    return pa.table({"phrase": pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(said[said != ord("\n")].tobytes())), "n": n})


TOLD = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The sums of each bucket and language, whose parcels follow each other: those of `least` and more, and the empty phrase's."""

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).rename_columns(["phrase", "n"])

    def done(lang: str, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        total = added(held)
        total = total.filter(pc.or_(pc.greater_equal(total["n"], least), pc.equal(total["phrase"], "")))
        yield from pa.table([pa.array([lang] * len(total), pa.string()), *total.columns], schema=TOLD).to_batches(20_000)

    now, held, size, most = None, [], 0, OPENED
    for bucket, lang, *own in rows(batches, "bucket", "lang", "phrases", "counts"):
        if (bucket, lang) != now:
            if held:
                yield from done(now[1], held)
            now, held, size, most = (bucket, lang), [], 0, OPENED
        held.append(unpacked(*own))
        size += len(held[-1])
        if size > most:
            held = [added(held)]
            size, most = len(held[0]), len(held[0]) + OPENED
    if held:
        yield from done(now[1], held)


def phrase_counts(docs: DataFrame, least: int = 10, most_words: int = 3, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, n): every phrase of at most `most_words` words that occurs `least` times or more in a language, and how often.

    A-Z are lower-cased; texts fall into pieces at any of `.,;:!?` and
    0x0A-0x0D, these into words at spaces and tabs; a phrase lies within a
    piece.  The empty phrase counts all words of its language, whatever its
    number.  Null languages count as `und`, null texts as empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    slots = slots_for(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0, most_words)
    partial = own.mapInArrow(thrifty(lambda it: _sketch(it, most_words, slots)), "segment long, low binary, high binary, n binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(thrifty(lambda it: _merged(it, least, slots)), "segment long, often binary")
    sketch = spark.sparkContext.broadcast(Sketch(slots, [tuple(r) for r in merged.collect()]))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # parcels compress worse the smaller they are
    found = own.mapInArrow(thrifty(lambda it: _scan(it, most_words, buckets, sketch)), PARCEL_KINDS)
    summed = found.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(thrifty(lambda it: _summed(it, least)), "lang string, phrase string, n long")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1)
    return summed.select("lang", "phrase", words.cast("int").alias("words"), "n")


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, top: int = 2000, inside_percent: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of several words by how much they keep together.

    a is how often the phrase occurs, n how many words the language has.  Cut
    after its first k words, l and r are how often the two parts occur and its
    score is floor(1000000 * a * a / (l * r)), in exact arithmetic; the lowest
    counts, the smallest k among equals.  A phrase inside a longer one that
    occurs at least `inside_percent` as often is left out.  Ranks are by score
    and a, both descending, and phrase in byte order.  See phrase_counts() for
    words, pieces and odd rows.  Empty in, empty out.
    """
    counts = keep(phrase_counts(docs, least, most_words, lang_col, text_col), "phrases")
    of = lambda name, n: counts.where(f"words between 1 and {most_words - 1}").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    many = counts.where("words > 1")
    said = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(said, start, size), " ")
    spans = [(i, w) for w in range(2, most_words) for i in range(1, most_words)]
    inner = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), (F.col("words") >= i + w - 1).alias("fits"), part(F.lit(i), F.lit(w)).alias("phrase")) for i, w in spans]), lambda x: x["fits"] & (x["w"] < F.col("words"))) if spans else F.array().cast("array<struct<w: int, fits: boolean, phrase: string>>")
    longer = many.where("words > 2").select("lang", "n", F.explode(inner).alias("inner")).groupBy("lang", F.col("inner.phrase").alias("phrase")).agg(F.max("n").alias("longest"))
    own = many.withColumnRenamed("n", "a").join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside_percent * F.col("a")))
    # a cut is told by its two parts, which make up the phrase
    cuts = own.select("lang", "a", "words", said.alias("said"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "a", F.col("k").cast("byte").alias("k"), F.array_join(F.slice("said", F.lit(1), F.col("k")), " ").alias("front"), F.array_join(F.slice("said", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    scored = cuts.join(of("front", "l"), ["lang", "front"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r)")
    lowest = scored.groupBy("lang", F.concat_ws(" ", "front", "rest").alias("phrase"), "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    ranked = lowest.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
