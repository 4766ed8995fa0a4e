"""Removal of word passages that an earlier document already holds.

A window is `width` consecutive words.  A word goes if some window over it also
starts in a document with a smaller id.

1. Sketch.  Every window is described by its anchor: the run of ANCHOR words
   with the smallest hash inside it.  Equal windows have equal anchors, so the
   number of documents that hold an anchor is never below that of any of its
   windows.  Each task counts anchors, once per document, in a count-min
   sketch; the partition sketches are merged by adding their counters.
2. Candidates.  Only windows whose anchor the merged sketch puts in two or more
   documents go on; it overestimates, so no repeated window is lost.  A row
   holds the consecutive windows of one document that share an anchor.
3. Exact grouping.  Equal windows meet under their anchor, and the smallest
   document of each is found from 96-bit window hashes.  Anchors that the
   sketch finds very frequent are not gathered: the minima of their windows
   are taken map-side first, and the most frequent windows, no more than
   MOST_SENT, go to every task; the rest, none of which is frequent, is joined.
4. The covered spans are joined to the documents once.

The sketch is sized by the corpus up to MAX_SLOTS; beyond that it fills up and
lets more windows through to step 3, which stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import U64, Rolling, batch_of, bounded_batches, emit, mixed, rows, thrifty, word_hashes
from wayfold.sources.shared import keep

ANCHOR = 16
#: Slots of each of the sketch's two rows: two bits of each go to every task, 64 MB at most.
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 27
#: Slots that one merging step holds, and the estimate from which an anchor is very frequent.
SEGMENT, FREQUENT = 1 << 16, 256
#: Windows that are sent to every task at once, 20 bytes each.
MOST_SENT = 1_000_000
TALLY = np.dtype([("h", "<u8"), ("c", "<u4")])


class Windows:
    """The windows of a document, as hashes, and their anchors."""

    def __init__(self, width: int) -> None:
        self.width, self.anchor = width, min(ANCHOR, width)
        self.small, self.first, self.second = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F), Rolling(0x165667B19E3779F9)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of each window."""
        runs = self.small(h, self.anchor)
        span = self.width - self.anchor + 1
        low = runs  # minima over spans of doubling length
        done = 1
        while done < span:
            step = min(done, span - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        return low

    def tallies(self, h: np.ndarray) -> np.ndarray:
        found = np.empty(len(h) - self.width + 1, dtype=TALLY)
        found["h"] = self.first(h, self.width)
        found["c"] = (self.second(h, self.width) >> U64(32)).astype("<u4")
        return found


def slots_for(letters: int) -> int:
    """A power of two at least 4 times the anchors that so many letters can hold, within the bounds."""
    need = max(MIN_SLOTS, letters // 20)
    return min(MAX_SLOTS, 1 << (need - 1).bit_length())


def slot(anchor: np.ndarray, row: int, slots: int) -> np.ndarray:
    return (mixed(anchor + U64(row)) & U64(slots - 1)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, slots: int) -> Iterator[pa.RecordBatch]:
    """This task's counters that aren't zero: (row, segment, positions, counts)."""
    windows, held, size = Windows(width), [], 0
    schema = pa.schema([("segment", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])

    def flush() -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        for row in (0, 1):
            at, n = np.unique(slot(every, row, slots), return_counts=True)
            cuts = np.nonzero(np.diff(at // SEGMENT))[0] + 1
            out = [((row * slots + int(a[0])) // SEGMENT, (a % SEGMENT).astype("<u2").tobytes(), np.minimum(c, 65535).astype("<u2").tobytes()) for a, c in zip(np.split(at, cuts), np.split(n, cuts), strict=True)]
            yield batch_of(out, schema)

    for (text,) in rows(batches, "text"):
        words = (text or "").encode().split()
        if len(words) >= width:
            held.append(np.unique(windows.anchors(word_hashes(words))))
            size += len(held[-1])
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counters of each segment; per segment the slots at 2 or more, and at FREQUENT or more, as bits."""
    schema = pa.schema([("segment", pa.int64()), ("two", pa.binary()), ("many", pa.binary())])

    def added() -> Iterator[tuple]:
        now, total = None, None

        def done() -> tuple:
            return now, np.packbits(total >= 2).tobytes(), np.packbits(total >= FREQUENT).tobytes()

        for segment, at, n in rows(batches, "segment", "at", "n"):
            if segment != now:
                if now is not None:
                    yield done()
                now, total = segment, np.zeros(SEGMENT, dtype=np.int64)
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u2")
        if now is not None:
            yield done()

    yield from emit(added(), schema)


class Sketch:
    """The merged sketch's answers: is an anchor in two or more documents, is it in very many?"""

    def __init__(self, slots: int, segments: list[tuple[int, bytes, bytes]]) -> None:
        self.slots = slots
        self.bits = {name: np.zeros(max(2 * slots, SEGMENT) // 8, dtype=np.uint8) for name in ("two", "many")}
        for segment, two, many in segments:
            at = segment * SEGMENT // 8
            self.bits["two"][at : at + SEGMENT // 8] = np.frombuffer(two, np.uint8)
            self.bits["many"][at : at + SEGMENT // 8] = np.frombuffer(many, np.uint8)

    def at_least(self, which: str, anchor: np.ndarray) -> np.ndarray:
        bits, found = self.bits[which], np.ones(len(anchor), dtype=bool)
        for row in (0, 1):
            s = slot(anchor, row, self.slots) + row * self.slots
            found &= (bits[s >> 3] >> (7 - (s & 7)) & 1).astype(bool)
        return found


def _candidates(batches: Iterator[pa.RecordBatch], width: int, sketch) -> Iterator[pa.RecordBatch]:
    """(anchor, frequent, doc_id, text_hash, start, n, tallies) for the windows that the sketch lets through."""
    windows, known = Windows(width), sketch.value
    schema = pa.schema([("anchor", pa.int64()), ("frequent", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("tallies", pa.binary())])

    def found() -> Iterator[tuple]:
        for doc, text, text_hash in rows(batches, "doc_id", "text", "text_hash"):
            words = (text or "").encode().split()
            if doc is None or len(words) < width:
                continue
            h = word_hashes(words)
            anchors = windows.anchors(h)
            cuts = np.append(np.nonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))[0], len(anchors))
            own = anchors[cuts[:-1]]
            two = known.at_least("two", own)
            if not two.any():
                continue
            many, tallies = known.at_least("many", own), windows.tallies(h)
            for k in np.nonzero(two)[0].tolist():
                a, b = int(cuts[k]), int(cuts[k + 1])
                yield int(own[k].view(np.int64)), bool(many[k]), doc, text_hash, a, tallies[a:b].tobytes()

    yield from emit(found(), schema)


def unpacked(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of rows (anchor, doc_id, text_hash, start, tallies), how many each row has, and their documents."""
    every = np.frombuffer(b"".join([x[4] for x in held]), dtype=TALLY)
    counts = np.array([len(x[4]) // TALLY.itemsize for x in held])
    return every, counts, np.repeat(np.array([x[1] for x in held], dtype=np.int64), counts)


def runs(held: list[tuple], counts: np.ndarray, gone: np.ndarray, width: int) -> Iterator[tuple]:
    """The word spans under the windows of `held` that are gone."""
    row = np.repeat(np.arange(len(held)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.nonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (gone[1:] != gone[:-1]))))[0]
    stops = np.append(starts[1:], len(row))
    for a, b in zip(starts[gone[starts]].tolist(), stops[gone[starts]].tolist(), strict=True):
        _, doc, text_hash, start, _ = held[row[a]]
        yield doc, text_hash, start + int(place[a]), start + int(place[b - 1]) + width


SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, first, n): smallest document and number of rows of each window, one row for each batch that has it."""
    for batch in batches:
        held = list(rows([batch], "anchor", "doc_id", "text_hash", "start", "tallies"))
        if not held:
            continue
        every, _, doc = unpacked(held)
        order = np.lexsort((doc, every["c"], every["h"]))
        h, c = every["h"][order], every["c"][order]
        at = np.nonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))[0]
        n = np.diff(np.append(at, len(h)))
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at].astype(np.int64)), pa.array(doc[order][at]), pa.array(n)], names=["h", "c", "first", "n"])


def _looked_up(batches: Iterator[pa.RecordBatch], width: int, sent) -> Iterator[pa.RecordBatch]:
    """Covered spans by the windows that were sent here: sorted h, c and the smallest document."""
    h, c, first = sent.value

    def found() -> Iterator[tuple]:
        for batch in batches:
            held = list(rows([batch], "anchor", "doc_id", "text_hash", "start", "tallies"))
            every, counts, doc = unpacked(held)
            gone = np.zeros(len(every), dtype=bool)
            at = np.searchsorted(h, every["h"])
            while len(h):  # windows of equal h follow each other
                inside = at < len(h)
                same = inside & (h[np.minimum(at, len(h) - 1)] == every["h"])
                if not same.any():
                    break
                k = np.minimum(at, len(h) - 1)
                gone |= same & (c[k] == every["c"]) & (doc > first[k])
                at = at + same
                at[~same] = len(h)
            yield from runs(held, counts, gone, width)

    yield from emit(found(), SPANS)


def _spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Covered word spans (doc_id, text_hash, start, stop) from candidate rows that come together by anchor."""

    def judged(held: list[tuple]) -> Iterator[tuple]:
        every, counts, doc = unpacked(held)
        order = np.lexsort((doc, every["c"], every["h"]))
        h, c = every["h"][order], every["c"][order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        first = doc[order][new][np.cumsum(new) - 1]  # the smallest document of each window
        gone = np.empty(len(every), dtype=bool)
        gone[order] = doc[order] > first
        return runs(held, counts, gone, width)

    def grouped() -> Iterator[tuple]:
        held: list[tuple] = []
        for x in rows(batches, "anchor", "doc_id", "text_hash", "start", "tallies"):
            if len(held) > 20_000 and x[0] != held[-1][0]:
                yield from judged(held)
                held = []
            held.append(x)
        if held:
            yield from judged(held)

    yield from emit(grouped(), SPANS)


def repeated_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, text_hash, start, stop): word spans of rows (doc_id, text, text_hash) that earlier documents hold."""
    spark = docs.sparkSession
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = slots_for(letters)
    partial = docs.select("text").mapInArrow(thrifty(lambda it: _sketch(it, width, slots)), "segment long, at binary, n binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(thrifty(_merged), "segment long, two binary, many binary")
    sketch = spark.sparkContext.broadcast(Sketch(slots, [tuple(r) for r in merged.collect()]))
    schema = "anchor long, frequent boolean, doc_id long, text_hash long, start int, tallies binary"
    found = keep(docs.mapInArrow(thrifty(lambda it: _candidates(it, width, sketch)), schema), "windows")
    rare = found.where("not frequent").drop("frequent").repartition("anchor").sortWithinPartitions("anchor")
    spans = rare.mapInArrow(thrifty(lambda it: _spans(it, width)), "doc_id long, text_hash long, start int, stop int")

    common = found.where("frequent").drop("frequent")
    least = keep(common.mapInArrow(thrifty(_minima), "h long, c long, first long, n long").groupBy("h", "c").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"), "minima")
    many = 2
    while least.where(F.col("n") >= many).count() > MOST_SENT:
        many *= 4
    got = least.where(F.col("n") >= many).select("h", "c", "first").toArrow()
    h, c, first = (got.column(k).to_numpy() for k in range(3))
    order = np.argsort(h.view(U64), kind="stable")
    sent = spark.sparkContext.broadcast((h.view(U64)[order], c[order].astype("<u4"), first[order]))
    kinds = "doc_id long, text_hash long, start int, stop int"
    spans = spans.unionByName(common.mapInArrow(thrifty(lambda it: _looked_up(it, width, sent)), kinds))
    if many > 2:  # what was not sent, at most `many` rows of each window
        single = common.mapInArrow(thrifty(_single), "h long, c long, doc_id long, text_hash long, start int")
        late = single.join(least.where(F.col("n") < many), ["h", "c"]).where("doc_id > first")
        spans = spans.unionByName(late.select("doc_id", "text_hash", "start", (F.col("start") + width).alias("stop")))
    return spans


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window."""
    for doc, text_hash, start, blob in rows(batches, "doc_id", "text_hash", "start", "tallies"):
        t = np.frombuffer(blob, dtype=TALLY)
        n = len(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(t["h"].view(np.int64)), pa.array(t["c"].astype(np.int64)), pa.array(np.full(n, doc)), pa.array(np.full(n, text_hash)), pa.array(np.arange(start, start + n, dtype=np.int32))],
            names=["h", "c", "doc_id", "text_hash", "start"],
        )


def _kept(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The parts of range(n) outside all spans, which ascend."""
    kept, at = [], 0
    for a, b in spans:
        if a > at:
            kept.append((at, a))
        at = max(at, b)
    if at < n:
        kept.append((at, n))
    return kept


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, carried: Column) -> DataFrame:
    """(doc_id, cut, original, carried): of each row the words that stay, joined, and how many there were and go."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(own.select("doc_id", "text", "text_hash"), width)
    gathered = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = own.join(gathered, ["doc_id", "text_hash"], "left")

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, starts, stops, strict=True):
            words = (text or "").encode().split()
            left = words if a is None else [w for s, e in _kept(sorted(zip(a.tolist(), b.tolist(), strict=True)), len(words)) for w in words[s:e]]
            out.append((b" ".join(left).decode(), len(words), len(words) - len(left)))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    return joined.select("doc_id", cut("text", "spans.start", "spans.stop").alias("cut"), F.col("text").alias("original"), "carried")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, others: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed, original, *others): every document without the words that earlier documents hold.

    Words are unchanged; those kept are joined by one space; `original` is the
    text before.  A null text has no words, and a text of fewer than `width`
    words keeps all.  A row with a null doc_id is kept whole and takes nothing
    from others.  Rows that share a doc_id take nothing from each other.
    Repeated rows stay repeated; columns other than `others`, none of which may
    have a name of those above, are not read.  Empty in, empty out.
    """
    carried = F.struct(*[F.col(c) for c in others or []]) if others else F.lit(None)
    found = _judged(docs, id_col, text_col, width, carried)
    return found.select("doc_id", "cut.*", "original", *[F.col(f"carried.{c}") for c in others or []])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """The rows and columns of `docs`, whatever their names, after remove_repeats(); a text from which nothing goes stays as it is, null too."""
    found = _judged(docs, id_col, text_col, width, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.text")).otherwise(F.col("original"))
    return found.select(*[text.alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in docs.columns])
