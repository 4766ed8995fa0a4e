"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document's ids fill whole windows first; what remains of it is a piece
shorter than a window.  Each task pools such pieces by length.  A window starts
with the longest piece; a bitset of reachable sums over the multiset of pooled
lengths shows how close the others can bring it to capacity, and backtracking
through the bitsets gives how many pieces of each length do so.  The same
choice is used for as many windows as the counts allow.  Where no choice is
exact, one piece is cut to close the gap.  What a task has left at its end goes
into windows whose lengths are powers of two, which need no padding.

Nothing is shuffled: a task packs what it reads, and packs it the same way if
it runs again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bpe import TextEncoder, buffers
from wayfold.llm.words import bounded_batches, emit, thrifty

WINDOW, END = 2048, 1
#: Pieces pooled before windows are made of them, and how many stay for the next choice.
POOL, STAY = 4096, 2048


def json_ranks(data: str) -> dict[bytes, int]:
    """The byte strings and ids of a byte-level BPE in the `tokenizers` JSON form; its ids are in order of merging."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found = json.loads(data)
    special = {x["id"] for x in found["added_tokens"]}
    return {bytes(letters[c] for c in token): i for token, i in found["model"]["vocab"].items() if i not in special}


def added_tokens(data: str) -> dict[str, int]:
    """Strings that the tokenizer takes out of a text before anything else, and their ids."""
    found = json.loads(data)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in found):
        raise ValueError("added tokens that look at what is around them aren't known here")
    return {x["content"]: x["id"] for x in found}


class JsonEncoder:
    """Ids of texts by a byte-level BPE in the `tokenizers` JSON form, added tokens included."""

    def __init__(self, data: str, pattern: str) -> None:
        self.text, self.added = TextEncoder(json_ranks(data), pattern), added_tokens(data)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's end) of a column of texts."""
        with_added = [pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False) for x in self.added]
        at = np.flatnonzero(np.any(with_added, axis=0)) if with_added else np.zeros(0, dtype=np.int64)
        if not len(at):
            return self.text(*buffers(texts))
        parts, sizes = [], []
        for k, text in enumerate(texts.to_pylist()):
            own = self.split.split(text or "")  # other text, an added token, other text, ...
            ids, ends = self.text(*buffers(pa.array(own[::2], type=pa.string())))
            cut = np.split(ids, ends[1:-1])
            every = [x for piece, token in zip(cut, [*own[1::2], None], strict=True) for x in (piece, [] if token is None else [self.added[token]])]
            parts.append(np.concatenate(every).astype(np.int32))
            sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.cumsum([0, *sizes])


@lru_cache(maxsize=1)
def coder_of(data: str, pattern: str) -> JsonEncoder:
    """A worker's coder, with what it remembers from one task to the next."""
    return JsonEncoder(data, pattern)


def closest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the pieces whose sum comes closest to `room` from below."""
    reach, layers, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = left = min(counts[length], room // length)
        layers.append((length, most, reach))
        step = 1
        while left:
            step = min(step, left)
            reach |= reach << step * length & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, picks = reach.bit_length() - 1, []
    for length, most, before in reversed(layers):
        n = next(n for n in range(most + 1) if total >= n * length and before >> total - n * length & 1)
        if n:
            picks.append((length, n))
            total -= n * length
    return picks


class Packer:
    """Windows of at most `window` ids from a stream of documents; rows (doc, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW) -> None:
        self.sequence, self.window = first_sequence, window
        self.pool: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.size = 0

    def put(self, piece: tuple) -> None:
        """piece: (doc, start, ids as uint32 bytes, doc_tokens)."""
        n = len(piece[2]) // 4
        self.pool.setdefault(n, []).append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.size += 1

    def take(self, n: int) -> tuple:
        piece = self.pool[n].pop()
        self.size -= 1
        if self.counts[n] == 1:
            del self.counts[n], self.pool[n]
        else:
            self.counts[n] -= 1
        return piece

    def written(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, ids, total, self.sequence, offset
            offset += n
        self.sequence += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, at, step = len(ids) // 4, 0, self.window
        while total - at >= step:
            yield from self.written([(doc, at, ids[4 * at : 4 * (at + step)], total)])
            at += step
        if at < total:
            self.put((doc, at, ids[4 * at :], total))
        if self.size >= POOL:
            yield from self.pack(STAY)

    def pack(self, stay: int = 0) -> Iterator[tuple]:
        """Windows until at most `stay` pieces are left, or less than a window."""
        ids_left = sum(n * k for n, k in self.counts.items())
        while self.size > stay and ids_left >= self.window:
            longest = max(self.counts)
            self.counts[longest] -= 1
            picks = dict(closest({n: k for n, k in self.counts.items() if k}, self.window - longest))
            self.counts[longest] += 1
            picks[longest] = picks.get(longest, 0) + 1
            gap = self.window - sum(n * k for n, k in picks.items())
            for _ in range(1 if gap else min(ids_left // self.window, *(self.counts[n] // k for n, k in picks.items()))):
                pieces = [self.take(n) for n, k in picks.items() for _ in range(k)]
                if gap:
                    doc, start, ids, total = self.take(min(n for n in self.counts if n > gap))
                    pieces.append((doc, start, ids[: 4 * gap], total))
                    self.put((doc, start + gap, ids[4 * gap :], total))
                yield from self.written(pieces)
                ids_left -= self.window

    def finish(self) -> Iterator[tuple]:
        yield from self.pack()
        left = sum(n * k for n, k in self.counts.items())
        pieces = [self.take(n) for n in sorted(self.counts) for _ in range(self.counts[n])]
        while left:
            room = size = 1 << left.bit_length() - 1
            own = []
            while room:
                doc, start, ids, total = pieces.pop()
                n = min(room, len(ids) // 4)
                own.append((doc, start, ids[: 4 * n], total))
                if n < len(ids) // 4:
                    pieces.append((doc, start + n, ids[4 * n :], total))
                room -= n
            yield from self.written(own)
            left -= size


def pack(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every id of every document, once.

    `ids` are little-endian uint32 bytes by the byte-level BPE in the JSON file
    `vocabulary`, `pattern` being its piece pattern; where a text holds one of
    the file's added tokens, that is its id, as in the `tokenizers` library;
    each document ends with id 1, so a null or empty text is that id alone.  Sequences hold 2048 ids or a
    power of two, and never need padding.  Null and repeated doc_ids stay as
    they are, other columns are not read, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        data = file.read()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = coder_of(data, pattern), np.array([END], dtype="<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40)

        def packed() -> Iterator[tuple]:
            for batch in batches:
                for k in range(0, batch.num_rows, 2000):
                    part = batch.slice(k, 2000)
                    ids, ends = coder(part.column(1))
                    held, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                    for doc, a, b in zip(part.column(0).to_pylist(), ends, ends[1:], strict=False):
                        yield from packer.add(doc, held[a:b] + end)
            yield from packer.finish()

        yield from emit(packed(), schema)

    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(thrifty(run), kinds)
