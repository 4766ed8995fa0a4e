"""Language-model scores by online logistic context mixing.

A token is coded by binary decisions.  All words seen twice or more, the end of
a text and an escape have Huffman codes; any other word is an escape followed by the bits of its bytes.  Each decision is predicted from several
hashed contexts: those of words from none, the word before, the two before and
the last very common word; those of bytes from the one, two, three and five
bytes before them in the word.  The contexts' log-odds are mixed with
weights chosen by a gate, how often the two most telling contexts were seen;
the mix is refined by an adaptive map from what was predicted to what happened.
While a document is read, its weights and map, those of words and those of
bytes, go on learning from the decisions made so far, never from later ones.

What is learned comes from all training documents: counts of words and of the
contexts' decisions, in hashed tables sized from the counted tokens and words.  The weights and
the adaptive map come from some of them, which the tables leave out meanwhile,
so that they are learned on decisions that the tables have not seen; then the
tables get these documents' counts too.

Vocabulary and tables are files in the shared folder, each written in place by
the tasks that sum its parts; a worker maps them and reads the pages it needs.
Neither the driver nor a worker holds any of them whole.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.words import OPEN, SQUEEZE, U64, emit, mixed, rows, thrifty, word_hashes
from wayfold.sources.shared import discard, keep, shared_dir

U32 = np.uint32
#: The common words that tell the language.
COMMON = 64
#: Training documents with this remainder of crc32 modulo 7 fit the weights.
FIT = 3
#: Tables are added up in segments, of 2**16 slots or 512 a table; decisions that a task holds before it counts them, and bytes of counts before it adds and sends them.
SEGMENT, HELD, KEPT = 16, 4_000_000, 96 << 20
#: Tokens that are worked on at once, decisions after which a document's weights and map move, and how far each decision moves them.
TOKENS, SLICE, STEP, MAP_STEP = 32_000, 256, 0.002, 0.02
#: How fast the weights are learned.
RATE = 0.5
GATES, LEVELS = 16, 33
#: Words are sorted by hash in buckets of the first ten bits; numbers that are written or looked up at once.
BUCKET, CHUNK = 10, 1 << 20


def model_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, for files that all workers map."""
    scheme, _, path = shared_dir(spark).rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError("vocabulary and tables are mapped files: set spark.checkpoint.dir to a folder that all executors have mounted")
    os.makedirs(path := f"/{path.lstrip('/')}/mixing-{uuid.uuid4().hex}")
    return path


def blank(path: str, kind: str, n: int) -> np.ndarray:
    """A new file of `n` zeros, to be written in place."""
    with open(path, "wb") as f:
        f.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(path, kind, "r+") if n else np.zeros(0, kind)


def mapped(path: str, kind: str) -> np.ndarray:
    """A file's numbers, whose pages are read when they are looked at."""
    return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)


def put(path: str, at: int, numbers: np.ndarray) -> None:
    """Writes numbers into a file from number `at` on; a task that runs twice writes the same."""
    with open(path, "r+b") as f:
        f.seek(at * numbers.itemsize)
        f.write(numbers.tobytes())


def huffman(runs: list[tuple[int, int, int]], up: np.ndarray, depth: np.ndarray) -> None:
    """From (count, first symbol, number of symbols) by rising counts: what is above symbol k, or above decision d at n + d, as twice the decision's number and the bit; the length of each code.

    Decision 0 is the first, and a decision's number is larger than that of the one above.
    Symbols of one count are paired a run at a time.
    """
    n = len(depth)
    leaves, inner = deque([max(w, 1), a, m] for w, a, m in runs), deque()
    k, odd = 0, None  # the next pair; the node of the run before that has no partner there

    def above(nodes: np.ndarray, pairs: np.ndarray, bit: int) -> None:
        up[nodes] = (n - 2 - pairs) * 2 + bit

    while k < n - 1:  # the two smallest are at the heads of two ascending queues
        own = leaves if not inner or (leaves and leaves[0][0] <= inner[0][0]) else inner
        w, a, m = own[0]
        node = (lambda x: x) if own is leaves else (lambda x: 2 * n - 2 - x)
        if odd:
            above(np.array([odd[1], node(a)]), np.array([k, k]), np.array([0, 1]))
            inner.append([odd[0] + w, k, 1])
            k, odd, a, m = k + 1, None, a + 1, m - 1
        elif m > 1:
            for x in range(0, m // 2, CHUNK):
                j = np.arange(x, min(x + CHUNK, m // 2))
                for bit in (0, 1):
                    above(node(a + 2 * j + bit), k + j, bit)
            inner.append([2 * w, k, m // 2])
            k, a, m = k + m // 2, a + m // 2 * 2, m % 2
        else:
            odd, m = (w, node(a)), 0
        if m:
            own[0] = [w, a, m]
        else:
            own.popleft()
    for x in range(0, n if n > 1 else 0, CHUNK):
        symbol = at = np.arange(x, min(x + CHUNK, n))
        while len(at):
            depth[symbol] += 1
            at = (up[at] >> U32(1)).astype(np.intp)
            symbol, at = symbol[at > 0], n + at[at > 0]


class Contexts:
    """Turns decisions into slots of one table per context."""

    def __init__(self, sizes: tuple[int, ...], gates: tuple[int, int]) -> None:
        self.sizes, self.gates = sizes, gates

    def slots(self, k: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Hashed from context and node, both unsigned 32-bit."""
        if self.sizes[k] > 32:
            return (mixed((context.astype(U64) << U64(32)) | node) >> U64(64 - self.sizes[k])).astype(np.intp)
        h = node * U32(0x9E3779B1)
        h += context
        h ^= h >> U32(15)
        h *= U32(0x85EBCA77)
        h ^= h >> U32(13)
        h *= U32(0xC2B2AE3D)
        h >>= U32(32 - self.sizes[k])
        return h.astype(np.intp)


def bits_for(n: int, least: int = 16) -> int:
    """Of a table for n entries."""
    return max(least, int(max(n, 1) - 1).bit_length())


def sized(n_tokens: int, n_words: int, n_known: int) -> tuple[Contexts, Contexts]:
    """Tables for words and for bytes, of 2**size slots, for so many tokens, distinct words and words with codes; the gate looks at two of them.

    The first table of words has a slot for each decision.  Those of the words
    before grow with the tokens, that of the common word with the words that
    have codes, those of bytes with the distinct words.
    """
    before = bits_for(n_tokens // 2, 22)
    words = bits_for(n_known + 1), before, before, bits_for(8 * n_known, 21)
    return Contexts(words, (1, 2)), Contexts((16, 18, bits_for(2 * n_words, 20), bits_for(4 * n_words, 21)), (2, 3))


@dataclass
class Decisions:
    """Slots per context, the bit, and the row each decision belongs to; rows ascend."""

    slots: list[np.ndarray]
    bits: np.ndarray
    row: np.ndarray


def hashed(context: np.ndarray, k: int) -> np.ndarray:
    return (mixed(context.astype(U64) * U64(8) + U64(k)) >> U64(32)).astype(U32)


def contexts_of(symbols: np.ndarray, lengths: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the symbol before, the two before as one number, and the last common one; `none` stands before a document."""
    n, starts = len(symbols), np.cumsum(lengths) - lengths
    one, two = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    one[starts], two[starts] = none, none
    two[np.minimum(starts + 1, n - 1)[lengths > 1]] = none
    at = np.where(one < COMMON, np.arange(n), -1)
    at[starts] = starts  # nothing from the document before
    at = one[np.maximum.accumulate(at)]
    return one, one * 1_000_003 + two, np.where(at < COMMON, at, COMMON)


def word_decisions(contexts: Contexts, symbols: np.ndarray, lengths: np.ndarray, code: tuple) -> Decisions:
    """Of documents, one after another, `lengths` symbols each, the last being the end."""
    up, depth = code
    n = len(depth)
    size = depth[symbols].astype(np.intp)
    ends = np.cumsum(size)
    node, bits = np.empty(ends[-1], dtype=U32), np.empty(ends[-1], dtype=np.int8)
    at, place = symbols, ends - 1
    while len(at):  # from the last decision of each symbol to its first
        above = up[at]
        bits[place] = above & U32(1)
        above >>= U32(1)
        node[place] = above
        more = above > 0
        at, place = n + above[more].astype(np.intp), place[more] - 1
    before = contexts_of(symbols, lengths, n - 2)
    slots = [node.astype(np.intp)] + [contexts.slots(k, np.repeat(hashed(x, k), size), node) for k, x in enumerate(before, 1)]
    return Decisions(slots, bits, np.repeat(np.arange(len(lengths)), np.add.reduceat(size, np.cumsum(lengths) - lengths)))


def byte_decisions(contexts: Contexts, words: list[bytes]) -> Decisions:
    """Of the bytes of words, each ended by a space; rows are words."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words])
    row = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h, every = np.zeros(len(data), dtype=U64), []
    for k in range(1, 6):  # the k bytes before, or as many as the word has
        before = np.zeros(len(data), dtype=np.int64)
        before[k:] = data[:-k]
        h = mixed(h * U64(257) + np.where(inside >= k, before, 256).astype(U64) + U64(k))
        if k != 4:
            every.append((h >> U64(32)).astype(U32))
    shifts = np.arange(7, -1, -1)
    bits = (data[:, None] >> shifts & 1).astype(np.int8)
    node = ((1 << np.arange(8)) + (data[:, None] >> (shifts + 1))).astype(U32).ravel()  # the bits read so far, led by a one
    slots = [contexts.slots(k, np.repeat(h, 8), node) for k, h in enumerate(every)]
    return Decisions(slots, bits.ravel(), np.repeat(row, 8))


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, as many as the largest needs and led by how many."""
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + SQUEEZE.compress(b"".join((numbers >> 8 * k).astype(np.uint8).tobytes() for k in range(planes)))


def opened(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(OPEN.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    found = planes[0].astype(kind)
    for k in range(1, len(planes)):
        found |= planes[k].astype(kind) << 8 * k
    return found


def packed(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as log-odds in 512ths, and in the two lowest bits how often they were seen."""
    n0, n1 = counts[0::2].astype(np.float32), counts[1::2].astype(np.float32)
    odds = np.clip(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), -15.9, 15.9)
    return (np.rint(odds * 512).astype("<i2") << 2) | np.searchsorted([1, 3, 16], n0 + n1, side="right").astype("<i2")


class Tables:
    """The merged tables of one mixer, in files."""

    def __init__(self, contexts: Contexts, paths: list[str]) -> None:
        self.contexts, self.paths = contexts, paths

    @property
    def slots(self) -> list[np.ndarray]:
        return [mapped(p, "<i2") for p in self.paths]

    @classmethod
    def blank(cls, folder: str, name: str, *kinds: Contexts) -> list[Tables]:
        sizes = [s for contexts in kinds for s in contexts.sizes]
        paths = [f"{folder}/{name}-{k}" for k in range(len(sizes))]
        for path, size in zip(paths, sizes, strict=True):
            blank(path, "<i2", 1 << size)
        return [cls(contexts, [paths.pop(0) for _ in contexts.sizes]) for contexts in kinds]


@dataclass
class Mixer:
    """Tables, the weights of each gate and the adaptive map."""

    contexts: Contexts
    slots: list[np.ndarray]
    weights: np.ndarray
    map: np.ndarray

    @classmethod
    def of(cls, tables: Tables) -> Mixer:
        """As it is before it has learned: equal weights."""
        n = len(tables.contexts.sizes)
        return cls(tables.contexts, tables.slots, np.full((GATES, n), 1.2 / n, dtype=np.float32), settled(np.zeros((GATES, LEVELS, 2))))

    def inputs(self, d: Decisions) -> tuple[list[np.ndarray], np.ndarray]:
        raw = [t[s] for t, s in zip(self.slots, d.slots, strict=True)]
        a, b = (raw[g] & 3 for g in self.contexts.gates)
        return [(r >> 2).astype(np.float32) * np.float32(1 / 512) for r in raw], (a * 4 + b).astype(np.uint8)

    def mixes(self, xs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        mix = np.zeros(len(gate), dtype=np.float32)
        for k, x in enumerate(xs):
            mix += self.weights[:, k][gate] * x
        return mix

    @staticmethod
    def level(mix: np.ndarray) -> np.ndarray:
        at = mix * np.float32(2)
        at += np.float32(16.5)
        return np.minimum(np.maximum(at, 0, out=at), LEVELS - 1, out=at).astype(np.intp)

    def learn(self, d: Decisions, told: np.ndarray, rate: float, block: int = 8192) -> None:
        """Moves the weights along the decisions; adds to `told`, the adaptive map's counts."""
        every, gates = self.inputs(d)
        for k in range(0, len(gates), block):
            xs, gate, bits = [x[k : k + block] for x in every], gates[k : k + block], d.bits[k : k + block]
            mix = self.mixes(xs, gate)
            np.add.at(told.reshape(-1), (gate.astype(np.intp) * LEVELS + self.level(mix)) * 2 + bits, 1)
            wrong = bits - 1 / (1 + np.exp(-mix))
            n = np.bincount(gate, minlength=GATES)
            for j, x in enumerate(xs):
                self.weights[:, j] += rate * np.bincount(gate, wrong * x, GATES) / (n + 64)

    def costs(self, d: Decisions, n_rows: int) -> np.ndarray:
        """Nats per row.  Each row's own weights and map move after every SLICE of its decisions.

        Slices of the same turn of all rows are worked on together, each slice
        a line of SLICE decisions, the longest rows first; a row's last slice is
        filled up with decisions that nothing is known of and that don't count.
        """
        sizes = np.bincount(d.row, minlength=n_rows)
        order = np.argsort(-sizes, kind="stable")
        turns = -(-sizes // SLICE)
        active = np.append(n_rows - np.searchsorted(np.sort(turns), np.arange(turns.max(initial=0)), side="right"), 0)  # rows that have such a turn
        firsts = np.concatenate(([0], np.cumsum(active)))
        line = firsts[np.concatenate([np.arange(n) for n in turns.tolist()])] + np.repeat(np.argsort(order), turns) if len(d.row) else np.zeros(0, np.intp)  # of each slice, row by row
        held = np.full(len(line), SLICE)
        held[np.cumsum(turns)[turns > 0] - 1] = (sizes - (turns - 1) * SLICE)[turns > 0]
        place = np.repeat(line * SLICE - (np.cumsum(held) - held), held) + np.arange(len(d.row))
        filled = np.zeros(len(line), dtype=np.intp)
        filled[line] = held

        def laid(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(line) * SLICE, dtype=x.dtype)
            out[place] = x
            return out.reshape(-1, SLICE)

        xs, gate = self.inputs(d)
        mix, sign = laid(self.mixes(xs, gate)), laid(d.bits * np.float32(2) - np.float32(1))  # one for a bit that was set, minus one for another
        xs, gate, levels = [laid(x) for x in xs], laid(gate), self.map.ravel()
        moved, shift = np.zeros((len(xs), n_rows, 1), dtype=np.float32), np.zeros(n_rows * LEVELS, dtype=np.float32)
        base, nats = np.arange(n_rows)[:, None] * LEVELS, np.zeros(n_rows)
        for k, (n, more) in enumerate(zip(active.tolist(), active[1:].tolist(), strict=False)):
            part, go_on = slice(firsts[k], firsts[k + 1]), slice(firsts[k], firsts[k] + more)
            now, said = mix[part], sign[part]
            if k:
                for j, x in enumerate(xs):
                    now += moved[j, :n] * x[part]
            level = self.level(now)
            at = gate[part].astype(np.intp)
            at *= LEVELS
            at += level
            final = levels.take(at)
            final += now
            level += base[:n]
            if k:
                final += shift.take(level)
            final *= np.float32(-0.5)
            final *= said
            odds = np.exp(np.minimum(final, 40, out=final), out=final)  # against what happened
            cost = odds + np.float32(1)
            if more:  # only rows that go on learn; what happened less its probability is the signed probability of the other bit
                wrong = now[:more] * said[:more]
                np.exp(np.minimum(np.negative(wrong, out=wrong), 40, out=wrong), out=wrong)
                wrong /= wrong + np.float32(1)
                wrong *= said[:more]
                for j, x in enumerate(xs):
                    moved[j, :more, 0] += STEP * np.einsum("ij,ij->i", wrong, x[go_on])
                odds = odds[:more] / cost[:more]
                odds *= said[:more]
                shift[: more * LEVELS] += MAP_STEP * np.bincount(level[:more].ravel(), odds.ravel(), more * LEVELS)
            np.log(cost, out=cost)
            cost[more:][np.arange(SLICE) >= filled[part][more:, None]] = 0
            nats[:n] += cost.sum(axis=1, dtype=np.float64)
        found = np.empty(n_rows)
        found[order] = nats
        return found


def settled(told: np.ndarray) -> np.ndarray:
    """The adaptive map: log-odds of what happened at each level, drawn to the level itself where little did."""
    said = 1 / (1 + np.exp(-(np.arange(LEVELS) / 2 - 8)))
    n0, n1 = told[..., 0] + 16 * (1 - said), told[..., 1] + 16 * said
    return np.log((n1 + 1e-9) / (n0 + 1e-9)).astype(np.float32)


def segment_bits(size: int) -> int:
    return max(SEGMENT, size - 9)


class Told:
    """Counts of decisions, held as sorted keys (twice the slot and the bit) and given out by segment."""

    def __init__(self, contexts: Contexts, first: int) -> None:
        self.contexts, self.first, self.n = contexts, first, 0
        self.keys: list[list[np.ndarray]] = [[] for _ in contexts.sizes]
        self.times: list[np.ndarray] = []
        self.kept: dict[tuple[int, int], list[tuple[memoryview, memoryview]]] = {}
        self.size = 0

    def add(self, d: Decisions, times: np.ndarray | None = None) -> Iterator[tuple]:
        for own, slots, size in zip(self.keys, d.slots, self.contexts.sizes, strict=True):
            own.append((slots * 2 + d.bits).astype(U32 if size < 32 else U64))
        if times is not None:
            self.times.append(times)
        self.n += len(d.bits)
        if self.n > (HELD if times is None else HELD // 2):
            self.fold()
        if self.size > KEPT:
            yield from self.given()

    def fold(self) -> None:
        """Keeps the counts of the decisions held, squeezed, all in one piece: thousands of small ones between large arrays keep the memory around them from being used again."""
        found = list(self.counted())
        whole, at = memoryview(b"".join(x for row in found for x in row[2:])), 0
        for part, segment, keys, n in found:
            end = at + len(keys) + len(n)
            self.kept.setdefault((part, segment), []).append((whole[at : at + len(keys)], whole[at + len(keys) : end]))
            at = end
        self.size += at

    def given(self) -> Iterator[tuple]:
        """(part, segment, keys, counts), each segment's counts added up."""
        self.fold()
        for (part, segment), own in self.kept.items():
            if len(own) > 1:
                keys = np.concatenate([np.cumsum(opened(k, "<u4"), dtype=np.int64) for k, _ in own])
                n = np.concatenate([opened(c, "<i8") for _, c in own])
                if segment_bits(self.contexts.sizes[part - self.first]) < 18:
                    total = np.bincount(keys, n)
                    keys = np.flatnonzero(total)
                    n = total[keys].astype(np.int64)
                else:
                    keys, place = np.unique(keys, return_inverse=True)
                    n = np.bincount(place, n).astype(np.int64)
                own = [(squeezed(np.diff(keys, prepend=0)), squeezed(n))] if len(keys) else []
            yield from ((part, segment, *map(bytes, x)) for x in own)
        self.kept, self.size = {}, 0

    def counted(self) -> Iterator[tuple]:
        times = np.concatenate(self.times) if self.times else None
        for k, own in enumerate(self.keys):
            if not own:
                continue
            keys = np.concatenate(own)
            own.clear()
            if times is not None and self.contexts.sizes[k] <= 18:
                total = np.bincount(keys, times)
                keys = np.flatnonzero(total)
                n = total[keys].astype(np.int64)
                if not len(keys):  # all were told no times
                    continue
            else:
                if times is None:
                    keys.sort()
                else:  # numbers are sorted faster than places of numbers
                    each = (keys.astype(U64) << U64(31)) | np.arange(len(keys), dtype=U64) if self.contexts.sizes[k] <= 32 else None
                    order = np.argsort(keys) if each is None else (np.sort(each) & U64((1 << 31) - 1)).astype(np.intp)
                    keys = keys[order]
                starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
                n = np.diff(np.append(starts, len(keys))) if times is None else np.add.reduceat(times[order], starts)
                keys = keys[starts].astype(np.int64)
            wide = segment_bits(self.contexts.sizes[k]) + 1
            segment = keys >> wide
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                at = keys[a:b] - (segment[a] << wide)
                yield self.first + k, int(segment[a]), squeezed(np.diff(at, prepend=0)), squeezed(n[a:b])
        self.times, self.n = [], 0


PARTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PART_KINDS = "part int, segment int, keys binary, counts binary"


def by_segment(parts: DataFrame, tables: list[Tables], hand_on: bool) -> DataFrame:
    """Adds the counts of each segment and writes it, packed, into its table; `hand_on` gives the sums as parts again, else none."""
    sizes, paths = [s for t in tables for s in t.contexts.sizes], [p for t in tables for p in t.paths]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, segment: int, total: np.ndarray) -> Iterator[tuple]:
            put(paths[part], segment << segment_bits(sizes[part]), packed(total))
            if hand_on:
                at = np.flatnonzero(total)
                yield part, segment, squeezed(np.diff(at, prepend=0)), squeezed(total[at])

        def found() -> Iterator[tuple]:
            key, total = None, np.zeros(0)
            for part, segment, keys, counts in rows(batches, "part", "segment", "keys", "counts"):
                if (part, segment) != key:
                    if key:
                        yield from done(*key, total)
                    key, total = (part, segment), np.zeros(2 << min(segment_bits(sizes[part]), sizes[part]), dtype=np.int64)
                total[np.cumsum(opened(keys, "<u4"), dtype=np.int64)] += opened(counts, "<i8")
            if key:
                yield from done(*key, total)

        yield from emit(found(), PARTS)

    return parts.repartition("part", "segment").sortWithinPartitions("part", "segment").mapInArrow(thrifty(added), PART_KINDS)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def in_chunks(found: Iterator[tuple], at_most: int = TOKENS, least: int = 1) -> Iterator[list[tuple]]:
    """(words, ...) rows gathered until they hold so many words, each taken for `least` at least."""
    held, size = [], 0
    for row in found:
        held.append(row)
        size += max(len(row[0]) + 1, least)
        if size >= at_most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Vocabulary:
    """Files of the words by 64-bit hash, ascending, their symbols and their codes; symbols are numbered by falling counts, then the end and the escape.

    Words of equal counts go by their letters, so that like words are near in the code.
    """

    FILES = {"hashes": "<u8", "symbol": "<i8", "counts": "<i8", "up": "<u4", "depth": "u1"}

    def __init__(self, folder: str, n: int, end_count: int, total: int, distinct: int) -> None:
        self.folder, self.n, self.end_count, self.total, self.distinct = folder, n, end_count, total, distinct

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("counts", "hashes", "symbol", "code")}

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.opened("hashes")

    @cached_property
    def symbol(self) -> np.ndarray:
        return self.opened("symbol")

    @cached_property
    def counts(self) -> np.ndarray:
        return self.opened("counts")

    def opened(self, name: str) -> np.ndarray:
        return mapped(f"{self.folder}/{name}", self.FILES[name])

    @cached_property
    def code(self) -> tuple[np.ndarray, np.ndarray]:
        return self.opened("up"), self.opened("depth")

    @classmethod
    def of(cls, words: DataFrame, folder: str, end_count: int, escape_count: int, total: int, distinct: int) -> Vocabulary:
        """From (word, n).  The driver sees how many words have each count, and how many are in each bucket of hashes and partition."""

        def hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, k = TaskContext.get().partitionId(), 0
            for batch in batches:
                h, m = word_hashes(batch.column(0).to_pylist()), batch.num_rows
                columns = np.full(m, place), np.arange(k, k + m), (h >> U64(64 - BUCKET)).astype(np.int64), h.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "k", "bucket", "hash"])
                k += m

        sizes = sorted(((int(n), int(m)) for n, m in words.groupBy("n").count().collect()), reverse=True)
        n = sum(m for _, m in sizes)
        own = {name: blank(f"{folder}/{name}", kind, 2 * n + 3 if name == "up" else n + 2 if name == "depth" else n) for name, kind in cls.FILES.items()}
        firsts, runs = [0, *accumulate(m for _, m in sizes)], []
        for first, (count, m) in zip(firsts, sizes, strict=False):
            own["counts"][first : first + m] = count
            runs.append((count, first, m))
        huffman(sorted([*runs, (end_count, n, 1), (escape_count, n + 1, 1)], key=lambda r: (max(r[0], 1), r[1])), own["up"], own["depth"])
        for written in own.values():
            if isinstance(written, np.memmap):
                written.flush()
        if n:
            ranked = keep(words.select("word", "n").orderBy(F.desc("n"), "word").select("word").mapInArrow(thrifty(hashed_words), "place long, k long, bucket long, hash long"), "ranked")
            starts = {}
            for key in ("place", "bucket"):
                found = sorted((int(x), int(m)) for x, m in ranked.groupBy(key).count().collect())
                starts[key] = dict(zip((x for x, _ in found), accumulate((m for _, m in found), initial=0), strict=False))

            def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                at = dict(starts["bucket"])
                for batch in batches:
                    place, k, bucket, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                    symbol = k + np.array([starts["place"][x] for x in place.tolist()], dtype=np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                    for a, b in zip(cuts, cuts[1:]):
                        if b > a:
                            put(f"{folder}/hashes", at[bucket[a]], h[a:b])
                            put(f"{folder}/symbol", at[bucket[a]], symbol[a:b])
                            at[bucket[a]] += b - a
                    yield batch.slice(0, 0)

            ranked.repartition("bucket").sortWithinPartitions("bucket", "hash").mapInArrow(thrifty(placed), ranked.schema).count()
            discard(ranked)
        return cls(folder, n, end_count, total, distinct)

    @property
    def end(self) -> int:
        return self.n

    @property
    def escape(self) -> int:
        return self.n + 1

    def counted(self, symbols: np.ndarray) -> np.ndarray:
        """How often each was read; the escape never was."""
        found = np.where(symbols == self.end, self.end_count, 0)
        inside = symbols < self.n
        found[inside] = self.counts[symbols[inside]]
        return found

    def of_words(self, words: list[bytes]) -> np.ndarray:
        h = word_hashes(words)
        if not len(self.hashes):
            return np.full(len(h), self.escape)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.symbol[at].astype(np.int64), self.escape)

    def symbols(self, held: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) + 1 for w in held])
        found = np.full(int(lengths.sum()), self.end, dtype=np.int64)
        inside = np.ones(len(found), dtype=bool)
        inside[np.cumsum(lengths) - 1] = False
        found[inside] = self.of_words([w for words in held for w in words])
        return found, lengths


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, told) over rows (text, fit): all occurrences, and those in texts that don't fit the weights."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("told", pa.int64())])
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for fit, own in enumerate(found):
                yield from emit(((w, n, 0 if fit else n) for w, n in own.items()), schema)
                own.clear()

        for text, fit in rows(batches, "text", "fit"):
            found[fit].update(tokens(text))
            if len(found[0]) + len(found[1]) > 500_000:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(thrifty(counted), "word binary, n long, told long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("told").alias("told"))


def _weights(texts: DataFrame, vocabulary, tables: list[Tables]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and adaptive map of each mixer, learned by each task and averaged by decisions."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        mixers = [Mixer.of(t) for t in tables]
        told = [np.zeros((GATES, LEVELS, 2), dtype=np.int64) for _ in mixers]
        for held in in_chunks((tokens(t),) for (t,) in rows(batches, "text")):
            words = [h[0] for h in held]
            symbols, lengths = voc.symbols(words)
            mixers[0].learn(word_decisions(mixers[0].contexts, symbols, lengths, voc.code), told[0], RATE)
            every = [w for ws in words for w in (*ws, b"")]
            if rare := [every[k] for k in np.flatnonzero(symbols == voc.escape).tolist()]:
                mixers[1].learn(byte_decisions(mixers[1].contexts, rare), told[1], RATE)
        data = [(k, int(t.sum()), m.weights.astype("<f4").tobytes(), t.astype("<i8").tobytes()) for k, (m, t) in enumerate(zip(mixers, told, strict=True)) if t.sum()]
        yield from emit(iter(data), pa.schema([("mixer", pa.int32()), ("n", pa.int64()), ("weights", pa.binary()), ("told", pa.binary())]))

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for k, n, w, t in rows(batches, "mixer", "n", "weights", "told"):
            at = total.setdefault(k, [0, 0, 0])
            at[0] += n
            at[1] = at[1] + n * np.frombuffer(w, "<f4").astype(np.float64)
            at[2] = at[2] + np.frombuffer(t, "<i8")
        data = ((k, n, (w / n).astype("<f4").tobytes(), t.astype("<i8").tobytes()) for k, (n, w, t) in total.items())
        yield from emit(data, pa.schema([("mixer", pa.int32()), ("n", pa.int64()), ("weights", pa.binary()), ("told", pa.binary())]))

    kinds = "mixer int, n long, weights binary, told binary"
    each = texts.mapInArrow(thrifty(learned), kinds)
    some = each.withColumn("salt", F.spark_partition_id() % 16).repartition("salt").drop("salt").mapInArrow(thrifty(averaged), kinds)
    found: dict[int, list] = {}
    for k, n, w, t in some.collect():  # 32 rows at most
        at = found.setdefault(k, [0, 0, 0])
        at[0] += n
        at[1] = at[1] + n * np.frombuffer(bytes(w), "<f4").astype(np.float64)
        at[2] = at[2] + np.frombuffer(bytes(t), "<i8")
    out = []
    for k, contexts in enumerate(t.contexts for t in tables):
        n, w, t = found.get(k, (0, 0, 0))
        shape = (GATES, len(contexts.sizes))
        weights = (w / n).astype(np.float32).reshape(shape) if n else np.full(shape, 1.2 / shape[1], dtype=np.float32)
        out.append((weights, settled(t.reshape(GATES, LEVELS, 2) if n else np.zeros((GATES, LEVELS, 2)))))
    return out


@dataclass
class Model:
    vocabulary: object
    tables: list[Tables]
    learned: list[tuple[np.ndarray, np.ndarray]]
    counts: DataFrame


def train(docs: DataFrame, fit: Column, text_col: str = "text") -> Model:
    """Learns from the texts of `docs`; those for which `fit` holds fit the weights before they too are told to the tables."""
    spark = docs.sparkSession
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(fit, F.lit(False)).alias("fit"))
    counts = keep(word_counts(own), "counts")
    n_docs = own.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known, n_known = counts.where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    folder = model_folder(spark)
    voc = Vocabulary.of(counts.where("n > 1"), folder, n_docs, int(total - known), int(total + n_docs), int(distinct + (n_docs > 0)))
    vocabulary = spark.sparkContext.broadcast(voc)
    kinds = by_word, by_byte = sized(int(total + n_docs), int(distinct), int(n_known))

    def words_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, told = vocabulary.value, Told(by_word, 0)
        for held in in_chunks((tokens(t),) for (t,) in rows(batches, "text")):
            yield from emit(told.add(word_decisions(by_word, *voc.symbols([h[0] for h in held]), voc.code)), PARTS)
        yield from emit(told.given(), PARTS)

    def bytes_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, told = vocabulary.value, Told(by_byte, len(by_word.sizes))
        for batch in batches:
            every = list(rows([batch], "word", "times", "known_times"))
            for k in range(0, len(every), 2000):
                part = [w for w, _, _ in every[k : k + 2000]]
                n = np.where(voc.of_words(part) == voc.escape, [n for _, n, _ in every[k : k + 2000]], [n for _, _, n in every[k : k + 2000]])
                d = byte_decisions(by_byte, part)
                yield from emit(told.add(d, n[d.row]), PARTS)
        yield from emit(told.given(), PARTS)

    def parts(fit: bool) -> DataFrame:
        """What the texts tell that fit the weights, or the others; known words, told once each by the first that hold them, tell how words are spelled."""
        words = counts.where("n > told" if fit else "told > 0").select("word", (F.col("n") - F.col("told") if fit else F.col("told")).alias("times"), (F.col("told") == 0 if fit else F.lit(True)).cast("long").alias("known_times"))
        texts = own.where("fit" if fit else "not fit").select("text")
        return texts.mapInArrow(thrifty(words_told), PART_KINDS).unionByName(words.mapInArrow(thrifty(bytes_told), PART_KINDS))

    tables = Tables.blank(folder, "first", *kinds)
    first = keep(by_segment(parts(False), tables, hand_on=True), "told")
    learned = _weights(own.where("fit").select("text"), vocabulary, tables)
    for path in (p for t in tables for p in t.paths):
        os.remove(path)
    tables = Tables.blank(folder, "table", *kinds)
    by_segment(first.unionByName(parts(True)), tables, hand_on=False).count()
    discard(first)
    return Model(vocabulary, tables, learned, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    `score` is the model's log10 probability of the tokens, `base_score` that
    of single tokens by add-one counts; a token is known if the training texts
    hold it.  A null text counts as empty: its end alone.  Null ids stay,
    repeated rows stay repeated, other columns are not read; empty in, empty
    out.  Without training texts all decisions are even.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("common", pa.int64()), ("base", pa.float64()), ("nats", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])
    vocabulary, tables, learned = model.vocabulary, model.tables, model.learned
    total, distinct = vocabulary.value.total, vocabulary.value.distinct
    log_all = float(np.log10(total + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        by_word, by_byte = (Mixer(t.contexts, t.slots, w, m) for t, (w, m) in zip(tables, learned, strict=True))
        row = TaskContext.get().partitionId() << 33

        def found() -> Iterator[tuple]:
            nonlocal row
            for held in in_chunks(((tokens(t), d, len((t or "").encode())) for d, t in rows(batches, "doc_id", "text")), least=32):  # a row takes a whole slice
                words = [h[0] for h in held]
                symbols, lengths = voc.symbols(words)
                nats = by_word.costs(word_decisions(by_word.contexts, symbols, lengths, voc.code), len(held))
                starts = np.cumsum(lengths) - lengths
                doc = np.repeat(np.arange(len(held)), lengths)
                counts = voc.counted(symbols)
                base = np.bincount(doc, np.log10(counts + 1.0), len(held))
                common = np.bincount(doc, counts > 0, len(held))
                rare: list[Counter] = [Counter() for _ in held]
                escapes = np.nonzero(symbols == voc.escape)[0]
                unknown = [words[doc[at]][at - starts[doc[at]]] for at in escapes.tolist()]
                for k, w in zip(doc[escapes].tolist(), unknown, strict=True):
                    rare[k][w] += 1
                if unknown:
                    spelled = byte_decisions(by_byte.contexts, unknown)
                    spelled.row = doc[escapes][spelled.row]
                    nats += by_byte.costs(spelled, len(held))
                for k, (ws, d, size) in enumerate(held):
                    yield row, d, len(ws) + 1, size, int(common[k]), float(base[k]), float(nats[k]), list(rare[k]), list(rare[k].values())
                    row += 1

        yield from emit(found(), schema, at_most=2000)

    kinds = "row long, doc_id long, n_tokens long, n_bytes long, common long, base double, nats double, rare array<binary>, times array<long>"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = keep(own.mapInArrow(thrifty(run), kinds), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("word"), F.col("e.times").alias("times"))
    told = pairs.join(model.counts.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("also"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    return scored.drop("rare", "times").join(told, "row", "left").select(
        "doc_id", "n_tokens", (F.col("common") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        (-F.col("nats") / float(np.log(10))).alias("score"),
        (F.col("nats") / float(np.log(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
