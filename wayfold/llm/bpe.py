"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding.  A sequence of tokens is the merge result of its bytes exactly if
every two neighbours are the merge result of theirs.  So each prefix of a piece
has one last token, the longest of its suffixes that is a token and fits the
last token before it.  Which tokens can end or stay open after some bytes is
the state of an automaton that is determinised lazily: a state is the longest
suffix read that a token begins with, and states and moves are made when first
met, as rows of flat integer arrays, and forgotten together when there are too
many.  All pieces of a batch walk these arrays at once, one byte a step.

No token stays open for more than the longest token's bytes, which bounds the
lookahead: the pieces of a batch, LONG bytes at most, emit their tokens at their
ends, and a longer piece goes through a stream of its own, whose states hold
the token emitted last too and which emits what all continuations share: the
tokens before the last boundary through which all prefixes pass that a longer
token could still continue from.

Decoding.  A UTF-8 automaton runs over whole tokens: the state is what the next
bytes must be, each (state, token) is resolved once, and text is released up to
the last complete character.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import bounded_batches, rows, thrifty

#: Bounds of what a worker remembers: states, and which tokens may follow each other.
STATES, FITS = 60_000, 50_000
#: The longest piece, in bytes, that walks with others, and the bytes of text that are worked on at once.
LONG, WINDOW = 256, 1 << 18


class State:
    """The token emitted last, the bytes read since, for each place in them the start and id of the last token, and where the longest open token can start."""

    __slots__ = ("last", "ends", "held", "reach", "moves")

    def __init__(self, last: int, held: bytes, ends: list[tuple[int, int]], reach: int) -> None:
        self.last, self.held, self.ends, self.reach, self.moves = last, held, ends, reach, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES) -> None:
        self.ranks, self.most_states = ranks, most_states
        self.openers = {t[:k] for t in ranks for k in range(1, len(t))}  # what a longer token can still grow from
        self.runs = self.openers | ranks.keys()
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.fits: dict[tuple[int, int], bool] = {}
        self.grown: dict[int, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        self.root = self.state(-1, b"", [(0, -1)], 0)

    def state(self, last: int, held: bytes, ends: list[tuple[int, int]], reach: int) -> State:
        if (found := self.states.get((last, held))) is None:
            found = self.states[last, held] = State(last, held, ends, reach)
        return found

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """The plain merge procedure, always the lowest rank, leftmost first, as long as there are more than `until` parts."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spines(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The pieces at a token's left and at its right end while it is merged: (bytes, rank), from one byte to the token."""
        if (known := self.grown.get(token)) is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = [(data, -1)], [(data, -1)]
            else:
                parts = self.merged(data, until=2)
                left, right = (self.spines(t) for t in parts)
                known = [*left[0], (data, token)], [*right[1], (data, token)]
            self.grown[token] = known
        return known

    def fit(self, a: int, b: int) -> bool:
        """Are a, b what merging their bytes leaves?  Only if no merge across their border comes before those inside."""
        if a < 0:
            return True
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > FITS:
                self.fits.clear()
            known = self.fits[a, b] = self.stay(a, b)
        return known

    def stay(self, a: int, b: int) -> bool:
        return self.apart(self.spines(a)[1], self.spines(b)[0])

    def apart(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        i = j = 0
        never = 1 << 30
        while True:
            across = self.ranks.get(left[i][0] + right[j][0], never)
            next_left = left[i + 1][1] if i + 1 < len(left) else never
            next_right = right[j + 1][1] if j + 1 < len(right) else never
            if across < next_left and across <= next_right and across < never:  # of equal ranks the leftmost merges first
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    @staticmethod
    def path(ends: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
        """(place, token that ends there) on the way from `at` back to the beginning."""
        way = []
        while at:
            way.append((at, ends[at][1]))
            at = ends[at][0]
        return way

    def move(self, s: State, byte: int) -> tuple[State, tuple[int, ...]]:
        held = s.held + bytes((byte,))
        n, reach, ranks, openers = len(held), s.reach, self.ranks, self.openers
        while held[reach:] not in self.runs:
            reach += 1
        for start in range(reach, n):  # tokens that end here start no earlier
            token = ranks.get(held[start:])
            if token is not None and self.fit(s.ends[start][1], token):
                break
        ends = [*s.ends, (start, token)]
        cut = 0
        if reach or held not in openers:  # else a longer token may still start where the last one ended
            cut = n
            for k in range(n - 1, reach - 1, -1):  # the last boundary that the ways to all open starts and to the end share
                if held[k:] in openers:
                    while k != cut:
                        if k > cut:
                            k = ends[k][0]
                        else:
                            cut = ends[cut][0]
        out = tuple(t for _, t in reversed(self.path(ends, cut)))
        if cut:
            ends = [(0, ends[cut][1])] + [(max(a - cut, 0), t) for a, t in ends[cut + 1 :]]
            after = self.state(out[-1], held[cut:], ends, max(reach - cut, 0))
        else:
            after = self.state(s.last, held, ends, reach)
        s.moves[byte] = after, out
        return after, out

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece, whatever its length, read byte by byte."""
        if len(self.states) > self.most_states:
            self.reset()
        out: list[int] = []
        s = self.root
        for byte in piece:
            s, new = s.moves.get(byte) or self.move(s, byte)
            if new:
                out += new
        if s.held:
            out += [t for _, t in reversed(self.path(s.ends, len(s.held)))]
        return out


class Walker:
    """The automaton in flat arrays, and the walk of many pieces along it."""

    def __init__(self, transducer: Transducer, most_states: int = STATES, bits: int = 20) -> None:
        self.transducer, self.most_states, self.bits = transducer, most_states, bits
        n = max(transducer.tokens) + 1
        self.size, self.shorter = np.zeros(n, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        for token, i in transducer.ranks.items():
            self.size[i] = len(token)
            self.shorter[i] = self.longest(token[1:])
        self.pairs = np.full(1 << bits, -1, dtype=np.int64)  # twice the pair of tokens, and whether they fit
        self.reset()

    def longest(self, held: bytes) -> int:
        """The longest token at the end of `held`."""
        ranks = self.transducer.ranks
        return next((ranks[held[k:]] for k in range(len(held)) if held[k:] in ranks), -1)

    def reset(self) -> None:
        self.held, self.number = [b""], {b"": 0}
        self.moves, self.token = np.full((1024, 256), -1, dtype=np.int32), np.full(1024, -1, dtype=np.int32)

    def move(self, state: int, byte: int) -> None:
        """Makes the move of a state by a byte, and where it leads."""
        held, runs = self.held[state] + bytes((byte,)), self.transducer.runs
        while held not in runs:
            held = held[1:]
        if (after := self.number.get(held)) is None:
            after = self.number[held] = len(self.held)
            self.held.append(held)
            if after == len(self.moves):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
                self.token = np.concatenate([self.token, np.full_like(self.token, -1)])
            self.token[after] = self.longest(held)
        self.moves[state, byte] = after

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Transducer.fit() of many pairs; pairs share slots, and what another pair has put there is asked for again."""
        pair = (a.astype(np.int64) + 1 << 32) + b
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        known = self.pairs[slot]
        missing = np.flatnonzero(known >> 1 != pair)
        if len(missing):
            new, back = np.unique(pair[missing], return_inverse=True)
            told = new * 2 + np.array([p >> 32 == 0 or self.transducer.stay((p >> 32) - 1, p & 0xFFFFFFFF) for p in new.tolist()])
            known[missing] = told[back]
            self.pairs[slot[missing]] = told[back]
        return (known & 1).astype(bool)

    def walk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """Puts the tokens of the pieces of `data` into `out`, each where its last byte is."""
        if len(self.held) > self.most_states:
            self.reset()
        if not len(sizes):
            return
        order = np.argsort((LONG - sizes).astype(np.uint16), kind="stable")  # the longest first, so that those still walking are in front
        starts, sizes = starts[order], sizes[order].astype(np.int64)
        walking = [len(sizes), *(len(sizes) - np.cumsum(np.bincount(sizes))).tolist()[:-1]]
        base = np.concatenate(([0], np.cumsum(walking)))
        last = np.empty(base[-1], dtype=np.int32)  # by length of prefix and piece, the last token
        last[: walking[0]] = -1
        state, lanes, size = np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes)), self.size
        for k, n in enumerate(walking[1:], 1):
            at = state[:n] * 256
            at += data[starts[:n] + (k - 1)]
            after = self.moves.reshape(-1)[at]
            if after.min() < 0:
                for new in np.unique(at[after < 0]).tolist():
                    self.move(new >> 8, new & 255)
                after = self.moves.reshape(-1)[at]
            state[:n] = after
            token = self.token[after]
            wrong = np.flatnonzero(~self.fits(last[base[k - size[token]] + lanes[:n]], token))
            while len(wrong):
                less = token[wrong] = self.shorter[token[wrong]]
                wrong = wrong[~self.fits(last[base[k - size[less]] + wrong], less)]
            last[base[k] : base[k] + n] = token
        ends = starts - 1
        while len(lanes):  # from each piece's end to its beginning
            token = last[base[sizes] + lanes]
            out[ends[lanes] + sizes] = token
            sizes = sizes - size[token]
            more = sizes > 0
            lanes, sizes = lanes[more], sizes[more]


LETTER, NUMBER, MARK, SPACE = range(4)


def by_tiktoken(text: str, pattern: str) -> str:
    """The characters of `text` that fit `pattern`, to the engine of `tiktoken`."""
    found = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes((b,)): b for b in range(256)}, special_tokens={})
    return bytes(found.encode_ordinary(text)).decode()


@lru_cache(maxsize=1)
def kinds(engine: Callable[[str, str], str] = by_tiktoken) -> np.ndarray:
    """What each code point is to the piece pattern; engines may follow different versions of Unicode."""
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    found = np.full(0x110000, MARK, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found[np.frombuffer(engine(every, pattern).encode("utf-32-le"), dtype="<u4")] = kind
    return found


def pieces(data: np.ndarray, texts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where in the UTF-8 bytes of texts that begin at `texts` a match of PIECES begins."""
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    at = np.flatnonzero(data & 0xC0 != 0x80)
    kind, n = kinds[point], len(point)
    first = np.zeros(n + 3, dtype=bool)  # padded, so that looking ahead stays inside
    first[np.searchsorted(at, texts)] = True
    first[n:] = True
    space = kind == SPACE
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    begins[1:] &= first[1:n] | space[1:] | (point[:-1] != 32)  # a space goes to what follows
    begins[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]  # the last white space before other text
    quote = np.flatnonzero((point == 39) & begins)
    quote = quote[~first[quote + 1]]
    if len(quote):
        one, two = point[quote + 1], np.where(first[quote + 2], 0, point[np.minimum(quote + 2, n - 1)])
        r, v, l, e = map(ord, "rvle")
        short = np.isin(one, list(map(ord, "stmd")))
        long = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
        quote, size = quote[short | long], np.where(short, 2, 3)[short | long]
        begins[quote + 1] = False
        after = quote + size
        begins[after[after < n]] = True
    return at[begins]


#: The pattern that pieces() knows; texts are cut by others one by one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextEncoder:
    """Ids of many texts at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer, self.kinds = Transducer(ranks), kinds()
        self.walker, self.pattern = Walker(self.transducer), None if pattern == PIECES else regex.compile(pattern)

    def cuts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        if self.pattern is None:
            return pieces(data, texts, self.kinds)
        found = []
        for a, b in zip(texts.tolist(), [*texts[1:].tolist(), len(data)], strict=True):
            parts = self.pattern.findall(data[a:b].tobytes().decode())
            found.append(a + np.cumsum([0, *(len(p.encode()) for p in parts[:-1])]))
        return np.concatenate(found)

    def encode(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """For each byte of texts that begin at `texts`, none empty, the token that ends with it or -1."""
        out = np.full(len(data), -1, dtype=np.int32)
        starts = self.cuts(data, texts)
        sizes = np.diff(starts, append=len(data))
        short = sizes <= LONG
        self.walker.walk(data, starts[short], sizes[short], out)
        for a, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
            ids = np.array(self.transducer.encode(data[a : a + n].tobytes()), dtype=np.int32)
            out[a - 1 + np.cumsum(self.walker.size[ids])] = ids
        return out

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's end) of texts whose bytes end at `ends`, worked on in windows of about WINDOW bytes."""
        found, counts, done = [], np.zeros(len(ends) + 1, dtype=np.int64), 0
        begins = np.concatenate(([0], ends[:-1]))
        total, n_ids = int(ends[-1]) if len(ends) else 0, 0
        cuts = np.unique(begins[begins < ends]) if total else np.zeros(0, dtype=np.int64)
        while done < total:
            stop = self.stop(data, cuts, done, total)
            here = cuts[np.searchsorted(cuts, done) : np.searchsorted(cuts, stop)] - done
            tokens = self.encode(data[done:stop], here if len(here) and here[0] == 0 else np.concatenate(([0], here)))
            at = np.flatnonzero(tokens >= 0)
            found.append(tokens[at])
            inside = slice(*np.searchsorted(ends, [done, stop], side="right"))
            counts[1:][inside] = n_ids + np.searchsorted(at, ends[inside] - done)
            n_ids, done = n_ids + len(at), stop
        np.maximum.accumulate(counts, out=counts)
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int32), counts

    def stop(self, data: np.ndarray, cuts: np.ndarray, begin: int, end: int) -> int:
        """Where a window from `begin` ends: before a text, or in a long one before white space after a visible ASCII character, where a piece begins whatever follows."""
        if end - begin <= WINDOW:
            return end
        k = np.searchsorted(cuts, begin + WINDOW, side="right") - 1
        if cuts[k] > begin:
            return int(cuts[k])
        if self.pattern is not None:
            return int(cuts[k + 1]) if k + 1 < len(cuts) else end
        last = int(cuts[k + 1]) if k + 1 < len(cuts) else end
        for at in range(begin + WINDOW, last, WINDOW):
            part = data[at - 1 : min(at + WINDOW, last)]
            space = (part == 32) | (part >= 9) & (part <= 13)
            found = np.flatnonzero(space[1:] & ~space[:-1] & (part[:-1] > 32) & (part[:-1] < 127))
            if len(found):
                return at + int(found[0])
        return last


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=1)
def coder_of(data: bytes, pattern: str) -> TextEncoder:
    """A worker's coder, with what it remembers from one task to the next."""
    return TextEncoder(read_ranks(data), pattern)


class Utf8:
    """A UTF-8 automaton: 0 between characters, else the bounds that the following bytes must keep."""

    def __init__(self) -> None:
        self.follow: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple, int] = {(): 0}
        self.lead: dict[int, int] = {}
        tail = (0x80, 0xBF)
        for byte in range(256):
            if byte < 0x80:
                rest: tuple | None = ()
            elif 0xC2 <= byte <= 0xDF:
                rest = (tail,)
            elif 0xE0 <= byte <= 0xEF:
                rest = ((0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), tail)
            elif 0xF0 <= byte <= 0xF4:
                rest = ((0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), tail, tail)
            else:
                rest = None
            self.lead[byte] = -1 if rest is None else self.named(rest)

    def named(self, rest: tuple) -> int:
        if rest not in self.number:
            self.number[rest] = len(self.follow)
            self.follow.append(rest)
        return self.number[rest]

    def step(self, state: int, byte: int) -> tuple[int, bool]:
        """The next state, and whether the bytes held so far turned out to be no character."""
        broken = False
        if state:
            (low, high), *rest = self.follow[state]
            if low <= byte <= high:
                return self.named(tuple(rest)), False
            broken = True  # the byte begins anew
        after = self.lead[byte]
        return (0, True) if after < 0 else (after, broken)


class Decoder:
    """Text from a stream of ids: feed() releases complete characters, finish() the rest; what is no UTF-8 becomes U+FFFD."""

    def __init__(self, tokens: dict[int, bytes], machine: Utf8, moves: dict[tuple[int, int], int], whole: frozenset[int] = frozenset()) -> None:
        self.tokens, self.machine, self.moves, self.whole = tokens, machine, moves, whole
        self.state, self.held = 0, b""

    def move(self, state: int, token: int) -> int:
        for byte in self.tokens[token]:
            state, _ = self.machine.step(state, byte)
        return state

    def feed(self, ids: list[int]) -> str:
        state, moves = self.state, self.moves
        if state or not self.whole.issuperset(ids):  # whole characters lead from between characters to between characters
            for t in ids:
                after = moves.get((state, t))
                if after is None:
                    after = moves[state, t] = self.move(state, t)
                state = after
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        self.state = state
        if not state:
            self.held = b""
            return data.decode("utf-8", "replace")
        cut = len(data) - 1  # where the open character began
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.state, self.held = self.held, 0, b""
        return rest.decode("utf-8", "replace")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text's end) of a column of texts; null texts are empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return held[at[0] : at[-1]], at[1:] - at[0]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each text cut by `pattern`, each piece merged by the ranks in the file `vocabulary`.

    A null or empty text has no ids.  Null and repeated doc_ids stay as they
    are, other columns are not read, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(data, pattern)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, 2000):
                ids, ends = coder(*buffers(texts.slice(k, 2000)))
                yield pa.RecordBatch.from_arrays([docs.slice(k, 2000), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(thrifty(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) for rows (doc_id, ids) of encode(); no ids give an empty text, null ids a null text."""
    with open(vocabulary, "rb") as file:
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in read_ranks(data).items()}
        machine, moves = Utf8(), {}
        plain = Decoder(tokens, machine, moves)
        whole = frozenset(t for t in tokens if plain.move(0, t) == 0)
        for batch in batches:
            texts: list[str | None] = []
            for (ids,) in rows([batch], "ids"):
                decoder = Decoder(tokens, machine, moves, whole)
                texts.append(None if ids is None else "".join([decoder.feed(ids[k : k + 4096]) for k in range(0, len(ids), 4096)]) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(thrifty(run), "doc_id long, ids array<int>, text string")
