"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give the characters of each word, given those
before them in the word.  Where a class has too few counts it backs off to one
Kneser-Ney model of both classes together, so an expression that neither class
knows well counts the same for both, and a rare form of a telling expression is
told by what it shares with others.  A text is judged by the difference of its
two log-likelihoods, every occurrence of every whole word counted, normalised
by its length; a logistic step, with how much of it comes from clearly toxic
words, makes that a probability.  The counts and the logistic step come from a
bounded sample of labelled documents.

What one character adds to the difference depends on its context and itself
only: the shared model cancels out where neither class has seen the character
after a context, so the models become two sorted arrays, of known contexts and
of known characters in them, by 64-bit hashes, and texts are scored by whole
batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import U64, bounded_batches, emit, give_back, mixed, rows, thrifty
from wayfold.sources.shared import keep

#: The most labelled documents of each class that the models are fitted on, and the share kept for the logistic step.
MOST_OF_CLASS, HELD_BACK = 4000, 4
#: Longest gram; full contexts seen fewer than RARE times in all back off.
ORDER, RARE = 6, 3
#: DRAWN more counts of a class's context go to the shared model.
DISCOUNT, DRAWN, THRESHOLD = 0.75, 6.0, 0.3
#: What stands before a word's first character and after its last; a word whose ratio is above CLEAR is clearly toxic.
START, STOP, CLEAR = 2, 3, 3.0
#: Characters of text that are scored at once, and words that are learned from at once.
WINDOW, CHUNK = 1 << 18, 20_000
SPACES, MARKS = " \t\n\x0b\x0c\r", "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"


@dataclass
class Words:
    """Words as one array of code points, START and STOP around each; rows ascend."""

    marked: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        """The words of texts in lower case, without the marks around them; what is only marks is none."""
        lowered = [(t or "").lower() for t in texts]
        point = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) + 1 for t in lowered])
        kind = np.zeros(len(point), dtype=np.int8)
        small = point < 128
        table = np.zeros(128, dtype=np.int8)
        table[list(map(ord, MARKS))], table[list(map(ord, SPACES))] = 1, 2
        kind[small] = table[point[small]]
        solid = np.flatnonzero(kind == 0)
        if not len(solid):
            return cls(np.zeros(0, dtype=np.uint32), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
        run = np.cumsum(kind == 2)[solid]  # characters of one run have no white space between them
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        begin, end = solid[first], solid[np.append(first[1:], len(solid)) - 1] + 1
        size = end - begin + 2
        starts = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(starts, size)
        at = np.repeat(begin, size) + inside - 1
        last = inside == np.repeat(size, size) - 1
        marked = np.where(inside == 0, START, np.where(last, STOP, point[np.clip(at, 0, len(point) - 1)])).astype(np.uint32)
        return cls(marked, inside, starts, np.searchsorted(ends, begin, side="right"))

    def word(self) -> np.ndarray:
        """Of each code point the word it belongs to."""
        return np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=len(self.marked)))

    def contexts(self, length: int) -> np.ndarray:
        """A hash of up to `length` code points before each, in its word."""
        h = np.zeros(len(self.marked), dtype=U64)
        for k in range(length, 0, -1):
            before = np.zeros(len(h), dtype=U64)
            before[k:] = self.marked[:-k]
            before[self.inside < k] = 0
            h = mixed(h + before + U64(k))
        return h

    def grams(self, contexts: np.ndarray) -> np.ndarray:
        return mixed(contexts ^ (self.marked.astype(U64) << U64(32)))


def first_and_sums(key: np.ndarray, carried: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys, ascending; what one row of each carries; the sums of their weights."""
    every, place, back = np.unique(key, return_index=True, return_inverse=True)
    return every, [x[place] for x in carried], [np.bincount(back, w, len(every)) for w in weights]


class Table:
    """Rows (key, *carried, *weights) with one row a key, to which others are added."""

    def __init__(self, carried: int, weights: int) -> None:
        self.key = np.zeros(0, dtype=U64)
        self.carried, self.weights = [np.zeros(0, dtype=U64) for _ in range(carried)], [np.zeros(0) for _ in range(weights)]

    def add(self, key: np.ndarray, carried: list[np.ndarray], weights: list[np.ndarray]) -> None:
        key, carried, weights = first_and_sums(key, carried, weights)
        both = lambda old, new: [np.concatenate(x) for x in zip(old, new, strict=True)]
        self.key, self.carried, self.weights = first_and_sums(np.concatenate([self.key, key]), both(self.carried, carried), both(self.weights, weights))


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `wanted` are among the ascending `keys`, and which are there at all."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.intp), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at, there = found(keys, wanted)
    return np.where(there, values[at] if len(keys) else 0.0, 0.0)


def backed_off(shared: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, here: np.ndarray) -> np.ndarray:
    """`shared` after the next longer context: the discounted count, what was discounted going to the shorter ones; unchanged where it is unknown."""
    return np.where(here & (total > 0), (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * shared) / np.maximum(total, 1), shared)


@dataclass
class KneserNey:
    """What characters add to the difference of the log-likelihoods: in known contexts those never seen there, and known ones."""

    contexts: np.ndarray
    unseen: np.ndarray
    grams: np.ndarray
    seen: np.ndarray

    @classmethod
    def fit(cls, words: pa.Array, toxic: np.ndarray, ordinary: np.ndarray) -> KneserNey:
        """From distinct words and how often each class has them; worked on CHUNK words at a time, only sums are held."""
        full = ORDER - 1

        def chunks() -> Iterator[tuple]:
            """Of each place in the words its contexts and grams by length, how long its full context is, and the counts."""
            for a in range(0, len(words), CHUNK):
                own = Words.of(words.slice(a, CHUNK).to_pylist())
                real, word = own.inside > 0, own.row[own.word()] + a
                contexts = [own.contexts(k) for k in range(ORDER)]
                grams = [own.grams(c)[real] for c in contexts]
                yield [c[real] for c in contexts], grams, np.minimum(own.inside, full)[real], toxic[word[real]], ordinary[word[real]]

        every = Table(0, 2)
        for contexts, _, depth, t, o in chunks():
            every.add(contexts[full], [], [t + o, depth == full])
        often = every.key[(every.weights[0] >= RARE) | (every.weights[1] == 0)]

        known = Table(2 * ORDER + 1, 2)  # grams in contexts that are kept, with those of their suffixes
        for contexts, grams, depth, t, o in chunks():
            kept = found(often, contexts[full])[1]
            known.add(grams[full][kept], [x[kept] for x in (*contexts, *grams, depth.astype(U64))], [t[kept], o[kept]])
        context, gram, depth = known.carried[:ORDER], known.carried[ORDER:-1], known.carried[-1].astype(np.int64)

        wanted = [np.unique(context[k][depth > k]) for k in range(full)]
        before = [Table(2, 0) for _ in wanted]  # per length, the different grams with one character more in front
        for contexts, grams, deep, _, _ in chunks():
            for k, table in enumerate(before):
                here = (deep > k) & found(wanted[k], contexts[k])[1]
                table.add(grams[k + 1][here], [contexts[k][here], grams[k][here]], [])

        contexts, total = np.unique(context[full], return_inverse=True)
        sums = [np.bincount(total, c, len(contexts)) for c in known.weights]
        types = [np.bincount(total, c > 0, len(contexts)) for c in known.weights]
        shared = np.full(len(known.key), 1 / 256)
        for k, table in enumerate(before):
            n_grams, (of,), (n,) = first_and_sums(table.carried[1], table.carried[:1], [np.ones(len(table.key))])
            n_contexts, _, (all_n, kinds) = first_and_sums(of, [], [n, np.ones(len(of))])
            shared = backed_off(shared, looked_up(n_grams, n, gram[k]), looked_up(n_contexts, all_n, context[k]), looked_up(n_contexts, kinds, context[k]), depth > k)
        shared = backed_off(shared, sum(known.weights), sum(sums)[total], np.bincount(total, minlength=len(contexts))[total], np.full(len(total), True))

        seen, unseen = [], []
        for c, n, kinds in zip(known.weights, sums, types, strict=True):
            seen.append(np.log(np.where(n[total] > 0, (np.maximum(c - DISCOUNT, 0) + (DISCOUNT * kinds[total] + DRAWN) * shared) / (n[total] + DRAWN), shared)))
            unseen.append(np.log(np.where(n > 0, (DISCOUNT * kinds + DRAWN) / (n + DRAWN), 1.0)))
        return cls(contexts, (unseen[0] - unseen[1]).astype(np.float32), known.key, (seen[0] - seen[1]).astype(np.float32))

    def ratios(self, words: Words) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not len(words.starts):
            return np.zeros(0)
        context = words.contexts(ORDER - 1)
        at, there = found(self.grams, words.grams(context))
        step = np.where(there, self.seen[at], looked_up(self.contexts, self.unseen, context)) if len(self.grams) else np.zeros(len(context))
        step[words.inside == 0] = 0
        return np.add.reduceat(step.astype(np.float64), words.starts)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, by its words: the mean of the ratios, what clearly toxic words add to it, that weighed by length, and the clearest word."""
        out = np.zeros((len(texts), 4))
        for a, b in windows(texts):
            words = Words.of(texts[a:b])
            r, n = self.ratios(words), np.bincount(words.row, minlength=b - a)
            clear = np.bincount(words.row, np.maximum(r - CLEAR, 0), b - a)
            top = np.zeros(b - a)
            np.maximum.at(top, words.row, r)
            some = np.maximum(n, 1)
            out[a:b] = np.column_stack([np.bincount(words.row, r, b - a) / some, clear / some, clear / some**0.5, np.minimum(top, 12.0)])
        return out


def windows(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about WINDOW characters together."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= WINDOW:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def words_of(text: str | None) -> list[str]:
    """The words of one text, as Words.of() has them."""
    return [w for x in re.split(f"[{SPACES}]+", (text or "").lower()) if (w := x.strip(MARKS))]


@dataclass
class Model:
    language: KneserNey
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (self.language.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(b)), x.T @ (w * (y - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def in_class(labels: DataFrame, toxic: int) -> DataFrame:
    return labels.where(F.col("toxic") == toxic)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on documents with a row (doc_id, toxic) in `labels`; rows with a null in either have no effect.

    At most MOST_OF_CLASS documents of each class, those with the smallest
    hashes of their ids, one in HELD_BACK of them for the logistic step, in
    which classes weigh as they do among all labels.  Without both classes
    every score is the share of toxic labels.
    """
    bounded_batches(docs.sparkSession)
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in said.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = in_class(said, 1).orderBy(order, "doc_id").limit(MOST_OF_CLASS).unionByName(in_class(said, 0).orderBy(order, "doc_id").limit(MOST_OF_CLASS))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = keep(own.join(F.broadcast(chosen), "doc_id").withColumn("back", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_BACK)) == 0), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        for text, toxic in rows(batches, "text", "toxic"):
            counts[1 - toxic].update(words_of(text))
        every = ((w, counts[0].get(w, 0), counts[1].get(w, 0)) for w in counts[0].keys() | counts[1].keys())
        yield from emit(every, pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())]))

    words = sample.where("not back").select("text", "toxic").mapInArrow(thrifty(counted), "word string, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic"), F.sum("ordinary"))
    counted_words = words.toArrow()
    language = KneserNey.fit(counted_words.column(0).combine_chunks(), *(counted_words.column(k).to_numpy().astype(float) for k in (1, 2)))
    del counted_words
    give_back()
    shipped = docs.sparkSession.sparkContext.broadcast(language)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            every = list(rows([batch], "text", "toxic"))
            x = shipped.value.features([text for text, _ in every])
            yield from emit(((toxic, f) for (_, toxic), f in zip(every, x.tolist(), strict=True)), schema)

    fitted = sample.where("back").select("text", "toxic").mapInArrow(thrifty(described), "toxic int, x array<double>").collect()
    y = np.array([r[0] for r in fitted], dtype=float)
    x = np.array([r[1] for r in fitted]).reshape(len(y), 4)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not 0 < y.sum() < len(y):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(language, np.zeros(4), np.ones(4), np.array([np.log(p / (1 - p)), 0, 0, 0, 0]))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y == 1, share * len(y) / y.sum(), (1 - share) * len(y) / (len(y) - y.sum()))
    return Model(language, centre, scale, logistic((x - centre) / scale, y, weight))


def scorer(model: Model, docs: DataFrame):
    """A column function: text -> score."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score(text.tolist()))

    return score


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text; a null text counts as empty, repeated rows stay repeated."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.select("doc_id", scorer(model, docs)("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text isn't predicted toxic."""
    return docs.where(scorer(model, docs)(F.col(text_col).cast("string")) < THRESHOLD)
