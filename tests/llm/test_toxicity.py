"""The toxicity model against a plain Kneser-Ney model of dictionaries."""

import random
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa

from wayfold.llm import toxicity
from wayfold.llm.toxicity import DISCOUNT, DRAWN, ORDER, RARE


class Plain:
    """counts[class][context][character]; the pooled lower orders count the different characters before."""

    def __init__(self, words):
        self.own, self.pooled, runs = [{}, {}], {}, set()
        for word, *counts in words:
            for context, c in self.grams(word):
                for at, n in ((self.own[0], counts[0]), (self.own[1], counts[1]), (self.pooled, sum(counts))):
                    if n:
                        at.setdefault(context, Counter())[c] += n
                runs |= {(context + c)[k:] for k in range(len(context))}
        for context in [k for k, at in self.pooled.items() if len(k) == ORDER - 1 and sum(at.values()) < RARE]:
            for at in (self.pooled, *self.own):
                at.pop(context, None)
        for run in runs:
            if len(run) < ORDER + 1 and not run[1:-1].startswith("\x02") and len(run) - 2 < ORDER - 1:
                self.pooled.setdefault(run[1:-1], Counter())[run[-1]] += 1

    @staticmethod
    def grams(word):
        marked = f"\x02{word}\x03"
        return [(marked[max(0, k - ORDER + 1) : k], marked[k]) for k in range(1, len(marked))]

    def shared(self, context, c):
        p = 1 / 256
        for k in range(len(context), -1, -1):
            if at := self.pooled.get(context[k:]):
                p = (max(at[c] - DISCOUNT, 0) + DISCOUNT * len(at) * p) / sum(at.values())
        return p

    def likelihood(self, word, which):
        total = 0.0
        for context, c in self.grams(word):
            at, p = self.own[which].get(context), self.shared(context, c)
            total += log((max(at[c] - DISCOUNT, 0) + (DISCOUNT * len(at) + DRAWN) * p) / (sum(at.values()) + DRAWN) if at else p)
        return total


def fitted(words):
    return toxicity.KneserNey.fit(pa.array([w for w, _, _ in words], type=pa.string()), *(np.array([w[k] for w in words], dtype=float) for k in (1, 2)))


def test_ratios_are_those_of_two_plain_models(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    rng = random.Random(11)
    stems = ["".join(rng.choices("abcdeß漢é", k=rng.randrange(1, 12))) for _ in range(150)]
    words = [(w, rng.randrange(4), rng.randrange(4)) for w in sorted(set(stems))]
    words = [w for w in words if w[1] + w[2]]
    plain, model = Plain(words), fitted(words)
    asked = [w for w, _, _ in words] + ["".join(rng.choices("abcdeßxyz", k=rng.randrange(1, 60))) for _ in range(150)]
    expected = [plain.likelihood(w, 0) - plain.likelihood(w, 1) for w in asked]
    assert np.allclose(model.ratios(toxicity.Words.of(asked)), expected, atol=1e-4) and np.std(expected) > 0.5


def test_every_occurrence_of_every_whole_word_counts():
    head = "x" * 50
    model = fitted([(f"{head}toxic", 20, 0), (f"{head}plain", 0, 20)])
    some, more, other = model.features([f"{head}toxic {head}plain", f"{head}toxic {head}toxic {head}plain", f"{head}plain"])[:, 0]
    assert other < some < more
    assert model.features([None, "", " .,! "]).tolist() == [[0.0] * 4] * 3


def test_words_are_the_same_one_by_one_and_together():
    rng = random.Random(12)
    texts = [None, "", "...", *("".join(rng.choices(["a", "B", "é", "Σ", "İ", " ", "  ", "\n", "\t", ".", "'", "-", "漢", "x-y"], k=rng.randrange(30))) for _ in range(300))]
    found = toxicity.Words.of(texts)
    together = [[] for _ in texts]
    for row, a, b in zip(found.row, found.starts, [*found.starts[1:], len(found.marked)]):
        together[row].append("".join(map(chr, found.marked[a + 1 : b - 1])))
    assert together == [toxicity.words_of(t) for t in texts]
