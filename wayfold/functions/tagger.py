"""Parts of speech and lemmas that are learned from marked sentences.

Tags: the most probable sequence (Viterbi) of a model of a tag after a tag and
a word by its tag; words never seen are told by their endings and shape.
Lemmas: a word seen with its tag has the commonest lemma there; any other takes
the rule (ending, new ending) of the longest ending known for its tag.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of words that count as tokens.  Fixed values.
KEPT = ("FW", "JJ", "JJR", "JJS", "NN", "NNS", "NNP", "NNPS", "RB", "RP", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "WRB")
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[^\w\s]")
LONGEST, START = 4, "<s>"


def shape(word: str) -> str:
    return "9" if word[0].isdigit() else "." if not word[0].isalnum() else "X" if word[0].isupper() else "x"


def endings(word: str) -> list[str]:
    """Its endings, the longest first, down to none."""
    low = word.lower()
    return [low[len(low) - k :] for k in range(min(LONGEST, len(low) - 1), 0, -1)] + [""]


@dataclass
class Tagger:
    """Counts of marked sentences: tags after tags, words and endings by tag, lemmas and their rules."""

    after: dict[str, Counter]
    words: dict[str, Counter]
    ends: dict[str, Counter]
    lemmas: dict[str, Counter]
    rules: dict[str, Counter]

    @classmethod
    def learned(cls, sentences: list[list[tuple[str, str, str]]]) -> Tagger:
        """From sentences of (word, tag, lemma)."""
        made = cls(*(defaultdict(Counter) for _ in range(5)))
        for sentence in sentences:
            before = START
            for word, tag, lemma in sentence:
                low, lemma = word.lower(), lemma.lower()
                made.after[before][tag] += 1
                before = tag
                made.words[low][tag] += 1
                for end in endings(word):
                    made.ends[f"{shape(word)} {end}"][tag] += 1
                made.lemmas[f"{low} {tag}"][lemma] += 1
                same = next((k for k, (a, b) in enumerate(zip(low, lemma, strict=False)) if a != b), min(len(low), len(lemma)))
                old, new = low[same:], lemma[same:]
                for end in endings(word):
                    if end.endswith(old):
                        made.rules[f"{tag} {end}"][f"{old}>{new}"] += 1
        return made

    def chances(self, word: str, tags: list[str]) -> list[float]:
        """The logarithm of how well a word goes with each tag."""
        low = word.lower()
        seen = self.words.get(low)
        if not seen:
            seen = next((c for end in endings(word) if (c := self.ends.get(f"{shape(word)} {end}"))), None) or self.ends.get(f"{shape(word)} ") or Counter()
        total = sum(seen.values())
        return [log((seen[t] + 0.01) / (total + 0.01 * len(tags))) - log(self.common[t]) for t in tags]

    @property
    def common(self) -> Counter:
        if not hasattr(self, "_common"):
            self._common = Counter()
            for c in self.after.values():
                self._common.update(c)
        return self._common

    def tags(self, words: list[str]) -> list[str]:
        """The most probable tags of a sentence."""
        tags = sorted(self.common)
        if not words or not tags:
            return [""] * len(words)
        step = {a: [log((self.after.get(a, Counter())[b] + 0.1) / (sum(self.after.get(a, Counter()).values()) + 0.1 * len(tags))) for b in tags] for a in [START, *tags]}
        best, back = [x + y for x, y in zip(step[START], self.chances(words[0], tags), strict=True)], []
        for word in words[1:]:
            own = self.chances(word, tags)
            come = [max(range(len(tags)), key=lambda a, b=b: best[a] + step[tags[a]][b]) for b in range(len(tags))]
            best = [best[a] + step[tags[a]][b] + own[b] for b, a in enumerate(come)]
            back.append(come)
        at = max(range(len(tags)), key=best.__getitem__)
        path = [at]
        for come in reversed(back):
            path.append(at := come[at])
        return [tags[k] for k in reversed(path)]

    def lemma(self, word: str, tag: str) -> str:
        low = word.lower()
        if known := self.lemmas.get(f"{low} {tag}"):
            return min(known, key=lambda x: (-known[x], x))
        for end in endings(word):
            if rules := self.rules.get(f"{tag} {end}"):
                old, _, new = min(rules, key=lambda x: (-rules[x], x)).partition(">")
                if low.endswith(old) and len(low) > len(old):
                    return low[: len(low) - len(old)] + new
        return low

    def lemma_set(self, text: str | None, kept: tuple[str, ...] = KEPT) -> list[str]:
        """Different lemmas of the words with the tags that are kept, in order of appearance."""
        found: dict[str, None] = {}
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
            words = WORDS.findall(sentence)
            for word, tag in zip(words, self.tags(words), strict=True):
                if tag in kept:
                    found.setdefault(self.lemma(word, tag))
        return list(found)

    def __call__(self, text: Column, kept: tuple[str, ...] = KEPT) -> Column:
        lemmas = F.pandas_udf(lambda texts: pd.Series([self.lemma_set(t, kept) for t in texts], dtype=object), "array<string>")  # the model, of bounded size, goes with it
        return lemmas(text)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(name, json.dumps(key), json.dumps(dict(c))) for name in ("after", "words", "ends", "lemmas", "rules") for key, c in getattr(self, name).items()]
        spark.createDataFrame(rows, "part string, key string, counts string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tagger:
        made = cls(*(defaultdict(Counter) for _ in range(5)))
        for r in spark.read.parquet(path).collect():  # as many as fit() has taken
            getattr(made, r.part)[json.loads(r.key)] = Counter(json.loads(r.counts))
        return made


def fit(marked: DataFrame, most: int = 50_000) -> Tagger:
    """From rows (sentence, place, word, tag, lemma); of more than `most` sentences those with the smallest hashes."""
    rows = marked.select(F.col("sentence").cast("string").alias("sentence"), "place", "word", "tag", F.coalesce("lemma", F.lower("word")).alias("lemma")).where("sentence is not null and length(word) > 0 and tag is not null")
    chosen = rows.select("sentence").distinct().orderBy(F.xxhash64("sentence"), "sentence").limit(most)
    sentences = rows.join(chosen, "sentence").groupBy("sentence").agg(F.sort_array(F.collect_list(F.struct("place", "word", "tag", "lemma"))).alias("words"))
    return Tagger.learned([[(w.word, w.tag, w.lemma) for w in r.words] for r in sorted(sentences.collect(), key=lambda r: r.sentence)])
