"""A grader of sentences that is learned: grades of 0 (worst) to 4 (best) by words in their order.

A sentence is told by its words, each marked if a negation stands before it in
the same clause, and by its runs of two and three words; their hashes select
rows of weights, and the grade with the largest sum wins.  The weights are
fitted by softmax regression on a bounded sample of graded sentences.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRADES, SLOTS = 5, 1 << 17
#: Words that turn what follows them.  Fixed values.
NEGATIONS = frozenset(["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "without", "hardly", "cannot"])
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?,;:]")


def slots(sentence: str | None) -> np.ndarray:
    """The different rows of weights that a sentence selects."""
    words = WORDS.findall((sentence or "").lower())
    marked, turned = [], False
    for word in words:
        if not word[0].isalpha():
            turned = False
        marked.append(("-" if turned and word[0].isalpha() else "") + word)
        turned = turned or word in NEGATIONS or word.endswith(("n't", "n’t"))
    runs = [*marked, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False))]
    return np.unique(np.fromiter((zlib.crc32(x.encode()) % SLOTS for x in runs), dtype=np.int64, count=len(runs)))


@dataclass
class Grader:
    """Grades sentences; the grade of one without known words is the commonest of the sample."""

    weights: np.ndarray  # a row for each slot and a last one for all sentences

    def grades(self, sentences: pd.Series) -> pd.Series:
        last = self.weights[-1]
        return pd.Series([int(np.argmax(last + self.weights[slots(s)].sum(axis=0))) for s in sentences], dtype="int32")

    def __call__(self, sentence: Column) -> Column:
        grades = F.pandas_udf(self.grades, "int")  # 2.6 MB of weights go with it
        return grades(sentence)

    def save(self, spark: SparkSession, path: str) -> None:
        at, grade = np.nonzero(self.weights)
        rows = pd.DataFrame({"slot": at, "grade": grade, "weight": self.weights[at, grade].astype(float)})
        spark.createDataFrame(rows, "slot int, grade int, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Grader:
        weights = np.zeros((SLOTS + 1, GRADES), dtype=np.float32)
        for r in spark.read.parquet(path).collect():  # at most SLOTS * GRADES
            weights[r.slot, r.grade] = r.weight
        return cls(weights)


def fit(sample: DataFrame, text: str = "text", grade: str = "grade", most: int = 20_000, rounds: int = 6) -> Grader:
    """Fits a grader on rows of `sample` (text, grade); of more than `most` different ones those with the smallest hashes, as many of each grade."""
    known = sample.select(F.col(text).cast("string").alias("text"), F.col(grade).cast("int").alias("grade")).where(f"text is not null and grade between 0 and {GRADES - 1}").distinct()
    place = F.row_number().over(Window.partitionBy("grade").orderBy(F.xxhash64("text"), "text"))
    rows = known.withColumn("place", place).where(F.col("place") <= most // GRADES).select("text", "grade").toPandas().sort_values(["text", "grade"])
    return trained([(slots(t), int(g)) for t, g in zip(rows["text"], rows["grade"], strict=True)], rounds)


def trained(rows: list[tuple[np.ndarray, int]], rounds: int, step: float = 0.4, weight: float = 1e-4) -> Grader:
    """Softmax regression by steps that shrink with each weight's own gradients; grades count alike, however common."""
    weights, seen = np.zeros((SLOTS + 1, GRADES), dtype=np.float32), np.full((SLOTS + 1, GRADES), 1e-2, dtype=np.float32)
    often = np.bincount([g for _, g in rows], minlength=GRADES) if rows else np.ones(GRADES)
    draw = np.random.default_rng(1)
    for _ in range(rounds):
        for k in draw.permutation(len(rows)).tolist():
            at, g = rows[k]
            at = np.append(at, SLOTS)
            z = weights[at].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[g] -= 1
            pull = p * (len(rows) / (np.count_nonzero(often) * often[g])) + weight * weights[at]
            seen[at] += pull * pull
            weights[at] -= step * pull / np.sqrt(seen[at])
    return Grader(weights)
