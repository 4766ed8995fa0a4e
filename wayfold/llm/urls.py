"""URL verdicts: fixed rules first, gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones.  The trees are fitted on
a bounded sample of them and judge every URL that no rule fits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import emit, rows, thrifty

#: The most labelled URLs that the trees are fitted on.
MOST_LABELLED = 20_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURES = ("length", "host length", "path length", "host labels", "path depth", "digits", "host digits", "entropy", "host entropy", "parameters", "query length", "hyphens", "longest part", "fragment", "suffix rate", "suffix count")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


def rules(said: dict[str, str]) -> list[Rule]:
    """From `host/path` to a verdict; the longest comes first."""
    found = [Rule(text[: text.index("/")], text[text.index("/") :], verdict) for text, verdict in said.items()]
    return sorted(found, key=lambda r: (-len(r.text), r.text))


def parts(url: str | None) -> tuple[str, str]:
    """Host, lower-cased, and path; both empty for a null or a url without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = next((rest[:k] for k, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    return host.translate(LOWER), next((path[:k] for k, c in enumerate(path) if c in "?#"), path)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffix(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def features(url: str | None, host: str, path: str, rates: dict[str, tuple[float, float]]) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    rate, count = rates.get(suffix(host), (rates[""][0], 0.0))
    pieces = [x for x in path.split("/") if x]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), host.count(".") + 1, len(pieces), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host) / max(1, len(host)),
        entropy(url), entropy(host), len([x for x in query.split("&") if x]), len(query), url.count("-"), max(map(len, [*pieces, ""])), float("#" in url), rate, count,
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown on quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.base, self.grown = float(np.log(share / (1 - share))), []
        if not 0 < y.sum() < len(y):
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self.tree(codes, edges, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.grown.append(tree)
            score += self.applied(tree, x)
        return self

    def tree(self, codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-6, None, None)
        for f, e in enumerate(edges if depth else []):
            if not len(e):
                continue
            left_g = np.bincount(codes[at, f], g[at], len(e) + 1).cumsum()[:-1]
            left_h = np.bincount(codes[at, f], h[at], len(e) + 1).cumsum()[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_h < self.least / 4) | (total_h - left_h < self.least / 4)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] is None:
            return float(self.rate * total_g / (total_h + 1))
        _, f, k = best
        low = codes[at, f] <= k
        return f, float(edges[f][k]), self.tree(codes, edges, g, h, at[low], depth - 1), self.tree(codes, edges, g, h, at[~low], depth - 1)

    def applied(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self.applied(low, x), self.applied(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        total = np.full(len(x), self.base)
        for tree in self.grown:
            total += self.applied(tree, x)
        return 1 / (1 + np.exp(-total))


@dataclass
class Model:
    trees: Trees
    rates: dict[str, tuple[float, float]]


def rates_of(known: list[tuple[str, str, str, int]]) -> dict[str, tuple[float, float]]:
    """Of each suffix the share of blocked URLs, drawn to that of all, and how common it is; all have the empty suffix."""
    told: dict[str, list[int]] = {}
    for _, host, _, y in known:
        told.setdefault(suffix(host), []).append(y)
    mean = sum(y for *_, y in known) / len(known) if known else 0.0
    return {s: ((sum(ys) + 5 * mean) / (len(ys) + 5), len(ys) / len(known)) for s, ys in told.items()} | {"": (mean, 0.0)}


def train(labelled: list[tuple[str, int]], folds: int = 5) -> Model:
    """From (url, blocked) pairs; the trees see each URL with the suffix statistics of the other folds, so that they don't learn its own label from them."""
    known = [(url, *parts(url), y) for url, y in labelled]
    x = np.zeros((len(known), len(FEATURES)))
    for f in range(folds):
        rates = rates_of([k for at, k in enumerate(known) if at % folds != f])
        for at in range(f, len(known), folds):
            x[at] = features(*known[at][:3], rates)
    return Model(Trees().fit(x, np.array([y for *_, y in known], dtype=float)), rates_of(known))


def judge(pages: DataFrame, said: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every url.

    `rule` is the longest that fits, else null; `score` is the trees'
    probability of `block`, which decides at 0.5 where no rule does.  They are
    fitted on at most MOST_LABELLED different urls that rules decide, those with
    the smallest hashes; without two classes among these every other url gets the
    verdict of the only class, or `allow`.  Null urls and repeated rows are
    judged like any other, null ids stay, other columns are not read; empty
    in, empty out.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    ordered = rules(said)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("blocked", pa.int32())])

        def found() -> Iterator[tuple]:
            for (url,) in rows(batches, "url"):
                at = parts(url)
                if rule := next((r for r in ordered if r.fits(*at)), None):
                    yield url, int(rule.verdict == "block")

        yield from emit(found(), schema)

    sample = own.select("url").mapInArrow(thrifty(decided), "url string, blocked int").distinct().orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED).collect()
    model = train([(r[0], r[1]) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(page, url, *parts(url)) for page, url in rows([batch], "page_id", "url")]
            x = np.array([features(url, host, path, model.rates) for _, url, host, path in found], dtype=float).reshape(-1, len(FEATURES))
            scores = model.trees.score(x)
            fitting = [next((r for r in ordered if r.fits(host, path)), None) for *_, host, path in found]
            verdicts = [r.verdict if r else "block" if s >= 0.5 else "allow" for r, s in zip(fitting, scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[2] for x in found], pa.string()), pa.array([x[3] for x in found], pa.string()), pa.array([r.text if r else None for r in fitting], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores)],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return own.mapInArrow(thrifty(run), "page_id long, host string, path string, rule string, verdict string, score double")
