"""SimHash near-duplicate groups found through tables of pivot distances.

Every fingerprint is described by its Hamming distances to reference
fingerprints, taken block by block: for reference P and block B the coordinate
is popcount((x ^ P) & B).  A coordinate differs between two fingerprints by at
most their own distance inside B, and these distances add up over disjoint
blocks.  So fingerprints within `radius` bits have, on at least
`blocks - radius` blocks, coordinates that do not differ at all: for each
choice of that many blocks, the coordinates there are an inverted key, and
linked fingerprints meet under one of them.  Pairs that meet are discarded if
any of their coordinates over all bits differ by more than `radius`; the exact
distance verifies the survivors.  No linked pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import U64, batch_of, bounded_batches, emit, mixed, rows, thrifty
from wayfold.operators.graph import Forest, connected_components
from wayfold.sources.shared import discard, keep

#: Members of a key that one task compares with each other; larger groups are dealt out as pairs of parts.
PART = 1024


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(bits), 255):
        votes += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every text as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(((i, (f ^ 1 << 63) - (1 << 63)) for i, f in ((i, fingerprint(t)) for i, t in rows(batches, "doc_id", "text"))), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(thrifty(run), "doc_id long, fp long")


class Pivots:
    """Distances to `count` reference fingerprints, in each of `blocks` blocks of bits and in all."""

    def __init__(self, blocks: int, count: int = 32) -> None:
        self.references = mixed(np.arange(1, count + 1, dtype=U64))
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.masks = [U64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]

    def within(self, fps: np.ndarray, mask: np.uint64) -> np.ndarray:
        return np.bitwise_count((fps[:, None] ^ self.references) & mask)

    def whole(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.references)


def block_count(n: int, radius: int, most: int = 64) -> int:
    """The fewest blocks for which a key of random fingerprints has at most `most` members on average."""
    blocks = radius + 2
    while n >> (64 * (blocks - radius) // blocks) > most and comb(blocks + 1, radius) <= 300:
        blocks += 1
    return blocks


def linked(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs within `radius` bits: coordinates first, then the exact distance."""
    near = np.ones((len(a), len(b)), dtype=bool)
    for k in range(da.shape[1]):
        x, y = da[:, k].astype(np.int8), db[:, k].astype(np.int8)
        near &= np.abs(x[:, None] - y[None, :]) <= radius
        if k >= 3 and near.sum() < 0.02 * near.size:
            break
    i, j = np.nonzero(near)
    if len(i):
        ok = (np.abs(da[i].astype(np.int8) - db[j].astype(np.int8)).max(axis=1) <= radius) & (np.bitwise_count(a[i] ^ b[j]) <= radius)
        i, j = i[ok], j[ok]
    return i, j


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first `keys` columns, cut only between groups."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) < 50_000:
            continue
        last = np.logical_or.reduce([c != c[-1] for c in held[:keys]])
        if last.any():
            cut = int(np.nonzero(last)[0][-1]) + 1
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _pairs_in(batches: Iterator[pa.RecordBatch], radius: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Links among the rows (key, cell, part, fp, node) of each (key, cell), as stars."""
    pivots, schema = Pivots(blocks), pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for key, cell, part, fp, node in whole_groups(batches, 2):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        starts = np.append(np.nonzero(new)[0], len(key))
        forest = Forest()
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            f, n, p = fp[s:e].view(U64), node[s:e], part[s:e]
            d = pivots.whole(f)
            low = p == p.min()
            left = np.nonzero(low)[0]
            right = left if low.all() else np.nonzero(~low)[0]
            for k in range(0, len(left), 256):
                at = left[k : k + 256]
                i, j = linked(f[at], f[right], d[at], d[right], radius)
                for x, y in zip(n[at[i]].tolist(), n[right[j]].tolist(), strict=True):
                    if x != y:
                        forest.join(x, y)
        if found := list(forest.links()):
            yield batch_of(found, schema)


def near_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): groups joined by links of at most `radius` differing bits.

    `component_id` is the smallest doc_id that links reach, the row's own
    included.  Only distinct fingerprints are compared, so copies cost one
    row; groups of many different close fingerprints are split into parts
    whose pairs go to separate tasks, and only spanning links leave a task.
    Rows with a null doc_id link nothing together and get a null component
    unless others share their fingerprint.  Empty in, empty out.
    """
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    nodes = distinct.where("node is not null")
    blocks = block_count(nodes.count(), radius)
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Pivots(blocks)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            one = []
            for k, mask in enumerate(pivots.masks):  # a number for the coordinates in each block
                d = pivots.within(fp, mask).astype(U64)
                h = np.full(len(fp), k + 1, dtype=U64)
                for c in range(0, d.shape[1], 8):
                    word = np.zeros(len(fp), dtype=U64)
                    for x in range(c, min(c + 8, d.shape[1])):
                        word = (word << U64(8)) | d[:, x]
                    h = mixed(h ^ word) + U64(c)
                one.append(h)
            for t, choice in enumerate(choices):
                h = np.full(len(fp), t, dtype=U64)
                for k in choice:
                    h = mixed(h + one[k])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0), batch.column(1)], names=["key", "fp", "node"])

    table = keep(nodes.select("fp", "node").mapInArrow(thrifty(keyed), "key long, fp long, node long"), "pivots")
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        table.join(sizes.select("key", parts.alias("parts")), "key")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).cast("long").alias("cell"), F.col("part").cast("long").alias("part"), "fp", "node")
    )
    links = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(thrifty(lambda it: _pairs_in(it, radius, blocks)), "u long, v long")
    reached = connected_components(links)
    discard(table)  # its links have been written
    labels = distinct.join(reached, distinct["node"] == reached["node"], "left").select(distinct["fp"], F.coalesce(reached["component"], distinct["node"]).alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every document: fingerprints of whole texts, grouped by near_groups().

    A null or empty text has fingerprint 0, which links like any other.
    Repeated rows stay repeated; other columns of `docs` are not read.
    """
    return near_groups(keep(fingerprints(docs, id_col, text_col), "fingerprints"), radius)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of `docs`, all columns, of the smallest doc_id of each group.

    Rows with a null doc_id stay; of rows that share a doc_id one stays.
    """
    groups = simhash_groups(docs, id_col, text_col, radius)
    firsts = keep(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies")), "firsts")
    mine = firsts.select(F.col("doc_id").alias(id_col)).hint("merge")  # as many as the documents, so never sent to all tasks
    kept = docs.join(mine, id_col, "left_semi").select(docs.columns)
    if not firsts.where("copies > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
