"""Near-duplicate vectors through a pivot-permutation index.

Pivots are vectors of a bounded sample.  A vector is described by its nearest
pivots in order; the inverted list of a pivot holds the vectors that have it
among them.  Two vectors of a list are retrieved if they share at least
`shared` of their nearest pivots (the count comes from products of membership
rows), in the list of their first shared pivot only, and verified by the cosine
in double precision.  Exact copies are one entry of the index, counted as many.
Lists longer than PART are dealt out as pairs of parts, and tasks give back
link counts and spanning links, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.words import emit, rows, thrifty
from wayfold.operators.graph import Forest, connected_components
from wayfold.sources.shared import discard, keep

#: Nearest pivots that describe a vector, how many two vectors must share, and how many pivots there may be.
NEAREST, SHARED, MOST_PIVOTS = 8, 3, 2048
PART = 1024


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, copy, vec): the vector as doubles and the digest that copies share; null for a vector that links with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("copy", pa.binary()), ("vec", pa.binary())])

    def found() -> Iterator[tuple]:
        for vec_id, label, values in rows(batches, "vec_id", "label", "embedding"):
            usable = vec_id is not None and label is not None and values and None not in values
            v = np.array(values if usable else [], dtype="<f8") + 0.0
            if not usable or not np.isfinite(v).all() or not v.any():
                yield vec_id, label, None, None
                continue
            data = v.tobytes()
            yield vec_id, label, hashlib.blake2b(f"{label}:".encode() + data, digest_size=16).digest(), data

    yield from emit(found(), schema)


def matrix(blobs: list[bytes]) -> np.ndarray:
    """Unit rows."""
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _listed(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], nearest: int) -> Iterator[pa.RecordBatch]:
    """One row for each of a vector's nearest pivots: (label, dims, pivot, node, copies, vec, near)."""
    schema = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("pivot", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("vec", pa.binary()), ("near", pa.binary())])

    def found() -> Iterator[tuple]:
        for batch in batches:
            every = list(rows([batch], "label", "node", "copies", "vec"))
            for dims in {len(x[3]) // 8 for x in every}:
                own = [x for x in every if len(x[3]) == 8 * dims]
                k = min(nearest, len(pivots[dims]))
                near = np.argsort(-(matrix([x[3] for x in own]) @ pivots[dims].T), axis=1, kind="stable")[:, :k].astype("<u2")
                for (label, node, copies, vec), p in zip(own, near, strict=True):
                    for pivot in p.tolist():
                        yield label, dims, pivot, node, copies, vec, p.tobytes()

    yield from emit(found(), schema)


def _verified(batches: Iterator[pa.RecordBatch], least: float, shared: int, most_pivots: int) -> Iterator[pa.RecordBatch]:
    """Per (label, dims, pivot, cell): (node, links) and spanning links (u, v), told apart by `v`."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def judged(key: tuple, held: list[tuple]) -> Iterator[tuple]:
        if len(held) < 2:
            return
        pivot = key[2]
        node = [x[1] for x in held]
        copies = np.array([x[2] for x in held])
        unit = matrix([x[3] for x in held])
        near = np.array([np.frombuffer(x[4], "<u2") for x in held])
        member = np.zeros((len(held), most_pivots), dtype=np.float32)
        member[np.arange(len(held))[:, None], near] = 1
        part = np.array([x[0] for x in held])
        left = np.nonzero(part == part.min())[0]
        right = left if len(left) == len(held) else np.nonzero(part != part.min())[0]
        links, forest = np.zeros(len(held), dtype=np.int64), Forest()
        need = min(shared, near.shape[1])
        for k in range(0, len(left), 256):
            a = left[k : k + 256]
            ok = (member[a] @ member[right].T >= need) & (member[a, :pivot] @ member[right, :pivot].T == 0)
            i, j = np.nonzero(ok)
            if right is left:
                i, j = i[a[i] < right[j]], j[a[i] < right[j]]
            x, y = a[i], right[j]
            close = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            x, y = x[close], y[close]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                forest.join(node[p], node[q])
        for k in np.nonzero(links)[0].tolist():
            yield node[k], None, int(links[k])
        for u, v in forest.links():
            yield u, v, 0

    def found() -> Iterator[tuple]:
        key, held = None, []
        for *now, part, node, copies, vec, near in rows(batches, "label", "dims", "pivot", "cell", "part", "node", "copies", "vec", "near"):
            if now != key:
                if held:
                    yield from judged(key, held)
                key, held = now, []
            held.append((part, node, copies, vec, near))
        if held:
            yield from judged(key, held)

    yield from emit(found(), schema)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: links between vectors of equal label and cosine `least` or more.

    The index is fitted on at most MOST_PIVOTS vectors, those with the
    smallest hashes, and holds every vector; its recall is measured in the
    tests.  A vector that is null, zero, or holds null or non-finite
    components, a null label and a null id link with nothing: no links, a
    component of their own.  Vectors of different length don't link.  Repeated
    rows count as different vectors.  Empty in, empty out; other columns are
    not read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    every = keep(own.mapInArrow(thrifty(_described), "vec_id long, label long, copy binary, vec binary"), "vectors")
    distinct = keep(every.where("copy is not null").groupBy("copy").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")), "distinct")
    n = distinct.count()
    wanted = min(MOST_PIVOTS, max(64, 1 << int(4 * n**0.5).bit_length() - 1))
    pivots: dict[int, np.ndarray] = {}
    for dims in [r[0] for r in distinct.select(F.length("vec") / 8).distinct().collect()]:
        sample = distinct.where(F.length("vec") == 8 * dims).orderBy(F.xxhash64("copy")).limit(wanted).select("vec").collect()
        pivots[int(dims)] = matrix([bytes(r[0]) for r in sample])
    listed = keep(distinct.select("label", "node", "copies", "vec").mapInArrow(thrifty(lambda it: _listed(it, pivots, nearest)), "label long, dims int, pivot int, node long, copies long, vec binary, near binary"), "lists")
    lists = ["label", "dims", "pivot"]
    sizes = listed.groupBy(lists).agg(F.count("*").alias("n")).where("n > 1").select(*lists, F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = (
        listed.join(sizes, lists)
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*lists, (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("cell"), "part", "node", "copies", "vec", "near")
        .repartition(*lists, "cell")
        .sortWithinPartitions(*lists, "cell")
    )
    found = keep(dealt.mapInArrow(thrifty(lambda it: _verified(it, least, shared, MOST_PIVOTS)), "u long, v long, links long"), "links")
    discard(listed)
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("v is not null").select("u", "v"))
    of_copy = (
        distinct.join(counts, distinct["node"] == counts["u"], "left")
        .join(reached, distinct["node"] == reached["node"], "left")
        .select(distinct["copy"], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", distinct["node"]).alias("component"))
    )
    alone = every.where("copy is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = every.where("copy is not null").select("vec_id", "copy").join(of_copy, "copy").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def brute_force(found: list[tuple], least: float = 0.98) -> dict[int, set[int]]:
    """Links of rows (vec_id, label, vector) by comparing all pairs; for measuring recall."""
    links: dict[int, set[int]] = {i: set() for i, _, _ in found}
    usable = [(i, label, np.array(v, dtype=float)) for i, label, v in found if label is not None and v is not None and len(v) and None not in v]
    usable = [x for x in usable if np.isfinite(x[2]).all() and x[2].any()]
    for k, (i, label, v) in enumerate(usable):
        for j, other, w in usable[:k]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links[i].add(j)
                links[j].add(i)
    return links

