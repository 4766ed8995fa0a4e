"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.sources.shared import discard, keep


#: Links that a task takes together.
RUN = 1_000_000


class Forest:
    """Union-find over arbitrary hashable nodes; the root is always the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.up[high] = low
            self.up.setdefault(low, low)

    def links(self) -> Iterator[tuple]:
        for x in self.up:
            if (top := self.root(x)) != x:
                yield x, top


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each bounded run of edges as stars: at most one per node, the same components."""
    forest, seen = Forest(), 0

    def flush():
        pairs = list(forest.links())
        return pa.RecordBatch.from_pydict({"u": [p[0] for p in pairs], "v": [p[1] for p in pairs]}, schema=pa.schema([("u", kind), ("v", kind)]))

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        seen += batch.num_rows
        if seen > RUN:
            yield flush()
            forest, seen = Forest(), 0
    if seen:
        yield flush()


def connected_components(edges: DataFrame, max_rounds: int = 40, few: int = 0) -> DataFrame:
    """(node, component) for every node of `edges`' first two columns that isn't its component's smallest.

    Alternating star contraction: in each round every node is linked to the
    smallest neighbour it knows, first from larger neighbours, then from
    smaller ones, until no link changes.  Each round is written to the shared
    folder, which cuts the lineage.  Self-links, repeated links and links with
    a null end have no effect; an empty table gives an empty table.  At most
    `few` links are followed to their ends by one task instead, with the same
    result.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    schema = f"u {pairs.schema['u'].dataType.simpleString()}, v {pairs.schema['v'].dataType.simpleString()}"
    stars = keep(pairs.mapInArrow(_shrink, schema).distinct(), "stars")
    before = None
    if few and stars.count() <= min(few, RUN):
        return keep(stars.coalesce(1).mapInArrow(_shrink, schema), "stars").select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, stars = stars, keep(small, "stars")
        discard(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
