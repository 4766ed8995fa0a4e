"""Density clustering of points in space and time, in batches and increments.

A point is core if it has more than `min_points` others within epsilon.  A
cluster is a connected component of cores; a point that isn't core but near
one is a border of the cluster with the smallest id among its neighbours'.
A cluster's id is the smallest id of its cores, so recomputing gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geofn import depth
from wayfold.operators.aggregate import preferred
from wayfold.operators.cells import clustered_cells
from wayfold.operators.graph import connected_components
from wayfold.operators.spatial import bin_of, neighbours, overlapping
from wayfold.params import Density
from wayfold.sources.shared import keep

CORE, BORDER = "CORE", "BORDER"
#: Points of a cell, and the most that a task gets together: a cell's and those around it.
CELL, CROWD = 4000, 100_000
#: Links of clusters that one task takes to their ends.
FEW = 200_000


def embedded(points: DataFrame, by: Density) -> DataFrame:
    """Points with x, y, z in degrees."""
    return points.withColumn("x", F.col("lon")).withColumn("y", F.col("lat")).withColumn("z", depth(F.unix_millis(F.col("ts").cast("timestamp")), by))


def cores(pairs: DataFrame, by: Density) -> DataFrame:
    """(a, n): points with more than `min_points` neighbours."""
    return pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > by.min_points)


FINE = ["fx", "fy", "fz"]


@dataclass
class CoreGraph:
    """The cores (a, rep), each with the smallest core of its fine cell; links (a, b) of such cores; other points near cores (b, rep, n), n cores of a cell near each."""

    core: DataFrame
    links: DataFrame
    edges: DataFrame


def core_graph(points: DataFrame, by: Density, were: DataFrame | None = None) -> CoreGraph:
    """What clusters are made of, without listing the pairs inside crowds; `were` (a) are points known to be core.

    Points lie in fine cells whose diagonal is below epsilon.  All points of a
    cell with more than `by.min_points` + 1 are cores and linked.  Only points
    of other, thin cells are paired with their neighbours: few cells are near
    a crowd and each holds few of them, so pairs grow with the points.  Crowds
    are linked by their bounding boxes, then by the boxes of their parts, and
    point by point only where these can't tell.
    """
    side = by.epsilon / 3**0.5 * (1 - 1e-9)
    own = keep(embedded(points, by).select("obj_id", "x", "y", "z", *[bin_of(F.col(c), side).alias(f"f{c}") for c in "xyz"]), "placed")
    full = keep(own.groupBy(FINE).agg(F.count("*").alias("n")).where(F.col("n") > by.min_points + 1).select(FINE), "full")
    dense = own.join(full, FINE, "left_semi")
    pairs = keep(neighbours(own.join(full, FINE, "left_anti"), by.epsilon, others=own), "pairs")
    found = dense.select(F.col("obj_id").alias("a")).unionByName(cores(pairs, by).select("a"))
    if were is not None:
        found = found.unionByName(were.select("a")).distinct()
    placed = own.join(found, own["obj_id"] == found["a"], "left_semi")
    reps = placed.groupBy(FINE).agg(F.min("obj_id").alias("rep"))
    core = keep(placed.join(reps, FINE).select(F.col("obj_id").alias("a"), "rep"), "cores")
    near = pairs.join(core.select(F.col("a").alias("b"), "rep"), "b").select("a", "rep")
    near = keep(near.groupBy("a", "rep").agg(F.count("*").alias("n")), "near_cores")
    links = near.join(core.select("a", F.col("rep").alias("own")), "a").where("own <> rep").select(F.col("own").alias("a"), F.col("rep").alias("b"))
    of_cell = reps.join(full, FINE, "left_semi")
    crowds = linked_crowds(dense, side, by.epsilon)
    for end in "ab":
        crowds = crowds.join(of_cell.select(*[F.col(c).alias(f"{end}_{c}") for c in FINE], F.col("rep").alias(end)), [f"{end}_{c}" for c in FINE])
    edges = near.join(core.select("a"), "a", "left_anti").select(F.col("a").alias("b"), "rep", "n")
    return CoreGraph(core, links.unionByName(crowds.select("a", "b")), edges)


def boxes(points: DataFrame, cells: list[str]) -> DataFrame:
    return points.groupBy(cells).agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((1, F.min), (2, F.max))])


def told_by_boxes(pairs: DataFrame, epsilon: float) -> DataFrame:
    """`pairs` of boxes with `sure`: true if all of their points are within epsilon, false if it can't be told; without those that are too far apart."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        gap = F.greatest(F.lit(0.0), F.col(f"b_{c}1") - F.col(f"a_{c}2"), F.col(f"a_{c}1") - F.col(f"b_{c}2"))
        reach = F.greatest(F.col(f"b_{c}2") - F.col(f"a_{c}1"), F.col(f"a_{c}2") - F.col(f"b_{c}1"))
        near, far = near + gap * gap, far + reach * reach
    return pairs.where(near < (epsilon * (1 + 1e-9)) ** 2).withColumn("sure", far < (epsilon * (1 - 1e-9)) ** 2)


def ends(df: DataFrame, end: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{end}_{c}") for c in df.columns])


def linked_crowds(dense: DataFrame, side: float, epsilon: float, parts: int = 4) -> DataFrame:
    """(a_fx, a_fy, a_fz, b_fx, b_fy, b_fz): pairs of full cells that hold points within epsilon of each other."""
    key = [f"{end}_{c}" for end in "ab" for c in FINE]
    whole = boxes(dense, FINE)
    around_a = ends(whole, "a")
    for c in FINE:  # points within epsilon are at most two cells apart along each axis
        around_a = around_a.withColumn(f"b_{c}", F.explode(F.sequence(F.col(f"a_{c}") - 2, F.col(f"a_{c}") + 2)))
    later = F.struct(*[f"a_{c}" for c in FINE]) < F.struct(*[f"b_{c}" for c in FINE])
    told = keep(told_by_boxes(around_a.where(later).join(ends(whole, "b"), [f"b_{c}" for c in FINE]), epsilon).select(*key, "sure"), "crowds")

    parted = dense.select("*", *[bin_of(F.col(c), side / parts).alias(f"p{c}") for c in "xyz"])
    of_part = boxes(parted, [*FINE, "px", "py", "pz"])
    open_pairs = told.where("not sure").select(key)
    by_part = open_pairs.join(ends(of_part, "a"), [f"a_{c}" for c in FINE]).join(ends(of_part, "b"), [f"b_{c}" for c in FINE])
    part_key = [f"{end}_p{c}" for end in "ab" for c in "xyz"]
    by_part = keep(told_by_boxes(by_part, epsilon).select(*key, *part_key, "sure"), "crowd_parts")
    by_parts = by_part.where("sure").select(key).distinct()

    left = by_part.where("not sure").join(by_parts, key, "left_anti")
    for end in "ab":
        left = left.join(ends(parted.select(*FINE, "px", "py", "pz", "x", "y", "z").distinct(), end), [f"{end}_{c}" for c in [*FINE, "px", "py", "pz"]])
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"]
    by_points = left.where(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < epsilon).select(key).distinct()
    return told.where("sure").select(key).unionByName(by_parts).unionByName(by_points)


def cluster_points(points: DataFrame, by: Density = Density(), promote: bool = False, most: int = CELL) -> DataFrame:
    """`points` (obj_id, ts, lon, lat, ...) with cluster_id and cluster_label, null for noise.

    With `promote` a border that is near at least `min_points` cores links
    their clusters.  Cells have about `most` points.
    """
    own = points.drop("cluster_id", "cluster_label")
    graph = cell_graph(own, by, most=most)
    links = graph.links
    if promote:
        linking = graph.edges.groupBy("b").agg(F.sum("n").alias("all"), F.min("rep").alias("low")).where(F.col("all") >= by.min_points)
        links = links.unionByName(graph.edges.join(linking, "b").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")))
    reached = connected_components(links, few=FEW)
    ids = with_component(graph.core, reached, "cluster_id")
    border = borders(graph.edges, reached, "cluster_id")
    labels = ids.select(F.col("a").alias("obj_id"), "cluster_id", F.lit(CORE).alias("cluster_label")).unionByName(border.withColumn("cluster_label", F.lit(BORDER)))
    return own.join(labels, "obj_id", "left")


def with_component(core: DataFrame, reached: DataFrame, name: str) -> DataFrame:
    """Cores (a, rep) with the component of their `rep`, which is its own if nothing links it."""
    return core.join(reached, core["rep"] == reached["node"], "left").select(core["a"], core["rep"], F.coalesce("component", core["rep"]).alias(name))


def borders(edges: DataFrame, reached: DataFrame, name: str) -> DataFrame:
    """(obj_id, smallest component) of points near cores; the `rep` of an edge may be a core for which another stands in its own cell."""
    return edges.join(reached, edges["rep"] == reached["node"], "left").groupBy(F.col("b").alias("obj_id")).agg(F.min(F.coalesce("component", "rep")).alias(name))


def cluster_increment(new: DataFrame, stored: DataFrame, by: Density = Density(), most: int = CELL, within: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """What `new` points change: rows of the store to write, and ids of clusters that have another from here on (cluster_id, now).

    Stored points near the new ones in time are judged again together with
    them, history winning over a repeated id.  A cluster id is the id of one of
    its cores, so clusters merge by linking their cores now seen with the ids
    stored for them.  Members far away in time aren't read: they follow by the
    second table.  Clusters only grow, so the result after any number of ticks
    is that of one batch.  Rows are in the order of `stored`'s first columns:
    obj_id, ts, lon, lat, cluster_id, cluster_label.  Cells have about `most`
    points and lie in a top cell of at least `within`.
    """
    t1, t2 = new.agg(F.min("ts"), F.max("ts")).first()
    columns = ["obj_id", "ts", "lon", "lat", "cluster_id", "cluster_label"]
    if t1 is None:
        return stored.select(columns).limit(0), stored.select("cluster_id", F.col("cluster_id").alias("now")).limit(0)
    span = F.make_dt_interval(secs=F.lit(2 * by.horizon_ms / 1000))
    history = stored.select(columns).where((F.col("ts") > F.lit(t1) - span) & (F.col("ts") < F.lit(t2) + span))
    fresh = new.withColumns({c: F.lit(None).cast("string") for c in ("cluster_id", "cluster_label")}).select(columns)
    both = preferred(history.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))), "obj_id", F.col("_new"), F.col("ts"), F.col("lon"), F.col("lat")).drop("_new")
    both = keep(both, "tick")
    graph = cell_graph(both, by, both.where(F.col("cluster_label") == CORE).select(F.col("obj_id").alias("a")), most, within=within)
    stored_ids = both.where("cluster_id is not null").select(F.col("obj_id").alias("a"), F.col("cluster_id").alias("b"))
    links = graph.links.unionByName(stored_ids.join(graph.core, "a").select(F.col("rep").alias("a"), "b").where("a <> b"))
    reached = keep(connected_components(links, few=FEW), "merged")
    ids = with_component(graph.core, reached, "core_id").select("a", "core_id")
    touched = borders(graph.edges, reached, "border_id")
    moved_to = reached.select(F.col("node").alias("cluster_id"), F.col("component").alias("moved_id"))
    judged = both.join(ids.withColumnRenamed("a", "obj_id"), "obj_id", "left").join(touched, "obj_id", "left").join(moved_to, "cluster_id", "left")
    kept_id = F.coalesce("moved_id", "cluster_id")
    now = judged.select(
        "obj_id", "ts", "lon", "lat",
        F.coalesce("core_id", F.least("border_id", kept_id)).alias("cluster_id"),
        F.when(F.col("core_id").isNotNull(), CORE).when(F.col("border_id").isNotNull() | kept_id.isNotNull(), BORDER).alias("cluster_label"),
    )
    moved = moved_to.join(both.select("cluster_id").where("cluster_id is not null").distinct(), "cluster_id", "left_semi").withColumnRenamed("moved_id", "now")
    return now, keep(moved, "moved")


def merged_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """`labels` (obj_id, cluster_id) after the clusters of each row (a, b) of `links` are merged under the smallest id."""
    reached = connected_components(links)
    return labels.join(reached, labels["cluster_id"] == reached["node"], "left").select(labels["obj_id"], F.coalesce("component", labels["cluster_id"]).alias("cluster_id"))


def halvings(bounds: dict[str, tuple[float, float]], least: float) -> list[dict[str, int]]:
    """Per level how often each axis has been halved: by one a level, while its side is more than `least`."""
    levels = [dict.fromkeys(bounds, 0)]
    while True:
        wide = [c for c, (low, high) in bounds.items() if (high - low) / 2 ** levels[-1][c] > least]
        if not wide:
            return levels
        levels.append({c: n + (c in wide) for c, n in levels[-1].items()})


def leaf_cells(top: DataFrame, by: Density, most: int, within: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, Column]:
    """(cell, n, fresh, x1, x2, y1, y2, z1, z2, level, ix, iy, iz): the cells of points (obj_id, x, y, z, fresh), how many each holds and whether one of them is fresh; and, for a point beside a cell, whether it is the cell's own.

    The extent of all points, widened to `within`, is halved along every axis
    of more than 2 epsilon, again and again, but only cells of more than `most`
    points; a point on a border belongs to the lower cell.  All cells of a
    level have the same sides, so cells are counted for all levels at once from
    the counts of the finest.
    """
    found = top.agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((1, F.min), (2, F.max))]).first()
    ends = {c: (found[f"{c}1"], found[f"{c}2"]) if found[f"{c}1"] is not None else (0.0, 0.0) for c in "xyz"}
    widest = {c: (within or {}).get(c, ends[c]) for c in "xyz"}
    bounds = {c: (min(low, widest[c][0]), max(high, widest[c][1])) for c, (low, high) in ends.items()}
    levels = halvings(bounds, 2 * by.epsilon)
    last = len(levels) - 1

    def of_level(values, level: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), level + 1)

    def side(c: str, level: Column) -> Column:
        return of_level([(bounds[c][1] - bounds[c][0] or 1.0) / 2 ** n[c] for n in levels], level)

    def place(c: str, value: Column, level: Column) -> Column:
        at = F.ceil((value - bounds[c][0]) / side(c, level)) - 1
        return F.greatest(F.lit(0), F.least(at, of_level([2 ** n[c] - 1 for n in levels], level))).cast("long")

    def up(c: str, by_levels: Column, level: Column) -> Column:
        """The place on `by_levels` of what is at column i<c> on `level`."""
        halved = [n[c] for n in levels]
        return F.floor(F.col(f"i{c}") / F.pow(F.lit(2.0), of_level(halved, level) - of_level(halved, by_levels))).cast("long")

    axes = [f"i{c}" for c in "xyz"]
    finest = top.select(*[place(c, F.col(c), F.lit(last)).alias(f"i{c}") for c in "xyz"], "fresh").groupBy(axes).agg(F.count("*").alias("n"), F.max("fresh").alias("fresh"))
    each = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last))))
    cells = keep(each.select("level", *[up(c, F.col("level"), F.lit(last)).alias(f"i{c}") for c in "xyz"], "n", "fresh").groupBy("level", *axes).agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh")), "cells")
    above = cells.where(F.col("n") > most).select((F.col("level") + 1).alias("level"), *[F.col(a).alias(f"p{a}") for a in axes])
    child = cells.where("level > 0").select("*", *[up(c, F.col("level") - 1, F.col("level")).alias(f"pi{c}") for c in "xyz"])
    reached = child.join(above, ["level", "pix", "piy", "piz"]).select(cells.columns).unionByName(cells.where("level = 0"))
    leaves = reached.where((F.col("n") <= most) | (F.col("level") == last))
    level = F.col("level")
    ends_of = [(F.lit(bounds[c][0]) + (F.col(f"i{c}") + k) * side(c, level)).alias(f"{c}{k + 1}") for c in "xyz" for k in (0, 1)]
    own = F.lit(True)
    for c in "xyz":
        own &= place(c, F.col(c), level) == F.col(f"i{c}")
    return leaves.select(F.concat_ws("-", "level", *axes).alias("cell"), "n", "fresh", *ends_of, "level", *axes), own


def with_cells(top: DataFrame, leaves: DataFrame, own: Column, halo: float) -> DataFrame:
    """Points (x, y, z, ...) with each of `leaves` whose box they are in or within `halo` of, along each axis: `cell`, `own` and the greatest distance to the box along an axis, `out`."""
    near = overlapping(top, leaves, [(F.col(c), F.col(f"{c}1") - halo, F.col(f"{c}2") + halo) for c in "xyz"])
    out = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}2")) for c in "xyz"])
    return near.select(*top.columns, "cell", own.alias("own"), out.alias("out"))


def grid_cells(points: DataFrame, by: Density, most: int = 700, fresh: Column | None = None, within: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(obj_id, cell, halo): the cells that a tick has to cluster, and their points; see leaf_cells().

    Cells of fewer than `by.min_points` points, or without one for which
    `fresh` holds, are dropped.  A cell's points are those within 1.01 epsilon
    of it; `halo` tells those outside.  A cell is named by its level and its
    place along each axis there.  Points meet the cells' boxes by a grid of
    many levels: each probes one bin for each level that has leaves.
    """
    top = embedded(points.withColumn("fresh", fresh if fresh is not None else F.lit(True)), by).select("obj_id", "x", "y", "z", "fresh")
    leaves, own = leaf_cells(top, by, most, within)
    wanted = leaves.where(F.col("fresh") & (F.col("n") >= by.min_points)).drop("fresh")
    return with_cells(top.drop("fresh"), wanted, own, 1.01 * by.epsilon).select("obj_id", "cell", (~F.col("own")).alias("halo"))


def cell_graph(points: DataFrame, by: Density, were: DataFrame | None = None, most: int = CELL, at_most: int = CROWD, within: dict[str, tuple[float, float]] | None = None) -> CoreGraph:
    """core_graph() cell by cell: each task clusters the cells it has, on arrays, and cells are joined by the cores that are around one and in another.

    Cells have about `most` points; where more than `at_most` meet within a few
    epsilon, so that a cell and what is around it would be too many for one
    task, core_graph() does the same without bringing them together.
    """
    own = embedded(points, by).select("obj_id", "x", "y", "z", F.lit(True).alias("fresh"))
    own = keep(own.join(were.select(F.col("a").alias("obj_id")).distinct().withColumn("was", F.lit(True)), "obj_id", "left").withColumn("was", F.coalesce("was", F.lit(False))) if were is not None else own.withColumn("was", F.lit(False)), "placed")
    leaves, is_own = leaf_cells(own, by, most, within)
    leaves = keep(leaves.drop("fresh"), "leaves")
    rings = with_cells(own.drop("fresh"), leaves.drop("n"), is_own, 2.02 * by.epsilon)
    if (leaves.agg(F.max("n")).first()[0] or 0) > most:  # a leaf of the last level: what is around it may be many, too
        crowd = rings.groupBy("cell").count().agg(F.max("count")).first()[0]
        if crowd > at_most:
            return core_graph(points, by, were)
    ring = F.when(F.col("own"), 0).when(F.col("out") <= 1.01 * by.epsilon, 1).otherwise(2)
    dealt = rings.select("cell", "obj_id", "x", "y", "z", ring.cast("int").alias("ring"), "was").repartition("cell").sortWithinPartitions("cell")
    epsilon, least = by.epsilon, by.min_points
    schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("rep", pa.string()), ("n", pa.int64())])
    found = keep(dealt.mapInArrow(lambda batches: clustered_cells(batches, epsilon, least, schema), "kind string, a string, rep string, n long"), "clustered")
    core = found.where("kind = 'core'").select("a", "rep")
    links = found.where("kind = 'halo'").select("a", F.col("rep").alias("b")).join(core, "a").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    edges = found.where("kind = 'edge'").select(F.col("a").alias("b"), "rep", "n")
    return CoreGraph(core, links, edges)
