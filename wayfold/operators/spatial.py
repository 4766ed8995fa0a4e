"""Distance joins as equi joins on grid bins.

The bins are as wide as the radius: a row of the left table keeps its bin, a
row of the right table is given to its bin and all bins next to it, and an
exact distance filter follows.  Catalyst plans that as a hash or sort-merge
join, and splits crowded bins as skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geofn import METRES, metres, to_segment


def bin_of(c: Column, side: float) -> Column:
    return F.floor(c / F.lit(side)).cast("long")


def around(b: Column, reach: int = 1) -> Column:
    return F.sequence(b - reach, b + reach)


def binned(df: DataFrame, columns: list[Column], sides: list[float]) -> DataFrame:
    for k, (c, side) in enumerate(zip(columns, sides, strict=True)):
        df = df.withColumn(f"bin{k}", bin_of(c, side))
    return df


def spread(df: DataFrame, columns: list[Column], sides: list[float]) -> DataFrame:
    for k, (c, side) in enumerate(zip(columns, sides, strict=True)):
        df = df.withColumn(f"bin{k}", F.explode(around(bin_of(c, side))))
    return df


def _prefixed(df: DataFrame, name: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{name}_{c}") for c in df.columns])


def within(left: DataFrame, right: DataFrame, radius_m: float, seconds: float | None = None, inclusive: bool = True, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Pairs of rows (lon, lat[, ts]) no farther apart than `radius_m` and, if given, `seconds`.

    Columns are prefixed by `names`; `metres` is the distance.  `right` should
    be the smaller table: its rows are the ones given to several bins.
    """
    l, r = names  # noqa: E741
    side = radius_m / METRES
    a, b = _prefixed(left, l), _prefixed(right, r)
    place = lambda n: [F.col(f"{n}_lon"), F.col(f"{n}_lat")] + ([F.unix_micros(F.col(f"{n}_ts")) / 1e6] if seconds else [])
    sides = [side, side] + ([float(seconds)] if seconds else [])
    keys = [f"bin{k}" for k in range(len(sides))]
    near = binned(a, place(l), sides).join(spread(b, place(r), sides), keys).drop(*keys)
    near = near.withColumn("metres", metres(F.col(f"{l}_lon") - F.col(f"{r}_lon"), F.col(f"{l}_lat") - F.col(f"{r}_lat")))
    near = near.where(F.col("metres") <= radius_m if inclusive else F.col("metres") < radius_m)
    if seconds:
        apart = F.abs(F.unix_micros(F.col(f"{l}_ts")) - F.unix_micros(F.col(f"{r}_ts")))
        near = near.where(apart < int(seconds * 1_000_000))  # open at both ends
    return near


def count_within(left: DataFrame, right: DataFrame, key: list[str], radius_m: float, seconds: float | None = None) -> DataFrame:
    """Each row of `left`, which `key` identifies, with how many rows of `right` are near; zero if none.

    Rows of `right` meet the different places of `left`, not its rows, so a
    place that comes at a thousand times costs its surroundings once.  Times
    are counted in their order: a row's count is what a running count has grown
    by from one end of its span to the other, both ends left out.  Running
    counts begin anew in each stretch of time and go on from the sums of the
    stretches before, so no task has all times of a place.
    """
    at = ["lon", "lat"]
    places = left.select(at).where("lon is not null and lat is not null").distinct()
    near = within(right.select(*at, *(["ts"] if seconds else [])), places, radius_m, names=("o", "s"))
    if not seconds:
        found = near.groupBy(*[F.col(f"s_{c}").alias(c) for c in at]).agg(F.count("*").alias("near"))
        return left.join(found, at, "left").withColumn("near", F.coalesce("near", F.lit(0)).cast("long"))
    span = int(seconds * 1_000_000)
    stretch = F.floor(F.col("t") / F.lit(16 * span)).cast("long")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = near.select(*[F.col(f"s_{c}").alias(c) for c in at], F.unix_micros(F.col("o_ts").cast("timestamp")).alias("t")).withColumn("stretch", stretch)
    seen = seen.groupBy(*at, "stretch", "t").agg(F.count("*").alias("n"))  # what comes at the same instant counts as one
    # an end takes what comes before it: of the same instant all at the span's beginning, nothing at its end
    ends = left.select(*key, *at, F.explode(F.array(F.struct((t - span).alias("t"), F.lit(2).alias("after"), F.lit(-1).alias("sign")), F.struct((t + span).alias("t"), F.lit(0).alias("after"), F.lit(1).alias("sign")))).alias("e")).select(*key, *at, "e.*").withColumn("stretch", stretch)
    both = ends.withColumn("n", F.lit(0).cast("long")).unionByName(seen.withColumns({"after": F.lit(1), "sign": F.lit(0)}), allowMissingColumns=True)
    sums = both.groupBy(*at, "stretch").agg(F.sum("n").alias("n"))
    before = sums.select(*at, "stretch", F.coalesce(F.sum("n").over(Window.partitionBy(*at).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = both.withColumn("upto", F.sum("n").over(Window.partitionBy(*at, "stretch").orderBy("t", "after").rowsBetween(Window.unboundedPreceding, 0))).where("sign <> 0")
    found = running.join(before, [*at, "stretch"]).groupBy(*key).agg(F.sum(F.col("sign") * (F.col("upto") + F.col("before"))).alias("near"))
    return left.join(found, key, "left").withColumn("near", F.coalesce("near", F.lit(0)).cast("long"))


def near_segment(points: DataFrame, lines: DataFrame, radius_m: float, key: str = "obj_id") -> DataFrame:
    """`points` with `on_street`: is any row (lon1, lat1, lon2, lat2) of `lines` within `radius_m`?

    A segment is given to the bins along it and those next to them, so that
    long streets don't reach every bin of their bounding box.
    """
    side = radius_m / METRES
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lon2") - F.col("lon1")), F.abs(F.col("lat2") - F.col("lat1"))) / side).cast("int"))
    along = F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct(bin_of(F.col("lon1") + (F.col("lon2") - F.col("lon1")) * k / steps, side).alias("x"), bin_of(F.col("lat1") + (F.col("lat2") - F.col("lat1")) * k / steps, side).alias("y")))
    cells = lines.select("lon1", "lat1", "lon2", "lat2", F.explode(F.array_distinct(along)).alias("c"))
    cells = cells.withColumn("bin0", F.explode(around(F.col("c.x")))).withColumn("bin1", F.explode(around(F.col("c.y")))).drop("c").distinct()
    own = binned(points.select(key, "lon", "lat"), [F.col("lon"), F.col("lat")], [side, side])
    hit = own.join(cells, ["bin0", "bin1"]).where(to_segment(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) <= radius_m)
    return points.join(hit.select(key).distinct().withColumn("on_street", F.lit(True)), key, "left").withColumn("on_street", F.coalesce("on_street", F.lit(False)))


def neighbours(points: DataFrame, epsilon: float, key: str = "obj_id", others: DataFrame | None = None) -> DataFrame:
    """Directed pairs (a, b) of different rows (key, x, y, z) closer than `epsilon`, b one of `others` or else of the same points.

    Both sides are shuffled: files of many points are small enough for Spark to
    send all of them to the driver and to every task.
    """
    axes = ["x", "y", "z"]
    sides = [epsilon] * 3
    a = points.select(F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in axes])
    b = (points if others is None else others).select(F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in axes])
    near = spread(a, [F.col(f"a_{c}") for c in axes], sides).hint("merge").join(binned(b, [F.col(f"b_{c}") for c in axes], sides).hint("merge"), ["bin0", "bin1", "bin2"])
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in axes]
    return near.where((F.col("a") != F.col("b")) & (F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < epsilon)).select("a", "b")


#: Bins of the smallest boxes are at most this many halvings smaller than those of the largest, so that a point probes few levels.
LEVELS = 12
#: Boxes that are sent to every task; of more, both tables are shuffled.
FEW_BOXES = 2000


def overlapping(points: DataFrame, boxes: DataFrame, axes: list[tuple[Column, Column, Column]], most: int = LEVELS) -> DataFrame:
    """Rows of `points` with every row of `boxes` that holds them, bounds included, by a grid of many levels.

    `axes` has, for each axis, a point's value and a box's low and high bound;
    the tables share no column names.  A box goes to the level whose bins are
    at least as wide as it is, along each axis for itself, and so to at most
    two bins an axis, whatever its size.  A point probes its one bin of each
    combination of levels that has boxes; these are at most `most` an axis, and
    few together, as extents go along with each other.  The join is an equi
    join, in which Catalyst splits crowded bins; at most FEW_BOXES boxes are
    sent to every task, points never.  Bounds that are null, not numbers or the
    wrong way round hold nothing.
    """
    low_high = [f"{end}{k}" for k in range(len(axes)) for end in ("_low", "_high")]
    own = boxes.withColumns({name: c.cast("double") for name, c in zip(low_high, [c for _, low, high in axes for c in (low, high)], strict=True)})
    for k in range(len(axes)):
        own = own.where((F.col(f"_low{k}") <= F.col(f"_high{k}")) & ~F.isnan(f"_high{k}"))  # NaN is the largest
    for k in range(len(axes)):  # -1000 is below any level; a width of 2**level is at least the extent
        extent = F.col(f"_high{k}") - F.col(f"_low{k}")
        level = F.ceil(F.log2(extent)).cast("int")
        level = F.when(F.pow(F.lit(2.0), level) < extent, level + 1).otherwise(level)
        own = own.withColumn(f"_level{k}", F.when(extent > 0, level).otherwise(F.lit(-1000)))
    levels = [f"_level{k}" for k in range(len(axes))]
    top = own.agg(*[F.max(c).alias(c) for c in levels], F.count("*").alias("n")).first()
    for c in levels:
        own = own.withColumn(c, F.greatest(F.col(c), F.lit(max(-30, (top[c] if top[c] is not None else 0) - most + 1))))
    found = [tuple(r) for r in own.select(levels).distinct().collect()]  # at most `most` an axis
    probes = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(levels, r, strict=True)]) for r in found]) if found else F.array().cast("array<struct<" + ", ".join(f"{c}: int" for c in levels) + ">>")
    at = lambda c, k: F.floor(c / F.pow(F.lit(2.0), F.col(f"_level{k}"))).cast("long")
    for k in range(len(axes)):
        own = own.withColumn(f"_bin{k}", F.explode(F.sequence(at(F.col(f"_low{k}"), k), at(F.col(f"_high{k}"), k))))
    probing = points.withColumn("_probe", F.explode(probes)).select(points.columns + [F.col(f"_probe.{c}") for c in levels])
    for k, (c, _, _) in enumerate(axes):
        probing = probing.withColumn(f"_at{k}", c.cast("double")).withColumn(f"_bin{k}", at(F.col(f"_at{k}"), k))
    near = probing.join(own.hint("broadcast" if top["n"] <= FEW_BOXES else "merge"), [*levels, *[f"_bin{k}" for k in range(len(axes))]])
    for k in range(len(axes)):
        near = near.where(F.col(f"_at{k}").between(F.col(f"_low{k}"), F.col(f"_high{k}")))
    return near.select(points.columns + boxes.columns)


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows (x, y, z) with every box (cell, x1, x2, y1, y2, z1, z2) that holds them, bounds included."""
    return overlapping(points, boxes, [(F.col(c), F.col(f"{c}1"), F.col(f"{c}2")) for c in "xyz"])


def interval_join(clusters: DataFrame, volumes: DataFrame, pad_m: float = 300, pad_ms: int = 1000) -> DataFrame:
    """Volumes (site, ts, lon, lat) near a cluster (cluster_id, lon, lat, radius_m, t1, t2) while it lasts.

    Near is within its radius and `pad_m`; the time is open at both ends, which
    are `pad_ms` outside the cluster's.  They meet in the box around both, by
    a grid of many levels: a cluster takes at most eight rows, however large it
    is and however long it lasts.
    """
    c = clusters.select(F.col("cluster_id"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"), "radius_m", "t1", "t2")
    reach = (F.col("radius_m") + pad_m) / F.lit(METRES) * (1 + 1e-9) + 1e-9  # the exact distance follows
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    begin, end = F.unix_millis(F.col("t1").cast("timestamp")) - pad_ms, F.unix_millis(F.col("t2").cast("timestamp")) + pad_ms
    near = overlapping(volumes, c, [(F.col("lon"), F.col("c_lon") - reach, F.col("c_lon") + reach), (F.col("lat"), F.col("c_lat") - reach, F.col("c_lat") + reach), (t, begin, end)])
    return near.where((t > begin) & (t < end) & (metres(F.col("lon") - F.col("c_lon"), F.col("lat") - F.col("c_lat")) <= F.col("radius_m") + pad_m))
