"""Clustering a stream of messages tick by tick."""

from __future__ import annotations

from collections.abc import Collection
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.operators.cluster import CELL, cluster_increment
from wayfold.params import Density
from wayfold.sources.files import KeyedTable, parse_messages, points_of
from wayfold.sources.log import LogSource
from wayfold.sources.shared import keep, kept_until_here

#: Bounds of x and y, and of z if it is to be bounded, that the cells' extent is widened to.
Top = dict[str, tuple[float, float]]
STATE = "obj_id string, ts timestamp, lon double, lat double, cluster_id string, cluster_label string"


def message_stream(spark: SparkSession, source: str, fmt: str = "text", **options: str) -> DataFrame:
    """A stream with a text column `value`: text files of a folder, a log, or Kafka where its connector is there."""
    if fmt == "log":
        spark.dataSource.register(LogSource)
        return spark.readStream.format(LogSource.name()).options(**options).load(source).select("value")
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.option("subscribe", source).load().select(F.col("value").cast("string").alias("value"))
    return reader.load(source).select("value")


def replay(spark: SparkSession, folder: str, target: str, checkpoint: str, seconds: float = 1, files: int = 1, fmt: str = "log", **options: str) -> StreamingQuery:
    """Sends the messages of a folder of JSON lines on, keyed by id, at a pace: so many files every so many seconds.

    Ended and started again with its checkpoint, it goes on with the next file.
    `seconds` 0 sends all there is and ends.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(folder)
    own = F.get_json_object("value", "$.id_str")
    messages = lines.select(F.coalesce(own, F.get_json_object("value", "$.value.id_str")).alias("key"), "value")
    if fmt == "log":
        spark.dataSource.register(LogSource)
        writer = messages.writeStream.format(LogSource.name()).options(**options).option("path", target)
    else:
        writer = messages.writeStream.format(fmt).options(**options).option("topic", target)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{round(seconds * 1000)} milliseconds") if seconds else writer.trigger(availableNow=True)).start()


def days_around(new: DataFrame, by: Density) -> set[str]:
    """The store's parts in which the history of new points lies."""
    span = F.make_dt_interval(secs=F.lit(2 * by.horizon_ms / 1000))
    first, last = new.agg(F.to_date(F.min("ts") - span), F.to_date(F.max("ts") + span)).first()
    return {str(first + timedelta(days=k)) for k in range((last - first).days + 1)}


ALIAS = "cluster_id string, now string"


class ClusterStore:
    """Clustered points, and which clusters have been merged into which.

    Points keep the id they were stored with; `aliases` has one row for each id
    that is no longer a cluster's, with the id that the cluster has now.  A
    merge writes rows of aliases, not the members on other days.  Readers see
    the ids of now.  Aliases point at the ids of now themselves: a merge also
    rewrites those that point at an id that it ends, so nothing is followed
    twice.
    """

    def __init__(self, spark: SparkSession, path: str, state: str = STATE) -> None:
        path = path.rstrip("/")
        self.points = KeyedTable(spark, f"{path}/points", state)
        self.aliases = KeyedTable(spark, f"{path}/aliases", ALIAS, key="cluster_id", part="cast(pmod(xxhash64(cluster_id), 16) as string)")

    def drop(self) -> None:
        self.points.drop()
        self.aliases.drop()

    def read(self, days: Collection[str] | None = None) -> DataFrame:
        """All points, or those of some days, with the ids of now."""
        stored = self.points.read(days)
        known = self.aliases.read().select(F.col("cluster_id").alias("_was"), "now")
        return stored.join(known, stored["cluster_id"] == known["_was"], "left").withColumn("cluster_id", F.coalesce("now", "cluster_id")).select(stored.columns)

    def merge(self, moved: DataFrame) -> int:
        """`moved` (cluster_id, now): clusters that have another id from here on, `now` being one that stays.  How many aliases were written."""
        ended = moved.select(F.col("cluster_id").alias("_was"), F.col("now").alias("_to"))
        known = self.aliases.read()
        led = known.join(ended, known["now"] == ended["_was"]).select("cluster_id", F.col("_to").alias("now"))
        return self.aliases.upsert(moved.select("cluster_id", "now").unionByName(led))


def tick(batch: DataFrame, store: ClusterStore, by: Density, most: int = CELL, within: Top | None = None) -> int:
    """One tick: how many points were written.  An empty one writes nothing.

    Late points find their own history, none is dropped, and a repeated tick
    changes nothing.  Only the days around the new points are read and
    written; where clusters on them are merged, members on other days follow by
    the aliases, which are written first: a tick that fails in between has
    merged clusters that it merges again when it is repeated.  Tables kept on
    the way are deleted at the tick's end.  Cells have about `most` points and
    lie in a top cell of at least `within`.
    """
    with kept_until_here():
        new = keep(batch.select("obj_id", "ts", "lon", "lat").where("ts is not null"), "new")
        if new.isEmpty():
            return 0
        now, moved = cluster_increment(new, store.read(days_around(new, by)), by, most, within)
        if not moved.isEmpty():
            store.merge(moved)
        return store.points.upsert(now)


def cluster_stream(points: DataFrame, store: ClusterStore, checkpoint: str, by: Density = Density(), seconds: int | None = None, most: int = CELL, within: Top | None = None) -> StreamingQuery:
    """Starts clustering a stream of points; without `seconds` it ends when all that is there has been read."""
    writer = points.writeStream.foreachBatch(lambda df, _: tick(df, store, by, most, within)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def cluster_messages(spark: SparkSession, source: str, store_path: str, checkpoint: str, by: Density = Density(), seconds: int | None = None, fmt: str = "text", most: int = CELL, within: Top | None = None, **options: str) -> StreamingQuery:
    points = points_of(parse_messages(message_stream(spark, source, fmt, **options)), need_id=True)
    return cluster_stream(points, ClusterStore(spark, store_path), checkpoint, by, seconds, most, within)
