"""Reading messages, counts and shapes; the keyed table that keeps points."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.geofn import point_lat, point_lon, segments
from wayfold.functions.textfn import clean_counts
from wayfold.functions.timefn import day_of_week, parse_message_time, second_of_day
from wayfold.operators.aggregate import preferred
from wayfold.operators.filters import geo_messages
from wayfold.params import ZONE
from wayfold.schema import MESSAGE
from wayfold.sources.log import LogSource
from wayfold.sources.shared import keep, kept_until_here
from wayfold.sources.snapshot import Snapshot

COUNTS = 96


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a file of JSON lines that wrap each in `value`; what can't be read is dropped."""
    wrapped = spark.read.schema(f"value struct<{MESSAGE}>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return wrapped.where("value is not null").select("value.*")


def parse_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """Messages of a column of JSON text; what can't be read is dropped."""
    return df.select(F.from_json(column, MESSAGE, {"mode": "PERMISSIVE"}).alias("m")).where("m is not null").select("m.*")


def points_of(messages: DataFrame, zone: str = ZONE, need_id: bool = True) -> DataFrame:
    """Stored form of geo-tagged messages."""
    placed = geo_messages(messages, need_id).withColumn("ts", parse_message_time(F.col("created_at")))
    return placed.select(
        F.concat(F.lit("tweet-"), "id_str").alias("obj_id"), "ts", F.col("coordinates.coordinates")[0].alias("lon"), F.col("coordinates.coordinates")[1].alias("lat"),
        "text", F.col("user.screen_name").alias("screen_name"), "tokens", "sentiment",
        day_of_week(F.col("ts"), zone).alias("day_of_week"), second_of_day(F.col("ts"), zone).alias("sec_of_day"),
        F.lit(None).cast("string").alias("cluster_id"), F.lit(None).cast("string").alias("cluster_label"),
    )


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header names its columns, all text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def to_long(wide: DataFrame, keys: list[str], counts: list[Column], day: Column, minutes: int = 15, zone: str = ZONE) -> DataFrame:
    """One row for each of the counts: keys, interval_ts, volume.  Slots follow each other by elapsed time from local midnight.

    Counts that are no whole non-negative numbers are 0; a row without any
    that is goes.
    """
    cells = clean_counts(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in counts]))
    start = F.to_utc_timestamp(F.to_timestamp(day), zone)
    rows = wide.withColumn("_cells", cells).where("_cells is not null").withColumn("_start", start)
    return rows.select(*keys, "_start", F.posexplode("_cells").alias("slot", "_cell")).select(
        *keys, (F.col("_start") + F.make_dt_interval(mins=F.col("slot") * minutes)).alias("interval_ts"), "slot", F.col("_cell").cast("int").alias("volume")
    )


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(site, lon, lat) of a CSV of WKT, SITE_NO; the last of repeated sites can't be told, so the smallest text counts."""
    own = read_wide(spark, path).select(F.col("SITE_NO").alias("site"), F.col("WKT").alias("wkt")).groupBy("site").agg(F.min("wkt").alias("wkt"))
    return own.select("site", point_lon(F.col("wkt")).alias("lon"), point_lat(F.col("wkt")).alias("lat"))


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """(flow, road) of a CSV of WKT, hfidl, hfidr: a line counts under both ids."""
    own = read_wide(spark, path).select(F.explode(F.array("hfidl", "hfidr")).alias("flow"), F.col("WKT").alias("wkt")).where("flow is not null")
    return own.groupBy("flow").agg(F.min("wkt").alias("wkt")).select("flow", segments(F.col("wkt")).alias("road"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(site, detector, location, general, lane, lane_mvt, loc_mvt, flow): fields 0 and 3 to 9 of the layout CSV."""
    df = read_wide(spark, path)
    at = {"site": 0, "location": 3, "detector": 4, "general": 5, "lane": 6, "lane_mvt": 7, "loc_mvt": 8, "flow": 9}
    return df.select([F.col(f"`{df.columns[k]}`").alias(name) for name, k in at.items()])


class KeyedTable:
    """A Parquet table with one row for each key, in parts that a snapshot names.

    A writer rewrites only the parts (days, by default) that its rows fall
    into, in a folder of the next version, and then replaces the snapshot, one
    small file that has the version of each part.  Reading and writing ask for
    that file and for the folders of the parts they need, however many versions
    there have been.  A version that a failed writer left is overwritten by the
    next.  Parts that were replaced stay for one more version, as readers may
    be at them, and are then deleted.  Rows that are written again replace
    themselves, so a repeated batch changes nothing, and none is refused:
    batches may be numbered anew after a checkpoint is lost.  The part of a key
    must not change.  A table has one writer.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "obj_id", part: str = "cast(to_date(ts) as string)") -> None:
        self.spark, self.path, self.schema, self.key, self.part = spark, path.rstrip("/"), schema, key, part
        self.snapshot = Snapshot(spark, path)

    def _said(self) -> dict:
        return self.snapshot.read() or {"version": -1, "parts": {}, "leaving": []}

    @staticmethod
    def _folder(part: str, version: int) -> str:
        return f"v={version}/part={part}"

    def parts(self) -> dict[str, str]:
        """The folder of each part."""
        return {part: f"{self.path}/{self._folder(part, v)}" for part, v in self._said()["parts"].items()}

    def drop(self) -> None:
        self.snapshot.delete("")

    def _read(self, said: dict, only: Collection[str] | None) -> DataFrame:
        parts = said["parts"] if only is None else {p: said["parts"][p] for p in only if p in said["parts"]}
        paths = [f"{self.path}/{self._folder(part, v)}" for part, v in parts.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, only: Collection[str] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        return self._read(self._said(), only)

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of the same key; of rows of one key the largest hash counts.  Returns how many keys were written."""
        said = self._said()
        names = self.spark.createDataFrame([], self.schema).columns
        with kept_until_here():
            fresh = keep(preferred(rows.select(names), self.key, F.hash(*names), F.to_json(F.struct(*names))), "fresh")
            part = F.coalesce(F.expr(self.part).cast("string"), F.lit("none")).alias("part")
            written = {r[0]: r[1] for r in fresh.groupBy(part).count().collect()}
            if not written:
                return 0
            merged = self._read(said, list(written)).join(fresh.select(self.key), self.key, "left_anti").select(names).unionByName(fresh)
            version = said["version"] + 1
            merged.select(*names, part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v={version}")
        parts = said["parts"] | dict.fromkeys(written, version)
        leaving = [[p, said["parts"][p]] for p in written if p in said["parts"]]
        used = {*parts.values(), *(v for _, v in leaving)}
        for name in {f"v={v}" if v not in used else self._folder(p, v) for p, v in said["leaving"]}:
            self.snapshot.delete(name)
        self.snapshot.replace({"version": version, "parts": parts, "leaving": leaving})
        return sum(written.values())


def save_counted(df: DataFrame, path: str, mode: str = "append") -> int:
    """Writes Parquet and returns how many rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def messages_of(points: DataFrame, zone_text: str = "+0000") -> DataFrame:
    """(key, value): points as the JSON messages that parse_messages() reads, keyed by id."""
    said = F.concat(F.date_format("ts", "E MMM dd HH:mm:ss "), F.lit(zone_text), F.date_format("ts", " yyyy"))
    own = F.regexp_replace("obj_id", "^tweet-", "")
    place = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(own.alias("key"), F.to_json(F.struct(own.alias("id_str"), F.col("text"), place.alias("coordinates"), said.alias("created_at"), F.struct("screen_name").alias("user"), F.col("tokens"), F.col("sentiment"))).alias("value"))


def write_messages(messages: DataFrame, target: str, fmt: str = "text", **options: str) -> None:
    """Messages (key, value) as text files of a folder, to a log (`log`), or to a Kafka topic where its connector is there.

    To a log or a topic the messages of a key go in one task, and so stay in
    their order there.
    """
    if fmt == "kafka":
        messages.repartition("key").write.format("kafka").options(**options).option("topic", target).save()
    elif fmt == "log":
        messages.sparkSession.dataSource.register(LogSource)
        messages.select("key", "value").repartition("key").write.format(LogSource.name()).mode("append").options(**options).save(target)
    else:
        messages.select("value").write.mode("append").format(fmt).options(**options).save(target)
