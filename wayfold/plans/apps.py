"""The applications as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.geofn import box_contains
from wayfold.functions.textfn import lemma_set, text_sentiment, with_tokens
from wayfold.functions.timefn import day_of_week, hour_of_day, local, local_date, time_of_day, utc_hour, zoned_hour
from wayfold.operators import aggregate, anomaly, filters, spatial
from wayfold.operators.cluster import cluster_increment, cluster_points
from wayfold.params import ZONE
from wayfold.sources.files import COUNTS, KeyedTable, points_of, read_layout, read_messages, read_places, read_roads, read_wide, to_long

#: The box around the city centre that is judged by default: lon, lat, lon, lat.
CENTRE = (144.895795, -37.86113, 145.014087, -37.763636)


def ingest_volumes(spark: SparkSession, volume_csv: str, layout_csv: str, point_csv: str, line_csv: str, zone: str = ZONE) -> DataFrame:
    """Volumes of 15 minutes from wide rows, with places, layout and roads; rows of sites without a place go."""
    wide = read_wide(spark, volume_csv)
    site, day, detector, *rest = wide.columns
    counts = [F.col(f"`{c}`") for c in rest[:COUNTS]]
    named = wide.select(F.col(f"`{site}`").alias("site"), F.col(f"`{day}`").alias("_day"), F.col(f"`{detector}`").alias("detector"), *counts)
    long = to_long(named, ["site", "detector"], counts, F.col("_day"), zone=zone)
    layout = read_layout(spark, layout_csv)
    one = layout.groupBy("site", "detector").agg(*[F.min(c).alias(c) for c in layout.columns if c not in ("site", "detector")])
    placed = long.join(read_places(spark, point_csv).where("lon is not null"), "site").join(one, ["site", "detector"], "left")
    return placed.join(read_roads(spark, line_csv), "flow", "left").withColumn("day_of_week", day_of_week(F.col("interval_ts"), zone))


def ingest_points(spark: SparkSession, path: str, grader=None, stop: list[str] | None = None, lemmas=None) -> DataFrame:
    """Points of a file of messages; with a grader of sentences also sentiment, with it or `lemmas` of a text also tokens: lemmas, or else lower-case words."""
    points = points_of(read_messages(spark, path))
    if grader is not None or lemmas is not None:
        points = points.withColumn("tokens", with_tokens(F.col("tokens"), lemmas(F.col("text")) if lemmas is not None else lemma_set(F.col("text"), stop)))
    return points.withColumn("sentiment", text_sentiment(F.col("text"), grader)) if grader is not None else points


def build_baseline(volumes: DataFrame, by: tuple[str, ...] = ("site", "day_of_week", "time_of_day"), zone: str = ZONE) -> DataFrame:
    """Statistics of the detectors' sum by site and local time; other `by` give hourly or any-day baselines."""
    return aggregate.statistics(with_local_times(volumes, zone), list(by))


def with_local_times(volumes: DataFrame, zone: str = ZONE) -> DataFrame:
    """The detectors' sum of each site and interval, with its local day of week, time of day and hour."""
    ts = F.col("interval_ts")
    return aggregate.over_detectors(volumes, ("site", "interval_ts")).withColumns({"day_of_week": day_of_week(ts, zone), "time_of_day": time_of_day(ts, zone), "hour": hour_of_day(ts, zone)})


def build_nearby_baseline(sites: DataFrame, points: DataFrame, radius_m: float = 1000, start: str = "2017-06-01", end: str = "2018-01-01", zone: str = ZONE, true_low: bool = False) -> DataFrame:
    """How many points are near each site by local day of week and hour, days without any counting 0."""
    near = spatial.within(points.select("ts", "lon", "lat"), sites.select("site", "lon", "lat"), radius_m, names=("o", "s"))
    t = F.col("o_ts")
    seen = near.select(F.col("s_site").alias("site"), local_date(t, zone).alias("date"), F.hour(local(t, zone)).alias("hour"))
    return aggregate.calendar_baseline(aggregate.calendar_counts(sites, seen, start, end), true_low)


class BaselineStore:
    """A baseline to which days are added: for each day the sums that give its statistics, replaced if the day comes again.

    Reading adds up the days' sums, a row for each site, day and time, and
    never the volumes; the result is build_baseline() of all days' volumes.
    """

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ("site", "day_of_week", "time_of_day"), zone: str = ZONE) -> None:
        self.by, self.zone = by, zone
        kept = [c for c in by if c != "day"]
        schema = "key string, day date, " + ", ".join(f"{c} string" for c in kept) + ", n long, mean double, squares double, low double, high double"
        self.table = KeyedTable(spark, path, schema, key="key", part="cast(day as string)")

    def add(self, volumes: DataFrame) -> int:
        """Volumes of whole local days; how many rows of sums were written."""
        told = with_local_times(volumes, self.zone).withColumn("day", local_date(F.col("interval_ts"), self.zone))
        sums = aggregate.partial_statistics(told, ["day", *self.by])
        return self.table.upsert(sums.withColumn("key", F.to_json(F.struct("day", *self.by))))

    def read(self) -> DataFrame:
        return aggregate.merged_statistics(self.table.read(), list(self.by))


def rush_hour(baseline: DataFrame, weekday: str = "Mon", zone: str = ZONE) -> DataFrame:
    """A weekday's averages summed by the UTC hour in which the local time of day falls on 1 January 2000, the day that stands for all."""
    at = F.to_utc_timestamp(F.to_timestamp(F.concat(F.lit("2000-01-01 "), "time_of_day")), zone)
    return aggregate.hourly(baseline.where(F.col("day_of_week") == weekday), utc_hour(at), F.sum("average"), "volume")


def count_clustered_by_hour(points: DataFrame, zone: str = ZONE) -> DataFrame:
    return aggregate.hourly(points.where(filters.filled(F.col("cluster_id"))), zoned_hour(F.col("ts"), zone), F.count("*"), "cnt")


def flag_on_street(points: DataFrame, lines: DataFrame, radius_m: float = 10) -> DataFrame:
    return spatial.near_segment(points, lines, radius_m)


def detect_site_anomalies(volumes: DataFrame, baseline: DataFrame, points: DataFrame, nearby: DataFrame, radius_m: float = 1000, seconds: float = 1800, k: float = 2.0, least: int = 10, box: tuple[float, float, float, float] | None = CENTRE, start=None, end=None, zone: str = ZONE) -> DataFrame:
    """Per local day, how often traffic and messages near a site are abnormal together, alone or not at all."""
    own = volumes.where(box_contains(F.col("lon"), F.col("lat"), *box)) if box else volumes
    if start is not None:
        own = own.where(filters.during(F.col("interval_ts"), start, end))
    summed = aggregate.over_detectors(own, ("site", "interval_ts", "lon", "lat"))
    ts = F.col("interval_ts")
    told = summed.withColumns({"ts": ts, "day": local_date(ts, zone), "day_of_week": day_of_week(ts, zone), "time_of_day": time_of_day(ts, zone), "hour": F.hour(local(ts, zone))})
    judged = anomaly.flagged(told, filters.baseline_quality(baseline, least), ["site", "day_of_week", "time_of_day"], "volume", k, "traffic_abnormal")
    seen = spatial.count_within(judged, points.select("ts", "lon", "lat"), ["site", "interval_ts"], radius_m, seconds)
    both = anomaly.flagged(seen, nearby, ["site", "day_of_week", "hour"], "near", k, "message_abnormal")
    return anomaly.confusion(both, ["day"])


def detect_cluster_anomalies(points: DataFrame, volumes: DataFrame, baseline: DataFrame, pad_m: float = 300, pad_ms: int = 1000, k: float = 2.0, more_than: int = 30, zone: str = ZONE) -> DataFrame:
    """Abnormal and normal traffic observations near each cluster of messages while it lasts."""
    extents = aggregate.cluster_extents(points.where(filters.filled(F.col("cluster_id"))))
    near = spatial.interval_join(extents, volumes.withColumn("ts", F.col("interval_ts")), pad_m, pad_ms)
    summed = aggregate.over_detectors(near, ("cluster_id", "site", "ts"))
    told = summed.withColumns({"day_of_week": day_of_week(F.col("ts"), zone), "time_of_day": time_of_day(F.col("ts"), zone)})
    judged = anomaly.flagged(told, filters.baseline_quality(baseline, more_than, strictly=True), ["site", "day_of_week", "time_of_day"], "volume", k)
    return anomaly.rates(judged)


def summarise_clusters(points: DataFrame) -> DataFrame:
    return aggregate.cluster_summary(points)


__all__ = ["BaselineStore", "build_baseline", "build_nearby_baseline", "cluster_increment", "cluster_points", "count_clustered_by_hour", "detect_cluster_anomalies", "detect_site_anomalies", "flag_on_street", "ingest_points", "ingest_volumes", "rush_hour", "summarise_clusters"]
