"""Sums over detectors, baselines by day of week and time of day, cluster summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geofn import METRES


def over_detectors(volumes: DataFrame, keys: tuple[str, ...] = ("site", "ts")) -> DataFrame:
    """One row for each of `keys`: the summed volume and the detector, `all` if there are several."""
    return volumes.groupBy(*keys).agg(
        F.sum("volume").cast("long").alias("volume"),
        F.when(F.count_distinct("detector") > 1, "all").otherwise(F.min("detector")).alias("detector"),
    )


def statistics(df: DataFrame, keys: list[str], value: str = "volume") -> DataFrame:
    """average, n, deviation (0 for one observation), low and high by `keys`, in one pass."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("average"),
        F.count(value).alias("n"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"),
        F.min(value).cast("double").alias("low"),
        F.max(value).cast("double").alias("high"),
    )


def partial_statistics(df: DataFrame, keys: list[str], value: str = "volume") -> DataFrame:
    """n, mean, squares (of the differences to the mean, summed), low and high by `keys`: what merged_statistics() adds up."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("squares"),
        F.min(value).cast("double").alias("low"),
        F.max(value).cast("double").alias("high"),
    )


def merged_statistics(partial: DataFrame, keys: list[str]) -> DataFrame:
    """statistics() of all values from partial_statistics() of disjoint parts of them.

    Parts of a key, which are as many as it has days, are put together one
    after the other by their means' difference, so nothing large is subtracted
    from anything large.
    """
    part = F.struct(F.col("n").cast("double").alias("n"), F.col("mean").cast("double").alias("mean"), F.col("squares").cast("double").alias("squares"))

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n).alias("squares"))

    nothing = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "squares")])
    parts = F.sort_array(F.collect_list(F.when(F.col("n") > 0, part)))  # in one order, so that every run gives the same
    found = partial.groupBy(*keys).agg(parts.alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.withColumn("all", F.aggregate("parts", nothing, add))
    n = F.col("all.n")
    return found.select(*keys, F.when(n > 0, F.col("all.mean")).alias("average"), n.cast("long").alias("n"), F.when(n > 1, F.sqrt(F.col("all.squares") / (n - 1))).otherwise(F.lit(0.0)).alias("deviation"), "low", "high")


def two_pass_deviation(df: DataFrame, keys: list[str], value: str = "volume") -> DataFrame:
    """The sample deviation from each observation's difference to its mean, for comparison with statistics()."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    squares = df.join(means, keys).groupBy(*keys).agg(F.sum(F.pow(F.col(value) - F.col("mean"), 2)).alias("squares"), F.count(value).alias("n"))
    return squares.select(*keys, "n", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("deviation"))


def calendar_counts(sites: DataFrame, near: DataFrame, start: str, end: str) -> DataFrame:
    """(site, day_of_week, hour, date, cnt) for every site, hour and day from `start` up to, not including, `end`; 0 where `near` (site, date, hour) has no row."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    grid = sites.select("site", F.explode(days).alias("date")).select("site", "date", F.date_format("date", "E").alias("day_of_week"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    seen = near.groupBy("site", "date", "hour").agg(F.count("*").alias("cnt"))
    return grid.join(seen, ["site", "date", "hour"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))


def calendar_baseline(counts: DataFrame, true_low: bool = False) -> DataFrame:
    """Statistics of the counts by site, day of week and hour; low and high start at 0 unless `true_low`; one day alone gives no row."""
    low, high = F.min("cnt"), F.max("cnt")
    return (
        counts.groupBy("site", "day_of_week", "hour")
        .agg(F.avg("cnt").alias("average"), F.count("*").alias("n"), F.stddev_samp("cnt").alias("deviation"), (low if true_low else F.least(low, F.lit(0))).cast("double").alias("low"), (high if true_low else F.greatest(high, F.lit(0))).cast("double").alias("high"))
        .where("n >= 2")
    )


def cluster_extents(points: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Centre, count, extremes, times and radius (half the diagonal of the extent, in metres) of each cluster."""
    found = points.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("size"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("ts").alias("t1"), F.max("ts").alias("t2"),
    )
    dx, dy = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")
    return found.withColumn("radius_m", F.sqrt(dx * dx + dy * dy) * (METRES / 2))


def cluster_summary(points: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Mean place and whole mean millisecond, and the number of members."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return points.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.floor(F.sum(ms) / F.count("*")).cast("long").alias("ms"), F.count("*").alias("size"))


def hourly(df: DataFrame, hour: Column, value: Column, name: str) -> DataFrame:
    return df.groupBy(hour.alias("hour")).agg(value.alias(name))


def first_known(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value of each key that isn't null: the smallest, so that every run gives the same."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def time_extremes(df: DataFrame, ts: str = "ts", key: str = "obj_id") -> DataFrame:
    """One row: the earliest and the latest time, and the smallest key at each."""
    at = F.col(ts)
    return df.agg(F.min(at).alias("first_ts"), F.min_by(key, F.struct(at, F.col(key))).alias("first_key"), F.max(at).alias("last_ts"), F.min_by(key, F.struct(-F.unix_micros(at.cast("timestamp")), F.col(key))).alias("last_key"))


def preferred(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first by `order`."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best.*")


