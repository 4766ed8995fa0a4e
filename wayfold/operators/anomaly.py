"""Observations more than `k` deviations from their baseline, and tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What average and deviation may be off by rounding, as a part of themselves.
ROUNDING = 1e-12


def beyond(x: Column, average: Column, deviation: Column, k: float = 2.0) -> Column:
    """Strictly outside average +- k deviations; a value on the bound is inside, in whatever order average and deviation were added up."""
    reach = k * deviation + ROUNDING * (F.abs(average) + k * deviation)
    return (x > average + reach) | (x < average - reach)


def flagged(observed: DataFrame, baseline: DataFrame, keys: list[str], value: str = "volume", k: float = 2.0, name: str = "abnormal") -> DataFrame:
    """Observations that have a baseline, with the flag."""
    told = baseline.select(*keys, F.col("average").alias("_average"), F.col("deviation").alias("_deviation"))
    return observed.join(told, keys).withColumn(name, beyond(F.col(value), F.col("_average"), F.col("_deviation"), k)).drop("_average", "_deviation")


def confusion(df: DataFrame, keys: list[str], a: str = "traffic_abnormal", b: str = "message_abnormal", count: str = "near") -> DataFrame:
    """Counts of the four combinations of two flags by `keys`, over all rows and over those with messages."""
    cells = []
    for suffix, also in (("", F.lit(True)), ("_seen", F.col(count) != 0)):
        for x in (True, False):
            for y in (True, False):
                cells.append(F.count_if((F.col(a) == x) & (F.col(b) == y) & also).alias(f"{'a' if x else 'n'}{'a' if y else 'n'}{suffix}"))
    return df.groupBy(*keys).agg(*cells)


def rates(df: DataFrame, key: str = "cluster_id", flag: str = "abnormal") -> DataFrame:
    """Abnormal and normal observations of each cluster."""
    return df.groupBy(key).agg(F.count_if(F.col(flag)).alias("abnormal"), F.count_if(~F.col(flag)).alias("normal"))


def share_with_any(per_cluster: DataFrame) -> DataFrame:
    """One row: clusters, those with an abnormal observation, and their percentage (null without clusters)."""
    return per_cluster.agg(F.count("*").alias("clusters"), F.count_if(F.col("abnormal") > 0).alias("hit")).withColumn("percent", F.when(F.col("clusters") > 0, F.col("hit") * 100.0 / F.col("clusters")))
