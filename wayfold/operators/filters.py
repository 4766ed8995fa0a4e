"""Row filters over stored points and volumes; all reach the scan as pushed-down comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def during(ts: Column, start, end, inclusive: bool = False) -> Column:
    """Between two instants, which themselves don't count unless `inclusive`."""
    return (ts >= start) & (ts <= end) if inclusive else (ts > start) & (ts < end)


def before(ts: Column, at) -> Column:
    return ts < at


def after(ts: Column, at) -> Column:
    return ts > at


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def geo_messages(df: DataFrame, need_id: bool = True) -> DataFrame:
    """Messages with coordinates and, unless it is a stream, an id."""
    placed = F.col("coordinates.coordinates").isNotNull() & (F.size("coordinates.coordinates") == 2)
    return df.where(placed & F.col("id_str").isNotNull() if need_id else placed)


def baseline_quality(df: DataFrame, least: int = 10, strictly: bool = False) -> DataFrame:
    """Baselines with a positive average over enough observations."""
    return df.where((F.col("average") > 0) & (F.col("n") > least if strictly else F.col("n") >= least))


def any_of(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose `column` is among the first column of `keys`."""
    k = keys.columns[0]
    return df.join(keys.select(F.col(k).alias(column)).distinct(), column, "left_semi")


def extent(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row: the bounding box, nulls without rows."""
    return df.agg(F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"))
