"""Planar geometry in degrees, and well-known text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.params import KM_PER_DEGREE, Density

METRES = KM_PER_DEGREE * 1000
NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def metres(dx: Column, dy: Column) -> Column:
    return F.lit(METRES) * F.sqrt(dx * dx + dy * dy)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere, for those who prefer it to the planar distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6_371_000.0) * F.asin(F.sqrt(a))


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to a segment, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))).otherwise(F.lit(0.0))
    return metres(x - x1 - along * dx, y - y1 - along * dy)


def depth(t_ms: Column, by: Density) -> Column:
    """Time as the third coordinate, in degrees."""
    return t_ms.cast("double") * F.lit(by.depth_per_ms)


def point_lon(wkt: Column) -> Column:
    return F.regexp_extract(wkt, rf"(?i)^\s*POINT\s*\(\s*{NUMBER}\s+{NUMBER}\s*\)\s*$", 1).try_cast("double")


def point_lat(wkt: Column) -> Column:
    return F.regexp_extract(wkt, rf"(?i)^\s*POINT\s*\(\s*{NUMBER}\s+{NUMBER}\s*\)\s*$", 2).try_cast("double")


def point_text(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def segments(wkt: Column) -> Column:
    """array<struct<lon1, lat1, lon2, lat2>> of a LINESTRING or MULTILINESTRING; null for anything else."""

    def of_line(line: Column) -> Column:
        places = F.transform(
            F.regexp_extract_all(line, F.lit(rf"{NUMBER}\s+{NUMBER}"), F.lit(0)),
            lambda p: F.struct(F.split_part(F.regexp_replace(p, r"\s+", " "), F.lit(" "), F.lit(1)).cast("double").alias("lon"), F.split_part(F.regexp_replace(p, r"\s+", " "), F.lit(" "), F.lit(2)).cast("double").alias("lat")),
        )
        return F.zip_with(
            F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))),
            F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))),
            lambda a, b: F.struct(a["lon"].alias("lon1"), a["lat"].alias("lat1"), b["lon"].alias("lon2"), b["lat"].alias("lat2")),
        )

    lines = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?LINESTRING\s*\("), F.flatten(F.transform(lines, of_line)))


def box_contains(lon: Column, lat: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    return lon.between(x1, x2) & lat.between(y1, y2)
