"""Points laid out by place and time, so that a scan of a box and a span reads few files.

Rows are sorted by a key that interleaves the bits of longitude, latitude and
time within a period (Morton order), after the number of the period.  Files
hold ranges of the key and are about equally large wherever points are dense.
A box and a span become ranges of the key: files that meet none are not in the
plan at all, and within files Parquet skips row groups and pages by the same
ranges, which are pushed down with the exact comparisons.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.snapshot import Snapshot

KEY = "place_key"
AXES = 3
#: Ranges by which files are chosen, and by which rows are.
FILE_RANGES, ROW_RANGES = 1024, 32


def millis_of(t: datetime) -> int:
    """Milliseconds since 1970; a time without a zone is UTC, as all of ours are."""
    return math.floor((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


@dataclass(frozen=True)
class Curve:
    """Keys of places and times: `bits` for each axis, over `box` (lon, lat, lon, lat) and one period of time.

    What is outside the box counts as on its border, so a box that is too small
    costs speed, not rows.
    """

    box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)
    period_ms: int = 7 * 86_400_000
    bits: int = 16

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 16 or self.box[0] >= self.box[2] or self.box[1] >= self.box[3] or self.period_ms < 1:
            raise ValueError("a curve has 1 to 16 bits an axis, a box with an extent and a period")

    @property
    def cells(self) -> int:
        return 1 << self.bits

    def scales(self) -> list[tuple[float, float]]:
        """Low end and cells a unit of longitude and latitude."""
        x1, y1, x2, y2 = self.box
        return [(x1, self.cells / (x2 - x1)), (y1, self.cells / (y2 - y1))]

    def key(self, lon: Column, lat: Column, t_ms: Column) -> Column:
        """Null where a coordinate or the time is null or not a number."""
        since = F.pmod(t_ms, F.lit(self.period_ms))
        period = ((t_ms - since) / F.lit(self.period_ms)).cast("long")
        own = [F.greatest(F.lit(0.0), F.least(F.lit(float(self.cells - 1)), F.floor((c.cast("double") - F.lit(low)) * F.lit(scale)).cast("double"))).cast("long") for c, (low, scale) in zip((lon, lat), self.scales(), strict=True)]
        own.append(F.floor(since * F.lit(self.cells) / F.lit(self.period_ms)).cast("long"))
        whole = sum((F.shiftleft(spread(c, self.bits), k) for k, c in enumerate(own)), F.lit(0).cast("long")) + period * F.lit(1 << AXES * self.bits).cast("long")
        finite = [c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)) for c in (lon, lat)]
        return F.when(finite[0] & finite[1] & t_ms.isNotNull(), whole)

    def ranges(self, box: tuple[float, float, float, float] | None = None, begin_ms: int | None = None, end_ms: int | None = None, most: int = 64) -> list[tuple[int, int]]:
        """At most `most` ranges of keys, ends included, with every key of the box and span, ends included; open where None."""
        low, high = [0, 0], [self.cells - 1, self.cells - 1]
        if box:
            for k, (start, scale) in enumerate(self.scales()):
                low[k], high[k] = (min(self.cells - 1, max(0, math.floor((v - start) * scale))) for v in (box[k], box[k + 2]))
        unit = 1 << AXES * self.bits
        if begin_ms is None or end_ms is None:  # no end of the periods: one range from or up to the given end
            first = -(1 << 63) if begin_ms is None else begin_ms // self.period_ms * unit
            return [(first, (1 << 63) - 1 if end_ms is None else (end_ms // self.period_ms + 1) * unit - 1)]
        first, last = begin_ms // self.period_ms, end_ms // self.period_ms
        if last < first or any(a > b for a, b in zip(low, high, strict=True)):
            return []
        if last - first + 1 > most:  # so long a span is read whole
            return [(first * unit, (last + 1) * unit - 1)]
        at = lambda ms: (ms % self.period_ms) * self.cells // self.period_ms
        share, found, middle = most // (last - first + 1), [], None
        for period in range(first, last + 1):
            begin, end = at(begin_ms) if period == first else 0, at(end_ms) if period == last else self.cells - 1
            if first < period < last:
                middle = own = middle or covering([*low, begin], [*high, end], self.bits, share)
            else:
                own = covering([*low, begin], [*high, end], self.bits, share)
            found += [(period * unit + a, period * unit + b) for a, b in own]
        return merged(found)


def spread(c: Column, bits: int) -> Column:
    """The bits of `c`, at most 16 of them, two apart."""
    for shift, mask in ((16, 0xFF0000FF), (8, 0xF00F00F00F), (4, 0xC30C30C30C3), (2, 0x249249249249)):
        if bits > shift // 2:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, ascending, with those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covering(low: list[int], high: list[int], bits: int, most: int) -> list[tuple[int, int]]:
    """At most `most` ranges of Morton keys that hold all cells from `low` to `high`.

    The cube is halved along all axes, again and again: parts inside the box
    are ranges, parts that it cuts are halved as long as there is room.
    """
    done: list[tuple[int, int]] = []
    cut = [(0, [0] * len(low))]  # key and corner, in units of the level's parts
    for level in range(bits + 1):
        side, keys = 1 << bits - level, 1 << len(low) * (bits - level)
        inside = [all(a <= c * side and (c + 1) * side - 1 <= b for a, b, c in zip(low, high, corner, strict=True)) for _, corner in cut]
        done = merged(done + [(key * keys, (key + 1) * keys - 1) for (key, _), all_in in zip(cut, inside, strict=True) if all_in])
        cut = [x for x, all_in in zip(cut, inside, strict=True) if not all_in]
        if not cut:
            return done
        half = side >> 1
        parts = ((key << len(low) | bit, [2 * c + (bit >> k & 1) for k, c in enumerate(own)]) for key, own in cut for bit in range(1 << len(low)))
        halves = [(key, corner) for key, corner in parts if all(c * half <= b and (c + 1) * half - 1 >= a for a, b, c in zip(low, high, corner, strict=True))]
        smaller = keys >> len(low)
        if len(merged(done + [(key * smaller, (key + 1) * smaller - 1) for key, _ in halves])) > most:
            return merged(done + [(key * keys, (key + 1) * keys - 1) for key, _ in cut])
        cut = halves
    return done


class PlacedTable:
    """A table of rows with lon, lat and ts, in files of key ranges that one snapshot names.

    `append` adds rows as files of their own, `compact` makes one order of all;
    both write new files first and then replace the snapshot, so readers see
    all of a change or none, and what a failed writer left is overwritten by
    the next.  Columns are those of the first rows, but for the key, which
    readers don't see.
    """

    def __init__(self, spark: SparkSession, path: str, curve: Curve = Curve(), file_rows: int = 1_000_000) -> None:
        self.spark, self.path, self.snapshot, self.file_rows = spark, path.rstrip("/"), Snapshot(spark, path), file_rows
        self._curve = curve

    def _said(self) -> dict:
        return self.snapshot.read() or {"version": -1, "schema": None, "curve": asdict(self._curve), "files": [], "leaving": []}

    @staticmethod
    def curve_of(said: dict) -> Curve:
        return Curve(**said["curve"] | {"box": tuple(said["curve"]["box"])})

    def _write(self, rows: DataFrame, said: dict, files: list[list], leaving: list[str]) -> int:
        version = said["version"] + 1
        folder = f"v={version}"
        t = F.unix_millis(F.col("ts").cast("timestamp"))
        keyed = rows.withColumn(KEY, self.curve_of(said).key(F.col("lon"), F.col("lat"), t))
        n = rows.count()
        spill = F.xxhash64(*[c for c in rows.columns if rows.schema[c].dataType.typeName() not in ("map", "variant")])  # one place and instant may hold many rows
        keyed.repartitionByRange(max(1, -(-n // self.file_rows)), KEY, spill).sortWithinPartitions(KEY).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(keyed.schema).parquet(f"{self.path}/{folder}")
        new = written.groupBy(F.col("_metadata.file_name")).agg(F.count("*"), F.min(KEY), F.max(KEY)).collect()  # one row a file
        for name in said["leaving"]:  # named by the snapshot before this one
            self.snapshot.delete(name)
        self.snapshot.replace({"version": version, "schema": rows.schema.jsonValue(), "curve": said["curve"], "files": sorted([*files, *([f"{folder}/{f}", *x] for f, *x in new)], key=lambda x: x[0]), "leaving": leaving})
        return n

    def append(self, rows: DataFrame) -> int:
        """Adds rows; how many."""
        said = self._said()
        if said["schema"]:
            rows = rows.select([f["name"] for f in said["schema"]["fields"]])
        return self._write(rows, said, said["files"], [])

    def compact(self) -> int:
        """Writes all rows anew in one order; the files so far stay until the next change, as readers may be at them."""
        said = self._said()
        return self._write(self.read(), said, [], sorted({name.partition("/")[0] for name, *_ in said["files"]})) if said["files"] else 0

    def files(self, box: tuple[float, float, float, float] | None = None, begin: datetime | None = None, end: datetime | None = None) -> tuple[list[str], int]:
        """The files that a scan has to read, and how many there are."""
        said = self._said()
        return self._met(said, self._ranges(said, box, begin, end, FILE_RANGES)), len(said["files"])

    def _ranges(self, said: dict, box, begin, end, most: int) -> list[tuple[int, int]] | None:
        if box is None and begin is None and end is None:
            return None
        keys = [x for _, _, a, b in said["files"] if a is not None for x in (a, b)]
        curve = self.curve_of(said)
        unit = 1 << AXES * curve.bits  # an open span ends where the table does
        spans = [(min(keys) // unit) * curve.period_ms, (max(keys) // unit + 1) * curve.period_ms - 1] if keys else [0, 0]
        return curve.ranges(box, *(spans[k] if t is None else millis_of(t) for k, t in enumerate((begin, end))), most=most)

    @staticmethod
    def _met(said: dict, ranges: list[tuple[int, int]] | None) -> list[str]:
        if ranges is None:
            return [name for name, *_ in said["files"]]
        ends = [b for _, b in ranges]
        return [name for name, _, a, b in said["files"] if a is not None and (k := bisect_left(ends, a)) < len(ranges) and ranges[k][0] <= b]

    def read(self, box: tuple[float, float, float, float] | None = None, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Rows inside the box (lon, lat, lon, lat; border included) from `begin` to `end`, both included; all rows without either.

        Rows without a place or a time are in none but the scan of all.
        """
        from pyspark.sql.types import StructType

        said = self._said()
        if not said["schema"]:
            raise ValueError(f"nothing has been written to {self.path}")
        schema = StructType.fromJson(said["schema"])
        names = self._met(said, self._ranges(said, box, begin, end, FILE_RANGES))
        if not names:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(StructType.fromJson(said["schema"]).add(KEY, "long")).parquet(*[f"{self.path}/{name}" for name in names])
        ranges = self._ranges(said, box, begin, end, ROW_RANGES)
        if ranges is not None:
            inside = F.lit(False)
            for a, b in ranges:
                inside |= F.col(KEY).between(a, b)
            found = found.where(inside)
            if box:
                found = found.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
            for t, sign in ((begin, 1), (end, -1)):
                if t is not None:
                    at = F.lit(t if t.tzinfo else t.replace(tzinfo=timezone.utc)).cast(schema["ts"].dataType)
                    found = found.where(F.col("ts") >= at if sign > 0 else F.col("ts") <= at)
        return found.drop(KEY)
