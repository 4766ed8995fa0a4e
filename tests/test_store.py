"""Tables named by a snapshot: what readers see, what is left on disk, which files a scan reads; and the grid of many levels."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import spatial
from wayfold.plans import cli
from wayfold.sources import shared
from wayfold.sources.files import KeyedTable
from wayfold.sources.placed import Curve, PlacedTable, covering, millis_of
from wayfold.sources.snapshot import Snapshot

POINTS = "obj_id string, ts timestamp, lon double, lat double"


def utc(*a):
    return dt.datetime(*a, tzinfo=dt.timezone.utc)


def folders(path):
    return sum(len(d) for _, d, _ in os.walk(path))


def table(spark, path):
    return KeyedTable(spark, str(path), "obj_id string, v int", part="left(obj_id, 1)")


def test_a_snapshot_is_replaced_whole(spark, tmp_path):
    s = Snapshot(spark, f"{tmp_path}/new/table")
    assert s.read() is None
    for k in range(3):
        s.replace({"k": k, "name": "é"})
        assert s.read() == {"k": k, "name": "é"}
    assert [f for f in os.listdir(tmp_path / "new/table") if not f.startswith(".")] == ["_snapshot"]


def test_many_upserts_leave_few_folders_and_ask_the_file_system_as_often_as_one(spark, tmp_path, monkeypatch):
    t, calls = table(spark, tmp_path), []
    for name in ("read", "replace", "delete"):
        monkeypatch.setattr(Snapshot, name, lambda self, *a, own=getattr(Snapshot, name), name=name: calls.append(name) or own(self, *a))
    t.upsert(spark.createDataFrame([("a", 0), ("b", 0)], t.schema))
    left, asked = [], []
    for k in range(1, 51):
        calls.clear()
        t.upsert(spark.createDataFrame([("a", k)], t.schema))
        left.append(folders(tmp_path))
        asked.append(len(calls))
    assert len(set(left[2:])) == 1 and left[-1] <= 8 and max(asked[2:]) == min(asked[2:]) <= 3
    assert {tuple(r) for r in t.read().collect()} == {("a", 50), ("b", 0)}


def test_readers_of_the_version_before_keep_their_files(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", 0), ("b", 0)], t.schema))
    before = t.read()
    t.upsert(spark.createDataFrame([("a", 1)], t.schema))
    assert {tuple(r) for r in before.collect()} == {("a", 0), ("b", 0)}


@pytest.mark.parametrize("step", ["write", "delete", "replace"])
def test_a_writer_that_fails_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    t = table(spark, tmp_path / "t")
    for k in range(3):
        t.upsert(spark.createDataFrame([("a", k), ("b", 0)], t.schema))
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(KeyedTable, "_read", lambda self, said, only: self.spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("obj_id"), F.lit(1).alias("v")))
        else:
            own = getattr(Snapshot, step)
            m.setattr(Snapshot, step, lambda self, *a: (own(self, *a) if step == "delete" else None, 1 / 0))
        with pytest.raises(Exception):
            t.upsert(spark.createDataFrame([("a", 9), ("c", 9)], t.schema))
    assert {tuple(r) for r in t.read().collect()} == {("a", 2), ("b", 0)}
    for k in range(3):
        t.upsert(spark.createDataFrame([("a", 9 + k), ("c", 9)], t.schema))
    assert {tuple(r) for r in t.read().collect()} == {("a", 11), ("b", 0), ("c", 9)}
    assert folders(tmp_path / "t") <= 9


def test_what_is_kept_on_the_way_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    with shared.kept_until_here():
        shared.keep(spark.range(3), "outer")
        with shared.kept_until_here():
            assert shared.keep(spark.range(3), "inner").count() == 3
        assert [f.partition("-")[0] for f in os.listdir(tmp_path)] == ["outer"]
    assert os.listdir(tmp_path) == []
    with pytest.raises(ZeroDivisionError), shared.kept_until_here():
        shared.keep(spark.range(3), "failed")
        1 / 0
    assert os.listdir(tmp_path) == []


def test_a_folder_of_our_own_where_none_is_set(spark, monkeypatch):
    class Unset:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Unset(), spark.sparkContext

    monkeypatch.setattr(shared, "_own", {})
    first = shared.shared_dir(Session())
    assert first.startswith("file://") and os.path.isdir(first.removeprefix("file://")) and shared.shared_dir(Session()) == first

    class Cluster(Session):
        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster())


def interleaved(curve, lon, lat, ms):
    cells = [min(curve.cells - 1, max(0, int((v - low) * scale // 1))) for v, (low, scale) in zip((lon, lat), curve.scales())] + [ms % curve.period_ms * curve.cells // curve.period_ms]
    return ms // curve.period_ms * (1 << 3 * curve.bits) + sum((c >> b & 1) << 3 * b + k for k, c in enumerate(cells) for b in range(curve.bits))


@pytest.mark.parametrize("bits", [1, 2, 3, 5, 8, 9, 16])
def test_keys_interleave_the_bits(spark, bits):
    draw, curve = random.Random(bits), Curve((144.0, -38.5, 146.0, -37.0), 86_400_000, bits)
    rows = [(draw.uniform(143, 147), draw.uniform(-39, -36), draw.randrange(-(10**11), 2 * 10**12)) for _ in range(300)] + [(144.0, -37.0, 0), (146.0, -38.5, -1), (144.9, -37.8, 86_400_000)]
    df = spark.createDataFrame([(*r, interleaved(curve, *r)) for r in rows], "lon double, lat double, ms long, told long")
    assert df.where(curve.key(F.col("lon"), F.col("lat"), F.col("ms")) != F.col("told")).count() == 0
    odd = spark.createDataFrame([(None, 1.0, 1), (1.0, None, 1), (1.0, 1.0, None), (float("nan"), 1.0, 1), (1.0, float("inf"), 1)], "lon double, lat double, ms long")
    assert odd.where(curve.key(F.col("lon"), F.col("lat"), F.col("ms")).isNotNull()).count() == 0


@pytest.mark.parametrize("most", [1, 2, 7, 64])
def test_ranges_cover_the_box_and_little_else(most):
    draw = random.Random(most)
    z = lambda c: sum((v >> b & 1) << 3 * b + k for k, v in enumerate(c) for b in range(4))
    cells = [(x, y, t) for x in range(16) for y in range(16) for t in range(16)]
    for _ in range(25):
        ends = [sorted(draw.choices(range(16), k=2)) for _ in range(3)]
        found = covering([a for a, _ in ends], [b for _, b in ends], 4, most)
        inside = {z(c) for c in cells if all(a <= v <= b for v, (a, b) in zip(c, ends))}
        covered = {k for a, b in found for k in range(a, b + 1)}
        assert inside <= covered and len(found) <= most
        assert most < 64 or covered == inside or len(found) > 8


@pytest.fixture(scope="module")
def city(spark):
    draw = random.Random(1)
    rows = [(f"p{k}", utc(2024, 1, 1) + dt.timedelta(seconds=draw.randrange(28 * 86_400)), draw.gauss(144.96, 0.05) if k % 3 else draw.uniform(144, 146), draw.gauss(-37.81, 0.05) if k % 3 else draw.uniform(-38.5, -37)) for k in range(20_000)]
    return spark.createDataFrame(rows + rows[:50] + [("far", utc(1960, 1, 1), -170.0, 80.0), ("none", None, 144.9, -37.8), ("nowhere", utc(2024, 1, 2), None, -37.8)], POINTS).repartition(4).cache()


BOX, BEGIN, END = (144.95, -37.82, 144.97, -37.80), dt.datetime(2024, 1, 9, 7), dt.datetime(2024, 1, 9, 8)


def test_a_box_and_an_hour_read_few_files(spark, city, tmp_path):
    t = PlacedTable(spark, f"{tmp_path}/t", Curve((144.0, -38.5, 146.0, -37.0)), file_rows=250)
    assert t.append(city) == 20_053
    found = t.read(BOX, BEGIN, END)
    met, every = t.files(BOX, BEGIN, END)
    assert every >= 80 and len(met) == len(found.inputFiles()) <= 4
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = t.read(BOX, BEGIN, END)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(place_key" in plan and "GreaterThanOrEqual(lon" in plan
    assert {r[0] for r in t.read().select("obj_id").collect()} == {r[0] for r in city.select("obj_id").collect()} and t.read().count() == 20_053


def test_scans_equal_filters(spark, city, tmp_path):
    t = PlacedTable(spark, f"{tmp_path}/t", Curve((144.5, -38.0, 145.5, -37.5), 86_400_000), file_rows=1000)
    t.append(city.where("obj_id <= 'p5'"))
    t.append(city.where("obj_id > 'p5'").select("lat", "lon", "ts", "obj_id"))
    draw = random.Random(2)
    scans = [(BOX, BEGIN, END), (None, BEGIN, END), (BOX, None, None), (BOX, BEGIN, None), (BOX, None, END), ((-180, -90, 180, 90), dt.datetime(1950, 1, 1), dt.datetime(1970, 1, 1)), (BOX, END, BEGIN), ((145.0, -37.0, 144.0, -38.0), None, None)]
    for _ in range(6):
        x, y, at = draw.uniform(144, 146), draw.uniform(-38.5, -37), dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(600))
        scans.append(((x, y, x + draw.choice([0.01, 0.3]), y + draw.choice([0.01, 0.3])), at, at + dt.timedelta(hours=draw.choice([1, 100]))))
    for compacted in (False, True):
        for box, begin, end in scans:
            told = city
            if box:
                told = told.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
            if begin:
                told = told.where(F.col("ts") >= F.lit(begin.replace(tzinfo=dt.timezone.utc)))
            if end:
                told = told.where(F.col("ts") <= F.lit(end.replace(tzinfo=dt.timezone.utc)))
            found = t.read(box, begin, end)
            assert sorted(map(tuple, found.select(told.columns).collect())) == sorted(map(tuple, told.collect())), (box, begin, end)
        if not compacted:
            before = t.read(BOX, BEGIN, END)
            n = before.count()
            t.compact()
            assert before.count() == n and t.files()[1] >= 20  # readers may still be at the files of before


def test_a_placed_table_without_rows(spark, tmp_path):
    t = PlacedTable(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.compact() == 0 and t.append(spark.createDataFrame([], POINTS)) == 0
    assert t.read(BOX, BEGIN, END).collect() == [] and t.read().columns == ["obj_id", "ts", "lon", "lat"]
    with pytest.raises(ValueError):
        Curve((1.0, 0.0, 1.0, 2.0))
    assert millis_of(dt.datetime(1970, 1, 1, 0, 0, 1)) == 1000


def test_store_and_find_by_command(spark, city, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    city.write.parquet(f"{tmp_path}/p")
    cli.main(["store-points", "--points", f"{tmp_path}/p", "--store", f"{tmp_path}/s", "--box", "144", "-38.5", "146", "-37", "--file-rows", "500", "--compact"])
    cli.main(["find-points", "--store", f"{tmp_path}/s", "--out", f"{tmp_path}/f", "--box", *map(str, BOX), "--begin", "2024-01-09T07:00:00", "--end", "2024-01-09T08:00:00"])
    said = capsys.readouterr().out
    assert f"find-points: {spark.read.parquet(f'{tmp_path}/f').count()} rows from" in said and "store-points: 20053 rows" in said


def test_boxes_of_all_sizes_meet_their_points(spark):
    draw = random.Random(3)
    points = [(k, draw.choice([draw.uniform(-50, 50), float(draw.randrange(-8, 8))]), draw.uniform(-50, 50)) for k in range(800)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 0.0, 0.0)]
    boxes = []
    for k in range(200):
        x, y, w, h = draw.uniform(-50, 50), draw.uniform(-50, 50), 10 ** draw.uniform(-9, 2), 10 ** draw.uniform(-9, 2)
        boxes.append((k, x, x + w, y, y + h))
    boxes += [(300, 0.0, 0.0, 0.0, 0.0), (301, None, 1.0, 0.0, 1.0), (302, 1.0, 0.0, 0.0, 1.0), (303, float("nan"), float("nan"), 0.0, 1.0), (304, -4.0, 4.0, -50.0, 50.0)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    b = spark.createDataFrame(boxes, "box int, x1 double, x2 double, y1 double, y2 double")
    axes = [(F.col("x"), F.col("x1"), F.col("x2")), (F.col("y"), F.col("y1"), F.col("y2"))]
    told = {(i, c) for i, x, y in points for c, x1, x2, y1, y2 in boxes if None not in (x, x1) and x1 <= x <= x2 and y1 <= y <= y2}
    for most in (1, 4, 12):
        found = spatial.overlapping(p, b, axes, most).select("id", "box").collect()
        assert sorted(map(tuple, found)) == sorted(told) and len(told) > 100
    assert spatial.overlapping(p, b.limit(0), axes).collect() == []


def test_a_box_takes_few_rows_whatever_its_size(spark):
    sizes = spark.range(2000).select(F.col("id").alias("cluster_id"), F.lit(144.9).alias("lon"), F.lit(-37.8).alias("lat"), F.pow(F.lit(10.0), F.col("id") % 6).alias("radius_m"), F.timestamp_seconds(F.col("id") * 3600).alias("t1"), F.timestamp_seconds(F.col("id") * 3600 + F.pow(F.lit(10.0), F.col("id") % 8)).alias("t2"))
    volumes = spark.createDataFrame([("s", utc(1970, 1, 2), 144.9, -37.8)], "site string, ts timestamp, lon double, lat double")
    found = spatial.interval_join(sizes, volumes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan
    exact = sizes.where("t1 < timestamp'1970-01-02 00:00:01' and t2 > timestamp'1970-01-01 23:59:59'").count()
    assert found.count() == exact > 0
