"""Edge cases of the functions, joins, baselines, clusters and streams."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geofn, textfn, timefn
from wayfold.operators import aggregate, anomaly, cluster, spatial
from wayfold.operators.graph import connected_components
from wayfold.params import Density
from wayfold.plans import apps, cli
from wayfold.sources import files
from wayfold.streaming import ticks


def utc(*a):
    return dt.datetime(*a, tzinfo=dt.timezone.utc)


def values(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("x")).first().x


def test_parameters():
    by = Density()
    assert by.epsilon == pytest.approx(0.0032161683852749)
    assert by.horizon_ms == 3_394_114


def test_times_on_days_when_the_clock_changes(spark):
    rows = [(utc(2017, 9, 30, 15, 59),), (utc(2017, 9, 30, 16, 0),), (utc(2017, 4, 1, 15, 30),), (utc(2017, 4, 1, 16, 30),), (utc(2014, 9, 6, 3, 26, 27),)]
    ts = F.col("ts")
    df = spark.createDataFrame(rows, "ts timestamp").select(timefn.time_of_day(ts).alias("tod"), timefn.second_of_day(ts).alias("s"), timefn.day_of_week(ts).alias("d"), timefn.zoned_hour(ts).alias("z"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("01:59:00", 7140, "Sun", "01 AEST") and got[1] == ("03:00:00", 10800, "Sun", "03 AEDT")
    assert got[2][3] == "02 AEDT" and got[3][3] == "02 AEST"
    assert got[4] == ("13:26:27", 48387, "Sat", "13 AEST")


def test_message_round_trip(spark, tmp_path):
    message = {"id_str": "1", "text": "Beautiful day :)", "coordinates": {"type": "Point", "coordinates": [144.97, -37.8]}, "created_at": "Sat Sep 06 03:26:27 +0000 2014", "user": {"screen_name": "a"}, "lang": "en"}
    path = tmp_path / "m.json"
    path.write_text("\n".join(json.dumps({"value": v}) for v in (message, message | {"coordinates": None}, message | {"id_str": None})) + "\n{broken\n")
    got = apps.ingest_points(spark, str(path), grader=lambda s: F.when(s.contains("Beautiful"), 4).otherwise(2)).collect()
    assert len(got) == 1 and got[0].obj_id == "tweet-1" and (got[0].lon, got[0].lat) == (144.97, -37.8)
    assert got[0].tokens == ["beautiful", "day"] and got[0].sentiment == 1 and (got[0].day_of_week, got[0].sec_of_day) == ("Sat", 48387)


def test_text_without_sentences(spark):
    assert values(spark, textfn.text_sentiment(F.col("t"), lambda s: F.lit(4)), t="") == -1
    assert values(spark, textfn.longest_sentence(F.col("t")), t="One two. Abc def! x") == "One two."


def test_sentences_keep_the_digits_at_their_ends(spark):
    text = "0 zero 0.  1 one 1!\n\n 22 two two 2 \n33"
    assert values(spark, textfn.sentences(F.col("t")), t=text) == ["0 zero 0.", "1 one 1!", "22 two two 2", "33"]
    assert values(spark, textfn.longest_sentence(F.col("t")), t=text) == "22 two two 2"


@pytest.mark.parametrize("cells,clean", [(["1", '"2"', "", "x", "-5", "+4", " 7", "3.5"], ["1", "2", "0", "0", "0", "0", "0", "0"]), (["", "-1", "a"], None)])
def test_clean_counts(spark, cells, clean):
    assert values(spark, textfn.clean_counts(F.col("c")), c=cells) == clean


def test_volumes_from_csv(spark, tmp_path):
    head = ["SITE", "DAY", "DETECTOR", *[f"V{k:02d}" for k in range(96)], "A", "B", "C", "D"]
    row = lambda site, day, counts: ",".join([site, f"{day} 00:00:00", "1", *counts, "0", "0", "0", "0"])
    (tmp_path / "v.csv").write_text("\n".join([",".join(head), row("10", "2017-10-01", [str(k) for k in range(96)]), row("11", "2017-07-01", ["x"] * 96), row("99", "2017-07-01", ["1"] * 96)]))
    (tmp_path / "l.csv").write_text("SITE,a,b,LOCATION,DETECTOR,GENERAL,LANE,LANE_MVT,LOC_MVT,FLOW\n10,,,here,1,g,2,L,T,f1\n10,,,there,1,g,2,L,T,f1\n")
    (tmp_path / "p.csv").write_text('WKT,SITE_NO\n"POINT (144.9 -37.8)",10\n"POINT (144.9 -37.8)",11\n')
    (tmp_path / "r.csv").write_text('WKT,hfidl,hfidr\n"LINESTRING (144.9 -37.8, 144.91 -37.8)",f1,f2\n')
    got = apps.ingest_volumes(spark, *[str(tmp_path / f"{x}.csv") for x in "vlpr"]).orderBy("interval_ts").collect()
    assert len(got) == 96 and {r.site for r in got} == {"10"} and [r.volume for r in got] == list(range(96))
    assert got[0].interval_ts == dt.datetime(2017, 9, 30, 14, 0) and got[95].interval_ts - got[0].interval_ts == dt.timedelta(minutes=95 * 15)
    assert got[0].location == "here" and len(got[0].road) == 1


def test_wkt(spark):
    got = values(spark, geofn.segments(F.col("w")), w="MULTILINESTRING ((1 2, 3 4,5 6),(7 8, -9.5 1e1))")
    assert [tuple(s) for s in got] == [(1, 2, 3, 4), (3, 4, 5, 6), (7, 8, -9.5, 10)]
    assert values(spark, geofn.segments(F.col("w")), w="POINT (1 2)") is None
    assert values(spark, geofn.point_lat(F.col("w")), w="point(1 -2.5)") == -2.5


def test_statistics_of_one_observation(spark):
    r = aggregate.statistics(spark.createDataFrame([("a", 5), ("b", 1), ("b", 3)], "k string, volume int"), ["k"]).orderBy("k").collect()
    assert r[0].deviation == 0 and r[1].deviation == pytest.approx(2**0.5)


def test_statistics_of_parts_are_those_of_all(spark):
    draw = random.Random(5)
    rows = [(draw.choice("abc"), draw.randrange(9), 1e9 + draw.gauss(0, 1)) for _ in range(400)] + [("one", 1, 5.0), ("none", 1, None), ("one", 2, None)]
    df = spark.createDataFrame(rows, "k string, day int, volume double")
    got = {r.k: r for r in aggregate.merged_statistics(aggregate.partial_statistics(df, ["k", "day"]), ["k"]).collect()}
    for r in aggregate.statistics(df, ["k"]).collect():
        own = got.pop(r.k)
        assert (own.n, own.low, own.high) == (r.n, r.low, r.high) and own.deviation == pytest.approx(r.deviation, rel=1e-6) and own.average == (r.average if r.average is None else pytest.approx(r.average))
    assert not got


def test_counts_near_a_place_need_no_pairs(spark):
    draw = random.Random(6)
    at = [(144.9 + draw.gauss(0, 0.01), -37.8 + draw.gauss(0, 0.01)) for _ in range(8)]
    left = [(k, utc(2024, 1, 1) + dt.timedelta(minutes=15 * draw.randrange(40)), *draw.choice(at)) for k in range(120)] + [(900, None, *at[0]), (901, utc(2024, 1, 1), None, None), (902, utc(1969, 12, 31, 23, 59), *at[0])]
    right = [(utc(2024, 1, 1) + dt.timedelta(minutes=draw.choice([15 * draw.randrange(40), draw.uniform(0, 600)])), 144.9 + draw.gauss(0, 0.012), -37.8 + draw.gauss(0, 0.012)) for _ in range(600)] + [(utc(1969, 12, 31, 23, 50), *at[0]), (None, *at[0]), (utc(2024, 1, 1), None, None)]
    a, b = spark.createDataFrame(left, "id int, ts timestamp, lon double, lat double"), spark.createDataFrame(right, "ts timestamp, lon double, lat double")
    for seconds in (None, 1800.0):
        told = {k: sum(x is not None and x2 is not None and ((x - x2) ** 2 + (y - y2) ** 2) ** 0.5 * geofn.METRES <= 900 and (seconds is None or None not in (t, t2) and abs((t - t2).total_seconds()) < seconds) for t2, x2, y2 in right) for k, t, x, y in left}
        found = spatial.count_within(a, b, ["id"], 900.0, seconds).collect()
        assert {r.id: r.near for r in found} == told and len(found) == len(left) and sum(told.values()) > 500


@pytest.mark.parametrize("values_of_hours", [(0, 3, 3, 3), (3, 0, 3, 3), (3, 3, 3, 0), (7, 1, 1, 1), (6, 5, 6, 6)])
def test_a_value_on_the_bound_is_not_abnormal(spark, values_of_hours):
    odd = next(v for v in values_of_hours if values_of_hours.count(v) == 1)
    average = sum(values_of_hours) / 4
    for deviation in (abs(average - odd) / 1.5, abs(average - odd) / 1.5 - 2e-16, abs(average - odd) / 1.5 + 2e-16):  # as orders of adding round it
        assert not values(spark, anomaly.beyond(F.lit(odd), F.lit(average), F.lit(deviation), 1.5), a=1)
    assert values(spark, anomaly.beyond(F.lit(odd), F.lit(average), F.lit(deviation * (1 - 1e-9)), 1.5), a=1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_never_sent_to_every_task(spark, monkeypatch, tmp_path):
    draw = random.Random(6)
    points = spark.createDataFrame([(f"p{k}", *(draw.uniform(0, 3) for _ in "xyz")) for k in range(60)], "obj_id string, x double, y double, z double")
    points.write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))  # Spark knows how small the files are
    pairs = spatial.neighbours(points, 1.0)
    assert "Broadcast" not in plan_of(pairs)
    rows = points.collect()
    assert sorted(map(tuple, pairs.collect())) == sorted((a.obj_id, b.obj_id) for a in rows for b in rows if a != b and math.dist(a[1:], b[1:]) < 1)
    boxes = points.select(F.col("obj_id").alias("cell"), *[(F.col(c) + d).alias(f"{c}{k}") for c in "xyz" for k, d in ((1, -0.5), (2, 0.5))])
    few = spatial.in_boxes(points, boxes)
    monkeypatch.setattr(spatial, "FEW_BOXES", 10)
    many = spatial.in_boxes(points, boxes)
    assert "BuildRight" in plan_of(few) and "Broadcast" not in plan_of(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() > 60


def test_exactly_two_deviations_is_normal(spark):
    x = [values(spark, anomaly.beyond(F.lit(v), F.lit(10.0), F.lit(2.0)), a=1) for v in (14.0, 14.1, 6.0, 5.9)]
    assert x == [False, True, False, True]


def test_join_radius_bins_and_segments(spark):
    d = 1000 / geofn.METRES
    left = spark.createDataFrame([("on", 10 + d, 0.0), ("off", 10 + d * 1.001, 0.0), ("west", 10 - d * 0.99, 0.0), ("south", 10.0, -d * 0.5)], "obj_id string, lon double, lat double")
    got = spatial.within(left, spark.createDataFrame([("s", 10.0, 0.0)], "site string, lon double, lat double"), 1000.000001).select("l_obj_id").collect()
    assert {r[0] for r in got} == {"on", "west", "south"}
    lines = spark.createDataFrame([(10.0, 0.0, 10.0, 0.0), (20.0, 0.0, 20.0 + 40 * d, 0.0)], "lon1 double, lat1 double, lon2 double, lat2 double")
    points = spark.createDataFrame([("dot", 10.0, d * 0.5), ("side", 20 + 17 * d, d * 0.9), ("far", 20 + 17 * d, d * 1.1), ("past", 20 + 40.5 * d, 0.0), ("beyond", 20 + 41.5 * d, 0.0)], "obj_id string, lon double, lat double")
    assert {r.obj_id for r in spatial.near_segment(points, lines, 1000.0).where("on_street").collect()} == {"dot", "side", "past"}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (7, 7), (9, 8), (None, 1)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(2, 1), (3, 1), (4, 1), (9, 8)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(8)
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def blobs(n, seed):
    rng = random.Random(seed)
    at = [(rng.uniform(0, 0.05), rng.uniform(0, 0.05), rng.randrange(0, 6)) for _ in range(12)]
    out = []
    for k in range(n):
        x, y, t = rng.choice(at)
        out.append((f"p{k:04d}", utc(2024, 1, 1) + dt.timedelta(minutes=t * 40 + rng.uniform(0, 30)), 144.9 + x + rng.gauss(0, 0.001), -37.8 + y + rng.gauss(0, 0.001)))
    return out


def expected_clusters(rows, by):
    xyz = [(lon, lat, t.timestamp() * 1000 // 1 * by.depth_per_ms) for _, t, lon, lat in rows]
    near = [[j for j, b in enumerate(xyz) if j != i and sum((p - q) ** 2 for p, q in zip(a, b)) ** 0.5 < by.epsilon] for i, a in enumerate(xyz)]
    core = {i for i, n in enumerate(near) if len(n) > by.min_points}
    label = {}
    for i in sorted(core, key=lambda k: rows[k][0]):
        stack = [i] if i not in label else []
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = rows[i][0]
                stack += [k for k in near[j] if k in core]
    for i, n in enumerate(near):
        if i not in core and (own := [label[j] for j in n if j in core]):
            label[i] = min(own)
    return {rows[i][0]: (c, "CORE" if i in core else "BORDER") for i, c in label.items()}


def labels_of(df):
    return {r.obj_id: (r.cluster_id, r.cluster_label) for r in df.collect() if r.cluster_id is not None}


POINTS = "obj_id string, ts timestamp, lon double, lat double"


def test_clusters_equal_the_definition_in_any_order(spark):
    rows = blobs(250, 3)
    expected = expected_clusters(rows, Density())
    assert len({c for c, _ in expected.values()}) > 3
    assert labels_of(cluster.cluster_points(spark.createDataFrame(rows, POINTS))) == expected
    assert labels_of(cluster.cluster_points(spark.createDataFrame(rows[::-1], POINTS).repartition(5))) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_crowds_are_linked_as_their_points_are(spark, seed):
    rng, by = random.Random(seed), Density()
    rows, at = [], 144.9
    for crowd in range(9):  # about epsilon apart, some linked and some not, each over a few fine cells
        for k in range(45):
            rows.append((f"p{crowd}_{k:02d}", utc(2024, 1, 1) + dt.timedelta(seconds=rng.uniform(0, 200)), at + rng.uniform(0, 0.2) * by.epsilon, -37.8 + rng.uniform(0, 0.2) * by.epsilon))
        at += by.epsilon * rng.choice([0.5, 1.1, 1.17, 1.2, 1.24])
    rows += [(f"q{k}", utc(2024, 1, 1), 144.9 + rng.uniform(-1, 10) * by.epsilon, -37.8 + rng.uniform(1, 3) * by.epsilon) for k in range(40)]
    expected = expected_clusters(rows, by)
    assert len({c for c, _ in expected.values()}) > 2
    assert labels_of(cluster.cluster_points(spark.createDataFrame(rows, POINTS).repartition(4))) == expected


def test_many_points_in_one_place_are_not_paired(spark):
    n, by = 100_000, Density()
    spot = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("obj_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 60).alias("ts"), (F.lit(144.9) + (F.col("id") % 1000) * F.lit(1e-7)).alias("lon"), F.lit(-37.8).alias("lat"))
    graph = cluster.core_graph(spot, by)
    assert graph.core.count() == n and graph.links.count() < 100
    found = cluster.cluster_points(spot)
    assert found.where("cluster_label = 'CORE' and cluster_id = 'p0'").count() == n


def test_increments_equal_one_batch(spark, tmp_path):
    rows = blobs(200, 4)
    order = rows[:]
    random.Random(1).shuffle(order)
    store = ticks.ClusterStore(spark, str(tmp_path / "s"))
    for k in range(3):
        part = spark.createDataFrame(order[k::3], POINTS)
        ticks.tick(part, store, Density())
        ticks.tick(part, store, Density())  # the same batch again changes nothing
    assert ticks.tick(spark.createDataFrame([], POINTS), store, Density()) == 0
    assert labels_of(store.read()) == expected_clusters(rows, Density())
    assert store.read().count() == len(rows)


def test_a_new_checkpoint_over_an_old_store_drops_no_tick(spark, tmp_path):
    rows = blobs(150, 7)
    for k in range(3):  # each run numbers its ticks anew
        spark.createDataFrame(rows[k::3], POINTS).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        points = spark.readStream.schema(POINTS).parquet(str(tmp_path / f"in{k}"))
        ticks.cluster_stream(points, ticks.ClusterStore(spark, str(tmp_path / "store")), str(tmp_path / f"ck{k}")).awaitTermination()
    found = ticks.ClusterStore(spark, str(tmp_path / "store")).read()
    assert found.count() == len(rows) and labels_of(found) == expected_clusters(rows, Density())


def test_merged_clusters_are_relabelled_on_far_days_which_are_not_read_or_written(spark, tmp_path, monkeypatch):
    begin = utc(2024, 1, 10)
    chain = [(f"p{k:04d}", begin + dt.timedelta(minutes=10 * k), 144.9, -37.8) for k in range(6 * 24 * 4)]
    late = chain[300:306]
    far_off = [(f"q{k}", begin + dt.timedelta(days=30, minutes=10 * k), 144.9, -37.8) for k in range(6)]
    store = ticks.ClusterStore(spark, str(tmp_path / "s"))
    ticks.tick(spark.createDataFrame([r for r in chain if r not in late] + far_off, POINTS), store, Density())
    before = store.points.parts()
    asked, read = [], store.points.read
    monkeypatch.setattr(store.points, "read", lambda only=None: asked.append(only) or read(only))
    ticks.tick(spark.createDataFrame(late, POINTS), store, Density())
    assert asked == [{"2024-01-12"}]
    assert {day for day, folder in store.points.parts().items() if before[day] != folder} <= asked[0]
    monkeypatch.undo()
    assert labels_of(store.read()) == expected_clusters(chain + far_off, Density())
    assert {tuple(r) for r in store.aliases.read().collect()} == {("p0308", "p0002")}


def test_aliases_lead_to_the_id_of_now_after_many_merges(spark, tmp_path):
    store = ticks.ClusterStore(spark, str(tmp_path / "s"))
    for was, now in (("d", "c"), ("c", "b"), ("z", "y"), ("b", "a")):
        store.merge(spark.createDataFrame([(was, now)], "cluster_id string, now string"))
    assert {tuple(r) for r in store.aliases.read().collect()} == {("d", "a"), ("c", "a"), ("b", "a"), ("z", "y")}


def test_a_tick_that_fails_between_its_two_writes_is_made_good_by_its_repetition(spark, tmp_path, monkeypatch):
    rows = [(f"p{k:04d}", utc(2024, 1, 10) + dt.timedelta(minutes=10 * k), 144.9, -37.8) for k in range(6 * 24 * 2)]
    late = rows[150:156]
    store = ticks.ClusterStore(spark, str(tmp_path / "s"))
    ticks.tick(spark.createDataFrame([r for r in rows if r not in late], POINTS), store, Density())
    before, replace = labels_of(store.read()), store.points.snapshot.replace
    monkeypatch.setattr(store.points.snapshot, "replace", lambda said: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ticks.tick(spark.createDataFrame(late, POINTS), store, Density())
    assert labels_of(store.read()).keys() == before.keys()  # no point is lost, none comes twice
    monkeypatch.setattr(store.points.snapshot, "replace", replace)
    ticks.tick(spark.createDataFrame(late, POINTS), store, Density())
    assert labels_of(store.read()) == expected_clusters(rows, Density())


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    assert files.save_counted(spark.range(1234).repartition(3), str(tmp_path / "n")) == 1234


def test_message_stream(spark, tmp_path):
    rows = blobs(120, 5)
    (tmp_path / "in").mkdir()
    for k in range(2):
        lines = [json.dumps({"id_str": i[1:], "coordinates": {"type": "Point", "coordinates": [lon, lat]}, "created_at": t.strftime("%a %b %d %H:%M:%S +0000 %Y")}) for i, t, lon, lat in rows[k::2]]
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join([*lines, "{broken"]))
    ticks.cluster_messages(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), maxFilesPerTrigger="1").awaitTermination()
    whole = [(f"tweet-{i[1:]}", t.replace(microsecond=0), lon, lat) for i, t, lon, lat in rows]
    assert labels_of(ticks.ClusterStore(spark, str(tmp_path / "store")).read()) == expected_clusters(whole, Density())


def test_merge_is_transitive(spark):
    links = spark.createDataFrame([("1", "2"), ("3", "4"), ("2", "3")], "a string, b string")
    labels = spark.createDataFrame([("x", "4"), ("y", "9")], "obj_id string, cluster_id string")
    assert {tuple(r) for r in cluster.merged_labels(links, labels).collect()} == {("x", "1"), ("y", "9")}


def test_keyed_table(spark, tmp_path):
    t = files.KeyedTable(spark, str(tmp_path / "k"), "obj_id string, v int", part="left(obj_id, 1)")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], t.schema))
    assert t.upsert(spark.createDataFrame([("b", 2), ("c", 2)], t.schema)) == 2
    assert {tuple(r) for r in t.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {k: v.split("/")[-2] for k, v in t.parts().items()} == {"a": "v=0", "b": "v=1", "c": "v=1"}  # untouched parts aren't written again
    for k in range(2, 5):
        t.upsert(spark.createDataFrame([("b", k)], t.schema))
    assert {tuple(r) for r in t.read(["b"]).collect()} == {("b", 4)}


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    spark.createDataFrame(blobs(100, 6), POINTS).write.parquet(str(tmp_path / "p"))
    cli.main(["cluster", "--points", str(tmp_path / "p"), "--out", str(tmp_path / "c"), "--overwrite"])
    cli.main(["clustered-by-hour", "--points", str(tmp_path / "c"), "--out", str(tmp_path / "h")])
    found = spark.read.parquet(str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "h")).agg(F.sum("cnt")).first()[0] == found.where("cluster_id is not null").count()


def test_command_line_reports(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame(blobs(100, 6), POINTS).write.parquet(at("p"))
    cli.main(["cluster", "--points", at("p"), "--out", at("c"), "--min-pts", "2", "--km", "0.3", "--minutes", "30"])
    cli.main(["summarise-clusters", "--points", at("c"), "--out", at("s")])
    cli.main(["cells", "--points", at("p"), "--out", at("e"), "--max-pts", "10"])
    spark.createDataFrame([("1", "Mon", "08:15:00", 2.5), ("2", "Mon", "08:30:00", 4.0), ("1", "Tue", "08:15:00", 9.0)], "site string, day_of_week string, time_of_day string, average double").write.parquet(at("b"))
    cli.main(["rush-hour", "--baseline", at("b"), "--out", at("r")])
    spark.createDataFrame([("x", 2, 1), ("y", 0, 3)], "cluster_id string, abnormal long, normal long").write.parquet(at("a"))
    cli.main(["abnormal-share", "--anomalies", at("a"), "--out", at("h")])
    expected = expected_clusters(blobs(100, 6), Density(2, 0.3, 1_800_000))
    assert labels_of(spark.read.parquet(at("c"))) == expected
    assert spark.read.parquet(at("s")).agg(F.sum("size")).first()[0] == len(expected)
    assert [tuple(r) for r in spark.read.parquet(at("r")).collect()] == [("1999-12-31T21 UTC", 6.5)]  # a quarter past eight in the morning in Melbourne's summer
    assert spark.read.parquet(at("h")).first().hit == 1
    assert "cluster: 100 rows" in capsys.readouterr().out and spark.read.parquet(at("e")).count()


def test_messages_written_and_read_again(spark, tmp_path):
    rows = [("tweet-1", utc(2024, 1, 2, 3, 4, 5), 144.9, -37.8, "hi", "a", ["x"], 1)]
    points = spark.createDataFrame(rows, "obj_id string, ts timestamp, lon double, lat double, text string, screen_name string, tokens array<string>, sentiment int")
    files.write_messages(files.messages_of(points), str(tmp_path / "m"))
    again = files.points_of(files.parse_messages(spark.read.text(str(tmp_path / "m"))))
    assert [tuple(r) for r in again.select(points.columns).collect()] == [tuple(r) for r in points.collect()]
