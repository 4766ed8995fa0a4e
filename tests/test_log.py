"""The log: offsets, restarts, batches that are repeated, pace."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.plans import cli
from wayfold.sources import files
from wayfold.sources.log import Log, LogSource, Piece, StreamReader, StreamWriter, Written
from wayfold.streaming import ticks


@pytest.fixture
def messages(spark):
    return lambda a, b: spark.createDataFrame([(f"k{k % 5}" if k % 7 else None, f"v{k}") for k in range(a, b)], "key string, value string")


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.format("wayfold-log").load(path).collect()), key=lambda r: (r[2], r[3]))


def test_messages_get_consecutive_offsets_in_the_partition_of_their_key(spark, messages, tmp_path):
    path = f"file://{tmp_path}/log"
    for a, b in ((0, 40), (40, 41), (41, 100)):
        files.write_messages(messages(a, b), path, "log", partitions="3")
    rows = rows_of(spark, path)
    assert sorted(int(v[1:]) for _, v, _, _ in rows) == list(range(100))
    by_key, by_part = {}, {}
    for key, value, part, offset in rows:
        by_key.setdefault(key, set()).add(part)
        by_part.setdefault(part, []).append(offset)
    assert all(len(p) == 1 for p in by_key.values()) and all(o == list(range(len(o))) for o in by_part.values())
    own = [int(v[1:]) for k, v, _, _ in rows if k == "k1"]
    assert [x >= 41 for x in own] == sorted(x >= 41 for x in own)
    with pytest.raises(Exception, match="only appended"):
        messages(0, 1).write.format("wayfold-log").mode("overwrite").save(path)


def test_a_restart_reads_each_message_once(spark, messages, tmp_path):
    path, seen = f"{tmp_path}/log", []
    spark.dataSource.register(LogSource)

    def read_on():
        stream = spark.readStream.format("wayfold-log").load(path)
        stream.writeStream.foreachBatch(lambda df, k: seen.append((k, sorted(int(r.value[1:]) for r in df.collect())))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    files.write_messages(messages(0, 10), path, "log")
    files.write_messages(messages(10, 12), path, "log")
    read_on()
    read_on()  # nothing new
    files.write_messages(messages(12, 30), path, "log")
    read_on()
    assert seen == [(0, list(range(12))), (1, list(range(12, 30)))]


def test_a_batch_that_fails_is_read_again_and_written_once(spark, messages, tmp_path):
    path, target = f"{tmp_path}/log", f"{tmp_path}/copy"
    files.write_messages(messages(0, 20), path, "log")
    spark.dataSource.register(LogSource)
    store, failed = files.KeyedTable(spark, f"{tmp_path}/store", "key string, value string", key="value", part="left(value, 2)"), []

    def once_failing(df, batch):
        store.upsert(df.select("key", "value"))
        if not failed:
            failed.append(batch)
            raise RuntimeError("after the write")

    start = lambda: spark.readStream.format("wayfold-log").load(path).writeStream.foreachBatch(once_failing).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="after the write"):
        start().awaitTermination()
    start().awaitTermination()
    assert failed == [0] and sorted(r.value for r in store.read().collect()) == sorted(f"v{k}" for k in range(20))

    writer, log = StreamWriter(target, {"producer": "p"}), Log(target)  # a streaming writer's batch that is committed again
    rows = [r.asDict() for r in messages(0, 6).collect()]
    for batch in (0, 0, 1, 1):
        writer.commit([writer.write(iter(rows)), None, Written()], batch)
    assert log.head() == 2 and len(rows_of(spark, target)) == 12 and len(os.listdir(f"{target}/data")) == sum(len(log.commit(n)["files"]) for n in (1, 2))
    lost = writer.write(iter(rows))
    writer.abort([lost, None], 2)
    assert len(os.listdir(f"{target}/data")) == sum(len(log.commit(n)["files"]) for n in (1, 2))


def test_readers_take_so_many_commits_at_once_and_go_on_there(messages, tmp_path):
    path = f"{tmp_path}/log"
    log = Log(path)
    assert log.head() == 0 and log.commit(0)["files"] == []
    for k in range(23):
        log.add([(k % 2, f"data/{k}", 10)])
        assert log.head() == k + 1 == log.head(k // 2)
    reader, at, read = StreamReader(path, {"perTrigger": "5", "group": "g"}), 0, []
    offset = reader.initialOffset()
    while (end := reader.latestOffset()) != offset:
        read.append(end["commit"] - offset["commit"])
        assert reader.partitions(offset, end)[0] == Piece(f"data/{offset['commit']}", offset["commit"] % 2, offset["commit"] // 2 * 10)
        reader.commit(end)
        offset = end
        if end["commit"] == 10:  # restarted
            reader = StreamReader(path, {"perTrigger": "5", "group": "g"})
    assert read == [5, 5, 5, 5, 3]
    assert StreamReader(path, {"startingOffsets": "latest"}).initialOffset() == {"commit": 23}


def test_replay_at_a_pace_and_clusters_from_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    draw = random.Random(1)
    (tmp_path / "in").mkdir()
    for k in range(3):
        lines = [json.dumps({"value": {"id_str": str(100 * k + j), "text": "x"}} if j % 2 else {"id_str": str(100 * k + j), "coordinates": {"type": "Point", "coordinates": [144.9 + draw.gauss(0, 1e-4), -37.8]}, "created_at": "Sat Sep 06 03:26:27 +0000 2014"}) for j in range(20)]
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
    q = ticks.replay(spark, f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/ck", seconds=0.2)
    q.processAllAvailable()
    q.stop()
    cli.main(["replay", "--folder", f"{tmp_path}/in", "--target", f"{tmp_path}/log", "--checkpoint", f"{tmp_path}/ck", "--seconds", "0"])  # nothing is sent twice
    assert Log(f"{tmp_path}/log").head() == 3
    sent = spark.read.format("wayfold-log").load(f"{tmp_path}/log")
    assert sent.count() == 60 == sent.select("key").distinct().count()
    cli.main(["cluster-stream", "--source", f"{tmp_path}/log", "--format", "log", "--store", f"{tmp_path}/store", "--checkpoint", f"{tmp_path}/ck2"])
    found = ticks.ClusterStore(spark, f"{tmp_path}/store").read()
    assert found.count() == 30 and found.select("cluster_id").distinct().count() == 1
    assert sent.where(F.col("offset") >= 0).count() == 60
