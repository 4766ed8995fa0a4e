"""Queries over the test tables, one for each operator, with the SQL that says the same.

Points come from `events`, sites from `nation`, volumes from `events`, streets
from consecutive sites; see the views below, which both sides derive alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geofn, grader, textfn, timefn
from wayfold.operators import aggregate, anomaly, cluster, filters, spatial
from wayfold.params import Density
from wayfold.plans import apps
from wayfold.sources.files import KeyedTable, messages_of, parse_messages, points_of, to_long, write_messages
from wayfold.sources.placed import Curve, PlacedTable
from wayfold.sources.shared import shared_dir
from wayfold.streaming.ticks import ClusterStore, cluster_stream, message_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Query parameters, the same on both sides.
START, END = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
BOX = (144.9002, -37.8497, 145.05, -37.76)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: obj_id, ts, lon, lat."""
    e = table(spark, sf_dir, "events")
    place = F.floor(F.col("user_id") / 50)
    return e.select(
        F.concat(F.lit("tweet-"), F.col("event_id").cast("string")).alias("obj_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(144.90) + place * F.lit(0.02) + (F.col("event_id") % 7) * F.lit(0.0001)).alias("lon"),
        (F.lit(-37.85) + place * F.lit(0.01) + (F.col("event_id") % 11) * F.lit(0.0001)).alias("lat"),
        "event_id", "user_id", "event_type", "value", "props",
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("site"), (F.lit(144.90) + (F.col("n_nationkey") % 5) * F.lit(0.01)).alias("lon"), (F.lit(-37.85) + F.floor(F.col("n_nationkey") / 5) * F.lit(0.005)).alias("lat"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, detector, interval_ts, volume."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 25).cast("string").alias("site"), F.col("event_type").alias("detector"), timefn.slot_start(F.col("ts").cast("timestamp")).alias("interval_ts"), F.round("value").cast("int").alias("volume"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sites(spark, sf_dir).withColumn("k", F.col("site").cast("int"))
    after = n.select((F.col("k") - 1).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return n.join(after, "k").select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")


#: The same views for the SQL side.
VIEWS = {
    "pv": """pv AS (SELECT 'tweet-' || event_id AS obj_id, ts, 144.90::DOUBLE + (user_id // 50) * 0.02::DOUBLE + (event_id % 7) * 0.0001::DOUBLE AS lon,
        -37.85::DOUBLE + (user_id // 50) * 0.01::DOUBLE + (event_id % 11) * 0.0001::DOUBLE AS lat, event_id, user_id, event_type, value, props FROM events)""",
    "sites": """sites AS (SELECT n_nationkey::VARCHAR AS site, 144.90::DOUBLE + (n_nationkey % 5) * 0.01::DOUBLE AS lon, -37.85::DOUBLE + (n_nationkey // 5) * 0.005::DOUBLE AS lat FROM nation)""",
    "volumes": """volumes AS (SELECT (user_id % 25)::VARCHAR AS site, event_type AS detector, time_bucket(INTERVAL 15 MINUTE, ts) AS interval_ts, round(value)::INT AS volume FROM events)""",
    "streets": """streets AS (SELECT a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM sites a JOIN sites b ON b.site::INT = a.site::INT + 1)""",
    "local": """local AS (SELECT *, (interval_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' AS lt FROM summed)""",
    "summed": """summed AS (SELECT site, interval_ts, sum(volume)::BIGINT AS volume, CASE WHEN count(DISTINCT detector) > 1 THEN 'all' ELSE min(detector) END AS detector FROM volumes GROUP BY ALL)""",
}
BASE = """base AS (SELECT site, strftime(lt, '%a') AS dow, strftime(lt, '%H:%M:%S') AS tod, avg(volume) AS average, count(*) AS n, coalesce(stddev_samp(volume), 0) AS deviation, min(volume)::DOUBLE AS low, max(volume)::DOUBLE AS high FROM local GROUP BY ALL)"""


def views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(VIEWS.get(n, n) for n in names) + "\n"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def millis(c: str = "ts") -> Column:
    return timefn.millis(F.col(c))


# --- filters -------------------------------------------------------------------------------------------------


@query("during_filter", f"SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE ts > TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'")
def during_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(filters.during(F.col("ts"), F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz"))).select("event_id", millis().alias("ms"))


@query("before_after_filter", f"SELECT event_id, ts < TIMESTAMP '{START}' AS early FROM events WHERE ts < TIMESTAMP '{START}' OR ts > TIMESTAMP '{END}'")
def before_after_filter(spark, sf_dir):
    ts = F.col("ts")
    early, late = filters.before(ts, F.lit(START).cast("timestamp_ntz")), filters.after(ts, F.lit(END).cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").where(early | late).select("event_id", early.alias("early"))


@query("bbox_filter", views("pv") + f"SELECT obj_id, lon, lat FROM pv WHERE lon BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND lat BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE")
def bbox_filter(spark, sf_dir):
    return pv(spark, sf_dir).where(geofn.box_contains(F.col("lon"), F.col("lat"), *BOX)).select("obj_id", "lon", "lat")


#: A box within the city and a day and a half, for scans by place and time.
NEAR, FROM, TO = (144.9002, -37.8497, 144.9405, -37.8296), "2024-01-09 06:00:00", "2024-01-10 18:30:00"


@query("place_time_scan", views("pv") + f"SELECT obj_id, (epoch_us(ts) // 1000) AS ms, lon, lat FROM pv WHERE lon BETWEEN {NEAR[0]}::DOUBLE AND {NEAR[2]}::DOUBLE AND lat BETWEEN {NEAR[1]}::DOUBLE AND {NEAR[3]}::DOUBLE AND ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def place_time_scan(spark, sf_dir):
    """Points written in an order of place and time, and a box and a span read from the files that meet them."""
    stored = PlacedTable(spark, f"{shared_dir(spark)}/placed-{uuid.uuid4().hex}", Curve((144.0, -38.5, 146.0, -37.0)), file_rows=2000)
    stored.append(pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat"))
    return stored.read(NEAR, datetime.fromisoformat(FROM), datetime.fromisoformat(TO)).select("obj_id", millis().alias("ms"), "lon", "lat")


@query("not_null_filter", "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
def not_null_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(filters.filled(F.col("lang")) & F.col("text").isNotNull()).select("doc_id", "lang")


@query("key_disjunction", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)")
def key_disjunction(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey")
    return filters.any_of(table(spark, sf_dir, "events"), "user_id", keys).select("event_id", "user_id")


@query("id_prefix", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tweet-' || event_id END AS obj_id FROM events")
def id_prefix(spark, sf_dir):
    fid = F.concat(F.when(F.col("event_id") % 3 == 0, "tweet-").otherwise("cluster-"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", textfn.id_of(fid).alias("obj_id"))


# --- scalar functions ----------------------------------------------------------------------------------------


@query("time_parts", """SELECT event_id, strftime(lt, '%a') AS dow, strftime(lt, '%H:%M:%S') AS tod, strftime(lt, '%H:00:00') AS hour, (hour(lt) * 3600 + minute(lt) * 60 + second(lt))::BIGINT AS sec_of_day,
    strftime(lt, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H UTC') AS utc_hour, strftime(lt, '%H ') || CASE WHEN epoch(lt) - epoch(ts) = 39600 THEN 'AEDT' ELSE 'AEST' END AS zoned_hour
    FROM (SELECT event_id, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' AS lt FROM events)""")  # fmt: skip
def time_parts(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", timefn.day_of_week(ts).alias("dow"), timefn.time_of_day(ts).alias("tod"), timefn.hour_of_day(ts).alias("hour"), timefn.second_of_day(ts).alias("sec_of_day"),
        timefn.local_date(ts).cast("string").alias("day"), timefn.utc_hour(ts).alias("utc_hour"), timefn.zoned_hour(ts).alias("zoned_hour"),
    )


@query("message_time", "SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS said, (epoch_us(date_trunc('second', ts)) // 1000) AS ms FROM events")
def message_time(spark, sf_dir):
    said = timefn.format_message_time(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", said.alias("said"), timefn.millis(timefn.parse_message_time(said)).alias("ms"))


@query("weekday_calendar", """WITH days AS (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM events), seen AS (SELECT ts::DATE AS d, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d, '%a') AS dow, coalesce(n, 0) AS n FROM days LEFT JOIN seen USING (d) WHERE strftime(d, '%a') = 'Mon'""")
def weekday_calendar(spark, sf_dir):
    """The Mondays from the first to the last day of events, with the clicks of each."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_type")
    days = timefn.days_of(e.agg(F.min("date").alias("first"), F.max("date").alias("last")), "first", "last", "Mon")
    seen = e.where("event_type = 'click'").groupBy("date").agg(F.count("*").alias("n"))
    return days.join(seen, "date", "left").select(F.col("date").cast("string").alias("day"), F.col("day_of_week").alias("dow"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("tokens_roundtrip", """SELECT doc_id, len(list_distinct(w)) AS n_tokens, w[1] AS first_token
    FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}'']+'), lambda x: x <> '') AS w FROM documents)""")
def tokens_roundtrip(spark, sf_dir):
    tokens = F.from_json(F.to_json(textfn.lemma_set(F.col("text"))), "array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"))


@query("message_points", """WITH m AS (SELECT event_id, ts, user_id, props, value FROM events) SELECT 'tweet-' || event_id AS obj_id, (epoch_us(date_trunc('second', ts)) // 1000) AS ms, round(144.9::DOUBLE + (event_id % 100) / 1000.0::DOUBLE, 6) AS lon,
    -37.85::DOUBLE AS lat, 'u' || user_id AS screen_name FROM m WHERE event_id % 5 <> 0""")
def message_points(spark, sf_dir):
    """JSON messages built from events, parsed again; every fifth has no place, every seventh text is broken and gives nothing."""
    e = table(spark, sf_dir, "events")
    placed = F.struct(F.lit("Point").alias("type"), F.array(F.round(F.lit(144.9) + (F.col("event_id") % 100) / F.lit(1000.0), 6), F.lit(-37.85)).alias("coordinates"))
    message = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id_str"), F.lit("a text").alias("text"), timefn.format_message_time(F.col("ts").cast("timestamp")).alias("created_at"),
        F.when(F.col("event_id") % 5 != 0, placed).alias("coordinates"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name")).alias("user"),
    ))
    broken = e.where("event_id % 7 = 0").select(F.lit("{broken").alias("value"))
    return points_of(parse_messages(e.select(message.alias("value")).unionByName(broken))).select("obj_id", timefn.millis(F.col("ts")).alias("ms"), "lon", "lat", "screen_name")


@query("log_replay", """SELECT 'tweet-' || event_id AS obj_id, (epoch_us(date_trunc('second', ts)) // 1000) AS ms, round(144.9::DOUBLE + (event_id % 100) / 1000.0::DOUBLE, 6) AS lon FROM events""")
def log_replay(spark, sf_dir):
    """Points as messages in a log, in three commits, streamed from there into a keyed table by a query that is ended in between."""
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    points = e.select(F.concat(F.lit("tweet-"), F.col("event_id").cast("string")).alias("obj_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.lit(144.9) + (F.col("event_id") % 100) / F.lit(1000.0), 6).alias("lon"), F.lit(-37.85).alias("lat"), F.lit("a text").alias("text"), F.lit("a").alias("screen_name"), F.lit(None).cast("array<string>").alias("tokens"), F.lit(None).cast("int").alias("sentiment"), (F.col("event_id") % 3).alias("part"))
    store = KeyedTable(spark, f"{base}/store", "obj_id string, ts timestamp, lon double")

    def read_on() -> None:
        stream = points_of(parse_messages(message_stream(spark, f"{base}/log", "log")))
        stream.writeStream.foreachBatch(lambda df, _: store.upsert(df)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        write_messages(messages_of(points.where(F.col("part") == k)), f"{base}/log", "log")
        if k:
            read_on()
    return store.read().select("obj_id", timefn.millis(F.col("ts")).alias("ms"), "lon")


@query("csv_clean", """WITH c AS (SELECT l_orderkey, l_linenumber, [l_quantity::BIGINT::VARCHAR, '"' || l_linenumber || '"', l_shipdate::DATE::VARCHAR, '', '-5', '+4', ' 7', l_returnflag] AS cells FROM lineitem),
    b AS (SELECT l_orderkey, l_linenumber, list_transform(cells, lambda x: regexp_replace(x, '^"(.*)"$', '\\1')) AS cells FROM c)
    SELECT l_orderkey, l_linenumber, array_to_string(list_transform(cells, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x ELSE '0' END), ',') AS cleaned FROM b WHERE len(list_filter(cells, lambda x: regexp_full_match(x, '[0-9]+'))) > 0""")
def csv_clean(spark, sf_dir):
    cells = F.array(F.col("l_quantity").cast("long").cast("string"), F.concat(F.lit('"'), F.col("l_linenumber").cast("string"), F.lit('"')), F.to_date("l_shipdate").cast("string"), F.lit(""), F.lit("-5"), F.lit("+4"), F.lit(" 7"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(textfn.clean_counts(cells), ",").alias("cleaned")).where("cleaned is not null")


@query("wide_to_long", views("volumes") + """, days AS (SELECT site, detector, date_trunc('day', interval_ts) AS day, ((hour(interval_ts) * 60 + minute(interval_ts)) // 15)::INT AS slot, volume FROM volumes),
    rows AS (SELECT DISTINCT site, detector, day FROM days), s AS (SELECT site, detector, day, slot, sum(volume)::INT AS v FROM days GROUP BY ALL)
    SELECT r.site, r.detector, (epoch_us(((r.day AT TIME ZONE 'Australia/Melbourne') AT TIME ZONE 'UTC') + to_minutes((15 * k)::BIGINT)) // 1000) AS ms, coalesce(v, 0)::INT AS volume
    FROM rows r CROSS JOIN generate_series(0, 95) g(k) LEFT JOIN s ON s.site = r.site AND s.detector = r.detector AND s.day = r.day AND s.slot = g.k""")
def wide_to_long(spark, sf_dir):
    v = volumes(spark, sf_dir).withColumn("day", F.date_trunc("day", "interval_ts")).withColumn("slot", ((F.hour("interval_ts") * 60 + F.minute("interval_ts")) / 15).cast("int"))
    wide = v.groupBy("site", "detector", "day").pivot("slot", list(range(96))).agg(F.sum("volume").cast("int"))
    long = to_long(wide, ["site", "detector"], [F.col(f"`{k}`") for k in range(96)], F.date_format("day", "yyyy-MM-dd HH:mm:ss"))
    return long.select("site", "detector", timefn.millis(F.col("interval_ts")).alias("ms"), "volume")


@query("wkt_parse", views("sites", "streets") + "SELECT round(lon1, 6) AS lon1, round(lat1, 6) AS lat1, round(lon2, 6) AS lon2, round(lat2, 6) AS lat2 FROM streets")
def wkt_parse(spark, sf_dir):
    """Streets written as WKT and read again."""
    c = [F.format_string("%.6f", F.col(x)) for x in ("lon1", "lat1", "lon2", "lat2")]
    wkt = F.concat(F.lit("MULTILINESTRING (("), c[0], F.lit(" "), c[1], F.lit(", "), c[2], F.lit("  "), c[3], F.lit("))"))
    return streets(spark, sf_dir).select(F.explode(geofn.segments(wkt)).alias("s")).select(*[F.round(f"s.{x}", 6).alias(x) for x in ("lon1", "lat1", "lon2", "lat2")])


@query("wkt_point", views("sites") + "SELECT site, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sites")
def wkt_point(spark, sf_dir):
    wkt = geofn.point_text(F.col("lon"), F.col("lat"))
    return sites(spark, sf_dir).select("site", F.round(geofn.point_lon(wkt), 6).alias("lon"), F.round(geofn.point_lat(wkt), 6).alias("lat"))


@query("embed_3d", views("pv") + f"SELECT obj_id, round(lon, 6) AS x, round(lat, 6) AS y, round((epoch_us(ts) // 1000)::DOUBLE * {Density().depth_per_ms!r}::DOUBLE, 6) AS z FROM pv")
def embed_3d(spark, sf_dir):
    return cluster.embedded(pv(spark, sf_dir), Density()).select("obj_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("sentiment_map", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 2 IN (3, 4) THEN 1 WHEN l_linenumber - 2 IN (0, 1) THEN -1 ELSE 0 END AS sentiment FROM lineitem")
def sentiment_map(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", textfn.sentiment_score(F.col("l_linenumber") - 2).alias("sentiment"))


@query("longest_sentence", """WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\n+')) AS s, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\n+'), 1) AS k FROM documents),
    t AS (SELECT doc_id, trim(s, ' ') AS s, k FROM s), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, k) AS n FROM t WHERE s <> '')
    SELECT doc_id, s AS sentence FROM r WHERE n = 1""")
def longest_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textfn.longest_sentence(F.col("text")).alias("sentence")).where("sentence is not null")


@query("viete_pi", """WITH RECURSIVE r(k, root, pi) AS (SELECT 0, 0.0::DOUBLE, 2.0::DOUBLE UNION ALL SELECT k + 1, sqrt(root + 2), pi * 2 / sqrt(root + 2) FROM r WHERE k < 1600)
    SELECT s_suppkey, round(pi, 6) AS pi FROM supplier JOIN r ON k = 1 + s_suppkey % 1600""")
def viete_pi(spark, sf_dir):
    """Viete's product of as many factors as each supplier's number asks for; each factor's nested root comes from the one before."""
    steps = F.aggregate(
        F.sequence(F.lit(1), (1 + F.col("s_suppkey") % 1600).cast("int")),
        F.struct(F.lit(0.0).alias("root"), F.lit(2.0).alias("pi")),
        lambda a, _: F.struct(F.sqrt(a["root"] + 2).alias("root"), (a["pi"] * 2 / F.sqrt(a["root"] + 2)).alias("pi")),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(steps["pi"], 6).alias("pi"))


@query("text_sentiments")
def text_sentiments(spark, sf_dir):
    """Sentiment of every document by its longest sentence; the grader learns from labelled ones: toxic 0, good 4, others 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 4).otherwise(2)
    known = docs.join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    learned = grader.fit(known.select(textfn.longest_sentence(F.col("text")).alias("text"), grade.alias("grade")))
    return docs.select("doc_id", textfn.text_sentiment(F.col("text"), learned).alias("sentiment"))


# --- joins ---------------------------------------------------------------------------------------------------


@query("lookup_broadcast", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def lookup_broadcast(spark, sf_dir):
    """A dictionary, sent to all tasks if it is small; rows that miss it go."""
    names = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    found = table(spark, sf_dir, "supplier").join(names, "s_nationkey", "left")
    return found.where("n_name is not null").select("s_suppkey", "n_name")


SQL_JOIN = """SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, c.brand, c.total FROM {lines} b LEFT JOIN
    (SELECT ps AS part, sup, min(brand) AS brand, count(*) AS total FROM {dim} GROUP BY ps, sup) c ON b.l_partkey = c.part AND b.l_suppkey = c.sup"""


@query("left_join_dedup", "WITH dim AS (SELECT l_partkey AS ps, l_suppkey AS sup, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 25)\n" + SQL_JOIN.format(lines="lineitem", dim="dim"))
def left_join_dedup(spark, sf_dir):
    """As a DataFrame plan: a left join on two keys with a de-duplicated right side."""
    lines = table(spark, sf_dir, "lineitem")
    dim = lines.where("l_quantity > 25").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    one = dim.groupBy("l_partkey", "l_suppkey").agg(F.min("p_brand").alias("brand"), F.count("*").alias("total"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(one, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "brand", "total")


@query("sql_text_join", ORACLES["left_join_dedup"])
def sql_text_join(spark, sf_dir):
    """The same as text given to spark.sql."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return spark.sql(
        "WITH dim AS (SELECT l_partkey AS ps, l_suppkey AS sup, p_brand AS brand FROM {lines} JOIN {part} ON p_partkey = l_partkey WHERE l_quantity > 25) " + SQL_JOIN.format(lines="{lines}", dim="dim"),
        lines=lines, part=part,
    )


@query("spatial_within", views("pv", "sites") + "SELECT site, obj_id, round(87944.0::DOUBLE * sqrt((p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat)), 6) AS metres FROM pv p, sites s WHERE 87944.0::DOUBLE * sqrt((p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat)) <= 1000")
def spatial_within(spark, sf_dir):
    return spatial.within(pv(spark, sf_dir).select("obj_id", "lon", "lat"), sites(spark, sf_dir), 1000.0).select(F.col("r_site").alias("site"), F.col("l_obj_id").alias("obj_id"), F.round("metres", 6).alias("metres"))


@query("spatiotemporal_count", views("pv", "sites", "volumes", "summed") + """, o AS (SELECT u.site, u.interval_ts, s.lon, s.lat FROM summed u JOIN sites s ON s.site = u.site)
    SELECT o.site, (epoch_us(o.interval_ts) // 1000) AS ms, count(p.obj_id) AS near FROM o LEFT JOIN pv p ON p.ts > o.interval_ts - INTERVAL 30 MINUTE AND p.ts < o.interval_ts + INTERVAL 30 MINUTE
    AND 87944.0::DOUBLE * sqrt((p.lon - o.lon) * (p.lon - o.lon) + (p.lat - o.lat) * (p.lat - o.lat)) <= 1000 GROUP BY o.site, o.interval_ts""")
def spatiotemporal_count(spark, sf_dir):
    own = aggregate.over_detectors(volumes(spark, sf_dir), ("site", "interval_ts")).join(sites(spark, sf_dir), "site").select("site", F.col("interval_ts").alias("ts"), "lon", "lat")
    return spatial.count_within(own, pv(spark, sf_dir).select("ts", "lon", "lat"), ["site", "ts"], 1000.0, 1800.0).select("site", millis().alias("ms"), "near")


ALONG = "CASE WHEN (lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / ((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)))) ELSE 0.0::DOUBLE END"


@query("exists_near_line", views("pv", "sites", "streets") + f""", d AS (SELECT obj_id, lon - lon1 - {ALONG} * (lon2 - lon1) AS dx, lat - lat1 - {ALONG} * (lat2 - lat1) AS dy FROM pv, streets)
    SELECT obj_id, bool_or(87944.0::DOUBLE * sqrt(dx * dx + dy * dy) <= 10) AS on_street FROM d GROUP BY obj_id""")
def exists_near_line(spark, sf_dir):
    return apps.flag_on_street(pv(spark, sf_dir).select("obj_id", "lon", "lat"), streets(spark, sf_dir), 10.0).select("obj_id", "on_street")


@query("baseline_lookup", views("volumes", "summed", "local", BASE) + "SELECT l.site, (epoch_us(l.interval_ts) // 1000) AS ms, round(b.average, 6) AS average FROM local l JOIN base b ON b.site = l.site AND b.dow = strftime(l.lt, '%a') AND b.tod = strftime(l.lt, '%H:%M:%S') WHERE b.average > 0 AND b.n >= 3")
def baseline_lookup(spark, sf_dir):
    v = volumes(spark, sf_dir)
    base = filters.baseline_quality(apps.build_baseline(v), 3)
    return keyed(v).join(base.select("site", "day_of_week", "time_of_day", "average"), ["site", "day_of_week", "time_of_day"]).select("site", timefn.millis(F.col("interval_ts")).alias("ms"), F.round("average", 6).alias("average"))


def keyed(v: DataFrame) -> DataFrame:
    ts = F.col("interval_ts")
    return aggregate.over_detectors(v, ("site", "interval_ts")).withColumns({"day_of_week": timefn.day_of_week(ts), "time_of_day": timefn.time_of_day(ts)})


# --- aggregates ----------------------------------------------------------------------------------------------


@query("feature_count", views("pv") + f"SELECT user_id, count(*) AS n FROM pv WHERE ts > TIMESTAMP '{START}' GROUP BY user_id")
def feature_count(spark, sf_dir):
    return pv(spark, sf_dir).where(filters.after(F.col("ts"), F.lit(START).cast("timestamp"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("detector_sum", views("volumes", "summed") + "SELECT site, (epoch_us(interval_ts) // 1000) AS ms, volume, detector FROM summed")
def detector_sum(spark, sf_dir):
    return aggregate.over_detectors(volumes(spark, sf_dir), ("site", "interval_ts")).select("site", timefn.millis(F.col("interval_ts")).alias("ms"), "volume", "detector")


@query("baseline_dow_tod", views("volumes", "summed", "local", BASE) + "SELECT site, dow, tod, round(average, 6) AS average, n, round(deviation, 6) AS deviation, low, high FROM base")
def baseline_dow_tod(spark, sf_dir):
    return apps.build_baseline(volumes(spark, sf_dir)).select("site", F.col("day_of_week").alias("dow"), F.col("time_of_day").alias("tod"), F.round("average", 6).alias("average"), "n", F.round("deviation", 6).alias("deviation"), "low", "high")


@query("baseline_any_day", views("volumes", "summed", "local") + "SELECT site, strftime(lt, '%H:00:00') AS hour, round(avg(volume), 6) AS average, count(*) AS n, round(coalesce(stddev_samp(volume), 0), 6) AS deviation FROM local GROUP BY ALL")
def baseline_any_day(spark, sf_dir):
    return apps.build_baseline(volumes(spark, sf_dir), ("site", "hour")).select("site", "hour", F.round("average", 6).alias("average"), "n", F.round("deviation", 6).alias("deviation"))


@query("variance_two_pass", "SELECT user_id, count(value) AS n, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY user_id")
def variance_two_pass(spark, sf_dir):
    return aggregate.two_pass_deviation(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", "n", F.round("deviation", 6).alias("deviation"))


@query("hourly_sum", views("volumes", "summed", "local") + "SELECT strftime(interval_ts, '%Y-%m-%dT%H UTC') AS hour, sum(volume)::BIGINT AS volume FROM local WHERE strftime(lt, '%a') = 'Mon' GROUP BY ALL")
def hourly_sum(spark, sf_dir):
    return aggregate.hourly(keyed(volumes(spark, sf_dir)).where("day_of_week = 'Mon'"), timefn.utc_hour(F.col("interval_ts")), F.sum("volume").cast("long"), "volume")


@query("rush_hour", views("volumes", "summed", "local", BASE) + "SELECT strftime((('2000-01-01 ' || tod)::TIMESTAMP AT TIME ZONE 'Australia/Melbourne') AT TIME ZONE 'UTC', '%Y-%m-%dT%H UTC') AS hour, round(sum(average), 6) AS volume FROM base WHERE dow = 'Mon' GROUP BY ALL")
def rush_hour(spark, sf_dir):
    return apps.rush_hour(apps.build_baseline(volumes(spark, sf_dir))).withColumn("volume", F.round("volume", 6))


@query("baseline_by_days", ORACLES["baseline_dow_tod"])
def baseline_by_days(spark, sf_dir):
    """The baseline from a store to which weeks are added out of order and one comes twice: the same as in one pass."""
    store = apps.BaselineStore(spark, f"{shared_dir(spark)}/baseline-{uuid.uuid4().hex}")
    v = volumes(spark, sf_dir)
    week = F.weekofyear(timefn.local_date(F.col("interval_ts")))
    for weeks in ([3], [1, 52, 53], [2], [3, 4, 5]):
        store.add(v.where(week.isin(weeks)))
    store.add(v.where(~week.isin([1, 2, 3, 4, 5, 52, 53])))
    return store.read().select("site", F.col("day_of_week").alias("dow"), F.col("time_of_day").alias("tod"), F.round("average", 6).alias("average"), "n", F.round("deviation", 6).alias("deviation"), "low", "high")


@query("calendar_fill_baseline", views("pv", "sites") + """, near AS (SELECT site, (p.ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' AS lt FROM pv p, sites s WHERE 87944.0::DOUBLE * sqrt((p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat)) <= 1000),
    cells AS (SELECT site, d, h FROM sites, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) a(d), generate_series(0, 23) b(h)),
    seen AS (SELECT site, date_trunc('day', lt) AS d, hour(lt) AS h, count(*) AS cnt FROM near GROUP BY ALL),
    filled AS (SELECT c.site, strftime(c.d, '%a') AS dow, c.h::INT AS hour, coalesce(cnt, 0) AS cnt FROM cells c LEFT JOIN seen s ON s.site = c.site AND s.d = c.d AND s.h = c.h)
    SELECT site, dow, hour, round(avg(cnt), 6) AS average, count(*) AS n, round(stddev_samp(cnt), 6) AS deviation, least(min(cnt), 0)::DOUBLE AS low, greatest(max(cnt), 0)::DOUBLE AS high FROM filled GROUP BY ALL HAVING count(*) >= 2""")
def calendar_fill_baseline(spark, sf_dir):
    found = apps.build_nearby_baseline(sites(spark, sf_dir), pv(spark, sf_dir), 1000.0, "2024-01-01", "2024-01-31")
    return found.select("site", F.col("day_of_week").alias("dow"), "hour", F.round("average", 6).alias("average"), "n", F.round("deviation", 6).alias("deviation"), "low", "high")


@query("bbox_extent", views("pv") + "SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM pv")
def bbox_extent(spark, sf_dir):
    return filters.extent(pv(spark, sf_dir))


@query("time_extremes", views("pv") + "SELECT (epoch_us(min(ts)) // 1000) AS first_ms, (SELECT min(obj_id) FROM pv WHERE ts = (SELECT min(ts) FROM pv)) AS first_key, (epoch_us(max(ts)) // 1000) AS last_ms, (SELECT min(obj_id) FROM pv WHERE ts = (SELECT max(ts) FROM pv)) AS last_key FROM pv")
def time_extremes(spark, sf_dir):
    found = aggregate.time_extremes(pv(spark, sf_dir))
    return found.select(millis("first_ts").alias("first_ms"), "first_key", millis("last_ts").alias("last_ms"), "last_key")


@query("first_known_value", "SELECT user_id, min(event_type) AS event_type FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def first_known_value(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
    return aggregate.first_known(e, "user_id", "event_type").where("event_type is not null")


@query("union_all", "SELECT event_id AS id, 'event' AS kind FROM events UNION ALL SELECT doc_id, 'document' FROM documents")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind")).unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")))


@query("dedup_prefer_history", "WITH b AS (SELECT user_id, event_id, event_id % 2 AS is_new FROM events) SELECT user_id, event_id, is_new FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_new, event_id) AS n FROM b) WHERE n = 1")
def dedup_prefer_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 2).alias("is_new"))
    return aggregate.preferred(e, "user_id", F.col("is_new"), F.col("event_id"))


@query("precedence_union", """WITH u AS (SELECT user_id, event_id, 0 AS place FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, event_id, 2 FROM events)
    SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place, event_id) AS n FROM u) WHERE n = 1""")
def precedence_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    parts = [e.where(c).select("user_id", "event_id", F.lit(k).alias("place")) for k, c in enumerate(("event_type = 'click'", "event_id % 3 = 0", "true"))]
    return aggregate.preferred(parts[0].unionByName(parts[1]).unionByName(parts[2]), "user_id", F.col("place"), F.col("event_id"))


# --- anomalies -----------------------------------------------------------------------------------------------

FLAGGED = "flagged AS (SELECT l.site, l.interval_ts, l.lt, l.volume, (l.volume > b.average + 1.5::DOUBLE * b.deviation OR l.volume < b.average - 1.5::DOUBLE * b.deviation) AS abnormal FROM local l JOIN base b ON b.site = l.site AND b.dow = strftime(l.lt, '%a') AND b.tod = strftime(l.lt, '%H:%M:%S') WHERE b.average > 0 AND b.n >= 3)"


@query("two_sigma", views("volumes", "summed", "local", BASE, FLAGGED) + "SELECT site, (epoch_us(interval_ts) // 1000) AS ms, volume, abnormal FROM flagged")
def two_sigma(spark, sf_dir):
    v = volumes(spark, sf_dir)
    base = filters.baseline_quality(apps.build_baseline(v), 3)
    return anomaly.flagged(keyed(v), base, ["site", "day_of_week", "time_of_day"], "volume", 1.5).select("site", timefn.millis(F.col("interval_ts")).alias("ms"), "volume", "abnormal")


@query("site_anomalies", views("pv", "sites", "volumes", "summed", "local", BASE, FLAGGED) + """, near AS (SELECT site, (p.ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' AS lt FROM pv p, sites s WHERE 87944.0::DOUBLE * sqrt((p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat)) <= 1000),
    cells AS (SELECT site, d, h FROM sites, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) a(d), generate_series(0, 23) b(h)),
    seen AS (SELECT site, date_trunc('day', lt) AS d, hour(lt) AS h, count(*) AS cnt FROM near GROUP BY ALL),
    nearby AS (SELECT c.site, strftime(c.d, '%a') AS dow, c.h::INT AS hour, avg(coalesce(cnt, 0)) AS average, stddev_samp(coalesce(cnt, 0)) AS deviation FROM cells c LEFT JOIN seen s ON s.site = c.site AND s.d = c.d AND s.h = c.h GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT f.site, f.interval_ts, f.lt, f.abnormal, s.lon, s.lat FROM flagged f JOIN sites s ON s.site = f.site),
    c AS (SELECT o.site, o.interval_ts, o.lt, any_value(o.abnormal) AS ta, count(p.obj_id) AS near FROM o LEFT JOIN pv p ON p.ts > o.interval_ts - INTERVAL 30 MINUTE AND p.ts < o.interval_ts + INTERVAL 30 MINUTE AND 87944.0::DOUBLE * sqrt((p.lon - o.lon) * (p.lon - o.lon) + (p.lat - o.lat) * (p.lat - o.lat)) <= 1000 GROUP BY o.site, o.interval_ts, o.lt),
    z AS (SELECT strftime(c.lt, '%Y-%m-%d') AS day, ta, near, (near > n.average + 1.5::DOUBLE * n.deviation OR near < n.average - 1.5::DOUBLE * n.deviation) AS ma FROM c JOIN nearby n ON n.site = c.site AND n.dow = strftime(c.lt, '%a') AND n.hour = hour(c.lt))
    SELECT day, count(*) FILTER (ta AND ma) AS aa, count(*) FILTER (ta AND NOT ma) AS an, count(*) FILTER (NOT ta AND ma) AS na, count(*) FILTER (NOT ta AND NOT ma) AS nn,
    count(*) FILTER (ta AND ma AND near <> 0) AS aa_seen, count(*) FILTER (ta AND NOT ma AND near <> 0) AS an_seen, count(*) FILTER (NOT ta AND ma AND near <> 0) AS na_seen, count(*) FILTER (NOT ta AND NOT ma AND near <> 0) AS nn_seen FROM z GROUP BY day""")
def site_anomalies(spark, sf_dir):
    v, p, s = volumes(spark, sf_dir), pv(spark, sf_dir), sites(spark, sf_dir)
    nearby = apps.build_nearby_baseline(s, p, 1000.0, "2024-01-01", "2024-01-31")
    found = apps.detect_site_anomalies(v.join(s, "site"), apps.build_baseline(v), p, nearby, k=1.5, least=3, box=None)
    return found.withColumn("day", F.col("day").cast("string"))


@query("confusion_matrix", "SELECT user_id % 7 AS day, count(*) FILTER (value > 100 AND event_id % 3 = 0) AS aa, count(*) FILTER (value > 100 AND event_id % 3 <> 0) AS an, count(*) FILTER (value <= 100 AND event_id % 3 = 0) AS na, count(*) FILTER (value <= 100 AND event_id % 3 <> 0) AS nn FROM events GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("day"), (F.col("value") > 100).alias("traffic_abnormal"), (F.col("event_id") % 3 == 0).alias("message_abnormal"), F.lit(1).alias("near"))
    return anomaly.confusion(e, ["day"]).select("day", "aa", "an", "na", "nn")


@query("abn_rate", "WITH r AS (SELECT user_id, count(*) FILTER (value > 60) AS abnormal FROM events GROUP BY user_id) SELECT count(*) AS clusters, count(*) FILTER (abnormal > 0) AS hit, round(count(*) FILTER (abnormal > 0) * 100.0::DOUBLE / count(*), 6) AS percent FROM r")
def abn_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("cluster_id"), (F.col("value") > 60).alias("abnormal"))
    return anomaly.share_with_any(anomaly.rates(e)).withColumn("percent", F.round(F.col("percent").cast("double"), 6))


# --- clusters ------------------------------------------------------------------------------------------------

BY = Density()
DBSCAN = f"""e3 AS MATERIALIZED (SELECT obj_id, lon AS x, lat AS y, (epoch_us(ts) // 1000)::DOUBLE * {BY.depth_per_ms!r}::DOUBLE AS z, user_id // 50 AS place FROM pv),
    pairs AS MATERIALIZED (SELECT a.obj_id AS a, b.obj_id AS b FROM e3 a JOIN e3 b ON a.place = b.place AND b.z > a.z - {BY.epsilon!r}::DOUBLE AND b.z < a.z + {BY.epsilon!r}::DOUBLE
        WHERE a.obj_id <> b.obj_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < {BY.epsilon!r}::DOUBLE),
    core AS MATERIALIZED (SELECT a, count(*) AS n FROM pairs GROUP BY a HAVING count(*) > {BY.min_points}),
    cc AS MATERIALIZED (SELECT p.a, p.b FROM pairs p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b),
    reach AS (SELECT a, a AS b FROM core UNION SELECT r.a, c.b FROM reach r JOIN cc c ON c.a = r.b),
    ids AS MATERIALIZED (SELECT b AS obj_id, min(a) AS cluster_id FROM reach GROUP BY b),
    border AS (SELECT p.b AS obj_id, min(i.cluster_id) AS cluster_id FROM pairs p JOIN ids i ON i.obj_id = p.a WHERE p.b NOT IN (SELECT a FROM core) GROUP BY p.b),
    clustered AS MATERIALIZED (SELECT obj_id, cluster_id, 'CORE' AS cluster_label FROM ids UNION ALL SELECT obj_id, cluster_id, 'BORDER' FROM border)"""


@query("eps_neighbours", views("pv", DBSCAN) + "SELECT a, b FROM pairs")
def eps_neighbours(spark, sf_dir):
    return spatial.neighbours(cluster.embedded(pv(spark, sf_dir), BY), BY.epsilon)


@query("core_points", views("pv", DBSCAN) + "SELECT a AS obj_id, n FROM core")
def core_points(spark, sf_dir):
    return cluster.cores(eps_neighbours(spark, sf_dir), BY).withColumnRenamed("a", "obj_id")


@query("dbscan_clusters", views("pv", DBSCAN) + "SELECT pv.obj_id, cluster_id, cluster_label FROM pv LEFT JOIN clustered c ON c.obj_id = pv.obj_id")
def dbscan_clusters(spark, sf_dir):
    return cluster.cluster_points(pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat")).select("obj_id", "cluster_id", "cluster_label")


@query("dbscan_promoted", views("pv", DBSCAN) + f""", linking AS (SELECT p.b, count(*) AS n FROM pairs p JOIN core c ON c.a = p.a WHERE p.b NOT IN (SELECT a FROM core) GROUP BY p.b HAVING count(*) >= {BY.min_points}),
    hop AS MATERIALIZED (SELECT DISTINCT i.cluster_id AS s, j.cluster_id AS t FROM linking l JOIN pairs p ON p.b = l.b JOIN ids i ON i.obj_id = p.a JOIN pairs q ON q.b = l.b JOIN ids j ON j.obj_id = q.a),
    far AS (SELECT DISTINCT cluster_id AS s, cluster_id AS t FROM ids UNION SELECT f.s, h.t FROM far f JOIN hop h ON h.s = f.t),
    top AS (SELECT t AS cluster_id, min(s) AS to_id FROM far GROUP BY t)
    SELECT i.obj_id, top.to_id AS cluster_id FROM ids i JOIN top ON top.cluster_id = i.cluster_id""")
def dbscan_promoted(spark, sf_dir):
    return cluster.cluster_points(pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat"), BY, promote=True).where("cluster_label = 'CORE'").select("obj_id", "cluster_id")


@query("cluster_summary", views("pv", DBSCAN) + "SELECT cluster_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, (sum((epoch_us(ts) // 1000)) // count(*))::BIGINT AS ms, count(*) AS size FROM pv JOIN clustered USING (obj_id) GROUP BY cluster_id")
def cluster_summary(spark, sf_dir):
    found = cluster.cluster_points(pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat"))
    return apps.summarise_clusters(found).select("cluster_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "ms", "size")


@query("hourly_count", views("pv", DBSCAN) + ", l AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' AS lt FROM pv JOIN clustered USING (obj_id)) SELECT strftime(lt, '%H ') || CASE WHEN epoch(lt) - epoch(ts) = 39600 THEN 'AEDT' ELSE 'AEST' END AS hour, count(*) AS cnt FROM l GROUP BY ALL")
def hourly_count(spark, sf_dir):
    return apps.count_clustered_by_hour(cluster.cluster_points(pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat")))


EXTENT = "extent AS MATERIALIZED (SELECT user_id AS cluster_id, avg(lon) AS lon, avg(lat) AS lat, count(*) AS size, min(ts) AS t1, max(ts) AS t2, sqrt((max(lon) - min(lon)) * (max(lon) - min(lon)) + (max(lat) - min(lat)) * (max(lat) - min(lat))) * 43972.0::DOUBLE AS radius_m FROM pv GROUP BY user_id)"


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.cluster_extents(pv(spark, sf_dir).withColumn("cluster_id", F.col("user_id")))


@query("cluster_extent", views("pv", EXTENT) + "SELECT cluster_id, round(lon, 6) AS lon, round(lat, 6) AS lat, size, (epoch_us(t1) // 1000) AS ms1, (epoch_us(t2) // 1000) AS ms2, round(radius_m, 6) AS radius_m FROM extent")
def cluster_extent(spark, sf_dir):
    return extents(spark, sf_dir).select("cluster_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "size", millis("t1").alias("ms1"), millis("t2").alias("ms2"), F.round("radius_m", 6).alias("radius_m"))


@query("cluster_interval_join", views("pv", "sites", "volumes", "summed", EXTENT) + """SELECT e.cluster_id, count(*) AS n, sum(u.volume)::BIGINT AS volume FROM extent e, summed u JOIN sites s ON s.site = u.site
    WHERE (epoch_us(u.interval_ts) // 1000) > (epoch_us(e.t1) // 1000) - 1000 AND (epoch_us(u.interval_ts) // 1000) < (epoch_us(e.t2) // 1000) + 1000 AND 87944.0::DOUBLE * sqrt((s.lon - e.lon) * (s.lon - e.lon) + (s.lat - e.lat) * (s.lat - e.lat)) <= e.radius_m + 300 GROUP BY e.cluster_id""")
def cluster_interval_join(spark, sf_dir):
    v = aggregate.over_detectors(volumes(spark, sf_dir), ("site", "interval_ts")).join(sites(spark, sf_dir), "site").withColumnRenamed("interval_ts", "ts")
    return spatial.interval_join(extents(spark, sf_dir), v).groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("volume"))


@query("cluster_anomalies", views("pv", "sites", "volumes", "summed", "local", BASE, DBSCAN) + """, ext AS (SELECT cluster_id, avg(lon) AS lon, avg(lat) AS lat, min(ts) AS t1, max(ts) AS t2, sqrt((max(lon) - min(lon)) * (max(lon) - min(lon)) + (max(lat) - min(lat)) * (max(lat) - min(lat))) * 43972.0::DOUBLE AS radius_m FROM pv JOIN clustered USING (obj_id) GROUP BY cluster_id),
    f AS (SELECT e.cluster_id, (l.volume > b.average + 2.0::DOUBLE * b.deviation OR l.volume < b.average - 2.0::DOUBLE * b.deviation) AS abn FROM ext e, local l JOIN sites s ON s.site = l.site JOIN base b ON b.site = l.site AND b.dow = strftime(l.lt, '%a') AND b.tod = strftime(l.lt, '%H:%M:%S')
    WHERE b.average > 0 AND b.n > 2 AND (epoch_us(l.interval_ts) // 1000) > (epoch_us(e.t1) // 1000) - 1000 AND (epoch_us(l.interval_ts) // 1000) < (epoch_us(e.t2) // 1000) + 1000 AND 87944.0::DOUBLE * sqrt((s.lon - e.lon) * (s.lon - e.lon) + (s.lat - e.lat) * (s.lat - e.lat)) <= e.radius_m + 300)
    SELECT cluster_id, count(*) FILTER (abn) AS abnormal, count(*) FILTER (NOT abn) AS normal FROM f GROUP BY cluster_id""")
def cluster_anomalies(spark, sf_dir):
    v = volumes(spark, sf_dir)
    points = cluster.cluster_points(pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat"))
    return apps.detect_cluster_anomalies(points, v.join(sites(spark, sf_dir), "site"), apps.build_baseline(v), more_than=2)


@query("box_assign", views("pv") + """, boxes AS (SELECT r_regionkey AS cell, 144.88::DOUBLE + r_regionkey * 0.02::DOUBLE AS x1, 144.93::DOUBLE + r_regionkey * 0.02::DOUBLE AS x2, -37.86::DOUBLE + r_regionkey * 0.01::DOUBLE AS y1, -37.83::DOUBLE + r_regionkey * 0.01::DOUBLE AS y2 FROM region)
    SELECT obj_id, cell FROM pv JOIN boxes ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2""")
def box_assign(spark, sf_dir):
    """Points with each of a few boxes that hold them."""
    k = F.col("r_regionkey")
    boxes = table(spark, sf_dir, "region").select(k.alias("cell"), (F.lit(144.88) + k * F.lit(0.02)).alias("x1"), (F.lit(144.93) + k * F.lit(0.02)).alias("x2"), (F.lit(-37.86) + k * F.lit(0.01)).alias("y1"), (F.lit(-37.83) + k * F.lit(0.01)).alias("y2"), F.lit(0.0).alias("z1"), F.lit(1e9).alias("z2"))
    return spatial.in_boxes(cluster.embedded(pv(spark, sf_dir), BY), boxes).select("obj_id", "cell")


@query("extent_members", views("pv") + """, box AS (SELECT user_id, min(lon) AS x1, max(lon) AS x2, min(lat) AS y1, max(lat) AS y2, min(ts) AS t1, min(ts) + to_hours((1 + user_id % 7 * user_id % 60)::BIGINT) AS t2 FROM pv GROUP BY user_id)
    SELECT b.user_id, count(*) AS n FROM box b JOIN pv p ON p.lon BETWEEN x1 AND x2 AND p.lat BETWEEN y1 AND y2 AND (epoch_us(p.ts) // 1000) BETWEEN (epoch_us(t1) // 1000) AND (epoch_us(t2) // 1000) GROUP BY b.user_id""")
def extent_members(spark, sf_dir):
    """How many points lie in each user's box in the hours after the user's first; boxes last from one hour to days."""
    points = pv(spark, sf_dir)
    hours = (1 + F.col("user_id") % 7 * F.col("user_id") % 60).cast("int")
    found = points.groupBy("user_id").agg(*[f(c).alias(f"{n}{k}") for n, c in (("x", "lon"), ("y", "lat")) for k, f in ((1, F.min), (2, F.max))], F.min("ts").alias("t1"))
    boxes = found.withColumns({"ms1": millis("t1"), "ms2": timefn.millis(F.col("t1") + F.make_dt_interval(hours=hours))}).drop("t1")
    own = points.select("lon", "lat", millis().alias("ms"))
    met = spatial.overlapping(own, boxes, [(F.col("lon"), F.col("x1"), F.col("x2")), (F.col("lat"), F.col("y1"), F.col("y2")), (F.col("ms"), F.col("ms1"), F.col("ms2"))])
    return met.groupBy("user_id").agg(F.count("*").alias("n"))


#: The points that count as new, and the most points of a cell, for cell_assign.
FRESH, MOST = "event_id % 20 = 0", 100


def sql_place(c: str, value: str, k: str) -> str:
    return f"greatest(0, least(pow(2, least({k}, n{c})) - 1, ceil(({value} - {c}1) / (d{c} / pow(2, least({k}, n{c})))) - 1))"


def sql_low(c: str) -> str:
    return f"({c}1 + i{c} * (d{c} / pow(2, least(k, n{c}))))"


@query("cell_assign", views("pv") + f""", e3 AS MATERIALIZED (SELECT obj_id, lon AS x, lat AS y, (epoch_us(ts) // 1000)::DOUBLE * {BY.depth_per_ms!r}::DOUBLE AS z, {FRESH} AS fresh FROM pv),
    ends AS (SELECT min(x) AS x1, max(x) - min(x) AS dx, min(y) AS y1, max(y) - min(y) AS dy, min(z) AS z1, max(z) - min(z) AS dz FROM e3),
    b AS MATERIALIZED (SELECT *, {", ".join(f"greatest(0, ceil(log2(d{c} / {2 * BY.epsilon!r}::DOUBLE))) AS n{c}" for c in "xyz")} FROM ends),
    cells AS MATERIALIZED (SELECT k, {", ".join(f"{sql_place(c, c, 'k')} AS i{c}" for c in "xyz")}, count(*) AS n, bool_or(fresh) AS fresh FROM e3, b, generate_series(0, (SELECT greatest(nx, ny, nz)::BIGINT FROM b)) lv(k) GROUP BY ALL),
    leaves AS (SELECT c.k, c.ix, c.iy, c.iz FROM cells c CROSS JOIN b LEFT JOIN cells p ON p.k = c.k - 1 AND {" AND ".join(f"p.i{c} = floor(c.i{c} / pow(2, least(c.k, n{c}) - least(c.k - 1, n{c})))" for c in "xyz")}
        WHERE c.fresh AND c.n >= {BY.min_points} AND (c.n <= {MOST} OR c.k = greatest(nx, ny, nz)) AND (c.k = 0 OR p.n > {MOST}))
    SELECT obj_id, concat_ws('-', k, ix::BIGINT, iy::BIGINT, iz::BIGINT) AS cell, NOT ({" AND ".join(f"i{c} = {sql_place(c, c, 'k')}" for c in "xyz")}) AS halo FROM e3, leaves, b
    WHERE {" AND ".join(f"{c} >= {sql_low(c)} - {1.01 * BY.epsilon!r}::DOUBLE AND {c} <= {sql_low(c)} + d{c} / pow(2, least(k, n{c})) + {1.01 * BY.epsilon!r}::DOUBLE" for c in "xyz")}""")
def cell_assign(spark, sf_dir):
    return cluster.grid_cells(pv(spark, sf_dir), BY, MOST, F.expr(FRESH))


#: Clusters that follow each other in the list of one nation and segment are merged, so each list becomes one.
@query("merge_labels", """WITH low AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM customer)
    SELECT o_orderkey AS obj_id, coalesce(m, o_custkey) AS cluster_id FROM orders LEFT JOIN low ON c_custkey = o_custkey""")
def merge_labels(spark, sf_dir):
    after = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), after.alias("b")).where("b is not null")
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obj_id"), F.col("o_custkey").alias("cluster_id"))
    return cluster.merged_labels(links, labels)


@query("stream_increment", ORACLES["dbscan_clusters"])
def stream_increment(spark, sf_dir):
    """The points as a stream of four slices of time, tick by tick into a keyed table: the same as one batch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    points = pv(spark, sf_dir).select("obj_id", "ts", "lon", "lat")
    t1, t2 = points.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - t1) / ((t2 - t1) / 4 + 1)), F.lit(3))
    for k in (0, 2, 1, 3):  # one slice comes late
        points.where(part == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    store = ClusterStore(spark, f"{base}/store")
    stream = spark.readStream.schema("obj_id string, ts timestamp, lon double, lat double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    cluster_stream(stream, store, f"{base}/checkpoint").awaitTermination()
    return store.read().select("obj_id", "cluster_id", "cluster_label")
