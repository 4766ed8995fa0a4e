"""The grader of sentences: held-out sentences, negation, order, the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import grader, textfn
from wayfold.plans import catalogue, cli

GOOD, BAD = ["good", "lovely", "great", "sunny", "kind", "delicious"], ["bad", "awful", "dreadful", "rude", "dirty", "bland"]
THINGS = ["food", "tram", "weather", "staff", "room", "view", "coffee", "park"]


def sentence(draw):
    """A sentence and its grade: strong words count double, a negation turns what it stands before."""
    word, strong = draw.choice(GOOD + BAD), draw.random() < 0.4
    turned = draw.random() < 0.4
    sign = (1 if word in GOOD else -1) * (-1 if turned else 1)
    said = f"the {draw.choice(THINGS)} {draw.choice(['was', 'is', 'seemed'])} {draw.choice(['not ', 'never ']) if turned else ''}{'very ' if strong else ''}{word}"
    tail = draw.choice(["", f", and the {draw.choice(THINGS)} was there", f" near the {draw.choice(THINGS)}"])
    return said + tail + ".", 2 + sign * (2 if strong and not turned else 1)


@pytest.fixture(scope="module")
def learned(spark):
    draw = random.Random(1)
    return grader.fit(spark.createDataFrame([sentence(draw) for _ in range(3000)] + [("nothing to say here.", 2)] * 3 + [(f"the {t} near the {u}.", 2) for t in THINGS for u in THINGS] + [(None, 1), ("x", None), ("y", 9)], "text string, grade int"))


def test_held_out_sentences(spark, learned):
    draw = random.Random(2)
    rows = [sentence(draw) for _ in range(600)]
    found = spark.createDataFrame(rows, "text string, grade int").select("grade", learned(F.col("text")).alias("own"), textfn.sentiment_score(F.col("grade")).alias("score"), textfn.sentiment_score(learned(F.col("text"))).alias("own_score")).collect()
    assert sum(r.grade == r.own for r in found) > 0.95 * len(found) and sum(r.score == r.own_score for r in found) > 0.97 * len(found)


def test_negation_and_order_count(spark, learned):
    rows = ["The coffee was good.", "The coffee was not good.", "The coffee was bad.", "The coffee was never bad.", "The view was not, in the park, good."]
    graded = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(learned(F.col("t"))).collect()]
    assert graded[0] > 2 > graded[1] and graded[2] < 2 < graded[3] and graded[4] > 2  # a clause ends the negation
    ordered = grader.trained([(grader.slots(t), g) for t, g in (("dog bites man", 1), ("man bites dog", 3))], 20)
    assert ordered.grades(["dog bites man", "man bites dog"]).tolist() == [1, 3]


def test_odd_sentences_and_samples(spark, learned):
    graded = spark.createDataFrame([("",), (None,), ("?!",), ("x " * 50_000,)], "t string").select(learned(F.col("t")).alias("g")).collect()
    assert all(0 <= r.g <= 4 for r in graded)
    empty = grader.fit(spark.createDataFrame([], "text string, grade int"))
    assert empty.grades(["good"]).tolist() == [0]


def test_a_grader_on_the_command_line(spark, learned, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    draw = random.Random(1)
    spark.createDataFrame([sentence(draw) for _ in range(2000)], "text string, grade int").write.parquet(f"{tmp_path}/sample")
    cli.main(["fit-grader", "--sample", f"{tmp_path}/sample", "--out", f"{tmp_path}/grader"])
    messages = [{"id_str": str(k), "text": t, "coordinates": {"type": "Point", "coordinates": [144.97, -37.8]}, "created_at": "Sat Sep 06 03:26:27 +0000 2014"} for k, t in enumerate(["The tram was lovely.", "The tram was not lovely.", "Hi. The room was dirty and the room was awful."])]
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"value": m}) for m in messages))
    cli.main(["ingest-points", "--messages", f"{tmp_path}/m.json", "--out", f"{tmp_path}/p", "--grader", f"{tmp_path}/grader"])
    assert {r.obj_id: r.sentiment for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {"tweet-0": 1, "tweet-1": -1, "tweet-2": -1}


def test_sentiments_of_all_documents(spark, sf):
    found = catalogue.QUERIES["text_sentiments"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count() and {r.sentiment for r in found} <= {-1, 0, 1}
