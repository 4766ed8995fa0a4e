"""Tags and lemmas from a small marked set."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions import tagger
from wayfold.plans import cli

MARKED = [
    "The/DT/the dog/NN/dog chases/VBZ/chase the/DT/the cats/NNS/cat ./././",
    "A/DT/a cat/NN/cat chased/VBD/chase two/CD/two dogs/NNS/dog ./././",
    "We/PRP/we walked/VBD/walk slowly/RB/slowly to/TO/to the/DT/the old/JJ/old park/NN/park ./././",
    "They/PRP/they walk/VBP/walk to/TO/to the/DT/the city/NN/city quickly/RB/quickly ./././",
    "She/PRP/she is/VBZ/be walking/VBG/walk in/IN/in Melbourne/NNP/melbourne ./././",
    "The/DT/the cities/NNS/city are/VBP/be larger/JJR/large than/IN/than parks/NNS/park ./././",
    "I/PRP/i like/VBP/like the/DT/the walk/NN/walk to/TO/to Sydney/NNP/sydney ./././",
    "He/PRP/he likes/VBZ/like parties/NNS/party and/CC/and talking/VBG/talk ./././",
    "The/DT/the talk/NN/talk was/VBD/be long/JJ/long ./././",
    "You/PRP/you talked/VBD/talk to/TO/to a/DT/a friend/NN/friend ./././",
]


def sentences():
    return [[tuple(w.split("/")[:3]) if not w.startswith(".") else (".", ".", ".") for w in s.split()] for s in MARKED]


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(f"s{k}", j, *w) for k, s in enumerate(sentences()) for j, w in enumerate(s)] + [(None, 0, "x", "NN", "x"), ("s0", 99, "", "NN", ""), ("s1", 98, "y", None, "y")]
    return spark.createDataFrame(rows, "sentence string, place int, word string, tag string, lemma string")


def test_tags_by_context_and_endings():
    t = tagger.Tagger.learned(sentences())
    assert t.tags("We like the talk .".split())[1:4] == ["VBP", "DT", "NN"]
    assert t.tags("They walk to the friend .".split())[:4] == ["PRP", "VBP", "TO", "DT"]  # marked as a noun, too
    assert t.tags("The walk was long .".split()) == ["DT", "NN", "VBD", "JJ", "."]
    unseen = t.tags("She is jumping in Perth .".split())
    assert unseen[2] == "VBG" and unseen[4] == "NNP" and unseen[5] == "."
    assert t.tags([]) == [] and tagger.Tagger.learned([]).tags(["x"]) == [""]


def test_lemmas_by_rules_of_endings():
    t = tagger.Tagger.learned(sentences())
    told = {("chases", "VBZ"): "chase", ("Cats", "NNS"): "cat", ("is", "VBZ"): "be", ("berries", "NNS"): "berry", ("jumping", "VBG"): "jump", ("jumped", "VBD"): "jump", ("houses", "NNS"): "house", ("s", "NNS"): "s", ("odd", "XX"): "odd"}
    assert {k: t.lemma(*k) for k in told} == told


def test_kept_tags_make_tokens(spark, marked, tmp_path, monkeypatch):
    t = tagger.fit(marked)
    assert t == tagger.Tagger.learned(sentences())
    rows = [("The dog is walking to the parks. Cats!",), ("",), (None,), ("to the of",)]
    found = [r[0] for r in spark.createDataFrame(rows, "text string").select(t(F.col("text"))).collect()]
    assert found[0] == ["dog", "be", "walk", "park", "cat"] and found[1:3] == [[], []]
    assert t.lemma_set("The dog is walking.", ("NN",)) == ["dog"]

    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    marked.write.parquet(f"{tmp_path}/marked")
    cli.main(["fit-tagger", "--marked", f"{tmp_path}/marked", "--out", f"{tmp_path}/tagger"])
    assert tagger.Tagger.load(spark, f"{tmp_path}/tagger") == t
    message = {"id_str": "1", "text": "The dogs walked to Melbourne.", "tokens": ["old"], "coordinates": {"type": "Point", "coordinates": [144.97, -37.8]}, "created_at": "Sat Sep 06 03:26:27 +0000 2014"}
    (tmp_path / "m.json").write_text(json.dumps({"value": message}))
    cli.main(["ingest-points", "--messages", f"{tmp_path}/m.json", "--out", f"{tmp_path}/p", "--tagger", f"{tmp_path}/tagger"])
    assert [r.tokens for r in spark.read.parquet(f"{tmp_path}/p").collect()] == [["old", "dog", "walk", "melbourne"]]


def test_a_bounded_number_of_sentences(marked):
    assert len(tagger.fit(marked, 3).after[tagger.START]) <= 3
