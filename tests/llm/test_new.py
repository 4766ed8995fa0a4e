"""The operators on codes, filters and phrases: brute force, odd rows, and their parts on their own."""

import random
import struct
import zlib
from collections import Counter
from itertools import permutations
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import audit, codes, phrases, queries
from wayfold.llm.words import batch_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977}x{k}." for k in range(30_000))
ODD = [(1, "one two three four five", "a", "en"), (2, None, "b", None), (3, "", None, "en"), (4, LONG, "c", "und"), (4, LONG, "c", "und"), (None, "one two three four five", "d", "en"), (None, None, None, None), (5, "A 'b' \n\n  c\té\U0001f600 あ|", "", "fr"), (6, "one two three four five", "f", "en")]
EXTRA = "doc_id long, text string, source string, lang string, part string, mask string, n string, phrase string, start string, shard string, digest string, own string, first string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in ODD], EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "z"), (1, 0, 1, "z"), (6, 1, None, "z"), (None, 1, 1, "z"), (99, 1, 1, "z")], "doc_id long, quality int, toxic int, mask string")


def test_op11_codes(spark, sf):
    tokenizer, at = Tokenizer.from_file(WORDS), 0
    found = {r.doc_id: r for r in queries.op11_codes(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert tuple(found[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), r.doc_id
        at += len(ids)


@pytest.mark.parametrize("top", [0, 1, 2, 255, 49407, 2**31 - 1, 2**32 - 1])
def test_codes_give_each_id_and_each_range(top):
    draw = np.random.default_rng(top)
    for n in (1, 511, 512, 513, 5000):
        ids = np.minimum(draw.integers(0, top + 1, n), draw.integers(0, top + 1, n)).astype(np.uint32)
        ids[n // 2] = top
        own = codes.Codes(codes.written(ids))
        assert own.between(0, n).tolist() == ids.tolist()
        for k in {0, n - 1, n // 2, *draw.integers(0, n, 40).tolist()}:
            end = min(n, k + int(draw.integers(0, 700)))
            assert own.at(k) == ids[k] and own.between(k, end).tolist() == ids[k:end].tolist()


def test_codes_take_fewer_bits_than_plain_ids():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 100_000), 49_000).astype(np.uint32)
    levels = codes.written(ids)
    assert len(levels) > 1 and sum(len(x["chunks"]) + len(x["more"]) + len(x["ranks"]) for x in levels) < 0.8 * 2 * len(ids)


def test_words_get_the_ids_that_whole_texts_have():
    draw = random.Random(3)
    bits = [*"aAbZz'.,;!?-)(&é́ÉßİΣσあ漢7１  \x1c\x85\x0b\x0c\t\r\n  "] + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "don't", "Hello", "é", "\U0001f600"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(60))) for _ in range(3000)] + ["", None, LONG]
    tokenizer, encoder = Tokenizer.from_file(WORDS), codes.WordEncoder(WORDS)
    column = pa.array(texts, type=pa.string())
    for begin, stop in ((0, 1000), (1000, len(texts))):  # the second is a slice of the column
        ids, ends = encoder(column.slice(begin, stop - begin))
        for k, text in enumerate(texts[begin:stop]):
            assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_codes_take_odd_rows_and_any_place(spark, odd, tmp_path, monkeypatch):
    codes.write_codes(odd, f"{tmp_path}/a", WORDS, 2)
    segments = codes.read_codes(spark, f"{tmp_path}/a")
    rows = sorted(codes.documents_of(segments).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6] and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    places = [0, 1, len(every) - 1, *random.Random(1).choices(range(len(every)), k=50)]
    asked = spark.createDataFrame([(p,) for p in [*places, places[0], -1, len(every), None]], "place long")
    assert {(r.place, r.id) for r in codes.tokens_at(segments, asked).collect()} == {(p, int(every[p])) for p in places}
    codes.write_codes(odd.limit(0), f"{tmp_path}/b", WORDS, 2)
    assert codes.digests_of(codes.read_codes(spark, f"{tmp_path}/b")).collect() == []


def brute_audit(docs, labels):
    """Rows of the audit by running every order over the documents."""
    first, known = {}, {}
    for d, text, _, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, q, t, *_ in labels:
        known[d] = (known.get(d, (0, 0))[0] | (q == 1), known.get(d, (0, 0))[1] | (t == 1))
    parts = {}
    for d, text, source, _ in docs:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > first[text]}
        parts.setdefault(source or "", []).append((fails, *(known.get(d, (0, 0)) if d is not None else (0, 0))))
    out = set()
    for part, own in parts.items():
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                kept, gone = [x for x in left if not x[0][f]], [x for x in left if x[0][f]]
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step, len(kept), len(gone), sum(x[0][f] for x in own) - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
                left = kept
        out |= {(*r[:-1], shapley[r[-1]]) for r in rows}
    return out


def test_op12_audit_by_running_every_order(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r) for r in queries.op12_audit(spark, sf).collect()} == brute_audit(docs, labels)


def test_audit_takes_odd_rows(spark, odd, labels):
    found = [tuple(r) for r in audit.audit(odd, labels).collect()]
    assert len(found) == 600 * 6 and set(found) == brute_audit(ODD, [tuple(r) for r in labels.collect()])
    assert audit.audit(odd.limit(0), labels).collect() == []
    assert {r.good_lost for r in audit.audit(odd, labels.limit(0)).collect()} == {0}


def test_audit_of_other_filters(spark, odd, labels):
    own = {"X": lambda t: not t.text, "Y": lambda t: len(t.text) > 1000}
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed) for r in audit.audit(odd, labels, filters=own, repeat="Z").collect()}
    assert len(found) == 6 * 6 * 3 and found[("c", "YXZ", 1)] == (0, 2) and found[("f", "XYZ", 3)] == (0, 1)


def brute_phrases(docs, least=10, top=2000, most=3):
    counts, words = {}, Counter()
    for _, text, _, lang in docs:
        own = counts.setdefault(lang or "und", Counter())
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\x0b\x0c\r":
            plain = plain.replace(mark, "\n")
        for piece in plain.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            words[lang or "und"] += len(w)
            own.update(" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        many = {p: c for p, c in f.items() if c >= least and " " in p}
        longest = Counter()
        for p, c in many.items():
            w = p.split(" ")
            for inner in {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w)}:
                longest[inner] = max(longest[inner], c)
        rows = []
        for p, a in many.items():
            w = p.split(" ")
            score, _, left, right = min((1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            if not (p in longest and 100 * longest[p] >= 50 * a):
                rows.append((-score, -a, p.encode(), (p, a, left, right, words[lang], score)))
        out += [(lang, k, *r[-1]) for k, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_op13_phrases(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    found = [tuple(r) for r in queries.op13_phrases(spark, sf).collect()]
    assert sorted(found) == brute_phrases(docs) and found


@pytest.mark.parametrize("words, small", [(3, False), (3, True), (2, False), (4, True)])
def test_phrases_of_small_runs_and_full_sketches(spark, monkeypatch, words, small):
    if small:  # runs, automata and a sketch that is of no use; Spark's workers get the function with its module's globals, so patch what is sent
        monkeypatch.setattr(phrases, "slots_for", lambda letters, most: 1 << 16)
    draw = random.Random(words)
    texts = ["".join(draw.choice(["ab", "c", "d d", "Ab", "é"]) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(draw.randrange(80))) for _ in range(200)]
    docs = [(k, t, None, draw.choice(["en", "fr", None, "und"])) for k, t in enumerate(texts)] + ODD
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(5)
    found = [tuple(r) for r in phrases.collocations(df, 3, words, 15).collect()]
    assert sorted(found) == brute_phrases(docs, 3, 15, words) and len({r[0] for r in found}) == 3


def test_gaps_give_places_back():
    for at in ([], [0], [0, 1, 65534, 65535, 65536, 400_000, 10**6], [70_000], [200_000, 265_535]):
        n = np.arange(1, len(at) + 1)
        place, count = phrases.places(*phrases.gaps(np.array(at, dtype=np.int64), n))
        assert place[count > 0].tolist() == at and count[count > 0].tolist() == n.tolist()


def test_runs_end_with_pieces_and_lose_no_word():
    draw = random.Random(5)
    batch = pa.RecordBatch.from_pydict({"lang": [f"l{k % 7}" for k in range(300)], "text": [" ".join(draw.choices(["a", "b.", "c\n"], k=50)) for _ in range(300)]})
    before = phrases.RUN, phrases.GATHERED
    try:
        phrases.RUN, phrases.GATHERED = 200, 900
        found = list(phrases.runs(iter([batch])))
    finally:
        phrases.RUN, phrases.GATHERED = before
    assert all(words[-1] == phrases.BREAK for _, words in found) and len(found) > 50
    got, told = Counter(), Counter()
    for lang, words in found:
        got.update((lang, w) for w in words if w != phrases.BREAK)
    for lang, text in zip(*batch.to_pydict().values()):
        told.update((lang, w) for w in text.encode().translate(phrases.PLAIN).split())
    assert got == told


def test_overlapping_matches_are_all_counted():
    assert phrases.matches(" a a a \n a b a b a \n", ["a", "a a", "a b a", "b", "a a a", "a b a b"]).tolist() == [6, 2, 2, 2, 1, 1]


def test_counts_of_runs_are_sent_in_small_parcels(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choices([f"word{k}" for k in range(300)], k=200)) for _ in range(150)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    counts = Counter(" ".join(w[k : k + n]) for w in map(str.split, texts) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    every = phrases.Sketch(1 << 16, [])
    every.bits[:] = 255  # lets all phrases through
    sent = [r for b in phrases._scan(iter(df.toArrow().to_batches()), 3, 8, SimpleNamespace(value=every)) for r in b.to_pylist()]
    assert sum(len(r["phrases"]) + len(r["counts"]) for r in sent) < 0.4 * sum(len(p) + 1 for p in counts)
    found = {p: n for r in sent for p, n in zip(*phrases.unpacked(r["phrases"], r["counts"]).to_pydict().values())}
    assert found.pop("") == 150 * 200 and found == counts and len({r["bucket"] for r in sent}) == 8


def test_parcels_are_summed_by_bucket_and_language(monkeypatch):
    monkeypatch.setattr(phrases, "OPENED", 3)
    sent = sorted(p for lang in ("a", "b") for n in range(1, 6) for p in phrases.parcels(lang, ["x y", "x é", "", f"z{n}"], [1 << 32, 2 << 32, 0, 3 << 32], np.full(4, n), 4))
    told = [tuple(r.values()) for b in phrases._summed(iter([batch_of(sent, phrases.PARCELS)]), 10) for r in b.to_pylist()]
    assert sorted(told) == sorted((lang, p, 15) for lang in "ab" for p in ("x y", "x é", ""))


def test_phrases_take_odd_rows_and_clashing_columns(spark, odd):
    many = odd.unionByName(odd).unionByName(odd)
    found = {(r.lang, r.phrase): (r.a, r.n) for r in phrases.collocations(many, 9).collect()}
    assert found[("en", "one two three")] == (9, 45) and all(lang == "en" for lang, _ in found)
    assert phrases.collocations(odd.limit(0)).collect() == []
    named = phrases.phrase_counts(many.withColumn("lang", F.lit("a\nb\n")), 9).where("phrase = 'one two'").collect()
    assert [(r.lang, r.n, r.words) for r in named] == [("a\nb\n", 9, 2)]
    assert phrases.phrase_counts(many, 9).where(F.col("phrase") == "").count() == 3
