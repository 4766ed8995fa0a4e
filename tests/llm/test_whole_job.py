"""Where operators once did less than the whole job."""

import heapq
import math
import os
import pickle
import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from wayfold.llm import mixing, personal


def scores(spark, texts, held, fit=lambda k: k % 6 == 3):
    """Rows of the held texts by a model of `texts`."""
    docs = spark.createDataFrame([(k, t, fit(k)) for k, t in enumerate(texts)], "doc_id long, text string, fit boolean")
    found = mixing.score(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), mixing.train(docs, F.col("fit")))
    return [r for _, r in sorted((r.doc_id, r) for r in found.collect())]


def test_every_decision_of_a_word_looks_at_the_word_before(spark):
    draw = random.Random(1)
    texts = [" ".join(f"a{k} b{k}" for k in draw.choices(range(300), k=40)) for _ in range(600)]
    (found,) = scores(spark, texts[1:], texts[:1])
    assert -found.score * math.log(10) / 40 < math.log(300) + 1  # the second of a pair costs next to nothing


def test_short_documents_learn_on_within_themselves(spark):
    draw = random.Random(2)
    texts = [" ".join(f"a{k} b{k} of{draw.randrange(10**6):06d}" for k in draw.choices(range(300), k=20)) for _ in range(600)]
    odd, new = " ".join(f"a{draw.randrange(300)} b{draw.randrange(300)}" for _ in range(60)), " ".join("".join(draw.choices("xyzuvw", k=8)) for _ in range(30))
    once, twice, new_once, new_twice = (-r.score for r in scores(spark, texts, [odd, f"{odd} {odd}", new, f"{new} {new}"]))
    assert twice < 1.96 * once  # under 4096 decisions of the code
    assert new_twice < 1.96 * new_once  # words that are spelled


def test_model_is_ahead_of_single_words(spark):
    from wayfold.llm import queries

    held = [r for r in queries.op9_mixing(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_vocabulary_and_tables_grow_with_the_input(spark):
    many = 140_000
    texts = [" ".join(f"q{k}" for k in range(a, a + 1000)) for a in range(0, many, 1000)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    model = mixing.train(docs, F.lit(False))
    assert len(model.vocabulary.value.counts) == many  # all words that occur twice
    small, large = (mixing.sized(n, n // 20, n // 50) for n in (10**8, 10**10))
    assert all(b >= a + 6 for a, b in zip(small[0].sizes, large[0].sizes))


def test_texts_that_fit_the_weights_are_in_the_tables_too(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(draw.choices(words, k=60)) for _ in range(300)]
    # number 3 fits the weights, number 4 doesn't: both were read once
    fitted, told, new = (-r.score for r in scores(spark, texts, [texts[3], texts[4], " ".join(draw.choices(words, k=60))]))
    assert fitted < 0.5 * (told + new)


def test_long_secrets_are_replaced_whole(spark):
    draw = random.Random(4)
    secrets = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789_.", k=n)) for n in (300, 300, 300, 5000)]
    texts = [f'token = "{secrets[0]}" x', f"secret: '{secrets[1]}' x", f"api_key={secrets[2]} x", f'password = "{secrets[3]}" x']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal.with_surrogates(docs, "k").collect():
        assert (r.pii_found, r.pii_kinds, len(r.text)) == (1, "login", len(texts[r.doc_id])) and r.text.endswith(" x")
        assert not any(secrets[r.doc_id][k : k + 20] in r.text for k in range(0, len(secrets[r.doc_id]) - 20))


def test_neither_driver_nor_workers_get_words_or_tables_whole(spark):
    texts = [" ".join(f"q{k}" for k in range(a, a + 1000)) for a in range(0, 50_000, 1000)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = mixing.train(docs, F.lit(False))
    sent = pickle.dumps((model.vocabulary.value, model.tables, model.learned))
    assert len(sent) < 50_000  # of 50,000 words; they and the tables are in files
    voc = model.vocabulary.value
    assert voc.counts.tolist() == [2] * 50_000 and (np.diff(voc.hashes.astype(float)) >= 0).all()
    assert voc.of_words([b"q0", b"q1", b"q10", b"nowhere", b"q9999"]).tolist() == [0, 1, 2, voc.escape, 49_999]


def test_codes_are_as_short_as_can_be(monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 5)
    draw = random.Random(7)
    for n in (0, 1, 2, 30, 200):
        counts = sorted((int(draw.paretovariate(0.8)) + 1 for _ in range(n)), reverse=True) + [7, 3]
        runs = sorted(((c, k, 1) for k, c in enumerate(counts)), key=lambda r: r[:2])
        up, depth = np.zeros(2 * len(counts) - 1, dtype=np.uint32), np.zeros(len(counts), dtype=np.uint8)
        mixing.huffman(runs, up, depth)
        heap, least = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            two = heapq.heappop(heap) + heapq.heappop(heap)
            least += two
            heapq.heappush(heap, two)
        assert sum(c * int(d) for c, d in zip(counts, depth)) == least
        grouped = [(c, counts.index(c), counts.count(c)) for c in sorted(set(counts[:n]) - {7, 3})]
        if n and sum(m for _, _, m in grouped) == n:  # a run at a time gives the same
            again, size = np.zeros_like(up), np.zeros_like(depth)
            mixing.huffman(sorted([*grouped, (7, n, 1), (3, n + 1, 1)], key=lambda r: r[:2]), again, size)
            assert (again == up).all() and (size == depth).all()


def test_slots_of_tables_beyond_32_bits():
    context, node = np.arange(1000, dtype=np.uint32), np.arange(1000, dtype=np.uint32) * np.uint32(77)
    slots = mixing.Contexts((33,), (0, 0)).slots(0, context, node)
    assert slots.min() >= 0 and (1 << 32) < slots.max() < 1 << 33 and len(np.unique(slots)) == 1000


def test_counts_are_told_alike_with_and_without_times():
    draw = np.random.default_rng(1)
    contexts = mixing.Contexts((16, 20, 33), (0, 1))
    slots, bits = [draw.integers(0, 1 << s, 3000) // 50 * 50 for s in contexts.sizes], draw.integers(0, 2, 3000).astype(np.int8)
    times = draw.integers(1, 5, 3000)
    found = []
    for rows, n in ((np.arange(3000), times), (np.repeat(np.arange(3000), times), None)):
        told = mixing.Told(contexts, 0)
        assert list(told.add(mixing.Decisions([s[rows] for s in slots], bits[rows], rows), n)) == []
        found.append(list(told.given()))
    assert found[0] == found[1] and sum(mixing.opened(c, "<i8").sum() for *_, c in found[0]) == 3 * times.sum()
    told = mixing.Told(contexts, 0)
    assert list(told.add(mixing.Decisions(slots, bits, np.arange(3000)), times * 0)) == [] and not any(mixing.opened(c, "<i8").any() for *_, c in told.given())


def test_a_task_adds_its_counts_before_it_sends_them(monkeypatch):
    monkeypatch.setattr(mixing, "HELD", 1000)
    draw = np.random.default_rng(2)
    contexts = mixing.Contexts((16, 28), (0, 1))
    slots, bits = [draw.integers(0, 1 << s, 500) for s in contexts.sizes], draw.integers(0, 2, 500).astype(np.int8)
    once, often = mixing.Told(contexts, 3), mixing.Told(contexts, 3)
    assert list(once.add(mixing.Decisions(slots, bits, np.arange(500)))) == []
    for _ in range(9):
        assert list(often.add(mixing.Decisions(slots, bits, np.arange(500)))) == []
    few, many = ({r[:2]: [mixing.opened(b, kind).tolist() for b, kind in zip(r[2:], ("<u4", "<i8"))] for r in t.given()} for t in (once, often))
    assert {k: [keys, [9 * n for n in counts]] for k, (keys, counts) in few.items()} == many


HOLDS = """
import numpy as np
from wayfold.llm import mixing

def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) / 1024 - told.size / 2**20

draw, contexts, first = np.random.default_rng(1), mixing.Contexts((20, 24, 24, 23), (1, 2)), 0
told = mixing.Told(contexts, 0)
for _ in range(80):
    n = int(draw.integers(300_000, 600_000))
    slots = [(draw.random(n) ** 6 * (1 << size)).astype(np.intp) for size in contexts.sizes]
    assert not list(told.add(mixing.Decisions(slots, draw.integers(0, 2, n).astype(np.int8), np.zeros(n, np.intp))))
    first = first or (held() if told.size else 0)
print(held() - first)
"""


def test_kept_counts_leave_a_workers_memory_usable():
    """MB by which a worker grows beyond the counts that it keeps, from the first that it keeps to the last."""
    said = subprocess.run([sys.executable, "-c", HOLDS], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True)
    assert float(said.stdout) < 180


def test_costs_are_those_of_a_plain_loop():
    draw, sizes = np.random.default_rng(0), [0, 3, 256, 257, 700, 512, 1, 0]
    slots = [(draw.normal(0, 1500, 1024).astype("<i2") << 2) | draw.integers(0, 4, 1024).astype("<i2") for _ in range(4)]
    m = mixing.Mixer(mixing.Contexts((10,) * 4, (1, 2)), slots, (draw.random((16, 4)) / 2).astype(np.float32), draw.normal(0, 1, (16, 33)).astype(np.float32))
    n, row = sum(sizes), np.repeat(np.arange(8), sizes)
    d = mixing.Decisions([draw.integers(0, 1024, n) for _ in range(4)], draw.integers(0, 2, n).astype(np.int8), row)
    found = m.costs(d, 8)
    for r in range(8):
        at, nats, moved, shift = np.flatnonzero(row == r).tolist(), 0.0, np.zeros(4), np.zeros(33)
        for k in range(0, len(at), mixing.SLICE):
            more, told = np.zeros(4), np.zeros(33)
            for i in at[k : k + mixing.SLICE]:
                raw = [int(t[s[i]]) for t, s in zip(slots, d.slots)]
                x, gate, bit = np.array([v >> 2 for v in raw]) / 512, (raw[1] & 3) * 4 + (raw[2] & 3), int(d.bits[i])
                mix = ((m.weights[gate] + moved) * x).sum()
                level = int(min(max(mix * 2 + 16.5, 0), 32))
                final = (mix + m.map[gate, level] + shift[level]) / 2
                nats += math.log1p(math.exp(-final if bit else final))
                more += (bit - 1 / (1 + math.exp(-mix))) * x
                told[level] += bit - 1 / (1 + math.exp(-final))
            moved, shift = moved + mixing.STEP * more, shift + mixing.MAP_STEP * told
        assert abs(found[r] - nats) < 1e-5 * max(nats, 1)
