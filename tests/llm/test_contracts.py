"""Every query of the subpackage against a brute-force version, on one of the small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from wayfold.llm import bpe, queries, urls, vectors


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op1_packing(spark, sf, documents):
    found = queries.op1_packing(spark, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == {d for d, _ in documents}
    for doc, text in documents:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & at - 1 == 0 else 2048 - at
    assert padding == 0


def test_op2_toxicity(spark, sf, documents):
    found = {r.doc_id: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in found.items())
    held = [(found[d].score, t) for d, t in labels.items() if found[d].held_out]
    toxic, fine = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in toxic for b in fine]) > 0.85


def test_op3_substrings(spark, sf, documents):
    first = {}
    every = [(d, words_of(t)) for d, t in documents]
    for d, w in every:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    found = {r.doc_id: r for r in queries.op3_substrings(spark, sf).collect()}
    assert len(found) == len(every)
    total = 0
    for d, w in every:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (found[d].n_words, found[d].n_removed, found[d].kept_sha256) == (len(w), len(gone), sha(kept)), d
        total += len(gone)
    assert total


def test_op4_personal(spark, sf, documents):
    found = {r.doc_id: r for r in queries.op4_personal(spark, sf).collect()}
    patterns = [r"[\w.]+@[\w.]+", r"\b\d{16}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"AKIA[0-9A-Z]{16}", r"password=\w+", r'token = "\w+"']
    mapped, seen = {}, 0
    for d, text in documents:
        new = found[d].text
        for p in patterns:
            a, b = re.findall(p, text), re.findall(p, new)
            assert len(a) == len(b), (d, p)
            for x, y in zip(a, b):
                assert x != y and mapped.setdefault(x, y) == y
                assert [c.isdigit() for c in x] == [c.isdigit() for c in y] or "." in x or "@" in x
                seen += 1
        if not re.search(r"[0-9@]|password|token", text):
            assert new == text and found[d].pii_found == 0
    assert seen and len(set(mapped.values())) == len(mapped)


def test_op5_urls(spark, sf):
    said = queries.URL_RULES
    for r in queries.op5_urls(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), "page_id").collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fitting = [t for t in said if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        rule = max(fitting, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (said[rule] if rule else "block" if r.score >= 0.5 else "allow")


def test_op5_trees_learn():
    rng = np.random.default_rng(5)
    known = [(f"http://{'a' * rng.integers(1, 9)}.org/{'/'.join('x' * k for k in rng.integers(1, 5, 3))}" + "?a=1&b=2" * (y := int(rng.random() < 0.4)), y) for _ in range(600)]
    model = urls.train(known[:400])
    x = np.array([urls.features(u, *urls.parts(u), model.rates) for u, _ in known[400:]])
    assert np.mean((model.trees.score(x) >= 0.5) == np.array([y for _, y in known[400:]])) > 0.97


def test_op5_judges_urls_that_it_has_not_seen(spark):
    rng = np.random.default_rng(6)

    def url(bad):
        host = f"{'x' * rng.integers(2, 9)}{rng.integers(1000) if bad else ''}.{'com/en' if bad else 'net/de'}"
        return f"http://{host}/{rng.integers(10**6)}" + (f"?id={rng.integers(10**9)}&s={rng.integers(10**9)}" if bad else "/about")

    seen = [url(k % 2) for k in range(600)] + ["http://a.net/de/1"] * 30_000  # one URL many times fills no sample
    held = [(url(k % 2).replace("/en/", "/xx/").replace("/de/", "/yy/"), k % 2) for k in range(200)]
    rows = list(enumerate(seen + [u for u, _ in held]))
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert all(found[len(seen) + k].rule is None for k in range(200))
    assert np.mean([(found[len(seen) + k].verdict == "block") == bool(bad) for k, (_, bad) in enumerate(held)]) > 0.95


def test_op6_vectors(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links = vectors.brute_force(rows)
    found = {r.vec_id: r for r in queries.op6_vectors(spark, sf).collect()}
    assert len(found) == len(rows)
    total = sum(map(len, links.values()))
    assert all(found[i].n_links <= len(v) for i, v in links.items())
    assert sum(r.n_links for r in found.values()) >= 0.97 * total
    expected = components(links, [(a, b) for a, v in links.items() for b in v])
    assert np.mean([found[i].component_id == c for i, c in expected.items()]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_op7_bpe(spark, sf, documents):
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in queries.op7_bpe(spark, sf).collect()}
    for d, text in documents:
        ids = plain.encode_ordinary(text or "")
        assert (found[d].n_tokens, found[d].ids_sha256, found[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text or "")), d


def plain_sketch(text):
    """Digest and retained shingle hashes by whole numbers: a polynomial of the words' hashes, mixed, below half the range."""
    mask, words, out = (1 << 64) - 1, (text or "").encode().split(), set()
    width = min(5, len(words))
    h = [xxhash.xxh64_intdigest(w) for w in words]
    for k in range(len(words) - width + 1 if words else 0):
        x = sum(h[k + j] * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(width)) & mask
        for shift in (32, 29):
            x = ((x ^ x >> shift) * 0xD6E8FEB86659FD93) & mask
        x ^= x >> 32
        if x < 1 << 63:
            out.add(x)
    return xxhash.xxh3_128_hexdigest((text or "").encode()), out


def contained(a, b):
    return 1.0 if a[0] == b[0] else len(a[1] & b[1]) / min(len(a[1]), len(b[1])) if a[1] and b[1] else 0.0


def test_op8_sketches(spark, sf, documents):
    found = {r.doc_id: r for r in queries.op8_sketches(spark, sf).collect()}
    assert len(found) == len(documents)
    equal = {}
    for k, (d, text) in enumerate(documents):
        after = documents[k - 1][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
        assert equal.setdefault(text, r.fingerprint) == r.fingerprint
        own, other = plain_sketch(text), plain_sketch(edited)
        for said, (digest, hashes) in ((r.fingerprint, own), (r.edited_fingerprint, other)):
            assert said == digest + ":" + "".join(f"{x:016x}" for x in sorted(hashes))
        assert (r.near_edited, r.near_next) == (contained(own, other), contained(own, plain_sketch(after)))
    assert 0.3 < np.mean([r.near_edited for r in found.values()]) < 0.8


def test_op10_simhash(spark, sf, documents):
    def fingerprint(text):
        w = words_of(lowered(text))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: fingerprint(t) for d, t in documents}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = components(prints, linked)
    found = queries.op10_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{prints[d]:016x}", expected[d]) for d in prints}
    assert len(found) == len(prints)


def test_op9_mixing(spark, sf, documents):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [None] for d, t in documents}
    train = [d for d, _ in documents if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for d in train for w in tokens[d])
    total, distinct = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in queries.op9_mixing(spark, sf).collect()}
    assert len(found) == len(documents)
    for d, _ in documents:
        r = found[d]
        assert r.held_out == (d not in train) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens[d]), sum(w in counts for w in tokens[d]))
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[d])) < 1e-6 * len(tokens[d])
        assert r.score < 0
    held = [r for r in queries.op9_mixing(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.bits_per_byte * r.n_tokens for r in held) / sum(r.n_tokens for r in held) < 2.7
