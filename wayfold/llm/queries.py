"""The queries of this subpackage, each applied to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import audit, bpe, codes, mixing, packing, personal, phrases, simhash, sketches, substrings, toxicity, urls, vectors
from wayfold.sources.shared import shared_dir

URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

#: A deployment passes its own secret; a fixed one keeps these queries' results the same.
SURROGATE_KEY = "wayfold"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(remainder(4) != 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, training_labels(labels))
    return toxicity.toxicity(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return found.select("doc_id", "text", "pii_found", "pii_kinds")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN), vocabulary)
    said = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "alike_edited", "alike_next")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs.where(remainder(7) != 2), remainder(7) == mixing.FIT)
    held = F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out")
    return mixing.score(docs, model).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    codes.write_codes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return codes.digests_of(codes.read_codes(spark, path))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def rules_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5_urls: the parts of each URL and the rule that decides it."""
    return op5_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_substrings, op4_personal, op5_urls, op6_vectors, op7_bpe, op8_sketches, op9_mixing, op10_simhash, op11_codes, op12_audit, op13_phrases, rules_of_urls)}

#: DuckDB SQL for what SQL can say; the others are compared with brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_substrings": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        win AS MATERIALIZED (SELECT doc_id, k, words[k:k + 49] AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS k FROM w WHERE len(words) >= 50)),
        early AS (SELECT win, min(doc_id) AS first_id FROM win GROUP BY win HAVING count(DISTINCT doc_id) > 1),
        gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 49)) AS k FROM win JOIN early USING (win) WHERE doc_id > first_id),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS k FROM w),
        kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY e.doc_id)
        SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op6_vectors": r"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        low AS (SELECT b, min(a) AS m FROM reach GROUP BY b), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN low ON low.b = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op12_audit": r"""WITH known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        fails AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
            coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM texts),
        masks AS MATERIALIZED (SELECT part, [a, b, c, d, e] AS f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
        letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letter p, letter q, letter r, letter s, letter t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (SELECT o, k, o[k] AS own, list_transform(generate_series(1, k - 1), lambda i: ascii(o[i]) - 64) AS before FROM orders, generate_series(1, 5) g(k)),
        each AS (SELECT part, o, k, own, n, good, toxic, f[ascii(own) - 64] AS failed, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS single FROM masks, steps),
        told AS (SELECT part, o AS filter_order, k::INT AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (failed AND single), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost FROM each GROUP BY part, o, k, own)
        SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told""",
    "op13_phrases": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        said AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, unnest(list_concat(w, list_concat(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS phrase FROM said),
        f AS MATERIALIZED (SELECT lang, phrase, count(*) AS c, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 10),
        words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
        cuts AS (SELECT f.lang, f.phrase, f.w, f.c AS a, k, array_to_string(f.w[:k], ' ') AS front, array_to_string(f.w[k + 1:], ' ') AS rest FROM f, generate_series(1, 2) g(k) WHERE k < len(f.w)),
        scored AS (SELECT cuts.*, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = front JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, c FROM f WHERE len(w) = 3),
        free AS (SELECT * FROM lowest WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = lowest.lang AND longer.phrase = lowest.phrase AND 100 * longer.c >= 50 * lowest.a))
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free) JOIN words USING (lang) WHERE rank <= 2000""",
    "rules_of_urls": r"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        said(rule, rule_host, rule_path) AS (VALUES ('com/en/', 'com', '/en/'), ('example.com/en/7', 'example.com', '/en/7'), ('net/de/', 'net', '/de/'), ('example.net/de/8', 'example.net', '/de/8'), ('org/es/', 'org', '/es/'))
        SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule FROM p LEFT JOIN said ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id""",
}
