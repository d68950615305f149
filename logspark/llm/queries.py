"""Registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    ann, bpe, chat, divergence, langid, mixing, negatives, quality, rules, secrets, sharding, simhash, toxicity)
from .common import fold, held_out, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_chat_snapshots(spark, sf_dir):
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op2_multi_index_hashing(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, "vec_id", "embedding", F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_naive_bayes_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(fold("doc_id", 3) != 1), "text", "lang")
    found = langid.predict(documents, "doc_id", "text", model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op4_secret_forest(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(documents.select("doc_id", "text"), "text", model)
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"),
        F.array_join("secrets", "\n").alias("secrets"), F.sha2("redacted", 256).alias("redacted_sha256"))


def op5_toxicity_grammar(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, "doc_id", "text", "toxic", fold("doc_id", 5) != 0)
    found = toxicity.predict(documents, "doc_id", "text", model)
    return found.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "clause_weight")


def op6_positive_unlabelled_quality(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels, "doc_id", "text", "quality", fold("doc_id", 3) != 1)
    found = quality.predict(documents, "doc_id", "text", model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op7_byte_bpe(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return bpe.digests(documents, "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_simhash_gray(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 4)


def op9_weak_supervision(spark, sf_dir):
    return rules.judge(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_low_discrepancy_mix(spark, sf_dir):
    planned = mixing.plan(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op11_rendezvous_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 24, grown=1.0)


def op12_secondary_sort_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.prepare(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_chat_snapshots, op2_multi_index_hashing, op3_naive_bayes_language, op4_secret_forest,
    op5_toxicity_grammar, op6_positive_unlabelled_quality, op7_byte_bpe, op8_simhash_gray,
    op9_weak_supervision, op10_low_discrepancy_mix, op11_rendezvous_sharding,
    op12_secondary_sort_negatives, op13_source_divergence, pipeline)}


def _crc32(blob: str) -> str:
    """CRC-32 of a blob in SQL: its bytes folded over the table of the reflected polynomial."""
    table_ = []
    for entry in range(256):
        for _ in range(8):
            entry = (entry >> 1) ^ (0xEDB88320 if entry & 1 else 0)
        table_.append(entry)
    steps = f"[{', '.join(map(str, table_))}]::BIGINT[]"
    return f"""xor(4294967295::BIGINT, coalesce(list_reduce(
      list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(({steps})[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT))"""


ORACLES = {
    "op1_chat_snapshots": """
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM once GROUP BY 1),
firsts AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY 1),
prefixes AS (SELECT DISTINCT l[1:k] AS p FROM firsts, generate_series(1, len(l) - 1) AS g(k)),
kept AS (SELECT * FROM firsts WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE p = l))
SELECT conv_id, 0::BIGINT AS part, len(l)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
  array_to_string(list_transform(l, lambda t: '<|im_start|>' || replace(coalesce(t.role, ''), '<|', '< |') || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM kept""",
    "op11_rendezvous_sharding": f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, coalesce('k' || doc_id, 'null') AS k FROM documents),
sized AS (SELECT doc_id, k, octet_length(b)::BIGINT + 8 AS size, {_crc32('b')} AS text_crc32 FROM d),
draws AS (SELECT k, s::INTEGER AS s, ('0x' || substr(md5(k || '/' || (s // 4)), 1 + 8 * (s % 4), 8))::BIGINT AS draw
  FROM (SELECT DISTINCT k FROM d), range(25) AS r(s)),
ranked AS (SELECT k, s, row_number() OVER (PARTITION BY k, s < 24 ORDER BY draw DESC, s) AS old,
  row_number() OVER (PARTITION BY k ORDER BY draw DESC, s) AS new FROM draws),
best AS (SELECT k, max(s) FILTER (old = 1 AND s < 24) AS shard, max(s) FILTER (new = 1) AS grown_shard FROM ranked GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot, grown_shard
FROM sized JOIN best USING (k)""",
    "op12_secondary_sort_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM e WHERE id % 100 = 0) AS a JOIN e AS b ON a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 5""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1),
c AS (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(c.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) AS s LEFT JOIN v ON s.lang = v.lang
  LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n::HUGEINT + v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM f AS a JOIN f AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM f WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
