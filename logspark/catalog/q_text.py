"""TF-IDF and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import tfidf
from ..session import materialize, scratch_path
from ..sources import models, stores
from . import query, sqlparts as D
from .inputs import spread, table


_STOP = ", ".join(D.q(word) for word in P.ENGLISH_STOP_WORDS)
_TOKENS = f"""toks AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w
  FROM documents)"""
_BOTH = "list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"


def _vocab(terms, size, min_df, max_df):
    return f"""{_TOKENS}, tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms}) AS term FROM toks) GROUP BY 1, 2
), n AS (SELECT count(*) AS n FROM documents), kept AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS doc_count FROM tf GROUP BY 1
  HAVING count(*) >= {min_df} AND count(*) <= (SELECT n FROM n) * {max_df}
  ORDER BY corpus_count DESC, term LIMIT {size}
), vocab AS MATERIALIZED (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index, corpus_count, doc_count,
    ln((1.0::DOUBLE + (SELECT n FROM n)) / (1 + doc_count)) + 1 AS idf FROM kept)"""


def _weights(tf_expression):
    return f""", raww AS (
  SELECT doc_id, tf.term, term_index, ({tf_expression}) * idf AS w FROM tf JOIN vocab ON vocab.term = tf.term
), weights AS MATERIALIZED (
  SELECT doc_id, term, term_index, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raww)"""


_MAIN = _vocab(_BOTH, 5000, 1, 0.95)
_SUB = _weights("1 + ln(tf)")


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def fitted(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs, tfidf.tfidf_fit(docs, "doc_id", "text")


@query("tfidf_fit", f"WITH {_MAIN} SELECT term, term_index, corpus_count, doc_count, round(idf, 6) AS idf FROM vocab")
def tfidf_fit(spark, sf_dir):
    return fitted(spark, sf_dir)[1].withColumn("idf", F.round("idf", 6)).withColumn(
        "term_index", F.col("term_index").cast("bigint"))


@query("tfidf_transform", f"WITH {_MAIN}{_SUB} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_transform(spark, sf_dir):
    docs, vocabulary = fitted(spark, sf_dir)
    weights = tfidf.tfidf_transform(docs, vocabulary, "doc_id", "text")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_transform_new_texts", f"""WITH {_MAIN}, tf2 AS (
  SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_BOTH}) AS term FROM (
    SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w
    FROM benchmark)) GROUP BY 1, 2
), r2 AS (SELECT item_id, tf2.term, (1 + ln(tf)) * idf AS w FROM tf2 JOIN vocab ON vocab.term = tf2.term)
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM r2""")
def tfidf_transform_new_texts(spark, sf_dir):
    """Texts the vocabulary was not fitted on."""
    _, vocabulary = fitted(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark")
    weights = tfidf.tfidf_transform(items, vocabulary, "item_id", "text")
    return weights.select("item_id", "term", F.round("weight", 6).alias("weight"))


@query("top_terms", f"""WITH {_MAIN}{_SUB} SELECT term, round(sum(weight) / (SELECT n FROM n), 6) AS mean_weight
FROM weights GROUP BY 1 ORDER BY sum(weight) DESC, 1 LIMIT 20""")
def top_terms(spark, sf_dir):
    docs, vocabulary = fitted(spark, sf_dir)
    weights = tfidf.tfidf_transform(docs, vocabulary, "doc_id", "text")
    top = tfidf.top_terms(weights, docs)
    return top.select("term", F.round("mean_weight", 6).alias("mean_weight"))


@query("svd_features")
def svd_features(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocabulary = tfidf.tfidf_fit(docs, "doc_id", "text", max_features=10_000, min_df=2)
    vectors = tfidf.tfidf_vectors(docs, vocabulary, "doc_id", "text", max_features=10_000)
    made = tfidf.svd_features(vectors, "doc_id", 10_000, k=300)
    return made.select("doc_id", F.posexplode("features").alias("dim", "value"))


_WORDS = _vocab("w", 5000, 2, 1.0)


@query("sentence_embedding", f"""WITH {_WORDS}{_weights("tf")}, chars AS (
  SELECT term, unnest(string_split(substr(term, 1, 297), '')) AS c, generate_subscripts(string_split(substr(term, 1, 297), ''), 1) - 1 AS dim FROM vocab
), vecs AS (
  SELECT term, dim, unicode(c) / 255 AS value FROM chars
  UNION ALL SELECT term, 297, length(term) / 20 FROM vocab
  UNION ALL SELECT term, 298, 1.0::DOUBLE FROM vocab WHERE contains(term, '@')
  UNION ALL SELECT term, 299, 1.0::DOUBLE FROM vocab WHERE regexp_matches(term, '^\\p{{Nd}}+$')
), share AS (SELECT doc_id, term, weight / sum(weight) OVER (PARTITION BY doc_id) AS s FROM weights)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(sum(s * value), 6) AS value FROM share JOIN vecs ON vecs.term = share.term GROUP BY 1, 2""")
def sentence_embedding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocabulary = tfidf.tfidf_fit(
        docs, "doc_id", "text", ngrams=(1, 1), min_df=2, max_df=1.0)
    weights = tfidf.tfidf_transform(
        docs, vocabulary, "doc_id", "text", ngrams=(1, 1), sublinear=False)
    made = tfidf.sentence_embedding(weights, vocabulary, "doc_id")
    return made.select("doc_id", "dim", F.round("value", 6).alias("value"))


_SCALED = """
WITH long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY 1)
SELECT vec_id, CAST(long.dim AS INTEGER) AS dim, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS value
FROM long JOIN s ON s.dim = long.dim"""


@query("standardize", _SCALED)
def standardize(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = tfidf.standardize(vectors, "embedding")
    return scaled.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("save_load_scaler", _SCALED)
def save_load_scaler(spark, sf_dir):
    """The vectors scaled by a saved and loaded scaler."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = scratch_path(spark, "scaler")
    stores.save_tables(path, scaler=tfidf.scaler_fit(vectors, "embedding"))
    scaled = tfidf.scale(vectors, "embedding", stores.load_table(spark, path, "scaler"))
    return scaled.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("save_load_svd", """SELECT count(*) AS texts, true AS same_components, true AS same_coordinates FROM documents""")
def save_load_svd(spark, sf_dir):
    """Scaled coordinates of all texts by a saved and loaded SVD against those by the fitted one."""
    docs = documents(spark, sf_dir)
    vocabulary = materialize(tfidf.tfidf_fit(docs, "doc_id", "text", max_features=10_000, min_df=2))
    vectors = materialize(tfidf.tfidf_vectors(docs, vocabulary, "doc_id", "text", max_features=10_000))
    components, values = tfidf.svd_components(vectors, 10_000, 300)
    first = materialize(tfidf.project(vectors, "doc_id", components))
    scaler = tfidf.scaler_fit(first, "features")
    path = scratch_path(spark, "svd")
    models.save_svd(spark, path, components, values, scaler)
    loaded, found, kept = models.load_svd(spark, path)
    second = tfidf.scale(tfidf.project(vectors, "doc_id", loaded), "features", kept)
    joined = tfidf.scale(first, "features", kept).join(
        second.select("doc_id", F.col("features").alias("_again")), "doc_id")
    apart = F.exists(F.arrays_zip("features", "_again"), lambda z: F.abs(z["features"] - z["_again"]) > 1e-9)
    same = bool((loaded == components).all() and (found == values).all())
    return joined.agg(
        F.count(F.lit(1)).alias("texts"), F.lit(same).alias("same_components"),
        (~F.max(apart)).alias("same_coordinates"))
