"""Outlier models, confidence, the grid, ensembles and hybrids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.confidence import ml_confidence
from ..operators import evaluate, forest, fuse, grid, neighbours, oneclass, tfidf
from ..session import materialize, scratch_path
from ..sources import models
from . import query, sqlparts as D
from .inputs import raw_logs, spread, table


def vectors(spark, sf_dir):
    """Embeddings, scaled per dimension."""
    rows = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return tfidf.standardize(rows, "embedding", "vector").drop("embedding")


def plain_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


@query("isolation_forest_fit")
def isolation_forest_fit(spark, sf_dir):
    made = forest.isolation_forest_fit(
        materialize(vectors(spark, sf_dir).select("vec_id", "vector")), "vec_id", 64)
    return made.nodes.select("tree", "node", "feature", "threshold", "path")


@query("isolation_forest_score")
def isolation_forest_score(spark, sf_dir):
    rows = materialize(vectors(spark, sf_dir).select("vec_id", "vector"))
    made = forest.isolation_forest_fit(rows, "vec_id", 64)
    return forest.isolation_forest_score(rows, "vec_id", made)


@query("isolation_forest_text")
def isolation_forest_text(spark, sf_dir):
    """The forest over TF-IDF rows of the documents, with confidences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = materialize(tfidf.tfidf_fit(docs, "doc_id", "text"))
    weights = tfidf.tfidf_transform(docs, vocabulary, "doc_id", "text")
    sparse = docs.join(tfidf.sparse_vectors(weights, "doc_id"), "doc_id", "left")
    rows = materialize(sparse.withColumns({
        "empty": F.col("positions").isNull(),
        "positions": F.coalesce("positions", F.array().cast("array<int>")),
        "values": F.coalesce("values", F.array().cast("array<double>")),
    }))
    made = forest.isolation_forest_fit(rows.drop("text", "empty"), "doc_id", 5000)
    scored = forest.isolation_forest_score(rows, "doc_id", made)
    return scored.withColumns(ml_confidence(
        F.col("score"), F.col("flagged"), F.col("empty"), F.col("text"))).drop("text")


_STRONG = "len(list_filter([" + ", ".join(D.q(w) for w in P.STRONG_WORDS) + "], lambda w: contains(lower(line), w)))"
_CONFIDENCE = D.RAW + f""", sc AS (
  SELECT r.line_no, line, value / 400 - 0.25::DOUBLE AS score, event_type = 'signup' AS empty, {_STRONG} AS hits
  FROM raw_logs r JOIN events e ON e.event_id = r.line_no
), base AS (
  SELECT *, least(greatest((score + 0.3::DOUBLE) / 0.5::DOUBLE, 0), 1) AS scaled FROM sc
), curve AS (
  SELECT *, least(greatest(1 / (1 + exp(-4 * ((CASE WHEN score < 0 THEN 1 - scaled ELSE scaled * 0.6::DOUBLE + 0.1::DOUBLE END) - 0.5::DOUBLE))), 0.1::DOUBLE), 0.9::DOUBLE) AS b FROM base)
SELECT line_no, CASE WHEN score < 0 OR empty OR hits > 0 THEN 'Anomaly' ELSE 'Normal' END AS ml_prediction,
  round(CASE WHEN empty THEN greatest(b, 0.92::DOUBLE) WHEN hits > 0 THEN least(greatest(b, 0.6::DOUBLE) + least(hits * 0.1::DOUBLE + 0.15::DOUBLE, 0.4::DOUBLE), 0.95::DOUBLE) ELSE b END, 2) AS confidence FROM curve"""


@query("ml_confidence", f"WITH {_CONFIDENCE}")
def confidence(spark, sf_dir):
    """Event values stand in for scores, sign-ups for texts without known terms."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"), (F.col("value") / 400 - 0.25).alias("score"),
        (F.col("event_type") == "signup").alias("empty"))
    rows = raw_logs(spark, sf_dir).select("line_no", "line").join(events, "line_no")
    return rows.withColumns(ml_confidence(
        F.col("score"), F.col("score") < 0, F.col("empty"), F.col("line"),
    )).select("line_no", "ml_prediction", "confidence")


_KNN = """d AS (
  SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b
), fitk AS MATERIALIZED (
  SELECT * FROM d WHERE q <> r QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, r) <= 10
), kd AS (SELECT q, max(dist) AS kd FROM fitk GROUP BY 1),
lrd AS MATERIALIZED (SELECT f.q, 1 / (avg(greatest(dist, kd.kd)) + 1e-10) AS lrd FROM fitk f JOIN kd ON kd.q = f.r GROUP BY 1)"""


@query("lof_fit", f"""WITH {_KNN}
SELECT f.q AS vec_id, round(avg(o.lrd) / any_value(s.lrd), 6) AS factor FROM fitk f JOIN lrd o ON o.q = f.r JOIN lrd s ON s.q = f.q GROUP BY 1""")
def lof_fit(spark, sf_dir):
    rows = plain_vectors(spark, sf_dir)
    points = materialize(neighbours.distinct_points(rows, "vec_id", "vector"))
    fitted = neighbours.lof_fit(points, 10).select("rep", "factor")
    made = neighbours.back_to_rows(rows, "vec_id", "vector", points, fitted)
    return made.select("vec_id", F.round("factor", 6).alias("factor"))


@query("lof", f"""WITH {_KNN}, newk AS (
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, r) <= 10
), newlrd AS (SELECT n.q, 1 / (avg(greatest(dist, kd.kd)) + 1e-10) AS lrd FROM newk n JOIN kd ON kd.q = n.r GROUP BY 1)
SELECT n.q AS vec_id, round(avg(o.lrd) / any_value(s.lrd), 6) AS factor FROM newk n JOIN lrd o ON o.q = n.r JOIN newlrd s ON s.q = n.q GROUP BY 1""")
def lof(spark, sf_dir):
    """Novelty mode: the rows are scored as new points against the fitted set."""
    rows = plain_vectors(spark, sf_dir)
    points = materialize(neighbours.distinct_points(rows, "vec_id", "vector"))
    reference = materialize(neighbours.lof_fit(points, 10))
    scores = neighbours.lof_score(points, points, reference, 10)
    made = neighbours.back_to_rows(rows, "vec_id", "vector", points, scores)
    return made.select("vec_id", F.round("factor", 6).alias("factor"))


@query("one_class_svm")
def one_class_svm(spark, sf_dir):
    rows = materialize(vectors(spark, sf_dir).select("vec_id", "vector"))
    model = oneclass.one_class_fit(rows, "vec_id", "vector")
    return oneclass.one_class_margins(rows, "vec_id", "vector", model)


def _small_grid(spark, sf_dir):
    rows = materialize(vectors(spark, sf_dir))
    made = grid.model_grid(rows, "vec_id", "vector")
    return rows, made


@query("model_grid")
def model_grid(spark, sf_dir):
    return _small_grid(spark, sf_dir)[1].offsets


@query("score_grid")
def score_grid(spark, sf_dir):
    rows, made = _small_grid(spark, sf_dir)
    return grid.score_grid(rows, made, "vector")


@query("save_load_grid", """SELECT family, models * (SELECT count(*) FROM embeddings)::BIGINT AS verdicts, models, true AS same
FROM (VALUES ('IsolationForest', 27::BIGINT), ('LOF', 9::BIGINT), ('OneClassSVM', 24::BIGINT)) AS t(family, models)""")
def save_load_grid(spark, sf_dir):
    """Per family, whether a saved and loaded grid of 60 models gives the fitted one's verdicts."""
    rows, made = _small_grid(spark, sf_dir)
    path = scratch_path(spark, "grid")
    models.save_grid(path, made)
    first = grid.score_grid(rows, made, "vector")
    second = grid.score_grid(rows, models.load_grid(spark, path), "vector").select(
        "vec_id", "model", F.col("score").alias("_score"), F.col("pred").alias("_pred"))
    same = (F.abs(F.col("score") - F.col("_score")) < 1e-9) & (F.col("pred") == F.col("_pred"))
    return first.join(second, ["vec_id", "model"]).groupBy("family").agg(
        F.count(F.lit(1)).alias("verdicts"), F.count_distinct("model").alias("models"),
        F.min(same).alias("same"))


@query("predict_grid")
def predict_grid(spark, sf_dir):
    """Metrics per model, label 0 of the embeddings standing for the anomalies."""
    rows, made = _small_grid(spark, sf_dir)
    labels = rows.select("vec_id", (F.col("label") == 0).cast("int").alias("truth"))
    scores = materialize(grid.score_grid(rows, made, "vector"))
    return grid.evaluate_grid(scores, labels, "vec_id", "truth")


# Three "models" over the events: thresholds on value and on the user number.
_VOTES = """votes AS (SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS a, CASE WHEN user_id > 75 THEN 1 ELSE 0 END AS b,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS c, 100 - value AS sa, CAST(75 - user_id AS DOUBLE) AS sb FROM events)"""


def voted(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    models = F.array(
        F.struct(F.lit("A").alias("model"), (F.col("value") > 100).cast("int").alias("pred"),
                 (100 - F.col("value")).alias("score")),
        F.struct(F.lit("B").alias("model"), (F.col("user_id") > 75).cast("int").alias("pred"),
                 (75 - F.col("user_id")).cast("double").alias("score")),
        F.struct(F.lit("C").alias("model"), (F.col("event_type") == "error").cast("int").alias("pred"),
                 F.lit(0.0).alias("score")),
    )
    return events.select("event_id", F.inline(models))


@query("ensemble_majority", f"WITH {_VOTES} SELECT event_id, CASE WHEN a + b + c > 1.5 THEN 1 ELSE 0 END AS ensemble_pred FROM votes")
def ensemble_majority(spark, sf_dir):
    return grid.ensemble(voted(spark, sf_dir), "event_id")


@query("ensemble_average", f"""WITH {_VOTES}, m AS (SELECT event_id, (sa + sb) / 3 AS mean FROM votes)
SELECT event_id, round(mean, 6) AS mean_score, CASE WHEN mean < (SELECT median(mean) FROM m) THEN 1 ELSE 0 END AS ensemble_pred FROM m""")
def ensemble_average(spark, sf_dir):
    made = grid.ensemble(voted(spark, sf_dir), "event_id", "average_score")
    return made.withColumn("mean_score", F.round("mean_score", 6))


# A verdict, a rule score of 0 to 100 and a sequence score per event.
_PARTS = """parts AS (SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS ml_pred, CAST(user_id % 6 * 20 AS DOUBLE) AS rule_score,
  least(value / 200, 1) AS ml_score, CASE WHEN event_type = 'error' THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS sequence_score FROM events)"""


def scored_parts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") > 100).cast("int").alias("ml_pred"),
        (F.col("user_id") % 6 * 20).cast("double").alias("rule_score"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("ml_score"),
        F.when(F.col("event_type") == "error", 0.9).otherwise(0.2).alias("sequence_score"))


def _hybrid_sql(verdict, cut):
    return f"""WITH {_PARTS}, h AS (SELECT event_id, rule_score, ({verdict}) * 0.6::DOUBLE + rule_score / 100 * 0.4::DOUBLE AS s FROM parts)
SELECT event_id, round(s, 6) AS hybrid_score, CASE WHEN s > (SELECT {cut} FROM h) THEN 1 ELSE 0 END AS hybrid_pred FROM h"""


_CUT90 = "quantile_cont(s, 0.9)"
_ADAPTIVE = "CASE WHEN avg(rule_score / 100) > 0.05 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END"


def _hybrid(name, sql, **options):
    def run(spark, sf_dir):
        made = fuse.hybrid(scored_parts(spark, sf_dir), **options)
        return made.select("event_id", F.round("hybrid_score", 6).alias("hybrid_score"), "hybrid_pred")

    query(name, sql)(run)


_hybrid("hybrid_weighted", _hybrid_sql("ml_pred", _CUT90))
_hybrid("hybrid_weighted_reference", _hybrid_sql("1 - ml_pred", _CUT90), reference_formula=True)
_hybrid("hybrid_adaptive", _hybrid_sql("ml_pred", _ADAPTIVE), method="adaptive_threshold")
_hybrid("hybrid_adaptive_reference", _hybrid_sql("1 - ml_pred", _ADAPTIVE),
        method="adaptive_threshold", reference_formula=True)


def _fused_sql(weights, limit, sign):
    a, b, c = weights
    return f"""WITH {_PARTS}, f AS (SELECT event_id, ml_score AS best, ml_score * 0.6::DOUBLE + sequence_score * 0.4::DOUBLE AS seq,
  ml_score * 0.7::DOUBLE + rule_score / 100 * 0.3::DOUBLE AS rul, ml_score * {a}::DOUBLE + rule_score / 100 * {b}::DOUBLE + sequence_score * {c}::DOUBLE AS ful FROM parts)
SELECT event_id, round(seq, 6) AS ml_sequence_score, round(rul, 6) AS ml_rules_score, round(ful, 6) AS full_score,
  CASE WHEN best {sign} (SELECT quantile_cont(best, 0.9) FROM f) THEN 1 ELSE 0 END AS ml_best_pred,
  CASE WHEN seq {sign} (SELECT quantile_cont(seq, 0.9) FROM f) THEN 1 ELSE 0 END AS ml_sequence_pred,
  CASE WHEN rul > 0.5 THEN 1 ELSE 0 END AS ml_rules_pred, CASE WHEN ful > {limit} THEN 1 ELSE 0 END AS full_pred FROM f"""


def _fused(name, sql, **options):
    def run(spark, sf_dir):
        made = fuse.fused_scores(scored_parts(spark, sf_dir), **options)
        scores = ("ml_sequence_score", "ml_rules_score", "full_score")
        return made.select("event_id", *[F.round(c, 6).alias(c) for c in scores],
                           "ml_best_pred", "ml_sequence_pred", "ml_rules_pred", "full_pred")

    query(name, sql)(run)


_fused("fused_scores", _fused_sql((0.4, 0.3, 0.3), 0.5, ">"))
_fused("fused_scores_reference", _fused_sql((0.4, 0.3, 0.3), 0.5, "<"), reference_formula=True)
_fused("fused_scores_small", _fused_sql((0.5, 0.3, 0.2), 0.4, ">"), small=True)
