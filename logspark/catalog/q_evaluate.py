"""Labels, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import evaluate, parse, rules
from . import query, sqlparts as D
from .inputs import raw_logs, table
from .q_rules import ruled

_PHRASES = [p.replace(P.WORD_START, r"\b").replace(P.WORD_END, r"\b") for p in P.SILVER_PHRASES]
SILVER = D.RULED + f""", silver AS (
  SELECT *, CASE WHEN dataset_label IN (0, 1) THEN dataset_label
    WHEN rule_name IS NOT NULL OR upper(log_level) IN ('ERROR', 'CRITICAL', 'FATAL')
      OR {D.any_like('lower(said)', P.SILVER_WORDS)} OR {D.matches('lower(said)', _PHRASES)} THEN 1 ELSE 0 END AS silver
  FROM hits)"""


@query("silver_labels", f"WITH {SILVER} SELECT id, CAST(silver AS INTEGER) AS silver FROM silver")
def silver_labels(spark, sf_dir):
    return evaluate.silver_labels(ruled(spark, sf_dir)).select("id", "silver")


# The feature record has no parsed address, so the rules look for one in the content.
_RECORD_RULES = f"""({D.rule_flag('brute_force', 'lower(content)')} OR {D.rule_flag('database_connection_failure', 'lower(content)')}
  OR {D.rule_flag('unauthorized_access', 'lower(content)')} OR {D.rule_flag('known_attack_pattern', 'lower(content)')}
  OR ({D.any_like('lower(content)', P.AUTH_WORDS)} AND (""" + " OR ".join(
    f"starts_with(coalesce(ip_address, regexp_extract(content, {D.q(P.IP_UNBOUNDED)})), {D.q(p)})"
    for p in P.SUSPICIOUS_PREFIXES) + ")))"


@query("heuristic_labels", f"""WITH {D.RECORDS} SELECT line_no, CASE WHEN {_RECORD_RULES}
  OR coalesce(log_level, '') IN ('ERROR', 'CRITICAL', 'FATAL') OR {D.any_like('lower(content)', ('failed', 'timeout', 'error'))}
  THEN 1 ELSE 0 END AS label FROM records""")
def heuristic_labels(spark, sf_dir):
    records = parse.parse_feature_record(raw_logs(spark, sf_dir).drop("ts", "host"))
    named = records.withColumns({"message": F.col("content"), "raw": F.lit("")})
    return evaluate.heuristic_labels(rules.evaluate_rules_all(named)).select("line_no", "label")


@query("hybrid_predictions", f"""WITH {D.RULED} SELECT id, CASE WHEN rule_name IS NOT NULL OR log_level = 'ERROR' THEN 1 ELSE 0 END AS hybrid_label FROM hits""")
def hybrid_predictions(spark, sf_dir):
    judged = ruled(spark, sf_dir).withColumn(
        "ml_label", (F.col("log_level") == "ERROR").cast("int"))
    return evaluate.hybrid_predictions(judged).select("id", "hybrid_label")


_CELLS = """count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp,
  count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp"""
_RATIOS = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1_score"""


@query("evaluate_binary", f"""WITH c AS (SELECT {_CELLS} FROM (SELECT quality AS y, toxic AS p FROM labels))
SELECT {_RATIOS}, tn, fp, fn, tp, tn + fp AS support_normal, tp + fn AS support_anomaly, tn + fp + fn + tp AS support_total FROM c""")
def evaluate_binary(spark, sf_dir):
    return evaluate.evaluate_binary(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("evaluate_rules_against_silver", f"""WITH {SILVER}, c AS (
  SELECT log_type, {_CELLS} FROM (SELECT log_type, silver AS y, CASE WHEN rule_name IS NOT NULL THEN 1 ELSE 0 END AS p FROM silver) GROUP BY 1)
SELECT log_type, {_RATIOS}, tn, fp, fn, tp, tn + fp AS support_normal, tp + fn AS support_anomaly, tn + fp + fn + tp AS support_total FROM c""")
def evaluate_rules_against_silver(spark, sf_dir):
    labeled = evaluate.silver_labels(ruled(spark, sf_dir)).withColumn(
        "pred", F.col("rule").isNotNull().cast("int"))
    return evaluate.evaluate_binary(labeled, "silver", "pred", by=["log_type"])


# Scores with ties: the event value without decimals; the label is an error event.
_SCORED = "scored AS (SELECT event_type = 'error' AS pos, floor(value) AS s FROM events)"


def scored_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.floor("value").cast("double").alias("score"))


@query("roc_auc", f"""WITH {_SCORED}, r AS (SELECT pos, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM scored)
SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    made = evaluate.roc_auc(scored_events(spark, sf_dir), "label", "score")
    return made.select(F.round("roc_auc", 6).alias("roc_auc"))


_CURVE = _SCORED + """, g AS (SELECT s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM scored GROUP BY 1),
cum AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g),
pts AS (SELECT s, tp / ap AS rec, tp / (tp + fp) AS pre, tp / ap - fp / an AS gap, lag(tp / ap) OVER (ORDER BY s DESC) AS rec0,
  lag(tp / (tp + fp)) OVER (ORDER BY s DESC) AS pre0 FROM cum)"""


@query("pr_auc", f"WITH {_CURVE} SELECT round(sum((rec - coalesce(rec0, 0)) * (pre + coalesce(pre0, 1)) / 2), 6) AS pr_auc FROM pts")
def pr_auc(spark, sf_dir):
    made = evaluate.pr_auc(scored_events(spark, sf_dir), "label", "score")
    return made.select(F.round("pr_auc", 6).alias("pr_auc"))


@query("optimal_threshold", f"""WITH {_CURVE} SELECT CAST(s AS DOUBLE) AS optimal_threshold, round(gap, 6) AS max_tpr_minus_fpr
FROM pts ORDER BY gap DESC, s DESC LIMIT 1""")
def optimal_threshold(spark, sf_dir):
    made = evaluate.optimal_threshold(scored_events(spark, sf_dir), "label", "score")
    return made.withColumn("max_tpr_minus_fpr", F.round("max_tpr_minus_fpr", 6))


_SCORED_BY = "scored AS (SELECT user_id % 8 AS host, event_type = 'error' AS pos, floor(value) AS s FROM events)"


@query("roc_auc_by_model", f"""WITH {_SCORED_BY}, r AS (SELECT host, pos, rank() OVER (PARTITION BY host ORDER BY s) + (count(*) OVER (PARTITION BY host, s) - 1) / 2 AS rk FROM scored)
SELECT host, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS roc_auc FROM r GROUP BY 1""")
def roc_auc_by_model(spark, sf_dir):
    """Several curves in one pass; eight groups of users stand for models."""
    scored = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("host"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.floor("value").cast("double").alias("score"))
    return evaluate.roc_auc(scored, "label", "score", by=["host"]).withColumn(
        "roc_auc", F.round("roc_auc", 6))


# One "model" per order priority: does the status predict a price above 150,000?
_MODELS = f"""cells AS (SELECT model, {_CELLS} FROM (
  SELECT o_orderpriority AS model, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS y, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS p FROM orders)
  GROUP BY 1), metrics AS (SELECT model, {_RATIOS}, tn, fp, fn, tp FROM cells)"""


def model_metrics(spark, sf_dir):
    judged = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"),
        (F.col("o_totalprice") > 150000).cast("int").alias("label"),
        (F.col("o_orderstatus") == "F").cast("int").alias("pred"))
    return evaluate.evaluate_binary(judged, "label", "pred", by=["model"])


@query("comparison_table", f"""WITH {_MODELS} SELECT model, accuracy, precision, recall, f1_score, tn + fp AS support_normal,
  tp + fn AS support_anomaly, tn, fp, fn, tp, tn + fp + fn + tp AS support_total FROM metrics""")
def comparison_table(spark, sf_dir):
    return evaluate.comparison_table(model_metrics(spark, sf_dir))


@query("compare_models", f"""WITH {_MODELS}, long AS (SELECT * FROM (SELECT model, accuracy, precision, recall, f1_score FROM metrics) UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1_score)))
SELECT model, metric, value, CAST(row_number() OVER w AS INTEGER) AS place, row_number() OVER w = 1 AS is_best FROM long WINDOW w AS (PARTITION BY metric ORDER BY value DESC, model)""")
def compare_models(spark, sf_dir):
    return evaluate.compare_models(model_metrics(spark, sf_dir))


@query("best_models", f"""WITH {_MODELS}, named AS (SELECT CASE substr(model, 1, 1) WHEN '1' THEN 'IF_' WHEN '2' THEN 'IF_' WHEN '3' THEN 'LOF_' WHEN '4' THEN 'LOF_' ELSE 'OCSVM_' END || model AS model, f1_score FROM metrics)
SELECT CASE split_part(model, '_', 1) WHEN 'IF' THEN 'IsolationForest' WHEN 'LOF' THEN 'LOF' ELSE 'OneClassSVM' END AS family, model, f1_score
FROM named QUALIFY row_number() OVER (PARTITION BY split_part(model, '_', 1) ORDER BY f1_score DESC, model) = 1""")
def best_models(spark, sf_dir):
    first = F.substring("model", 1, 1)
    prefix = F.when(first.isin("1", "2"), "IF_").when(first.isin("3", "4"), "LOF_").otherwise("OCSVM_")
    metrics = model_metrics(spark, sf_dir).withColumn("model", F.concat(prefix, F.col("model")))
    return evaluate.best_models(metrics)


_TWO = f"""{_MODELS}, long AS (SELECT model, metric, value FROM (SELECT model, accuracy, precision, recall, f1_score FROM metrics) UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1_score))),
ch AS (SELECT b.metric, b.value AS baseline, n.value AS improved, (n.value - b.value) / b.value * 100 AS change_percent
  FROM long b JOIN long n ON n.metric = b.metric AND b.model = '1-URGENT' AND n.model = '5-LOW' WHERE b.value > 0),
dir AS (SELECT *, CASE WHEN change_percent > 0 THEN 'improvement' WHEN change_percent < 0 THEN 'degradation' ELSE 'same' END AS direction FROM ch),
bal AS (SELECT count(*) FILTER (direction = 'improvement') - count(*) FILTER (direction = 'degradation') AS b FROM dir)"""


@query("improvement_summary", f"""WITH {_TWO} SELECT metric, baseline, improved, round(change_percent, 2) AS change_percent, direction,
  abs(change_percent) > 10 AS significant, CASE WHEN b > 0 THEN 'Overall improvement achieved' WHEN b < 0 THEN 'Overall performance degraded'
  ELSE 'Mixed results - trade-offs between metrics' END AS overall FROM dir, bal""")
def improvement_summary(spark, sf_dir):
    metrics = model_metrics(spark, sf_dir)
    base = metrics.where(F.col("model") == "1-URGENT")
    new = metrics.where(F.col("model") == "5-LOW")
    return evaluate.improvement_summary(base, new).withColumn(
        "change_percent", F.round("change_percent", 2))
