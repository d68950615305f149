"""Time windows, alert tables and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..operators import parse, windows
from . import query, sqlparts as D
from .inputs import raw_logs, table
from .q_rules import verdicts


def client(spark, sf_dir):
    return parse.parse_logs_client(raw_logs(spark, sf_dir).drop("ts", "host"))


def ten_minutes(spark, sf_dir):
    return windows.window_features(client(spark, sf_dir))


def scored(spark, sf_dir):
    return verdicts(spark, sf_dir).withColumn("template", X.mask_template(F.col("message")))


_AGG = """count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level = 'WARN') AS warn_count,
  count(DISTINCT template) AS unique_templates, count(*) AS event_frequency,
  avg(TRY_CAST(nullif(regexp_extract(raw, '(\\d+)\\s*ms', 1), '') AS DOUBLE)) AS avg_ms"""
_FINISH = """time_window, error_count, warn_count, unique_templates,
  floor(coalesce(avg_ms, CAST(50 + 30 * error_count + 25 AS DOUBLE)) + 0.5) AS avg_response_time, event_frequency,
  floor(list_stddev_pop([CAST(error_count AS DOUBLE), CAST(warn_count AS DOUBLE), CAST(unique_templates AS DOUBLE)]) * 100 + 0.5) / 100 AS std_deviation"""
TEN = D.CLIENT + f""", w10 AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, strptime(substr("timestamp", 1, 19), '%Y-%m-%d %H:%M:%S')) AS time_window, {_AGG}
  FROM client WHERE "timestamp" IS NOT NULL GROUP BY 1
), ten AS (SELECT {_FINISH} FROM w10)"""

JUDGED = TEN + """, st AS (
  SELECT avg(error_count) AS em, stddev_pop(error_count) AS es, avg(avg_response_time) AS rm,
    stddev_pop(avg_response_time) AS rs, avg(unique_templates) AS tm, stddev_pop(unique_templates) AS tsd,
    avg(event_frequency) AS fm, stddev_pop(event_frequency) AS fs FROM ten
), z AS (
  SELECT ten.*, st.*, list_avg(list_filter([
    CASE WHEN es > 0 THEN abs(error_count - em) / es END, CASE WHEN rs > 0 THEN abs(avg_response_time - rm) / rs END,
    CASE WHEN tsd > 0 THEN abs(unique_templates - tm) / tsd END, CASE WHEN fs > 0 THEN abs(event_frequency - fm) / fs END],
    lambda d: d IS NOT NULL)) AS dist FROM ten, st
), zs AS (
  SELECT *, coalesce(1 / (1 + exp(2 - dist)), 0) AS score FROM z
), zv AS (
  SELECT *, CASE WHEN score > 0.65 THEN 'anomaly' ELSE 'normal' END AS isolation_forest,
    CASE WHEN error_count > greatest(em + 3 * es, 12) OR avg_response_time > greatest(rm + 3 * rs, 700)
      THEN 'anomaly' ELSE 'normal' END AS statistical FROM zs
), judged AS (
  SELECT time_window, error_count, avg_response_time, unique_templates,
    floor(score * 100 + 0.5) / 100 AS anomaly_score,
    isolation_forest = 'anomaly' OR statistical = 'anomaly' AS is_anomaly, isolation_forest, statistical,
    CASE WHEN isolation_forest = 'anomaly' AND statistical = 'anomaly' THEN 'anomaly'
      WHEN isolation_forest = 'anomaly' OR statistical = 'anomaly' THEN 'warning' ELSE 'normal' END AS hybrid_decision
  FROM zv)"""

_SCORED = D.VERDICTS + f""", scored AS (SELECT *, {D.template('message')} AS template FROM verdicts)"""


@query("window_features_10m", f"WITH {TEN} SELECT * FROM ten")
def window_features_10m(spark, sf_dir):
    return ten_minutes(spark, sf_dir)


@query("window_features_time_of_day", f"""WITH {D.CLIENT}, w AS (
  SELECT substr("timestamp", 12, 4) || '0' AS time_window, {_AGG}
  FROM client WHERE "timestamp" IS NOT NULL GROUP BY 1) SELECT {_FINISH} FROM w""")
def window_features_time_of_day(spark, sf_dir):
    return windows.window_features(client(spark, sf_dir), by_time_of_day=True)


_MINUTE = """time_window, error_count, warn_count, unique_templates, CAST(200 + 100 * error_count AS DOUBLE) AS avg_response_time,
  n / 10 AS event_frequency, CAST(least(error_count * 15.5, 50) AS DOUBLE) AS std_deviation"""


@query("window_features_1m", f"""WITH {D.PARSED}, m AS (
  SELECT substr("timestamp", 1, 16) AS time_window, count(*) AS n, count(*) FILTER (log_level = 'ERROR') AS error_count,
    count(*) FILTER (log_level = 'WARN') AS warn_count, count(DISTINCT {D.template('message')}) AS unique_templates
  FROM parsed WHERE "timestamp" <> '' GROUP BY 1)
SELECT {_MINUTE} FROM m ORDER BY time_window DESC LIMIT 50""")
def window_features_1m(spark, sf_dir):
    logs = parse.parse_logs(raw_logs(spark, sf_dir))
    return windows.window_features_1m(logs.withColumn("template", X.mask_template(F.col("message"))))


@query("recent_anomalies", f"""WITH {_SCORED}, g AS (
  SELECT substr("timestamp", 1, 16) AS time_window, count(*) AS n, count(*) FILTER (log_level = 'ERROR') AS error_count,
    count(*) FILTER (prediction = 'Anomaly') AS anomalies, avg(confidence) FILTER (prediction = 'Anomaly') AS conf,
    count(DISTINCT template) AS unique_templates FROM scored WHERE "timestamp" <> '' GROUP BY 1
), l AS (
  SELECT substr("timestamp", 1, 16) AS time_window, message, source, detection_reason, service, log_level, confidence,
    row_number() OVER (PARTITION BY substr("timestamp", 1, 16) ORDER BY "timestamp" DESC, line_no) AS rn
  FROM scored WHERE "timestamp" <> '' AND prediction = 'Anomaly'
), j AS (
  SELECT g.*, l.message AS lm, l.source AS ls, l.detection_reason AS lr, l.service AS lsv, l.log_level AS ll, l.confidence AS lc,
    CASE WHEN anomalies > 0 THEN least(conf + anomalies / n * CAST(0.3 AS DOUBLE), 1) ELSE CAST(0 AS DOUBLE) END AS anomaly_score
  FROM g LEFT JOIN l ON l.time_window = g.time_window AND l.rn = 1 WHERE anomalies > 0 OR error_count > 0)
SELECT time_window, substr(CASE WHEN anomalies > 0 THEN lm ELSE error_count || ' errors detected' END, 1, 300) AS message,
  'Anomaly' AS prediction,
  round(CASE WHEN anomaly_score > 0 THEN anomaly_score WHEN anomalies > 0 THEN lc ELSE CAST(0.5 AS DOUBLE) END, 6) AS confidence,
  CASE WHEN anomalies > 0 THEN ls ELSE 'Statistical' END AS source,
  CASE WHEN anomalies > 0 THEN lr ELSE 'High error count (' || error_count || ')' END AS detection_reason,
  CASE WHEN anomalies > 0 THEN lsv ELSE 'System' END AS service,
  CASE WHEN error_count > 0 THEN 'ERROR' WHEN anomalies > 0 THEN ll ELSE 'INFO' END AS log_level, error_count,
  CAST(200 + 50 * anomalies + 100 * error_count AS DOUBLE) AS avg_response_time, unique_templates,
  round(anomaly_score, 6) AS anomaly_score, true AS is_anomaly, 'anomaly' AS hybrid_decision
FROM j ORDER BY time_window DESC LIMIT 50""")
def recent_anomalies(spark, sf_dir):
    return windows.recent_anomalies(scored(spark, sf_dir)).withColumns({
        "confidence": F.round("confidence", 6), "anomaly_score": F.round("anomaly_score", 6)})


@query("backend_window_flag", f"""WITH {_SCORED}, g AS (
  SELECT substr("timestamp", 1, 16) AS time_window, count(*) FILTER (log_level = 'ERROR') AS error_count,
    count(*) FILTER (prediction = 'Anomaly') AS anomalies FROM scored WHERE "timestamp" <> '' GROUP BY 1)
SELECT time_window, error_count, 'anomaly' AS isolation_forest,
  CASE WHEN error_count > 5 THEN 'anomaly' ELSE 'normal' END AS statistical, 'anomaly' AS hybrid_decision
FROM g WHERE anomalies > 0 OR error_count > 0""")
def backend_window_flag(spark, sf_dir):
    alerts = windows.recent_anomalies(scored(spark, sf_dir), last=None)
    return windows.backend_window_flag(alerts).select(
        "time_window", "error_count", "isolation_forest", "statistical", "hybrid_decision")


_METRICS = ("error_count", "avg_response_time", "unique_templates", "event_frequency")
_STATS_SQL = " UNION ALL ".join(f"""
SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std,
  coalesce(nullif(list_sort(list(CAST({m} AS DOUBLE)))[CAST(floor(count(*) * 0.99) AS INTEGER) + 1], 0), max(CAST({m} AS DOUBLE))) AS p99
FROM ten""" for m in _METRICS)


@query("window_statistics", f"WITH {TEN} {_STATS_SQL}")
def window_statistics(spark, sf_dir):
    made = windows.window_statistics(ten_minutes(spark, sf_dir), _METRICS)
    return made.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "p99")


@query("window_zscore_detect", f"WITH {JUDGED} SELECT * FROM judged")
def window_zscore_detect(spark, sf_dir):
    return windows.window_zscore_detect(ten_minutes(spark, sf_dir))


@query("threat_alerts", f"WITH {JUDGED} SELECT * FROM judged WHERE hybrid_decision <> 'normal' OR is_anomaly")
def threat_alerts(spark, sf_dir):
    return windows.threat_alerts(window_zscore_detect(spark, sf_dir))


@query("flag_high_windows", f"""WITH {TEN} SELECT time_window, error_count, warn_count, avg_response_time,
  error_count > 12 OR avg_response_time > 700 AS is_high, warn_count > 8 AS many_warnings FROM ten""")
def flag_high_windows(spark, sf_dir):
    return windows.flag_high_windows(ten_minutes(spark, sf_dir)).select(
        "time_window", "error_count", "warn_count", "avg_response_time", "is_high", "many_warnings")


@query("client_summary", f"""WITH {JUDGED}
SELECT (SELECT count(*) FROM raw_logs) AS total_lines, count(*) AS parsed_logs,
  count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level = 'WARN') AS warn_count,
  count(DISTINCT template) AS unique_templates,
  (SELECT count(*) FROM judged WHERE hybrid_decision = 'anomaly') AS anomaly_count,
  (SELECT count(*) FROM judged WHERE hybrid_decision = 'warning') AS warning_count FROM client""")
def client_summary(spark, sf_dir):
    return windows.client_summary(
        table(spark, sf_dir, "events"), client(spark, sf_dir),
        window_zscore_detect(spark, sf_dir))


@query("stats", f"""WITH {D.VERDICTS} SELECT count(*) AS total_logs,
  count(*) FILTER (prediction = 'Anomaly') AS anomaly_count, count(*) FILTER (prediction <> 'Anomaly') AS normal_count,
  round(100.0 * count(*) FILTER (prediction = 'Anomaly') / count(*), 1)::DOUBLE AS anomaly_percentage FROM verdicts""")
def stats(spark, sf_dir):
    return windows.stats(verdicts(spark, sf_dir))


@query("scored_logs", f"""WITH {D.VERDICTS}
SELECT p.id, p.log_level, p.message, coalesce(v.prediction, 'Normal') AS prediction,
  coalesce(v.confidence, CAST(0 AS DOUBLE)) AS confidence, coalesce(v.source, 'ML') AS source,
  coalesce(v.detection_reason, '') AS detection_reason
FROM parsed p LEFT JOIN (SELECT * FROM verdicts WHERE log_type <> 'plain') v ON v.id = p.id""")
def scored_logs(spark, sf_dir):
    """Plain lines have no stored verdict here, so that the defaults show."""
    logs = parse.parse_logs(raw_logs(spark, sf_dir)).select("id", "log_level", "message")
    stored = verdicts(spark, sf_dir).where(F.col("log_type") != "plain")
    return windows.scored_logs(logs, stored)


@query("top_services", f"""WITH {D.VERDICTS} SELECT coalesce(nullif(service, ''), 'System') AS service, count(*) AS anomalies
FROM verdicts WHERE prediction = 'Anomaly' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def top_services(spark, sf_dir):
    return windows.top_services(verdicts(spark, sf_dir))


@query("critical_errors", f"""WITH {D.PARSED} SELECT id, "timestamp", service, message FROM parsed WHERE log_level = 'ERROR'""")
def critical_errors(spark, sf_dir):
    logs = parse.parse_logs(raw_logs(spark, sf_dir))
    return windows.critical_errors(logs).select("id", "timestamp", "service", "message")


@query("search_logs", f"""WITH {D.VERDICTS} SELECT id, log_level, prediction, message FROM verdicts
WHERE log_level = 'ERROR' AND prediction = 'Anomaly' AND contains(lower(message), 'timeout') ORDER BY line_no LIMIT 100""")
def search_logs(spark, sf_dir):
    found = windows.search_logs(verdicts(spark, sf_dir), "TimeOut", "ERROR", "Anomaly")
    return found.select("id", "log_level", "prediction", "message")
