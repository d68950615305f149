"""Streams, each run over the events file and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parse
from ..streaming import jobs
from . import query, sqlparts as D
from .inputs import as_log_lines
from .q_windows import _AGG, _FINISH

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def events(spark, sf_dir):
    return jobs.stream_lines(spark, sf_dir, _EVENTS, "events.parquet")


_CLOSED = "(SELECT max(ts) - INTERVAL 30 MINUTE FROM events)"


@query("stream_scored", f"""WITH {D.PROCESSED}, one AS (SELECT *, {D.SUSPICIOUS} AS ip_hit FROM processed),
hit AS (SELECT *, {' OR '.join(D.rule_flag(n, 'lower(said)') for n in (
    'critical_error', 'login_failure', 'brute_force', 'database_connection_failure', 'unauthorized_access'))}
  OR ip_hit OR {D.rule_flag('known_attack_pattern', 'lower(message || raw)')} AS hit FROM one)
SELECT id, cleaned_message, CASE WHEN dataset_label = 1 THEN 'Anomaly' WHEN dataset_label = 0 THEN 'Normal' WHEN hit THEN 'Anomaly' ELSE 'Normal' END AS prediction,
  CASE WHEN dataset_label IS NOT NULL THEN 'Dataset label' WHEN hit THEN 'Rules' ELSE 'ML' END AS source FROM hit""")
def stream_scored(spark, sf_dir):
    scored = jobs.stream_scored(as_log_lines(events(spark, sf_dir)).drop("ts"))
    return jobs.run_available(scored.select("id", "cleaned_message", "prediction", "source"))


@query("stream_window_features", f"""WITH {D.CLIENT}, w10 AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS time_window, {_AGG} FROM client GROUP BY 1)
SELECT {_FINISH} FROM w10 WHERE time_window + INTERVAL 10 MINUTE <= {_CLOSED}""")
def stream_window_features(spark, sf_dir):
    """By the event time of the table; windows past the watermark are complete."""
    records = parse.parse_logs_client(as_log_lines(events(spark, sf_dir)))
    return jobs.run_available(jobs.stream_window_features(records, "ts"))


@query("stream_repeated_failures", D.select(D.RULED, """
SELECT host, line_no, CAST(sum(CASE WHEN login_hit THEN 1 ELSE 0 END) OVER w AS BIGINT) AS login_failures,
  sum(CASE WHEN login_hit THEN 1 ELSE 0 END) OVER w >= 3 AS repeated
FROM flagged WINDOW w AS (PARTITION BY host ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"""))
def stream_repeated_failures(spark, sf_dir):
    logs = parse.parse_logs(as_log_lines(events(spark, sf_dir)).drop("ts"))
    return jobs.run_available(jobs.stream_repeated_failures(logs, "host"))


@query("stream_request_rate", f"""
WITH s AS (SELECT user_id % 8 AS grp, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
SELECT window_start, grp, count(*) AS requests FROM s WHERE window_start + INTERVAL 60 MINUTE <= {_CLOSED} GROUP BY 1, 2 HAVING count(*) > 3""")
def stream_request_rate(spark, sf_dir):
    keyed = events(spark, sf_dir).withColumn("grp", F.col("user_id") % 8)
    return jobs.run_available(jobs.stream_request_rate(
        keyed, "ts", "grp", 3, "60 minutes", "30 minutes"))
