"""Per-record features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, parse
from ..session import materialize
from . import query, sqlparts as D
from .inputs import raw_logs


def records(spark, sf_dir):
    return parse.parse_feature_record(raw_logs(spark, sf_dir).drop("ts", "host"))


def settled_records(spark, sf_dir):
    """Records behind a checkpoint: the time features read them several times."""
    return materialize(records(spark, sf_dir))


def rounded(df, names):
    exact = ("ip_hash", "content_hash")
    return df.select("line_no", *[n if n in exact else F.round(n, 6).alias(n) for n in names])


def _r(expression, name):
    if name in ("ip_hash", "content_hash"):
        return f"CAST({expression} AS DOUBLE) AS {name}"
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


_TEMPORAL = D.RECORDS + """, timed AS (
  SELECT line_no, epoch_us(record_ts) // 1000000 AS t, record_ts FROM records WHERE record_ts IS NOT NULL
), gaps AS (
  SELECT line_no, record_ts, t - lag(t) OVER (ORDER BY t, line_no) AS back,
    lead(t) OVER (ORDER BY t, line_no) - t AS ahead FROM timed
), temporal AS (
  SELECT r.line_no, coalesce(back, 0) AS since_previous, coalesce(ahead, 0) AS until_next,
    coalesce(sin(2 * pi() * hour(r.record_ts) / 24), 0) AS hour_sin,
    coalesce(cos(2 * pi() * hour(r.record_ts) / 24), 0) AS hour_cos,
    coalesce(sin(2 * pi() * (isodow(r.record_ts) - 1) / 7), 0) AS day_sin,
    coalesce(cos(2 * pi() * (isodow(r.record_ts) - 1) / 7), 0) AS day_cos
  FROM records r LEFT JOIN gaps g ON g.line_no = r.line_no)"""

_FREQUENCY = """, near AS MATERIALIZED (
  SELECT a.line_no, count(*) AS near_total,
    count(*) FILTER (b.log_level = 'DEBUG') AS near_debug, count(*) FILTER (b.log_level = 'INFO') AS near_info,
    count(*) FILTER (b.log_level = 'WARN') AS near_warn, count(*) FILTER (b.log_level = 'ERROR') AS near_error,
    count(*) FILTER (b.log_level IN ('ERROR', 'CRITICAL', 'FATAL')) / count(*) AS near_error_ratio,
    count(DISTINCT b.ip_address) AS near_ips, count(DISTINCT b."user") AS near_users
  FROM records a JOIN records b ON b.record_ts BETWEEN a.record_ts - INTERVAL 5 MINUTE AND a.record_ts + INTERVAL 5 MINUTE
  GROUP BY a.line_no
), frequency AS (
  SELECT r.line_no, """ + ", ".join(f"coalesce({n}, 0) AS {n}" for n in features.FREQUENCY) + """
  FROM records r LEFT JOIN near n ON n.line_no = r.line_no)"""

_STRUCTURAL = r""", structural AS (
  SELECT line_no, length(content) AS chars,
    len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda w: w <> '')) AS words,
    len(regexp_extract_all(content, '\b\d+\b')) AS numbers,
    len(regexp_extract_all(content, '[^a-zA-Z0-9\s]')) AS special_chars,
    CASE WHEN length(content) > 0 THEN len(regexp_extract_all(content, '\p{Lu}')) / length(content) ELSE 0 END AS upper_ratio,
    coalesce(list_position(['DEBUG','INFO','WARN','ERROR','CRITICAL','FATAL'], log_level) - 1, 0) AS level_code,
    coalesce(status_code / 1000, 0) AS status_scaled, CASE WHEN status_code >= 400 THEN 1 ELSE 0 END AS is_error_status,
    coalesce(CAST('0x' || substr(md5(ip_address), 1, 8) AS BIGINT) / 1e8, 0) AS ip_hash,
    CAST('0x' || substr(md5(content), 1, 8) AS BIGINT) / 1e8 AS content_hash
  FROM records)"""

_SEQUENCE = """, changes AS (
  SELECT *, CASE WHEN lag(line_no) OVER o IS NULL THEN 0 WHEN log_level IS DISTINCT FROM lag(log_level) OVER o THEN 1 ELSE 0 END AS changed
  FROM records WINDOW o AS (ORDER BY line_no)
), sequences AS (
  SELECT line_no,
    sum(changed) OVER (ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / greatest(count(*) OVER w - 1, 1) AS level_change_rate,
    sum(CASE WHEN log_level IN ('ERROR', 'CRITICAL', 'FATAL') THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS error_share,
    coalesce((epoch_us(max(record_ts) OVER w) - epoch_us(min(record_ts) OVER w)) / 60e6, 0) AS span_minutes,
    var_pop(length(content)) OVER w / 1000 AS length_variance,
    len(list_distinct(list(ip_address) FILTER (ip_address IS NOT NULL) OVER w)) / greatest(count(ip_address) OVER w, 1) AS ip_diversity
  FROM changes WINDOW w AS (ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
_SEQUENCE = _SEQUENCE.replace(
    "len(list_distinct(list(ip_address) FILTER (ip_address IS NOT NULL) OVER w))",
    "coalesce(len(list_distinct(list_filter(list(ip_address) OVER w, lambda x: x IS NOT NULL))), 0)")


def _columns(names):
    return ", ".join(_r(n, n) for n in names)


@query("temporal_features", f"WITH {_TEMPORAL} SELECT line_no, {_columns(features.TEMPORAL)} FROM temporal")
def temporal_features(spark, sf_dir):
    return rounded(features.temporal_features(settled_records(spark, sf_dir), "record_ts", "line_no"),
                   features.TEMPORAL)


@query("frequency_features",
       f"WITH {D.RECORDS}{_FREQUENCY} SELECT line_no, {_columns(features.FREQUENCY)} FROM frequency")
def frequency_features(spark, sf_dir):
    return rounded(features.frequency_features(settled_records(spark, sf_dir), "record_ts"),
                   features.FREQUENCY)


@query("structural_features",
       f"WITH {D.RECORDS}{_STRUCTURAL} SELECT line_no, {_columns(features.STRUCTURAL)} FROM structural")
def structural_features(spark, sf_dir):
    return rounded(features.structural_features(records(spark, sf_dir)), features.STRUCTURAL)


@query("sequence_features",
       f"WITH {D.RECORDS}{_SEQUENCE} SELECT line_no, {_columns(features.SEQUENCE)} FROM sequences")
def sequence_features(spark, sf_dir):
    return rounded(features.sequence_features(records(spark, sf_dir), "record_ts", "line_no"),
                   features.SEQUENCE)


_ALL = ", ".join([_columns(features.ALL_FEATURES[:29]),
                  *[f"CAST(0 AS DOUBLE) AS {n}" for n in features.SEQUENCE_PADDING]])


@query("all_features", f"""WITH {_TEMPORAL}{_FREQUENCY}{_STRUCTURAL}{_SEQUENCE}
SELECT t.line_no, {_ALL} FROM temporal t JOIN frequency f ON f.line_no = t.line_no
JOIN structural s ON s.line_no = t.line_no JOIN sequences q ON q.line_no = t.line_no""")
def all_features(spark, sf_dir):
    made = features.all_features(settled_records(spark, sf_dir), "record_ts", "line_no")
    return rounded(made, features.ALL_FEATURES)
