"""Signature rules, neighbour rules and the verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, parse, prepare, rules
from . import query, sqlparts as D
from .inputs import raw_logs, table
from .q_parse import parsed


def processed(spark, sf_dir):
    return prepare.process_logs(parsed(spark, sf_dir))


def ruled(spark, sf_dir):
    """Numbered, parsed, cleaned, and the first rule that fires."""
    numbered = parse.number_lines(raw_logs(spark, sf_dir))
    logs = prepare.process_logs(parse.parse_logs(numbered))
    return rules.run_rules(logs, order="seq", numbered=True)


def verdicts(spark, sf_dir):
    """Rules alone decide: without a model every line is Normal at 0.5."""
    without_model = ruled(spark, sf_dir).withColumns(
        {"ml_prediction": F.lit("Normal"), "confidence": F.lit(0.5)})
    return rules.combine_rule_ml(without_model)


_RULE_KEYS = {
    "rule_critical_error": "critical_error", "rule_login_failure": "login_failure",
    "rule_brute_force": "brute_force", "rule_db_failure": "database_connection_failure",
    "rule_unauthorized": "unauthorized_access", "rule_suspicious_ip": "suspicious_ip",
    "rule_known_attack": "known_attack_pattern",
}
_MESSAGES = {
    "critical_error": "'Critical error detected'", "login_failure": "'Login failure detected'",
    "brute_force": "'Brute force attempt detected'",
    "database_connection_failure": "'Database connection failure detected'",
    "unauthorized_access": "'Unauthorized access detected'",
    "suspicious_ip": "'Suspicious internal IP in auth context: ' || seen_ip",
    "known_attack_pattern": "'Known attack pattern detected'",
}


def _register(key, name):
    test = {"suspicious_ip": "ip_hit", "known_attack_pattern": "attack_hit"}.get(name)
    test = test or D.rule_flag(name, "lower(said)")
    severity = "MEDIUM" if name == "suspicious_ip" else "HIGH"
    sql = D.select(D.RULED, f"""
SELECT id, {test} AS triggered, CASE WHEN {test} THEN '{severity}' ELSE 'LOW' END AS severity,
  CASE WHEN {test} THEN 'Anomaly' ELSE 'Normal' END AS status, '{name}' AS rule_name,
  CASE WHEN {test} THEN {_MESSAGES[name]} ELSE '' END AS message FROM flagged""")

    def run(spark, sf_dir):
        return parsed(spark, sf_dir).select(
            "id", rules.keyword_rules()[name].alias("r")).select("id", "r.*")

    query(key, sql)(run)


for _key, _name in _RULE_KEYS.items():
    _register(_key, _name)


@query("rule_repeated_login_failures", D.select(D.RULED, """
SELECT id, CAST(failures AS BIGINT) AS login_failures, failures >= 3 AS repeated FROM counted"""))
def rule_repeated_login_failures(spark, sf_dir):
    return rules.repeated_login_failures(parsed(spark, sf_dir), "line_no").select(
        "id", "login_failures", "repeated")


@query("rule_repeated_login_failures_by_host", D.select(D.RULED, """
SELECT id, host, CAST(sum(CASE WHEN login_hit THEN 1 ELSE 0 END) OVER w AS BIGINT) AS login_failures
FROM flagged WINDOW w AS (PARTITION BY host ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"""))
def rule_repeated_login_failures_by_host(spark, sf_dir):
    return rules.repeated_login_failures(parsed(spark, sf_dir), "line_no", by=["host"]).select(
        "id", "host", "login_failures")


@query("rule_request_frequency", """
SELECT event_id, count(*) OVER (ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS requests,
  count(*) OVER (ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) > 30 AS unusual FROM events""")
def rule_request_frequency(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return rules.request_frequency(events, "event_id")


@query("request_rate", """
SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS requests, count(*) OVER w > 2 AS unusual
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW)""")
def request_rate(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rules.request_rate(events, "ts", ["user_id"], seconds=43200, threshold=2).drop("ts")


@query("run_rules", D.select(D.RULED, "SELECT id, rule_name, severity, rule_message FROM hits"))
def run_rules(spark, sf_dir):
    return ruled(spark, sf_dir).select(
        "id", "rule.rule_name", "rule.severity", F.col("rule.message").alias("rule_message"))


@query("anomalies_by_rule", D.select(D.VERDICTS, """
SELECT coalesce(rule_name, 'none') AS rule_name, prediction, count(*) AS lines
FROM verdicts GROUP BY 1, 2"""))
def anomalies_by_rule(spark, sf_dir):
    name = F.coalesce("rule.rule_name", F.lit("none")).alias("rule_name")
    return verdicts(spark, sf_dir).groupBy(name, "prediction").agg(
        F.count(F.lit(1)).alias("lines"))


_ALL_NAMES = f"""array_to_string(list_filter([
  CASE WHEN {D.rule_flag('brute_force', 'lower(message)')} THEN 'brute_force' END,
  CASE WHEN {D.rule_flag('database_connection_failure', 'lower(message)')} THEN 'database_connection_failure' END,
  CASE WHEN {D.rule_flag('unauthorized_access', 'lower(message)')} THEN 'unauthorized_access' END,
  CASE WHEN ip_hit THEN 'suspicious_ip' WHEN attack_hit THEN 'known_attack_pattern' END],
  lambda x: x IS NOT NULL), ',')"""


@query("evaluate_rules_all", D.select(D.RULED, f"SELECT id, {_ALL_NAMES} AS rule_names FROM flagged"))
def evaluate_rules_all(spark, sf_dir):
    return rules.evaluate_rules_all(parsed(spark, sf_dir)).select(
        "id", F.array_join("rule_names", ",").alias("rule_names"))


# Rule scores are taken from the model text, message and raw_message both being that text.
_TEXT = "trim(coalesce(nullif(cleaned_message, ''), message, ''))"
_TWICE = f"lower({_TEXT} || {_TEXT})"
SCORE_SQL = f"""least(100, 20 * (
  CASE WHEN {D.rule_flag('brute_force', _TWICE)} THEN 1 ELSE 0 END
  + CASE WHEN {D.rule_flag('database_connection_failure', _TWICE)} THEN 1 ELSE 0 END
  + CASE WHEN {D.rule_flag('unauthorized_access', _TWICE)} THEN 1 ELSE 0 END
  + CASE WHEN {D.rule_flag('known_attack_pattern', f'lower({_TEXT})')} THEN 1 ELSE 0 END))"""


@query("rule_score", D.select(D.PROCESSED, f"SELECT id, CAST({SCORE_SQL} AS DOUBLE) AS rule_score FROM processed"))
def rule_score(spark, sf_dir):
    from ..functions.text import message_text

    texts = processed(spark, sf_dir).select("id", message_text().alias("message"))
    scored = rules.evaluate_rules_all(texts.withColumn("raw_message", F.col("message")))
    return scored.select("id", rules.rule_score().alias("rule_score"))


@query("combine_rule_ml", D.select(D.RULED, """
SELECT id,
  CASE WHEN rule_name IS NOT NULL OR log_level = 'ERROR' THEN 'Anomaly' ELSE 'Normal' END AS prediction,
  CASE WHEN rule_name IS NOT NULL AND log_level = 'ERROR' THEN 'ML + Rules'
    WHEN rule_name IS NOT NULL THEN 'Rules' ELSE 'ML' END AS source,
  CASE WHEN rule_name IS NOT NULL THEN rule_message
    WHEN log_level = 'ERROR' THEN 'ML anomaly score threshold exceeded' ELSE 'Normal' END AS detection_reason
FROM hits"""))
def combine_rule_ml(spark, sf_dir):
    """The level stands in for a model's verdict, so that all four outcomes occur."""
    judged = ruled(spark, sf_dir).withColumn(
        "ml_prediction", F.when(F.col("log_level") == "ERROR", "Anomaly").otherwise("Normal"))
    return rules.combine_rule_ml(judged, label_override=False).select(
        "id", "prediction", "source", "detection_reason")


@query("dataset_label_override", D.select(D.VERDICTS, """
SELECT id, dataset_label, prediction, source, detection_reason, rule_triggered FROM verdicts"""))
def dataset_label_override(spark, sf_dir):
    return verdicts(spark, sf_dir).select(
        "id", "dataset_label", "prediction", "source", "detection_reason", "rule_triggered")
