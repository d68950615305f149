"""Rule verdicts as Columns: struct<triggered, severity, status, rule_name, message>.

A rule takes its test as ``known`` where that has been computed already.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .fields import contains_any, found

RULE_TYPE = "struct<triggered:boolean,severity:string,status:string,rule_name:string,message:string>"


def outcome(test: Column, name: str, message: Column | str, severity: str = "HIGH") -> Column:
    """The struct of a rule that either fired or did not."""
    message = F.lit(message) if isinstance(message, str) else message
    test = F.coalesce(test, F.lit(False))
    return F.struct(
        test.alias("triggered"),
        F.when(test, severity).otherwise("LOW").alias("severity"),
        F.when(test, "Anomaly").otherwise("Normal").alias("status"),
        F.lit(name).alias("rule_name"),
        F.when(test, message).otherwise("").alias("message"),
    )


def is_login_failure(text: Column) -> Column:
    return text.rlike(P.any_of(P.LOGIN_FAILURE, ignore_case=True))


def _keyword_rule(patterns, name: str, message: str):
    def rule(text: Column, known: Column | None = None) -> Column:
        test = F.lower(text).rlike(P.any_of(patterns)) if known is None else known
        return outcome(test, name, message)

    rule.__name__ = f"rule_{name}"
    rule.__doc__ = f"{message} where the text has one of the {name} signatures."
    return rule


rule_critical_error = _keyword_rule(
    P.CRITICAL_ERROR, "critical_error", "Critical error detected")
rule_login_failure = _keyword_rule(
    P.LOGIN_FAILURE, "login_failure", "Login failure detected")
rule_brute_force = _keyword_rule(
    P.BRUTE_FORCE, "brute_force", "Brute force attempt detected")
rule_db_failure = _keyword_rule(
    P.DB_FAILURE, "database_connection_failure", "Database connection failure detected")
rule_unauthorized = _keyword_rule(
    P.UNAUTHORIZED, "unauthorized_access", "Unauthorized access detected")


def seen_ip(ip: Column, text: Column) -> Column:
    """The parsed address, else the first thing in the text that looks like one."""
    return F.coalesce(F.nullif(ip, F.lit("")), found(text, P.IP_UNBOUNDED))


def rule_suspicious_ip(ip: Column, text: Column, known: Column | None = None) -> Column:
    """An internal address in a text about authentication."""
    address = seen_ip(ip, text)
    internal = F.lit(False)
    for prefix in P.SUSPICIOUS_PREFIXES:
        internal = internal | address.startswith(prefix)
    test = internal & contains_any(F.lower(text), P.AUTH_WORDS)
    message = F.concat(F.lit("Suspicious internal IP in auth context: "), address)
    return outcome(test if known is None else known, "suspicious_ip", message, "MEDIUM")


def rule_known_attack(text: Column, known: Column | None = None) -> Column:
    test = text.rlike(P.any_of(P.KNOWN_ATTACK, ignore_case=True)) if known is None else known
    return outcome(test, "known_attack_pattern", "Known attack pattern detected")


def first_triggered(rules) -> Column:
    """The first rule that fired, null if none did."""
    return F.coalesce(*[F.when(rule["triggered"], rule) for rule in rules])


def first_fired(rules) -> Column:
    """The place of the first rule that fired, null if none did."""
    return F.coalesce(*[F.when(rule["triggered"], place) for place, rule in enumerate(rules)])


def triggered_names(rules) -> Column:
    """The names of all rules that fired, in the given order."""
    return F.array_compact(F.array(*[F.when(rule["triggered"], rule["rule_name"]) for rule in rules]))


def verdict(rule_fired: Column, rule_reason: Column, ml_anomaly: Column) -> dict:
    """Prediction, source and reason from a rule outcome and a model outcome."""
    return {
        "prediction": F.when(rule_fired | ml_anomaly, "Anomaly").otherwise("Normal"),
        "source": F.when(rule_fired & ml_anomaly, "ML + Rules")
        .when(rule_fired, "Rules").otherwise("ML"),
        "detection_reason": F.when(rule_fired, rule_reason)
        .when(ml_anomaly, "ML anomaly score threshold exceeded").otherwise("Normal"),
    }
