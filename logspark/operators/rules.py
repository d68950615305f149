"""Signature rules over parsed logs, the rules that look at neighbours, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import signatures as S
from ..functions.text import message_or_raw
from . import frames


def _both(separator: str = ""):
    return F.concat(
        F.coalesce(F.col("message"), F.lit("")), F.lit(separator),
        F.coalesce(F.col("raw"), F.lit("")),
    )


def keyword_rules(text=None, known=None) -> dict:
    """The rules that need one line only, by name, in the order they are tried."""
    text = message_or_raw() if text is None else text
    both = _both()
    return {
        "critical_error": S.rule_critical_error(text, known),
        "login_failure": S.rule_login_failure(text, known),
        "brute_force": S.rule_brute_force(text, known),
        "database_connection_failure": S.rule_db_failure(text, known),
        "unauthorized_access": S.rule_unauthorized(text, known),
        "suspicious_ip": S.rule_suspicious_ip(F.col("ip_address"), both, known),
        "known_attack_pattern": S.rule_known_attack(both, known),
    }


def repeated_login_failures(
    df: DataFrame, order: str, by=(), window: int = 10, min_hits: int = 3,
    numbered: bool = False, frequency_rows: int = 20,
) -> DataFrame:
    """Add ``login_failures`` and ``requests``: counts over a line and those before it.

    ``login_failures`` covers ``window`` lines back, ``requests`` counts the lines
    themselves over ``frequency_rows`` back. ``numbered`` says that ``order`` already has
    no gaps. Adds ``repeated`` where there are ``min_hits`` failures or more.
    """
    by = list(by)
    flagged = frames.settle(
        df.withColumn("_hit", S.is_login_failure(_both(" ")).cast("int"))
    )
    seq = order if numbered else "_seq"
    indexed = flagged if numbered else frames.line_index(flagged, order, by, name=seq)
    wide = frames.with_halo(indexed, seq, before=max(window, frequency_rows), by=by)
    counted = wide.withColumns({
        "login_failures": F.sum("_hit").over(frames.block_window(seq, by, -window, 0)),
        "requests": F.count(F.lit(1)).over(frames.block_window(seq, by, -frequency_rows, 0)),
    })
    result = frames.own_rows(counted).withColumn(
        "repeated", F.col("login_failures") >= min_hits
    )
    return result.drop("_hit", *([] if numbered else [seq]))


def run_rules(
    df: DataFrame, order: str | None, by=(), numbered: bool = False, threshold: int = 30
) -> DataFrame:
    """Add ``rule``, the struct of the first rule that fires (null if none does).

    Without ``order`` every line is its own context and the neighbour rules see one line.
    """
    if order is None:
        failures = S.is_login_failure(_both(" ")).cast("bigint")
        context = df.withColumns({"login_failures": failures, "requests": F.lit(1)})
    else:
        context = repeated_login_failures(df, order, by, numbered=numbered)

    def tried(known=None) -> list:
        repeated = S.outcome(
            F.col("login_failures") >= 3 if known is None else known, "repeated_login_failures",
            F.concat(F.lit("Multiple login failures ("),
                     F.col("login_failures").cast("string"), F.lit(") detected")),
        )
        frequent = S.outcome(
            F.col("requests") > threshold if known is None else known, "unusual_request_frequency",
            F.concat(F.lit("Unusual request frequency: "),
                     F.col("requests").cast("string"), F.lit(" in window")),
        )
        return [*keyword_rules(known=known).values(), repeated, frequent]

    # A test is made once: the struct of the rule that fired does not ask again.
    judged = frames.settle(context.withColumn("_first", S.first_fired(tried())))
    fired = F.coalesce(*[
        F.when(F.col("_first") == place, rule) for place, rule in enumerate(tried(F.lit(True)))])
    return frames.settle(judged.withColumn("rule", fired).drop(
        "_first", "login_failures", "requests", "repeated"
    ))


def request_frequency(
    df: DataFrame, order: str, by=(), rows: int = 20, threshold: int = 30,
    numbered: bool = False,
) -> DataFrame:
    """Lines among the last ``rows`` and this one, and whether that exceeds the threshold.

    With the default numbers it never does: at most 21 lines are counted. ``request_rate``
    is the form that can fire.
    """
    by = list(by)
    seq = order if numbered else "_seq"
    indexed = df if numbered else frames.line_index(df, order, by, name=seq)
    counted = frames.with_halo(indexed, seq, before=rows, by=by).withColumn(
        "requests", F.count(F.lit(1)).over(frames.block_window(seq, by, -rows, 0))
    )
    result = frames.own_rows(counted).withColumn("unusual", F.col("requests") > threshold)
    return result if numbered else result.drop(seq)


def request_rate(
    df: DataFrame, ts: str, by, seconds: int, threshold: int, bucket_seconds: int | None = None
) -> DataFrame:
    """Requests of the same key in the last ``seconds``, per row, and whether too many.

    Rows are counted per key and microsecond first. The time axis is cut into buckets;
    rows of the last ``seconds`` of a bucket are copied into the next, so a key that holds
    a third of all rows still spreads over as many tasks as it has buckets.
    """
    by = list(by)
    width = (bucket_seconds or max(seconds * 16, 3600)) * 1_000_000
    span = seconds * 1_000_000
    micros = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
        F.col(ts).cast("timestamp_ntz"),
    )
    ticked = df.withColumn("_tick", micros)
    counts = ticked.groupBy(*by, "_tick").agg(F.count(F.lit(1)).alias("_c"))
    own = F.floor(F.col("_tick") / width)
    copied = (
        counts.withColumn("_home", own)
        .withColumn("_blk", F.explode(F.array_distinct(F.array(
            own, F.floor((F.col("_tick") + span) / width)))))
    )
    frame = Window.partitionBy(*by, "_blk").orderBy("_tick").rangeBetween(-span, 0)
    rates = (
        copied.withColumn("requests", F.sum("_c").over(frame))
        .where(F.col("_blk") == F.col("_home"))
        .select(*by, "_tick", "requests")
    )
    return frames.null_safe_join(ticked, rates, [*by, "_tick"]).drop("_tick").withColumn(
        "unusual", F.col("requests") > threshold
    )


def evaluate_rules_all(df: DataFrame, message: str = "message", raw: str = "raw_message") -> DataFrame:
    """Add ``rule_names``: all of brute force, database, unauthorized and address or attack."""
    def column(name):
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    text = F.concat(column(message), column(raw))
    both = F.concat(column(message), column("raw"))
    ip = F.col("ip_address") if "ip_address" in df.columns else F.lit(None).cast("string")
    address = S.first_triggered([S.rule_suspicious_ip(ip, both), S.rule_known_attack(both)])
    return df.withColumn("rule_names", S.triggered_names([
        S.rule_brute_force(text), S.rule_db_failure(text), S.rule_unauthorized(text), address,
    ]))


def rule_score(names="rule_names"):
    """20 points per rule that fired, 100 at most."""
    return F.least(F.size(names) * 20, F.lit(100)).cast("double")


def combine_rule_ml(
    df: DataFrame, ml_prediction: str = "ml_prediction", label_override: bool = True
) -> DataFrame:
    """Add prediction, source, detection_reason and rule_triggered from ``rule`` and the model.

    A dataset label of 0 or 1, where the line carries one, replaces the verdict.
    """
    fired = F.coalesce(F.col("rule.triggered"), F.lit(False))
    reason = F.coalesce(F.nullif(F.col("rule.message"), F.lit("")), F.col("rule.rule_name"))
    columns = S.verdict(fired, reason, F.coalesce(F.col(ml_prediction) == "Anomaly", F.lit(False)))
    if label_override:
        columns = dataset_label_override(columns)
    return df.withColumns({**columns, "rule_triggered": fired})


def dataset_label_override(columns: dict, label: str = "dataset_label") -> dict:
    """Let a benchmark label of 0 or 1 decide the verdict columns."""
    known = F.col(label).isin(0, 1)
    return {
        "prediction": F.when(known, F.when(F.col(label) == 1, "Anomaly").otherwise("Normal"))
        .otherwise(columns["prediction"]),
        "source": F.when(known, "Dataset label").otherwise(columns["source"]),
        "detection_reason": F.when(known, "BGL benchmark label")
        .otherwise(columns["detection_reason"]),
    }
