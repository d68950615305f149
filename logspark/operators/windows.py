"""Time windows: tumbling features, their statistics, z-score verdicts and alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import frames

WINDOW_COLUMNS = ("error_count", "warn_count", "unique_templates", "avg_response_time",
                  "event_frequency", "std_deviation")


def number(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def half_up(value: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity, the way browsers do."""
    scale = 10.0 ** digits
    return F.floor(value * scale + 0.5).cast("double") / scale


def response_ms(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"(\d+)\s*ms", 1), F.lit("")).try_cast("double")


def window_aggregates(raw: str = "raw") -> list:
    """The aggregates of a window; errors, warnings, templates, lines, response times."""
    return [
        number(F.col("level") == "ERROR").alias("error_count"),
        number(F.col("level") == "WARN").alias("warn_count"),
        F.count_distinct("template").alias("unique_templates"),
        F.count(F.lit(1)).alias("event_frequency"),
        F.avg(response_ms(F.col(raw))).alias("_avg_ms"),
    ]


def finish_window(grouped: DataFrame, key: str) -> DataFrame:
    """Response time (or a stand-in from the errors) and spread of the three counts."""
    stand_in = 50 + F.col("error_count") * 30 + 25
    counts = [F.col(c) for c in ("error_count", "warn_count", "unique_templates")]
    mean = (counts[0] + counts[1] + counts[2]) / F.lit(3.0)
    spread = F.sqrt(sum((c - mean) * (c - mean) for c in counts) / F.lit(3.0))
    return grouped.select(
        key, "error_count", "warn_count", "unique_templates",
        half_up(F.coalesce(F.col("_avg_ms"), stand_in.cast("double"))).alias("avg_response_time"),
        "event_frequency", half_up(spread, 2).alias("std_deviation"),
    )


def window_features(
    df: DataFrame, ts: str = "timestamp", minutes: int = 10, by_time_of_day: bool = False
) -> DataFrame:
    """Tumbling window features over client records; lines without a time are left out.

    ``by_time_of_day`` puts the same clock time of all days into one window, named HH:MM.
    """
    when = F.try_to_timestamp(F.substring(F.col(ts), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    timed = df.withColumn("_when", when.cast("timestamp_ntz")).where(F.col("_when").isNotNull())
    if by_time_of_day:
        slot = F.floor(F.minute("_when") / minutes) * minutes
        key = F.format_string("%02d:%02d", F.hour("_when"), slot.cast("int"))
    else:
        key = F.window("_when", f"{minutes} minutes")["start"]
    grouped = timed.groupBy(key.alias("time_window")).agg(*window_aggregates())
    return finish_window(grouped, "time_window")


def window_features_1m(df: DataFrame, last: int | None = 50) -> DataFrame:
    """Per-minute features of parsed logs, the latest ``last`` windows (a report)."""
    grouped = df.where(F.col("timestamp") != "").groupBy(
        F.substring("timestamp", 1, 16).alias("time_window")
    ).agg(
        number(F.col("log_level") == "ERROR").alias("error_count"),
        number(F.col("log_level") == "WARN").alias("warn_count"),
        F.count_distinct("template").alias("unique_templates"),
        F.count(F.lit(1)).alias("_n"),
    )
    errors = F.col("error_count")
    made = grouped.select(
        "time_window", "error_count", "warn_count", "unique_templates",
        (errors * 100 + 200).cast("double").alias("avg_response_time"),
        (F.col("_n") / F.lit(10.0)).alias("event_frequency"),
        F.least(errors * F.lit(15.5), F.lit(50.0)).alias("std_deviation"),
    )
    return made if last is None else made.orderBy(F.desc("time_window")).limit(last)


def recent_anomalies(
    df: DataFrame, order: str = "line_no", last: int | None = 50, message_chars: int = 300
) -> DataFrame:
    """Per-minute alerts over scored logs: windows with an anomaly or an error.

    The latest anomaly of a window lends its message, source and reason; among equal
    stamps the first line wins.
    """
    anomalous = F.col("prediction") == "Anomaly"
    latest = F.max_by(
        F.struct("message", "source", "detection_reason", "service", "log_level", "confidence"),
        F.when(anomalous, F.struct("timestamp", -F.col(order))),
    )
    grouped = df.where(F.col("timestamp") != "").groupBy(
        F.substring("timestamp", 1, 16).alias("time_window")
    ).agg(
        F.count(F.lit(1)).alias("_n"),
        number(F.col("log_level") == "ERROR").alias("error_count"),
        number(F.col("log_level") == "WARN").alias("warn_count"),
        number(anomalous).alias("_anomalies"),
        F.avg(F.when(anomalous, F.col("confidence"))).alias("_confidence"),
        F.count_distinct("template").alias("unique_templates"),
        latest.alias("_latest"),
    )
    errors, found = F.col("error_count"), F.col("_anomalies") > 0
    share = F.col("_anomalies") / F.col("_n")
    scored = grouped.where(found | (errors > 0)).withColumn(
        "anomaly_score",
        F.when(found, F.least(F.col("_confidence") + share * 0.3, F.lit(1.0))).otherwise(0.0),
    )

    def from_latest(field: str, otherwise: Column) -> Column:
        return F.when(found, F.coalesce(F.col(f"_latest.{field}"), F.lit(""))).otherwise(otherwise)

    score = F.col("anomaly_score")
    error_text = errors.cast("string")
    made = scored.select(
        "time_window",
        F.substring(
            from_latest("message", F.concat(error_text, F.lit(" errors detected"))), 1, message_chars
        ).alias("message"),
        F.lit("Anomaly").alias("prediction"),
        F.when(score > 0, score).when(found, F.col("_latest.confidence")).otherwise(0.5)
        .alias("confidence"),
        from_latest("source", F.lit("Statistical")).alias("source"),
        from_latest("detection_reason", F.concat(F.lit("High error count ("), error_text, F.lit(")")))
        .alias("detection_reason"),
        from_latest("service", F.lit("System")).alias("service"),
        F.when(errors > 0, "ERROR").otherwise(from_latest("log_level", F.lit("INFO")))
        .alias("log_level"),
        "error_count",
        (F.col("_anomalies") * 50 + errors * 100 + 200).cast("double").alias("avg_response_time"),
        "unique_templates", "anomaly_score",
        F.lit(True).alias("is_anomaly"), F.lit("anomaly").alias("hybrid_decision"),
    )
    return made if last is None else made.orderBy(F.desc("time_window")).limit(last)


def window_statistics(df: DataFrame, columns) -> DataFrame:
    """Mean, population deviation and the 99th-percentile element per column, as rows."""
    result = None
    for name in columns:
        value = F.col(name).cast("double")
        narrow = df.select(value.alias("value"))
        ranked = frames.ranked_counts(narrow, "value")
        above = F.floor(F.col("_size") * F.lit(0.99))
        p99 = ranked.agg(
            F.min(F.when(F.col("cum_n") > above, F.col("value"))).alias("_p"),
            F.max("value").alias("_max"),
        ).select(F.coalesce(F.nullif(F.col("_p"), F.lit(0.0)), F.col("_max")))
        row = narrow.agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
        ).select(F.lit(name).alias("metric"), "mean", "std", p99.scalar().alias("p99"))
        result = row if result is None else result.unionByName(row)
    return result


def window_zscore_detect(df: DataFrame) -> DataFrame:
    """A verdict per window from its distance to the mean window and from fixed limits."""
    metrics = ("error_count", "avg_response_time", "unique_templates", "event_frequency")
    stats = df.agg(*[
        part for name in metrics
        for part in (F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std"))
    ])
    judged = df.withColumn("_s", stats.select(F.struct("*")).scalar())

    def stat(name: str, kind: str) -> Column:
        return F.col(f"_s.{name}_{kind}")

    distances = [
        F.when(stat(m, "std") > 0, F.abs(F.col(m) - stat(m, "mean")) / stat(m, "std"))
        for m in metrics
    ]
    used = sum(F.when(d.isNotNull(), 1).otherwise(0) for d in distances)
    total = sum(F.coalesce(d, F.lit(0.0)) for d in distances)
    score = F.when(used == 0, 0.0).otherwise(1 / (1 + F.exp(2 - total / used)))

    def limit(name: str, floor: float) -> Column:
        return F.greatest(stat(name, "mean") + 3 * stat(name, "std"), F.lit(floor))

    beyond = (F.col("error_count") > limit("error_count", 12.0)) | (
        F.col("avg_response_time") > limit("avg_response_time", 700.0)
    )
    outlying = F.col("_score") > 0.65
    return judged.withColumn("_score", score).withColumns({
        "isolation_forest": F.when(outlying, "anomaly").otherwise("normal"),
        "statistical": F.when(beyond, "anomaly").otherwise("normal"),
    }).withColumn(
        "hybrid_decision",
        F.when((F.col("isolation_forest") == "anomaly") & (F.col("statistical") == "anomaly"), "anomaly")
        .when((F.col("isolation_forest") == "anomaly") | (F.col("statistical") == "anomaly"), "warning")
        .otherwise("normal"),
    ).select(
        F.col("time_window"), "error_count", "avg_response_time", "unique_templates",
        half_up(F.col("_score"), 2).alias("anomaly_score"),
        (F.col("hybrid_decision") != "normal").alias("is_anomaly"),
        "isolation_forest", "statistical", "hybrid_decision",
    )


def client_summary(lines: DataFrame, logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row of totals over the lines, the parsed records and the window verdicts."""
    counts = logs.agg(
        F.count(F.lit(1)).alias("parsed_logs"),
        F.coalesce(number(F.col("level") == "ERROR"), F.lit(0)).alias("error_count"),
        F.coalesce(number(F.col("level") == "WARN"), F.lit(0)).alias("warn_count"),
        F.count_distinct("template").alias("unique_templates"),
    )
    windows = verdicts.agg(F.struct(
        F.coalesce(number(F.col("hybrid_decision") == "anomaly"), F.lit(0)).alias("anomaly_count"),
        F.coalesce(number(F.col("hybrid_decision") == "warning"), F.lit(0)).alias("warning_count"),
    ))
    total = lines.agg(F.count(F.lit(1)))
    return counts.select(
        total.scalar().alias("total_lines"), "*", windows.scalar().alias("_w")
    ).select("*", "_w.*").drop("_w")


def stats(df: DataFrame) -> DataFrame:
    """Totals over scored logs, the share of anomalies in percent."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.coalesce(number(F.col("prediction") == "Anomaly"), F.lit(0)).alias("anomaly_count"),
    )
    share = F.round(F.col("anomaly_count") * 100.0 / F.col("total_logs"), 1)
    return counted.select(
        "total_logs", "anomaly_count",
        (F.col("total_logs") - F.col("anomaly_count")).alias("normal_count"),
        F.when(F.col("total_logs") > 0, share).otherwise(0.0).alias("anomaly_percentage"),
    )


def scored_logs(logs: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Logs with their verdict; a log without one is Normal at 0 from the model."""
    defaults = {"prediction": "Normal", "confidence": 0.0, "source": "ML", "detection_reason": ""}
    verdict = predictions.select(key, *defaults)
    return logs.join(verdict, key, "left").withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    )


def top_services(df: DataFrame, top: int = 8) -> DataFrame:
    """Services with the most anomalies (a top-k report); ties by name."""
    name = F.coalesce(F.nullif(F.col("service"), F.lit("")), F.lit("System")).alias("service")
    counted = df.where(F.col("prediction") == "Anomaly").groupBy(name).agg(
        F.count(F.lit(1)).alias("anomalies")
    )
    return counted.orderBy(F.desc("anomalies"), "service").limit(top)


def critical_errors(df: DataFrame, level: str = "log_level") -> DataFrame:
    return df.where(F.col(level) == "ERROR")


def search_logs(
    df: DataFrame, text: str = "", level: str = "ALL", prediction: str = "ALL",
    order: str = "line_no", first: int | None = 100,
) -> DataFrame:
    """Logs by level, verdict and a case-insensitive substring, the ``first`` of them."""
    found = df
    if level != "ALL":
        found = found.where(F.col("log_level") == level)
    if prediction != "ALL":
        found = found.where(F.col("prediction") == prediction)
    if text:
        found = found.where(F.lower("message").contains(text.lower()))
    return found if first is None else found.orderBy(order).limit(first)


def threat_alerts(df: DataFrame) -> DataFrame:
    """Windows whose verdict is not normal, or that are flagged."""
    return df.where((F.col("hybrid_decision") != "normal") | F.col("is_anomaly"))


def flag_high_windows(df: DataFrame) -> DataFrame:
    """Mark windows with many errors or slow responses, and those with many warnings."""
    return df.withColumns({
        "is_high": (F.col("error_count") > 12) | (F.col("avg_response_time") > 700),
        "many_warnings": F.col("warn_count") > 8,
    })


def backend_window_flag(df: DataFrame) -> DataFrame:
    """The dashboard's reading of an alert: more than five errors make it statistical."""
    anomalous = F.col("prediction") == "Anomaly"
    return df.withColumns({
        "isolation_forest": F.when(anomalous, "anomaly").otherwise("normal"),
        "statistical": F.when(F.col("error_count") > 5, "anomaly").otherwise("normal"),
        "hybrid_decision": F.when(anomalous, "anomaly").otherwise("normal"),
    })
