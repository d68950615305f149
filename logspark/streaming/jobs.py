"""Streams over log lines: scoring, window features, rates, and the keyed failure rule.

Each function takes a streaming DataFrame and returns one; ``run_available`` starts it,
works off what is there and stops, which is how tests and backfills use it.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import signatures as S
from ..operators import parse, prepare, rules, windows
from ..session import scratch_path


def stream_lines(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_trigger).parquet(folder)
    )


def stream_text(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder as a stream of lines."""
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def stream_scored(lines: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Parse, clean and the rules that need one line; no state."""
    logs = prepare.process_logs(parse.parse_logs(lines, line, line_no))
    return rules.combine_rule_ml(
        rules.run_rules(logs, order=None).withColumns(
            {"ml_prediction": F.lit("Normal"), "confidence": F.lit(0.5)})
    )


def _on_clock(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return df.withColumn("_clock", F.col(ts).cast("timestamp"))


def stream_window_features(
    records: DataFrame, ts: str, minutes: int = 10, late: str = "30 minutes"
) -> DataFrame:
    """Tumbling window features of client records; later rows than ``late`` are dropped.

    A window comes out once the watermark has passed it. Counts are kept per window and
    template first and added up per window then, so a state row is a few numbers however
    many templates a window has.
    """
    size = f"{minutes} minutes"
    timed = _on_clock(records, ts).withWatermark("_clock", late)
    by_template = timed.groupBy(F.window("_clock", size).alias("_w"), "template").agg(
        windows.number(F.col("level") == "ERROR").alias("_errors"),
        windows.number(F.col("level") == "WARN").alias("_warnings"),
        F.count(F.lit(1)).alias("_lines"),
        F.sum(windows.response_ms(F.col("raw"))).alias("_ms"),
        F.count(windows.response_ms(F.col("raw"))).alias("_timed"),
    )
    grouped = by_template.groupBy(F.window("_w", size)).agg(
        F.sum("_errors").alias("error_count"),
        F.sum("_warnings").alias("warn_count"),
        F.count("template").alias("unique_templates"),
        F.sum("_lines").alias("event_frequency"),
        (F.sum("_ms") / F.sum("_timed")).alias("_avg_ms"),
    )
    return windows.finish_window(
        grouped.withColumn("time_window", F.col("window.start").cast("timestamp_ntz")), "time_window")


def stream_request_rate(
    df: DataFrame, ts: str, by: str, threshold: int, size: str = "10 minutes",
    slide: str = "5 minutes", late: str = "30 minutes",
) -> DataFrame:
    """Sliding windows in which a key has more than ``threshold`` requests."""
    timed = _on_clock(df, ts).withWatermark("_clock", late)
    counted = timed.groupBy(F.window("_clock", size, slide), by).agg(
        F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > threshold).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), by, "requests")


def stream_repeated_failures(
    logs: DataFrame, by: str, order: str = "line_no", window: int = 10, min_hits: int = 3
) -> DataFrame:
    """The repeated-failure rule per key, with the last ``window`` flags as state.

    Expects parsed logs. Inside a micro-batch rows are ordered by ``order``; what a task
    holds of a key is its rows of one micro-batch, which ``stream_lines`` bounds.
    """
    flagged = logs.select(
        by, order,
        S.is_login_failure(F.concat_ws(" ", "message", "raw")).cast("int").alias("hit"),
    )
    kind = dict(flagged.dtypes)
    schema = f"{by} {kind[by]}, {order} {kind[order]}, login_failures bigint, repeated boolean"

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(batches)).sort_values(order, kind="stable")
        hits = pd.Series(recent + batch["hit"].tolist(), dtype="int64")
        sums = hits.rolling(window + 1, min_periods=1).sum().astype("int64").to_numpy()[len(recent):]
        state.update((hits.tolist()[-window:],))
        yield pd.DataFrame({
            by: batch[by].to_numpy(), order: batch[order].to_numpy(),
            "login_failures": sums, "repeated": sums >= min_hits,
        })

    return flagged.groupBy(by).applyInPandasWithState(
        count, schema, "recent array<int>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run a stream over what is there, into Parquet, and return the written table.

    Output and checkpoint lie in the session's shared folder.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
