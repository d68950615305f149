"""Metrics as JSON, and fitted models as Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.forest import Forest

METRICS_SCHEMA = "name string, payload string"


def write_metrics(metrics: DataFrame, path: str, name: str = "metrics", **context) -> None:
    """Write metric rows as JSON lines, each with its name and the run's parameters."""
    payload = F.to_json(F.struct(
        *metrics.columns, *[F.lit(json.dumps(v)).alias(k) for k, v in context.items()]
    ))
    metrics.select(F.lit(name).alias("name"), payload.alias("payload")).write.mode(
        "overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric rows back, by the schema of the payload."""
    rows = spark.read.schema(METRICS_SCHEMA).json(path)
    return rows.select("name", F.from_json("payload", schema).alias("m")).select("name", "m.*")


def save_tables(path: str, **tables: DataFrame) -> None:
    """One Parquet table per part of a model: vocabulary, patterns, offsets, scaler."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def save_model(path: str, vocabulary: DataFrame, forest: Forest) -> None:
    """A text model: its vocabulary and its forest."""
    save_tables(path, vocabulary=vocabulary)
    forest.save(f"{path}/forest")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, Forest]:
    return load_table(spark, path, "vocabulary"), Forest.load(spark, f"{path}/forest")
