"""Splits and samples."""

from __future__ import annotations

from ..operators import splits
from . import query
from .inputs import table

_HASH = "md5(CAST(doc_id AS STRING) || ':42')"


@query("holdout_per_file", f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH}) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rn <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS part FROM r WHERE n >= 2""")
def holdout_per_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.holdout_per_file(docs, "source", "doc_id")


@query("stratified_split", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_HASH}) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return splits.stratified_split(labels, "quality", "doc_id")


@query("chronological_split", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN rn < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""")
def chronological_split(spark, sf_dir):
    return splits.chronological_split(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("sample_rows", """
SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS STRING) || ':42'), event_id LIMIT 5000""")
def sample_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return splits.sample_rows(events, "event_id", 5000)
