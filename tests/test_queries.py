"""Registered queries against their SQL at the smallest scale.

By default a selection that touches every module; LOGSPARK_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = (
    "parse_logs", "parse_logs_client", "clean_message", "run_rules", "request_rate",
    "all_features", "window_zscore_detect", "recent_anomalies", "tfidf_transform", "lof",
    "sequence_ensemble", "optimal_threshold", "stratified_split", "ingest", "read_logs",
    "stream_repeated_failures", "stream_window_features", "fused_scores",
)
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("LOGSPARK_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
