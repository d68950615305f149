"""The client's smaller flow: parse, ten-minute windows, z-score verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import parse, windows


def client_flow(lines: DataFrame, minutes: int = 10, by_time_of_day: bool = False) -> DataFrame:
    """Window verdicts over log lines."""
    logs = parse.parse_logs_client(lines)
    made = windows.window_features(logs, minutes=minutes, by_time_of_day=by_time_of_day)
    return windows.window_zscore_detect(made)
