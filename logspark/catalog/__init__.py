"""Registered queries: each a Spark callable and, where SQL can say it, its SQL text."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under a name."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


MODULES = ("q_parse", "q_rules", "q_features", "q_windows", "q_text", "q_sequence", "q_evaluate", "q_splits", "q_models", "q_plans", "q_sources", "q_streams")


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
