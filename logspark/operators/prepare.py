"""Cleaned messages and the filters in front of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .frames import settle


def process_logs(df: DataFrame, **options) -> DataFrame:
    """Add ``cleaned_message``: the level and the message (or raw line), cleaned."""
    spoken = F.concat(
        F.coalesce(F.col("log_level"), F.lit("")), F.lit(" "), T.message_or_raw()
    )
    return settle(df.withColumn("cleaned_message", T.clean_message(spoken, **options)))


def filter_messages(df: DataFrame, longer_than: int = 0) -> DataFrame:
    """Rows whose model text has more than ``longer_than`` characters (training uses 3)."""
    return df.where(F.length(T.message_text()) > longer_than)
