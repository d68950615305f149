"""Gold labels from CSV files whose headers vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fields import parse_label, strip
from ..functions.text import clean_message

MESSAGE_NAMES = ("message", "raw_message", "raw", "log")
LABEL_NAMES = ("label", "is_anomaly", "anomaly", "gold_label")


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """(raw, cleaned, label) of the rows with a message and a 0/1 label.

    Header names are matched trimmed and in lower case, the first alias wins. Files
    without a message or a label column give no rows. A field may span lines.
    """
    table = spark.read.options(
        header="true", multiLine="true", quote='"', escape='"', mode="PERMISSIVE"
    ).csv(path)
    by_name = {name.strip().lower(): name for name in table.columns}
    message = next((by_name[n] for n in MESSAGE_NAMES if n in by_name), None)
    label = next((by_name[n] for n in LABEL_NAMES if n in by_name), None)
    if message is None or label is None:
        return spark.createDataFrame([], "raw string, cleaned string, label int")
    raw = strip(F.coalesce(F.col(f"`{message}`"), F.lit("")))
    rows = table.select(raw.alias("raw"), parse_label(F.col(f"`{label}`")).alias("label"))
    kept = rows.where((F.length("raw") > 0) & F.col("label").isNotNull())
    cleaned = F.coalesce(F.nullif(clean_message(F.col("raw")), F.lit("")), F.col("raw"))
    return kept.select("raw", cleaned.alias("cleaned"), "label")
