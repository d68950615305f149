"""Log files of any supported suffix under a root, as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import frames

SUFFIXES = ("txt", "log", "csv", "json")
GOLD_FILE = "labeled_eval.csv"


def _path_under(root: str):
    """The path of a file below the root, from its full URI."""
    anchored = root.rstrip("/").split("://")[-1].replace("file:", "")
    full = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^[a-z0-9]+:/*(?=/)", "")
    at = F.instr(full, F.lit(anchored))
    return F.ltrim(F.substring(full, at + F.lit(len(anchored)), F.length(full)), F.lit("/"))


def any_case(suffixes) -> str:
    """A path pattern for the suffixes in upper, lower or mixed case."""
    spelled = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*.{" + ",".join(spelled) + "}"


def _text(spark: SparkSession, root: str, suffixes, exclude, whole: bool) -> DataFrame:
    """(path, value, split start) of the wanted files below a root."""
    glob = any_case(suffixes)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    texts = reader.text(root, wholetext=whole).select(
        _path_under(root).alias("path"), "value",
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    if not exclude:
        return texts
    return texts.where(~F.element_at(F.split("path", "/"), -1).isin(*exclude))


def read_logs(
    spark: SparkSession, root: str, exclude=(GOLD_FILE,), suffixes=SUFFIXES
) -> DataFrame:
    """(path, line_no, line) of every log file below ``root``, numbered from 0 per file.

    Files of any size are read in splits. Inside a split rows have consecutive ids; the
    lines of the splits before it are counted, which reads the files twice.
    """
    lines = _text(spark, root, suffixes, exclude, whole=False)
    starts = lines.groupBy("path", "_start").agg(
        F.min("_id").alias("_first"), (F.max("_id") - F.min("_id") + 1).alias("n")
    )
    offsets = frames.sums_along(starts.select("path", "_start", "n"), "_start", ["n"], by=["path"])
    placed = starts.join(offsets, ["path", "_start"]).select("path", "_start", "_first", "cum_n")
    return lines.join(placed, ["path", "_start"]).select(
        "path", (F.col("cum_n") + F.col("_id") - F.col("_first")).alias("line_no"),
        F.col("value").alias("line"),
    )


def read_small_logs(
    spark: SparkSession, root: str, exclude=(GOLD_FILE,), suffixes=SUFFIXES
) -> DataFrame:
    """The same for many small files: each is read once, as one text, and cut into lines."""
    texts = _text(spark, root, suffixes, exclude, whole=True).where(F.length("value") > 0)
    body = F.regexp_replace("value", r"(?:\r\n|\n|\r)\z", "")
    return texts.select(
        "path", F.posexplode(F.split(body, "\r\n|\n|\r")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def select_datasets(logs: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """Only the rows of the wanted files; ``wanted`` has one column ``path``."""
    return logs.join(wanted.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def unknown_datasets(logs: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """Wanted files that are not there; a caller raises if there are any."""
    return wanted.select("path").distinct().join(
        logs.select(F.col(path).alias("path")).distinct(), "path", "left_anti"
    )


def dataset_inventory(spark: SparkSession, root: str, parsed: DataFrame, exclude=(GOLD_FILE,)) -> DataFrame:
    """Every file below the root with its size and its number of parsed records.

    ``parsed`` has a row per record and a column ``path``. Files without records stay.
    """
    glob = any_case(SUFFIXES)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(root)
        .select(_path_under(root).alias("path"), F.col("length").alias("size_bytes"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.isin(*exclude)) if exclude else files
    records = parsed.groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    return kept.join(records, "path", "left").select(
        "path", name.alias("name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"),
        "size_bytes", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"),
    )


def write_scored(scored: DataFrame, path: str) -> None:
    """Replace the stored scored logs."""
    scored.write.mode("overwrite").parquet(path)


def write_split(df: DataFrame, path: str, line: str = "line", part: str = "part") -> None:
    """Write the lines of both parts as text files in new folders, one per part and source."""
    df.select(part, "path", F.col(line).alias("value")).write.mode("overwrite").partitionBy(
        part, "path").text(path)
