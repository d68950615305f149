"""Driver tables, and the log lines written out of ``events`` for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The line for each event, by event number; {ts} is the event time as text.
_LINE = r"""
CASE WHEN event_id % 100 BETWEEN 40 AND 44
     THEN concat({ts}, ' WARN Login failed for user u', CAST(user_id AS STRING), ' from 10.0.0.', CAST(user_id % 250 AS STRING))
ELSE CASE CAST(event_id % 17 AS INT)
 WHEN 0 THEN concat({ts}, ' INFO User u', CAST(user_id AS STRING), ' logged in successfully from 203.0.113.', CAST(user_id % 250 AS STRING))
 WHEN 1 THEN concat({ts}, ' ERROR Database connection timeout after ', CAST(event_id % 60 AS STRING), 's')
 WHEN 2 THEN concat({ts}, ',worker,WARN,"queue depth exceeded, retrying"')
 WHEN 3 THEN concat('{{"time":"', replace({ts}, ' ', 'T'), 'Z","severity":"ERROR","logger":"api","event":"timeout after ', CAST(event_id % 900 AS STRING), ' ms"}}')
 WHEN 4 THEN concat('10.0.0.', CAST(user_id % 250 AS STRING), ' - - [01/Jan/2024:10:00:00 +0000] "GET /api/users/', CAST(user_id AS STRING), ' HTTP/1.1" 500 10')
 WHEN 5 THEN concat('vhost1 www 198.51.100.', CAST(user_id % 250 AS STRING), ' - [01/Jan/2024:10:00:00 +0000] "GET /health HTTP/1.1" 200 10')
 WHEN 6 THEN concat(CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'APPREAD' END, ' 1117838570 2005.06.03 R02-M1 2005-06-03-15.42.50.363779 R02-M1 RAS KERNEL FATAL data storage interrupt ', CAST(event_id % 9 AS STRING))
 WHEN 7 THEN concat('081109 203615 ', CAST(event_id % 99 AS STRING), ' INFO dfs.DataNode: PacketResponder for block blk_', CAST(event_id AS STRING), ' terminating')
 WHEN 8 THEN concat({ts}, ' INFO [billing] Payment of ', CAST(value AS STRING), ' took ', CAST(event_id % 1500 AS STRING), ' ms at /var/app/pay.log')
 WHEN 9 THEN concat({ts}, ' CRITICAL Brute force attack detected from 192.168.1.', CAST(user_id % 250 AS STRING))
 WHEN 10 THEN concat({ts}, ' WARN 403 Forbidden for user=u', CAST(user_id AS STRING), ' status: 403')
 WHEN 11 THEN concat({ts}, ' WARN possible SQL injection in id 0x', CAST(event_id % 9000 AS STRING))
 WHEN 12 THEN concat('heartbeat ', event_type, ' from node ', CAST(user_id AS STRING))
 WHEN 13 THEN concat({ts}, ' DEBUG Cache hit for key ', CAST(event_id % 50 AS STRING))
 WHEN 14 THEN '   '
 WHEN 15 THEN concat('{{"broken json ', CAST(event_id AS STRING))
 ELSE concat({ts}, ' NOTICE Auth token check ok from 172.16.0.', CAST(user_id % 250 AS STRING)) END END"""

LINE_SPARK = _LINE.format(ts="date_format(ts,'yyyy-MM-dd HH:mm:ss')")
LINE_DUCK = _LINE.format(ts="strftime(ts,'%Y-%m-%d %H:%M:%S')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_log_lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("line_no"), "ts",
        F.concat(F.lit("host"), (F.col("user_id") % 8).cast("string")).alias("host"),
        F.expr(LINE_SPARK).alias("line"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that costs more than the read.

    A small file arrives as one partition, and a parse of it would run in one task. Inputs
    that already have a partition per core are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: line_no bigint, ts timestamp_ntz, host string, line string."""
    events = table(spark, sf_dir, "events").drop("props")
    return as_log_lines(spread(events))


def spread(scan):
    """A scan whose files make fewer tasks than the session shuffles into, dealt out evenly.

    Files of one row group are one task, however much work their rows make.
    """
    width = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return scan.repartition(width) if scan.rdd.getNumPartitions() < width else scan
