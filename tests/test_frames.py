"""Block-wise computations against plain global windows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from logspark.operators import features, frames, rules, splits
from logspark.plans import training


@pytest.fixture(scope="module")
def gappy(spark):
    """Sparse positions in two groups, one of which holds most rows."""
    chance = np.random.default_rng(1)
    at = np.sort(chance.choice(20_000, 3000, replace=False))
    frame = pd.DataFrame({
        "at": at, "grp": np.where(chance.random(3000) < 0.9, "hot", "cold"),
        "v": chance.integers(0, 2, 3000),
    })
    frame.loc[(frame["at"] > 5000) & (frame["at"] < 9000), "at"] += 0
    frame = frame[(frame["at"] < 5000) | (frame["at"] > 9000)]
    return spark.createDataFrame(frame).cache()


@pytest.mark.parametrize("block", [16, 500, 100_000])
@pytest.mark.parametrize("by", [(), ("grp",)])
def test_line_index_and_halo(gappy, block, by):
    plain = gappy.select("*", (F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1).cast("bigint").alias("seq"))
    made = frames.line_index(gappy, "at", by, block=block)
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()
    wide = frames.with_halo(made, "seq", before=10, by=by, block=block)
    framed = frames.own_rows(wide.withColumn("s", F.sum("v").over(frames.block_window("seq", by, -10, 0))))
    want = plain.withColumn("s", F.sum("v").over(Window.partitionBy(*by).orderBy("at").rowsBetween(-10, 0)))
    assert framed.exceptAll(want).isEmpty() and want.exceptAll(framed).isEmpty()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(gappy, descending):
    keyed = gappy.select(F.col("at").cast("string").alias("k"), "v")
    made = frames.running_totals(keyed, "k", ["v"], descending=descending, buckets=7)
    order = F.desc("k") if descending else F.asc("k")
    want = keyed.withColumn("cum_v", F.sum("v").over(
        Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()


def test_exact_quantiles(spark, gappy):
    values = gappy.select((F.col("at") % 97).cast("double").alias("x"))
    got = frames.exact_quantiles(values, "x", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    want = np.quantile([r[0] for r in values.collect()], [0.1, 0.5, 0.99])
    assert np.allclose([got.a, got.b, got.c], want)


def test_weighted_quantiles(spark):
    """A weight counts as so many copies, also more than any task could hold."""
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 4), ("a", 9.0, 0), ("a", 0.0, None), ("a", None, 2), ("b", 7.0, 10**12), ("b", 8.0, 1)]
    frame = spark.createDataFrame(rows, "g string, x double, w bigint")
    got = {r.g: (r.q, r.m) for r in frames.exact_quantiles(frame, "x", {"q": 0.3, "m": 0.9}, by=["g"], weight="w").collect()}
    assert np.allclose(got["a"], np.quantile([1, 1, 1, 2, 5, 5, 5, 5], [0.3, 0.9])) and got["b"] == (7.0, 7.0)


def test_no_single_partition_window_over_rows(gappy):
    plan = rules.request_frequency(gappy.select("at"), "at")._jdf.queryExecution().executedPlan().toString()
    # The only window without a partition key sums spans of blocks.
    for line in plan.splitlines():
        if "Window [" in line and "_span" not in line:
            assert "_blk" in line or "_place" in line


def test_request_rate_matches_range_frame(spark, gappy):
    rows = gappy.select(
        "grp", "at", F.timestamp_seconds(F.col("at") * 7).cast("timestamp_ntz").alias("ts"))
    made = rules.request_rate(rows, "ts", ["grp"], 600, 20, bucket_seconds=900).select("at", "requests")
    want = rows.select("at", F.count(F.lit(1)).over(
        Window.partitionBy("grp").orderBy(F.col("at") * 7).rangeBetween(-600, 0)).alias("requests"))
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()


def test_frequency_features_match_brute_force(spark):
    chance = np.random.default_rng(3)
    n = 400
    seconds = np.sort(chance.integers(0, 86_400 * 2, n))
    frame = pd.DataFrame({
        "line_no": np.arange(n), "record_ts": pd.to_datetime(seconds, unit="s"),
        "log_level": chance.choice(["INFO", "ERROR", "WARN", None], n),
        "ip_address": chance.choice(["10.0.0.1", "10.0.0.2", "10.0.0.3", None], n),
        "user": chance.choice(["a", "b", None], n), "status_code": 200, "content": "x",
    })
    df = spark.createDataFrame(frame, "line_no bigint, record_ts timestamp_ntz, log_level string, ip_address string, user string, status_code int, content string")
    got = features.frequency_features(df, "record_ts", minutes=30).orderBy("line_no").toPandas()
    for i in range(0, n, 7):
        near = frame[(seconds >= seconds[i] - 1800) & (seconds <= seconds[i] + 1800)]
        assert got["near_total"][i] == len(near)
        assert got["near_ips"][i] == near["ip_address"].dropna().nunique()
        assert got["near_users"][i] == near["user"].dropna().nunique()
        assert got["near_error"][i] == (near["log_level"] == "ERROR").sum()


def test_holdout_counts(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 950, "hot").otherwise("cold").alias("path"))
    parts = splits.holdout_per_file(rows, "path", "id").groupBy("path", "part").count().collect()
    assert {(r.path, r.part): r["count"] for r in parts} == {
        ("hot", "test"): 190, ("hot", "train"): 760, ("cold", "test"): 10, ("cold", "train"): 40}


def test_sample_rows_sorts_few_rows(spark):
    keys = [None, None, *range(20_000), 7, 7]
    df = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "key bigint, text string")
    digests = [(k is not None, hashlib.md5(f"{k}:42".encode()).hexdigest() if k is not None else "", k) for k in keys]
    for n in (0, 1, 500, 30_000):
        made = splits.sample_rows(df, "key", n)
        assert sorted(str(r["key"]) for r in made.collect()) == sorted(str(k) for *_, k in sorted(digests, key=lambda d: d[:2])[:n])
    few = splits.sample_rows(df, "key", 500)
    limits = few._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in limits.split("Sort", 1)[1]


def test_sampled_training_reads_its_sample(spark, monkeypatch):
    read, seen = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    def stop(lines, *_):
        seen.append(lines)
        raise InterruptedError

    lines = spark.range(3000).selectExpr("id AS line_no", "concat('INFO job ', id) AS line")
    monkeypatch.setattr(training.splits, "chronological_split", stop)
    with pytest.raises(InterruptedError):
        training.train_sampled(lines.mapInPandas(counted, "line_no bigint, line string"), sample=100)
    before = read.value
    assert seen[0].count() == seen[0].where("line LIKE 'INFO%'").count() == 100
    assert read.value == before > 0
