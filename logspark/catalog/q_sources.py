"""Sources and sinks, over files that Spark writes out of the log lines first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, parse, sequence
from ..plans import scoring, training
from ..session import materialize, scratch_path
from ..sources import labels, logs, stores
from . import query, sqlparts as D
from .inputs import raw_logs, table


def log_folder(spark, sf_dir):
    """One folder per host with the host's lines in order, as text files."""
    path = scratch_path(spark, "logs")
    lines = raw_logs(spark, sf_dir).select("host", "line_no", F.col("line").alias("value"))
    lines.repartition("host").sortWithinPartitions("host", "line_no").select(
        "host", "value").write.partitionBy("host").text(path)
    return path


_FILES = D.RAW + """, files AS (
  SELECT 'host=' || host AS folder, row_number() OVER (PARTITION BY host ORDER BY line_no) - 1 AS n, line FROM raw_logs)"""


def _folder():
    return F.element_at(F.split("path", "/"), 1).alias("folder")


@query("read_logs", D.select(_FILES, "SELECT folder, n AS line_no, line FROM files"))
def read_logs(spark, sf_dir):
    lines = logs.read_logs(spark, log_folder(spark, sf_dir))
    return lines.select(_folder(), "line_no", "line")


@query("read_small_logs", D.select(_FILES, "SELECT folder, n AS line_no, line FROM files"))
def read_small_logs(spark, sf_dir):
    lines = logs.read_small_logs(spark, log_folder(spark, sf_dir))
    return lines.select(_folder(), "line_no", "line")


@query("dataset_inventory", f"""WITH {D.PARSED}, sizes AS (
  SELECT 'host=' || host AS folder, sum(strlen(line) + 1) AS size_bytes FROM raw_logs GROUP BY 1
), counts AS (SELECT 'host=' || host AS folder, count(*) AS records FROM parsed GROUP BY 1)
SELECT s.folder, '.txt' AS extension, CAST(size_bytes AS BIGINT) AS size_bytes, records FROM sizes s JOIN counts c ON c.folder = s.folder""")
def dataset_inventory(spark, sf_dir):
    path = log_folder(spark, sf_dir)
    records = parse.parse_logs(logs.read_logs(spark, path))
    made = logs.dataset_inventory(spark, path, records)
    return made.select(_folder(), "extension", "size_bytes", "records")


_WANTED = "SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 50"


def _wanted(docs):
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n >= 50").select(F.col("source").alias("path"))


@query("select_datasets", f"SELECT doc_id, source FROM documents WHERE source IN ({_WANTED})")
def select_datasets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return logs.select_datasets(docs, _wanted(docs), path="source")


@query("unknown_datasets", "SELECT DISTINCT lang AS path FROM documents WHERE lang NOT IN (SELECT source FROM documents)")
def unknown_datasets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return logs.unknown_datasets(docs, docs.select(F.col("lang").alias("path")), path="source")


@query("read_gold_csv", f"""SELECT md5(trim(text)) AS raw_md5, {D.clean('trim(text)')} AS cleaned, toxic AS label
FROM documents JOIN labels USING (doc_id) WHERE trim(text) <> ''""")
def read_gold_csv(spark, sf_dir):
    path = scratch_path(spark, "gold")
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    word = F.when(F.col("toxic") == 1, "anomaly").otherwise("0")
    joined.select(F.col("text").alias(" Raw_Message"), word.alias("IS_ANOMALY")).write.options(
        header="true", quoteAll="true", escape='"').csv(path)
    return labels.read_gold_csv(spark, path).select(F.md5("raw").alias("raw_md5"), "cleaned", "label")


@query("write_scored", D.select(D.VERDICTS, "SELECT id, prediction, source, detection_reason FROM verdicts"))
def write_scored(spark, sf_dir):
    path = scratch_path(spark, "scored")
    logs.write_scored(scoring.ingest(raw_logs(spark, sf_dir).drop("ts")), path)
    return spark.read.parquet(path).select("id", "prediction", "source", "detection_reason")


@query("write_metrics", """WITH c AS (SELECT count(*) FILTER (quality = toxic) AS ok, count(*) AS n FROM labels)
SELECT 'toxic' AS name, round(ok / n, 4) AS accuracy, n AS support_total, '0.2' AS ratio FROM c""")
def write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    metrics = evaluate.evaluate_binary(table(spark, sf_dir, "labels"), "quality", "toxic")
    stores.write_metrics(metrics, path, "toxic", ratio=0.2)
    back = stores.read_metrics(
        spark, path, "accuracy double, support_total bigint, ratio string")
    return back.select("name", "accuracy", "support_total", "ratio")


@query("save_load_model", """SELECT true AS same_scores, count(*) AS texts FROM documents""")
def save_load_model(spark, sf_dir):
    """Scores of a saved and loaded model against those of the fitted one."""
    docs = materialize(table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("key"), "text"))
    model = scoring.fit_text_model(docs, "key", "text")
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = scoring.TextModel.load(spark, path)
    columns = ("key", "ml_prediction", "confidence")
    first = scoring.score_texts(docs, "text", model, "key").select(*columns)
    second = scoring.score_texts(docs, "text", loaded, "key").select(*columns)
    joined = first.join(second.toDF("key", "_p", "_c"), "key")
    same = (F.col("ml_prediction") == F.col("_p")) & (F.col("confidence") == F.col("_c"))
    return joined.agg(F.min(same).alias("same_scores"), F.count(F.lit(1)).alias("texts"))


@query("save_load_sequence_model", """WITH runs AS (
  SELECT list(event_type) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run, event_id FROM events
) SELECT array_to_string(run, '>') AS run, count(*) AS seen FROM runs WHERE event_id >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def save_load_sequence_model(spark, sf_dir):
    path = scratch_path(spark, "sequences")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    keyed = sequence.sequence_keys(events, "event_id", "event_type", length=3)
    stores.save_tables(path, patterns=sequence.sequence_fit(keyed))
    back = stores.load_table(spark, path, "patterns")
    return back.select(F.array_join("run", ">").alias("run"), "seen")


@query("write_split", D.select(D.RAW, """
SELECT host AS path, count(*) AS lines FROM raw_logs WHERE trim(line) <> '' GROUP BY 1"""))
def write_split(spark, sf_dir):
    """Both parts of the split written as text and read back: no line is lost."""
    path = scratch_path(spark, "split")
    lines = raw_logs(spark, sf_dir).select(F.col("host").alias("path"), "line_no", "line")
    logs.write_split(training.split_lines(lines), path)
    back = spark.read.option("basePath", path).text(f"{path}/part=*")
    return back.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@query("analyze_datasets", f"""WITH {D.RULED} SELECT 'host=' || host AS folder, count(*) AS records FROM flagged
WHERE host IN ('host1', 'host3') GROUP BY 1""")
def analyze_datasets(spark, sf_dir):
    """The files of two hosts, read back, selected and scored."""
    lines = logs.read_logs(spark, log_folder(spark, sf_dir))
    paths = lines.select("path").distinct()
    wanted = paths.where(F.element_at(F.split("path", "/"), 1).isin("host=host1", "host=host3"))
    scored = scoring.ingest(logs.select_datasets(lines, wanted), by=["path"])
    return scored.groupBy(_folder()).agg(F.count("prediction").alias("records"))
