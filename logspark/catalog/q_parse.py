"""Parsing and text preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X, patterns as P, text as T
from ..operators import parse, prepare
from . import query, sqlparts as D
from .inputs import raw_logs, table

FIELDS = ("line_no", "id", "timestamp", "service", "log_level", "message", "ip_address",
          "user_id", "status_code", "log_type")
_LIST = 'line_no, id, "timestamp", service, log_level, message, ip_address, user_id, status_code, log_type'


def parsed(spark, sf_dir):
    return parse.parse_logs(raw_logs(spark, sf_dir))


@query("detect_log_type", D.select(D.TYPED, "SELECT line_no, log_type FROM typed"))
def detect_log_type(spark, sf_dir):
    lines = raw_logs(spark, sf_dir).select("line_no", X.strip(F.col("line")).alias("raw"))
    return lines.where(F.length("raw") > 0).select(
        "line_no", parse.log_type(F.col("raw")).alias("log_type"))


def _one_format(kind, extra=""):
    sql = D.select(D.PARSED, f"SELECT {_LIST}{extra} FROM parsed WHERE log_type = '{kind}'")

    def run(spark, sf_dir):
        return parsed(spark, sf_dir).where(F.col("log_type") == kind).select(
            *FIELDS, *[c.strip() for c in extra.split(",") if c.strip()])

    return sql, run


for _name, _kind, _extra in (
    ("parse_json_log", "json", ""), ("parse_apache", "apache_nginx", ""),
    ("parse_bgl", "bgl", ", dataset_label"), ("parse_csv_log", "csv", ""),
    ("parse_application", "application", ""), ("parse_plain", "plain", ""),
):
    _sql, _run = _one_format(_kind, _extra)
    query(_name, _sql)(_run)


@query("parse_logs", D.select(D.PARSED, f"SELECT {_LIST}, raw, dataset_label, event_ts FROM parsed"))
def parse_logs(spark, sf_dir):
    return parsed(spark, sf_dir).select(*FIELDS, "raw", "dataset_label", "event_ts")


_WORDS = "upper(event_type), upper(substr(event_type, 1, 4)), lang"
_LEVEL_POOL = ["EMERG", "alert", "Crit", "WARNING", "notice", "TRACE", "debug", "FATAL", "info",
               "error", "warn", "severe", "critical", "ERR", "other"]
_POOL_SQL = "[" + ", ".join(D.q(w) for w in _LEVEL_POOL) + "]"


def _level_words(spark, sf_dir):
    """A level spelling for every event, picked by its number."""
    words = F.array(*[F.lit(w) for w in _LEVEL_POOL])
    at = (F.col("event_id") % len(_LEVEL_POOL)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", words[at].alias("word"))


_LEVEL_SQL = (f"SELECT event_id, word, {{}} AS level FROM (SELECT event_id, "
              f"{_POOL_SQL}[event_id % {len(_LEVEL_POOL)} + 1] AS word FROM events)")


@query("normalize_level", _LEVEL_SQL.format(D.norm_level("word")))
def normalize_level(spark, sf_dir):
    return _level_words(spark, sf_dir).withColumn("level", X.normalize_level(F.col("word")))


@query("normalize_level_client", _LEVEL_SQL.format(D.norm_level_client("word")))
def normalize_level_client(spark, sf_dir):
    return _level_words(spark, sf_dir).withColumn(
        "level", X.normalize_level(F.col("word"), client=True))


@query("guess_service", D.select(D.RAW, f"SELECT line_no, {D.service_of('line')} AS service FROM raw_logs"))
def guess_service(spark, sf_dir):
    return raw_logs(spark, sf_dir).select(
        "line_no", X.guess_service(F.col("line")).alias("service"))


@query("guess_component_client", D.select(
    D.RAW, f"SELECT line_no, {D.first_named('line', P.CLIENT_COMPONENTS, 'System')} AS component FROM raw_logs"))
def guess_component_client(spark, sf_dir):
    return raw_logs(spark, sf_dir).select(
        "line_no", X.guess_service(F.col("line"), client=True).alias("component"))


@query("extract_entities", D.select(D.RAW, f"""
SELECT line_no, {D.ip_of('line')} AS ip_address, {D.user_of('line')} AS user_id,
  {D.status_of('line')} AS status_code FROM raw_logs"""))
def extract_entities(spark, sf_dir):
    line = F.col("line")
    return raw_logs(spark, sf_dir).select(
        "line_no", X.extract_ip(line).alias("ip_address"),
        X.extract_user(line).alias("user_id"), X.extract_status(line).alias("status_code"))


_EDGE_IP = r"(?:^|[^\p{L}\p{N}_])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:$|[^\p{L}\p{N}_])"
_EDGE_STATUS = (r"(?:^|[^\p{L}\p{N}_])(200|201|301|302|400|401|403|404|500|502|503)"
                r"(?:$|[^\p{L}\p{N}_])")


@query("extract_entities_html", f"""
SELECT page_id, nullif(regexp_extract(html, {D.q(_EDGE_IP)}, 1), '') AS ip_address,
  {D.user_of('html')} AS user_id,
  coalesce(nullif(regexp_extract(html, {D.q(P.STATUS_BY_KEY)}, 1), ''),
    nullif(regexp_extract(html, {D.q(_EDGE_STATUS)}, 1), '')) AS status_code FROM pages""")
def extract_entities_html(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.extract_ip(html).alias("ip_address"),
        X.extract_user(html).alias("user_id"), X.extract_status(html).alias("status_code"))


@query("extract_template", D.select(D.RAW, f"""
SELECT line_no, {D.template('line')} AS template,
  array_to_string({D.template_passes('line')}, '|') AS params FROM raw_logs"""))
def extract_template(spark, sf_dir):
    return raw_logs(spark, sf_dir).select(
        "line_no", X.mask_template(F.col("line")).alias("template"),
        F.array_join(X.template_params(F.col("line")), "|").alias("params"))


@query("parse_logs_client", D.select(D.CLIENT, """
SELECT line_no, id, "timestamp", level, raw, template, array_to_string(params, '|') AS params,
  component FROM client"""))
def parse_logs_client(spark, sf_dir):
    return parse.parse_logs_client(raw_logs(spark, sf_dir)).select(
        "line_no", "id", "timestamp", "level", "raw", "template",
        F.array_join("params", "|").alias("params"), "component"
    ).orderBy(F.asc_nulls_last("timestamp"), "line_no")


@query("parse_feature_record", D.select(D.RECORDS, """
SELECT line_no, record_ts, log_level, ip_address, "user", status_code, content FROM records"""))
def parse_feature_record(spark, sf_dir):
    return parse.parse_feature_record(raw_logs(spark, sf_dir).drop("ts", "host"))


_LABEL_TEXT = "CASE quality WHEN 1 THEN ' Anomaly ' ELSE 'false' END"


@query("parse_label", f"""
SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN toxic = 0 THEN 0 END AS from_number,
  CASE WHEN quality = 1 THEN 1 WHEN quality IS NULL OR quality <> 1 THEN 0 END AS from_word,
  CASE WHEN doc_id IN (0, 1) THEN CAST(doc_id AS INTEGER) END AS from_other FROM labels""")
def parse_label(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", X.parse_label(F.col("toxic").cast("string")).alias("from_number"),
        X.parse_label(F.expr(_LABEL_TEXT)).alias("from_word"),
        X.parse_label(F.col("doc_id")).alias("from_other"))


@query("split_lines", """
WITH parts AS (
  SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM parts
)
SELECT doc_id, line_no, 'log-' || line_no AS id, md5(trim(line)) AS line_md5 FROM numbered
WHERE trim(line) <> ''""")
def split_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = parse.split_lines(docs, "text").withColumn("line", X.strip(F.col("line")))
    return lines.where(F.length("line") > 0).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.concat(F.lit("log-"), F.col("line_no").cast("string")).alias("id"),
        F.md5("line").alias("line_md5"))


@query("clean_message", f"SELECT doc_id, {D.clean('text')} AS cleaned FROM documents")
def clean_message(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.clean_message(F.col("text")).alias("cleaned"))


@query("clean_message_keep_stop", f"SELECT doc_id, {D.clean('text', stop=False)} AS cleaned FROM documents")
def clean_message_keep_stop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.clean_message(F.col("text"), remove_stop=False).alias("cleaned"))


@query("process_logs", D.select(D.PROCESSED, "SELECT id, log_level, message, cleaned_message FROM processed"))
def process_logs(spark, sf_dir):
    return prepare.process_logs(parsed(spark, sf_dir)).select(
        "id", "log_level", "message", "cleaned_message")


@query("filter_messages", D.select(D.PROCESSED, """
SELECT id, trim(coalesce(nullif(cleaned_message, ''), message, '')) AS text FROM processed
WHERE length(trim(coalesce(nullif(cleaned_message, ''), message, ''))) > 3"""))
def filter_messages(spark, sf_dir):
    processed = prepare.process_logs(parsed(spark, sf_dir))
    return prepare.filter_messages(processed, longer_than=3).select(
        "id", T.message_text().alias("text"))


def _duck_vectors(text):
    out = f"lower({text})"
    for pattern in P.VECTOR_STAMPS:
        out = f"regexp_replace({out}, {D.q(pattern)}, '', 'g')"
    for pattern, mask in (
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"), (r"\b\d{8,}\b", "<LONGNUM>"),
        (r"\b[1-5]\d{2}\b", "<STATUS>"), (r"\bport\s+\d+\b", "<PORT>"),
    ):
        out = f"regexp_replace({out}, {D.q(pattern)}, '{mask}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("normalize_for_vectors", D.select(
    D.RAW, f"SELECT line_no, {_duck_vectors('line')} AS normal FROM raw_logs"))
def normalize_for_vectors(spark, sf_dir):
    return raw_logs(spark, sf_dir).select(
        "line_no", T.normalize_for_vectors(F.col("line")).alias("normal"))
