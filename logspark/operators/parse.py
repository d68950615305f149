"""Log lines to records: one projection, whatever mix of formats the lines have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields as X, patterns as P
from .frames import line_index, settle

JSON_ALIASES = {
    "timestamp": ("timestamp", "time", "@timestamp"),
    "log_level": ("level", "log_level", "severity"),
    "message": ("message", "msg", "event"),
    "service": ("service", "service_name", "logger"),
    "ip_address": ("ip", "ip_address"),
    "user_id": ("user_id", "userId"),
    "status_code": ("status_code", "status"),
}

RECORD_FIELDS = (
    "id", "timestamp", "service", "log_level", "message", "ip_address", "user_id",
    "status_code", "raw", "log_type", "dataset_label", "event_ts",
)


def json_object(line: Column) -> Column:
    """The line as map<name, struct<kind, text>> if it is exactly one JSON object, else null.

    Wrapping the line into an array makes trailing text an error instead of being ignored.
    ``kind`` is the JSON type; ``text`` spells null and booleans the way the reports do.
    A name that is present has a struct, also for an explicit null.
    """
    parsed = F.from_json(
        F.concat(F.lit("["), line, F.lit("]")),
        "array<map<string,variant>>",
        {"allowSingleQuotes": "false"},
    )

    def spelled(_, value):
        kind = F.schema_of_variant(value)
        shown = (
            F.when(kind == "VOID", "None")
            .when(kind == "BOOLEAN", F.initcap(value.cast("string")))
            .otherwise(value.cast("string"))
        )
        return F.struct(kind.alias("kind"), shown.alias("text"))

    whole = F.when(line.startswith("{"), parsed)
    return F.when(F.size(whole) == 1, F.transform_values(whole[0], spelled))


def log_type(line: Column, as_json: Column | None = None) -> Column:
    """The format of a stripped line; the first that fits."""
    as_json = json_object(line) if as_json is None else as_json
    stamped = line.rlike(P.LEADING_STAMP)
    return (
        F.when(line == "", "plain")
        .when(as_json.isNotNull(), "json")
        .when(line.rlike(P.BGL_LINE), "bgl")
        .when((F.length(line) - F.length(F.replace(line, F.lit(","))) >= 3) & stamped, "csv")
        .when(line.rlike(P.ACCESS_LINE), "apache_nginx")
        .when(stamped | line.rlike(P.LEVEL), "application")
        .otherwise("plain")
    )


def _first(as_json: Column, field: str) -> Column:
    """The value under the first alias that is present, as struct<kind, text>."""
    return F.coalesce(*[as_json[name] for name in JSON_ALIASES[field]])


def _json_stamp(value: Column) -> Column:
    """A JSON time: text cut to 19 characters, or seconds since 1970 written out in UTC."""
    kind, text = value["kind"], value["text"]
    seconds = F.floor(text.try_cast("double")).cast("bigint")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    written = F.date_format(F.timestamp_add("SECOND", seconds, epoch), "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(value.isNull() | (kind == "VOID"), "")
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), written)
        .otherwise(F.substring(text, 1, 19))
    )


def _csv_field(line: Column, number: int) -> Column:
    """Field ``number`` of a CSV line, unquoted and stripped."""
    field = F.regexp_extract(line, P.CSV_LINE, number)
    quoted = r'^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'
    inner = F.replace(F.regexp_extract(field, quoted, 1), F.lit('""'), F.lit('"'))
    plain = F.concat(inner, F.regexp_extract(field, quoted, 2))
    return X.strip(F.when(field.startswith('"'), plain).otherwise(field))


def parse_logs(
    df: DataFrame, line: str = "line", line_no: str = "line_no", fields=RECORD_FIELDS
) -> DataFrame:
    """Parse lines of mixed formats; blank and unparseable ones go.

    Adds the record ``fields`` to the other columns of the input; what only other fields need
    is not computed. ``id`` is ``log-<line_no>``; ``event_ts`` is the stamp as a time where it
    is one. Every value is a native expression.
    """
    made = {*fields, *(["timestamp"] if "event_ts" in fields else [])}
    others = [c for c in df.columns if c != line]
    raw, kind = F.col("raw"), F.col("log_type")
    as_json = F.col("_json")

    def only(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    def need(field: str, value: Column) -> Column:
        return value if field in made else F.lit(None).cast("string")

    lines = settle(df.select(*others, X.strip(F.col(line)).alias("raw")))
    objects = settle(lines.where(F.length("raw") > 0).withColumn("_json", json_object(raw)))
    typed = settle(objects.withColumn("log_type", log_type(raw, as_json)))

    # Pieces that several fields share, each computed once and only for its own format.
    pieces = settle(typed.withColumns({
        "_bgl": only("bgl", F.split(raw, r"\s+", 10)),
        "_csv": only("csv", F.when(
            raw.rlike(P.CSV_LINE), F.array(*[_csv_field(raw, i) for i in (1, 2, 3, 4)])
        )),
        "_lead": only("application", F.regexp_extract(raw, P.LEADING_STAMP, 0)),
        "_stamp": need("timestamp", F.when(kind.isin("application", "plain"), F.coalesce(
            X.found(raw, P.LEADING_STAMP, 1), X.found(raw, P.ANY_STAMP, 1), F.lit("")
        ))),
        "_access": only("apache_nginx", F.array(
            F.coalesce(X.found(raw, P.ACCESS_LINE, 1), X.found(raw, P.ACCESS_LINE, 2)),
            *[F.regexp_extract(raw, P.ACCESS_LINE, group) for group in (3, 4, 5)],
        )),
        "_jmsg": only("json", F.coalesce(_first(as_json, "message")["text"], raw)),
    }))
    cut = pieces.where(
        (kind != "bgl") | (F.size("_bgl") == 10)
    ).where((kind != "csv") | F.col("_csv").isNotNull())

    rest = cut.withColumn("_rest", F.substring(raw, F.length("_lead") + 1, F.length(raw)))
    word = settle(rest.withColumn("_word", X.found(F.col("_rest"), P.LEVEL, 1)))
    # The level word goes where its spelling first occurs; then leading separators go.
    at = F.instr(F.col("_rest"), F.col("_word"))
    without = F.when(F.col("_word").isNull(), F.col("_rest")).otherwise(F.concat(
        F.substring(F.col("_rest"), F.lit(1), at - 1),
        F.substring(F.col("_rest"), at + F.length("_word"), F.length("_rest")),
    ))
    bare = settle(word.withColumn("_bare", F.coalesce(
        F.nullif(X.strip(F.regexp_replace(without, r"^[\s\-:|]+", "")), F.lit("")), raw
    )))
    tagged = settle(bare.withColumn("_tag", X.found(F.col("_bare"), r"^\[([^\]]+)\]", 1)).withColumn(
        "message",
        F.when(kind == "json", F.col("_jmsg"))
        .when(kind == "bgl", F.col("_bgl")[9])
        .when(kind == "csv", F.col("_csv")[3])
        .when(kind == "apache_nginx", F.coalesce(F.nullif(F.col("_access")[2], F.lit("")), raw))
        .when(kind == "application", F.when(
            F.col("_tag").isNotNull(), F.regexp_extract("_bare", r"^\[[^\]]+\]\s*(.*)", 1)
        ).otherwise(F.col("_bare")))
        .otherwise(raw),
    ))

    # Address, user, status and service are guessed from one text per line: the message of
    # a JSON object, the whole line of the free formats.
    message = F.col("message")
    guessed = kind.isin("json", "application", "plain")
    sourced = tagged.withColumn(
        "_text", F.when(kind == "json", message).when(kind.isin("csv", "application", "plain"), raw)
    ).withColumn("_said", F.when(guessed, message))
    text = F.col("_text")
    entities = settle(sourced.withColumns({
        "_ip": need("ip_address", X.extract_ip(text)),
        "_user": need("user_id", X.extract_user(text)),
        "_status": need("status_code", X.extract_status(text)),
        "_svc": need("service", F.when(guessed, X.guess_service(F.col("_said")))),
    }))

    def named(field: str, missing: Column, keep_null: bool = False) -> Column:
        value = _first(as_json, field)
        text = F.when(value["kind"] != "VOID", value["text"]) if keep_null else value["text"]
        return F.when(value.isNotNull(), text).otherwise(missing)

    objects = settle(entities.withColumn("_fields", only("json", F.struct(
        need("timestamp", _json_stamp(_first(as_json, "timestamp"))).alias("timestamp"),
        need("service", named("service", F.col("_svc"))).alias("service"),
        need("log_level", named("log_level", F.lit("INFO"))).alias("level"),
        need("ip_address", named("ip_address", F.col("_ip"), keep_null=True)).alias("ip"),
        need("user_id", named("user_id", F.col("_user"), keep_null=True)).alias("user"),
        need("status_code", F.coalesce(
            F.nullif(named("status_code", F.lit("")), F.lit("")), F.col("_status")
        )).alias("status"),
    ))))

    access_status = F.col("_access")[3]
    stamp = (
        F.when(kind == "json", F.col("_fields.timestamp"))
        .when(kind == "bgl", F.concat(F.col("_bgl")[2], F.lit(" "), F.col("_bgl")[4]))
        .when(kind == "csv", F.substring(F.col("_csv")[0], 1, 19))
        .when(kind == "apache_nginx", F.col("_access")[1])
        .otherwise(F.substring(F.replace(F.col("_stamp"), F.lit("T"), F.lit(" ")), 1, 19))
    )
    service = (
        F.when(kind == "json", F.col("_fields.service"))
        .when(kind == "bgl", F.concat(F.col("_bgl")[6], F.lit("/"), F.col("_bgl")[7]))
        .when(kind == "csv", F.col("_csv")[1])
        .when(kind == "apache_nginx", "WebServer")
        .otherwise(F.coalesce(F.col("_tag"), F.col("_svc")))
    )
    level_word = (
        F.when(kind == "json", F.col("_fields.level"))
        .when(kind == "bgl", F.col("_bgl")[8])
        .when(kind == "csv", F.col("_csv")[2])
        .when(kind == "apache_nginx", F.when(access_status.startswith("2"), "INFO").otherwise("ERROR"))
        .when(kind == "application", F.coalesce(F.col("_word"), F.lit("INFO")))
        .otherwise("INFO")
    )
    ip = F.when(kind == "json", F.col("_fields.ip")).when(
        kind == "apache_nginx", F.nullif(F.col("_access")[0], F.lit("-"))
    ).otherwise(F.col("_ip"))
    user = F.when(kind == "json", F.col("_fields.user")).otherwise(F.col("_user"))
    status = F.when(kind == "json", F.col("_fields.status")).when(
        kind == "apache_nginx", access_status
    ).otherwise(F.col("_status"))
    label = F.when(
        kind == "bgl", F.when(F.col("_bgl")[0] == "-", 0).otherwise(1)
    ).cast("int")

    record = settle(objects.select(
        *others, "raw", "log_type", "message",
        F.concat(F.lit("log-"), F.col(line_no).cast("string")).alias("id"),
        need("timestamp", stamp).alias("timestamp"), need("service", service).alias("service"),
        need("log_level", level_word).alias("_level"), need("ip_address", ip).alias("ip_address"),
        need("user_id", user).alias("user_id"), need("status_code", status).alias("status_code"),
        label.alias("dataset_label"),
    )).withColumn("log_level", X.normalize_level(F.col("_level")))
    when = F.replace(F.col("timestamp"), F.lit("T"), F.lit(" "))
    return record.withColumn(
        "event_ts", F.try_to_timestamp(when, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    ).select(*others, *fields)


def parseable(raw: Column) -> Column:
    """Whether a stripped line gives a record; cheaper than parsing it.

    Blank lines do not, nor BGL lines without a message, nor CSV lines whose quotes leave
    fewer than four fields.
    """
    short_bgl = raw.rlike(P.BGL_LINE) & (F.size(F.split(raw, r"\s+", 10)) < 10)
    commas = F.length(raw) - F.length(F.replace(raw, F.lit(",")))
    short_csv = (commas >= 3) & raw.rlike(P.LEADING_STAMP) & ~raw.rlike(P.CSV_LINE) & ~raw.rlike(P.BGL_LINE)
    return (F.length(raw) > 0) & (
        json_object(raw).isNotNull() | ~(short_bgl | short_csv)
    )


def number_lines(
    df: DataFrame, line: str = "line", line_no: str = "line_no", by=(), name: str = "seq"
) -> DataFrame:
    """Drop lines that give no record and number the others without gaps.

    Done before parsing, on the narrow rows, so that the block counts do not cost a second
    parse and the parse itself runs spread over the blocks.
    """
    kept = settle(df.withColumn(line, X.strip(F.col(line)))).where(parseable(F.col(line)))
    return line_index(kept, line_no, by, name)


def split_lines(df: DataFrame, text: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row per line of a text column, numbered from 0; blank lines keep their number."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, "\r\n|\n|\r")).alias(line_no, line))


def parse_logs_client(df: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """The client's smaller parse: stamp, level, template, parameters, component."""
    others = [c for c in df.columns if c != line]
    lines = df.select(*others, X.strip(F.col(line)).alias("_line")).where(F.length("_line") > 0)
    raw = F.col("_line")
    cut = settle(lines).withColumns({
        "_lead": F.regexp_extract(raw, P.CLIENT_STAMP, 0),
        "_word": X.found(raw, P.CLIENT_LEVEL, 1),
    })
    rest = cut.withColumn("_rest", F.substring(raw, F.length("_lead") + 1, F.length(raw)))
    at = F.instr(F.col("_rest"), F.col("_word"))
    without = F.when(
        F.col("_word").isNull() | (at == 0), F.col("_rest")
    ).otherwise(F.concat(
        F.substring(F.col("_rest"), F.lit(1), at - 1),
        F.substring(F.col("_rest"), at + F.length("_word"), F.length("_rest")),
    ))
    message = settle(rest.withColumn(
        "_msg", X.strip(F.regexp_replace(X.strip(without), r"^[\s\-:|\[\]]+", ""))
    ))
    stamp = F.replace(X.found(raw, P.CLIENT_STAMP, 1), F.lit("T"), F.lit(" "))
    return settle(message.select(
        *others,
        F.concat(F.lit("uploaded-"), F.col(line_no).cast("string")).alias("id"),
        stamp.alias("timestamp"),
        X.normalize_level(F.coalesce(F.col("_word"), F.lit("INFO")), client=True).alias("level"),
        F.coalesce(F.nullif(F.col("_msg"), F.lit("")), raw).alias("raw"),
        X.mask_template(F.col("_msg")).alias("template"),
        X.template_params(F.col("_msg")).alias("params"),
        X.guess_service(F.col("_msg"), client=True).alias("component"),
    ))


def parse_feature_record(df: DataFrame, line: str = "line") -> DataFrame:
    """The record the feature extractor works on, with its own looser patterns."""
    others = [c for c in df.columns if c != line]
    base = settle(df.select(*others, F.col(line).alias("_line"))).withColumns({
        "_stamp": X.found(F.col("_line"), P.RECORD_STAMP),
        "_upper": F.upper("_line"),
    })
    level = None
    for name in P.RECORD_LEVELS:
        test = F.col("_upper").contains(name)
        level = F.when(test, name) if level is None else level.when(test, name)
    leveled = settle(base.withColumn("log_level", level))
    text = X.strip(F.col("_line"))
    text = F.when(
        F.col("_stamp").isNotNull(), X.strip(F.replace(text, F.col("_stamp"), F.lit("")))
    ).otherwise(text)
    text = F.when(
        F.col("log_level").isNotNull(), X.strip(F.replace(text, F.col("log_level"), F.lit("")))
    ).otherwise(text)
    written = F.regexp_replace(F.col("_stamp"), r"\s+", " ")
    return settle(leveled.select(
        *others,
        F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss"))
        .cast("timestamp_ntz").alias("record_ts"),
        "log_level",
        X.found(F.col("_line"), P.IP).alias("ip_address"),
        X.found(F.col("_line"), P.RECORD_USER, 1).alias("user"),
        X.found(F.col("_line"), P.RECORD_STATUS).cast("int").alias("status_code"),
        text.alias("content"),
    ))
