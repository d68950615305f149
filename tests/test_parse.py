"""Golden lines and awkward ones."""

from pyspark.sql import functions as F

from logspark.functions import fields as X, patterns as P, signatures as S, text as T
from logspark.operators import parse, prepare, rules
from logspark.plans import scoring

LINES = [
    "081109 203615 11 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_1 terminating",
    '{"time":"2024-01-01T12:00:00Z","severity":"ERROR","logger":"api","event":"timeout"}',
    '2024-01-01 12:00:01,worker,WARN,"queue depth exceeded, retrying"',
    "- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO parity error",
    '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /health HTTP/1.1" 500 10',
    "   ",
    "",
    '{"broken',
    '{"time": 1700000000, "level": null, "msg": true, "status": 503, "user_id": null}',
    '{"message": "x", "message": "y"}',
    '2024-01-01 12:00:01,worker,WARN,"say ""hi"", twice"',
    "2024-01-01 12:00:01,a,b,",
    "2024-01-01T12:00:01 [billing] ERROR Échec à 10.0.0.1",
    "  heartbeat é ok  ",
    "- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO",
    '{"a": 1} trailing',
    '2024-01-01 12:00:01,a,b,"no end, here',
]


def records(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, line string")
    logs = prepare.process_logs(parse.parse_logs(lines))
    return {row["line_no"]: row for row in logs.collect()}


def test_golden_rows(spark):
    got = records(spark)
    hdfs, js, csv, bgl, web = (got[i] for i in range(5))
    assert (hdfs.log_type, hdfs.timestamp, hdfs.log_level, hdfs.service) == (
        "application", "081109 203615", "INFO", "BlockManager")
    assert hdfs.message.startswith("11") and hdfs.raw.endswith("terminating")
    assert (js.log_type, js.timestamp, js.log_level, js.service, js.cleaned_message) == (
        "json", "2024-01-01T12:00:00", "ERROR", "api", "error timeout")
    assert (csv.log_type, csv.timestamp, csv.log_level, csv.service, csv.cleaned_message) == (
        "csv", "2024-01-01 12:00:01", "WARN", "worker", "warn queue depth exceeded retrying")
    assert (bgl.log_type, bgl.timestamp, bgl.log_level, bgl.service, bgl.dataset_label) == (
        "bgl", "2005.06.03 2005-06-03-15.42.50.363779", "INFO", "RAS/KERNEL", 0)
    assert (web.log_type, web.timestamp, web.log_level, web.service, web.status_code, web.ip_address) == (
        "apache_nginx", "10/Oct/2000:13:55:36 -0700", "ERROR", "WebServer", "500", "127.0.0.1")
    assert hdfs.id == "log-0" and str(csv.event_ts) == "2024-01-01 12:00:01"


def test_awkward_lines(spark):
    got = records(spark)
    assert 5 not in got and 6 not in got, "blank lines"
    assert got[7].log_type == "plain"
    epoch = got[8]
    assert (epoch.timestamp, epoch.log_level, epoch.message) == ("2023-11-14 22:13:20", "INFO", "True")
    assert (epoch.status_code, epoch.user_id) == ("503", None)
    assert got[9].log_type in ("json", "plain"), "a repeated name must not fail the job"
    assert got[10].message == 'say "hi", twice'
    assert got[11].message == "" and got[11].log_level == "INFO"
    accent = got[12]
    assert (accent.service, accent.log_level, accent.ip_address) == ("billing", "ERROR", "10.0.0.1")
    assert got[13].message == "heartbeat é ok"
    assert 14 not in got, "BGL without a message"
    assert got[15].log_type == "plain", "trailing text after an object"
    assert 16 not in got or got[16].message == "no end, here"


def test_numbering_keeps_what_parses(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, line string")
    numbered = parse.number_lines(lines)
    kept = {r.line_no: r.seq for r in numbered.collect()}
    assert set(kept) == set(records(spark))
    assert [kept[i] for i in sorted(kept)] == list(range(len(kept)))


def test_labels_levels_templates(spark):
    rows = spark.createDataFrame(
        [("1",), ("true",), ("Anomaly ",), ("0",), ("False",), ("normal",), ("2",), ("x",), ("",), (None,), ("+1",)],
        "v string")
    assert [r[0] for r in rows.select(X.parse_label(F.col("v"))).collect()] == [
        1, 1, 1, 0, 0, 0, None, None, None, None, 1]
    words = spark.createDataFrame([("warning",), ("Fatal",), ("trace",), ("odd",)], "w string")
    assert [tuple(r) for r in words.select(
        X.normalize_level(F.col("w")), X.normalize_level(F.col("w"), client=True)).collect()] == [
        ("WARN", "ERROR"), ("ERROR", "ERROR"), ("DEBUG", "DEBUG"), ("INFO", "INFO")]
    text = "from 10.0.0.1 id 0xFF took 12.5 ms at /var/log/x.log " + "7 " * 20000
    masked = spark.createDataFrame([(text,)], "t string").select(
        X.mask_template(F.col("t")), F.size(X.template_params(F.col("t")))).first()
    assert masked[0] == "from <*> id <*> took <*> ms at <*>" and masked[1] == 20004


def test_cleaning_options(spark):
    one = spark.createDataFrame([("2024-01-01T10:00:00Z The [x] user-name, à OK foo",)], "t string")
    clean = lambda **o: one.select(T.clean_message(F.col("t"), **o)).first()[0]
    assert clean() == "t z user name à foo"
    assert clean(remove_stop=False) == "t z the user name à ok foo"
    assert clean(custom_stopwords=("foo",)) == "t z user name à"
    assert "username" in clean(keep_spaces=False)


def test_wanted_fields_equal_those_of_the_whole_record(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, line string")
    whole = parse.parse_logs(lines)
    for fields in (("message", "raw", "ip_address"), ("event_ts",), ("log_level", "user_id"), ("service", "status_code")):
        some = parse.parse_logs(lines, fields=fields)
        assert some.columns == ["line_no", *fields] and some.dtypes == whole.select("line_no", *fields).dtypes
        assert sorted(some.collect(), key=str) == sorted(whole.select("line_no", *fields).collect(), key=str)
    messages = lines.withColumnRenamed("line_no", "key")
    plan = scoring.analyze_messages(messages, "key", "line")._jdf.queryExecution().optimizedPlan().toString()
    assert P.USER not in plan and P.IP in plan


def test_a_rule_is_tried_once(spark):
    said = [*LINES, "fatal flaw", "Login  FAILED for root", "brute force", "db unreachable", "forbidden", "SQL injection",
            "login from 10.0.0.1", "nothing", None]
    rows = spark.createDataFrame([(i, t, t, None) for i, t in enumerate(said)], "id int, message string, raw string, ip_address string")
    made = rules.run_rules(rows, order=None)
    got = {r["id"]: r["rule"] for r in made.collect()}
    want = rows.select("id", S.first_triggered([*rules.keyword_rules().values()]).alias("rule"))
    assert got == {r["id"]: r["rule"] for r in want.collect()}
    names = {r["rule_name"] for r in got.values() if r}
    assert len(names) == 7
    assert made._jdf.queryExecution().optimizedPlan().toString().count("brute\\s+force") == 1


def test_the_look_ahead_changes_no_match(spark):
    groups = (P.LOGIN_FAILURE, P.BRUTE_FORCE, P.DB_FAILURE, P.UNAUTHORIZED, P.CRITICAL_ERROR, P.KNOWN_ATTACK, P.SILVER_PHRASES)
    said = [*LINES, "xlogin\tfailed", "LOGIN FAILED", "error and it failed", "a db connection", "out of  memory", "crashed",
            "heartbeat failure", "sq sql error", "", "xss  attempt"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for patterns in groups:
        for flag, ignore in (("", False), ("(?i)", True)):
            plain = flag + "(?:" + "|".join(patterns) + ")"
            assert not rows.where(F.col("t").rlike(plain) != F.col("t").rlike(P.any_of(patterns, ignore))).count()
    assert P.any_of(("ab", "ac|d")) == "(?:ab|ac|d)" and P.any_of(("ab", "c?d")) == "(?:ab|c?d)"
