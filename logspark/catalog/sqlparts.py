"""SQL text the oracles are put together from. Written for DuckDB, format by format."""

from __future__ import annotations

from ..functions import patterns as P
from .inputs import LINE_DUCK


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_like(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def matches(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


def first_named(text: str, table, default: str) -> str:
    arms = " ".join(f"WHEN {any_like(f'lower({text})', words)} THEN {q(name)}"
                    for name, words in table)
    return f"CASE {arms} ELSE {q(default)} END"


def blank_null(expression: str) -> str:
    return f"nullif({expression}, '')"


SPACE_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def strip(text: str) -> str:
    return f"trim({text}, {SPACE_CHARS})"


LEVELS = "|".join(P.LEVEL_WORDS)
LEVEL = rf"(?i)\b({LEVELS})\b"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
STATUS_VALUE = r"\b(200|201|301|302|400|401|403|404|500|502|503)\b"
BGL = (
    r"(?i)^\S+\s+\d+\s+\d{4}\.\d{2}\.\d{2}\s+\S+\s+"
    r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+\s+\S+\s+\S+\s+\S+\s+"
    rf"(?:{LEVELS})\b"
)
CSV_QUOTED_LAST = r'^([^,"]*),([^,"]*),([^,"]*),"([^"]*)"'


def norm_level(word: str) -> str:
    return (
        f"CASE WHEN upper({word}) IN ('EMERG','ALERT','CRIT','CRITICAL','FATAL','SEVERE','ERR','ERROR') THEN 'ERROR' "
        f"WHEN upper({word}) IN ('WARNING','NOTICE','WARN') THEN 'WARN' "
        f"WHEN upper({word}) IN ('TRACE','DEBUG') THEN 'DEBUG' ELSE 'INFO' END"
    )


def norm_level_client(word: str) -> str:
    return (
        f"CASE upper({word}) WHEN 'WARNING' THEN 'ERROR' WHEN 'CRITICAL' THEN 'ERROR' "
        f"WHEN 'FATAL' THEN 'ERROR' WHEN 'ERROR' THEN 'ERROR' WHEN 'TRACE' THEN 'DEBUG' "
        f"WHEN 'DEBUG' THEN 'DEBUG' WHEN 'WARN' THEN 'WARN' ELSE 'INFO' END"
    )


def ip_of(text: str) -> str:
    return blank_null(f"regexp_extract({text}, {q(IP)})")


def user_of(text: str) -> str:
    return blank_null(f"regexp_extract({text}, {q(P.USER)}, 1)")


def status_of(text: str) -> str:
    return (
        f"coalesce({blank_null(f'regexp_extract({text}, {q(P.STATUS_BY_KEY)}, 1)')}, "
        f"{blank_null(f'regexp_extract({text}, {q(STATUS_VALUE)}, 1)')})"
    )


def service_of(text: str) -> str:
    return first_named(text, P.SERVICES, "System")


RAW = f"""raw_logs AS (
  SELECT event_id AS line_no, ts, concat('host', CAST(user_id % 8 AS STRING)) AS host,
  {LINE_DUCK} AS line FROM events)"""

TYPED = RAW + f""", stripped AS (
  SELECT line_no, ts, host, {strip('line')} AS raw FROM raw_logs
), typed AS (
  SELECT *, CASE
    WHEN starts_with(raw, '{{') AND json_valid(raw) THEN 'json'
    WHEN regexp_matches(raw, {q(BGL)}) THEN 'bgl'
    WHEN length(raw) - length(replace(raw, ',', '')) >= 3 AND regexp_matches(raw, {q(P.LEADING_STAMP)}) THEN 'csv'
    WHEN regexp_matches(raw, {q(P.ACCESS_LINE)}) THEN 'apache_nginx'
    WHEN regexp_matches(raw, {q(P.LEADING_STAMP)}) OR regexp_matches(raw, {q(LEVEL)}) THEN 'application'
    ELSE 'plain' END AS log_type
  FROM stripped WHERE raw <> '')"""


def _jpick(names, missing: str) -> str:
    arms = " ".join(f"WHEN json_exists(raw, '$.\"{n}\"') THEN json_extract_string(raw, '$.\"{n}\"')"
                    for n in names)
    return f"CASE {arms} ELSE {missing} END"


PARSED = TYPED + f""", p_json AS (
  SELECT *, substr({_jpick(('timestamp', 'time', '@timestamp'), "''")}, 1, 19) AS "timestamp",
    {_jpick(('message', 'msg', 'event'), 'raw')} AS message,
    {_jpick(('level', 'log_level', 'severity'), "'INFO'")} AS lvl
  FROM typed WHERE log_type = 'json'
), p_app AS (
  SELECT *, regexp_extract(raw, {q(P.LEADING_STAMP)}, 0) AS lead,
    substr(replace(coalesce({blank_null(f'regexp_extract(raw, {q(P.LEADING_STAMP)}, 1)')},
      regexp_extract(raw, {q(P.ANY_STAMP)}, 1)), 'T', ' '), 1, 19) AS "timestamp"
  FROM typed WHERE log_type = 'application'
), p_app2 AS (
  SELECT *, substr(raw, length(lead) + 1) AS rest,
    regexp_extract(substr(raw, length(lead) + 1), {q(LEVEL)}, 1) AS word FROM p_app
), p_app3 AS (
  SELECT *, coalesce(nullif(trim(regexp_replace(
      CASE WHEN word = '' THEN rest
      ELSE substr(rest, 1, instr(rest, word) - 1) || substr(rest, instr(rest, word) + length(word)) END,
      '^[\\s\\-:|]+', '')), ''), raw) AS bare FROM p_app2
), p_app4 AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^\\[[^\\]]+\\]') THEN regexp_extract(bare, '^\\[([^\\]]+)\\]\\s*(.*)', 2) ELSE bare END AS message,
    nullif(regexp_extract(bare, '^\\[([^\\]]+)\\]', 1), '') AS tag FROM p_app3
), parsed_fields AS (
  SELECT line_no, ts, host, raw, log_type, "timestamp",
    {_jpick(('service', 'service_name', 'logger'), service_of('message'))} AS service,
    {norm_level('lvl')} AS log_level, message,
    {_jpick(('ip', 'ip_address'), ip_of('message'))} AS ip_address,
    {_jpick(('user_id', 'userId'), user_of('message'))} AS user_id,
    coalesce(nullif({_jpick(('status_code', 'status'), "''")}, ''), {status_of('message')}) AS status_code,
    CAST(NULL AS INTEGER) AS dataset_label FROM p_json
  UNION ALL
  SELECT line_no, ts, host, raw, log_type, parts[3] || ' ' || parts[5], parts[7] || '/' || parts[8],
    {norm_level('parts[9]')}, regexp_extract(raw, '^(?:\\S+\\s+){{9}}(.*)$', 1), NULL, NULL, NULL,
    CASE WHEN parts[1] = '-' THEN 0 ELSE 1 END
  FROM (SELECT *, regexp_split_to_array(raw, '\\s+') AS parts FROM typed WHERE log_type = 'bgl')
  WHERE len(parts) >= 10
  UNION ALL
  SELECT line_no, ts, host, raw, log_type, substr(trim(regexp_extract(raw, {q(CSV_QUOTED_LAST)}, 1)), 1, 19),
    trim(regexp_extract(raw, {q(CSV_QUOTED_LAST)}, 2)),
    {norm_level(f'trim(regexp_extract(raw, {q(CSV_QUOTED_LAST)}, 3))')},
    trim(regexp_extract(raw, {q(CSV_QUOTED_LAST)}, 4)),
    {ip_of('raw')}, {user_of('raw')}, {status_of('raw')}, NULL
  FROM typed WHERE log_type = 'csv'
  UNION ALL
  SELECT line_no, ts, host, raw, log_type, regexp_extract(raw, {q(P.ACCESS_LINE)}, 3), 'WebServer',
    CASE WHEN starts_with(regexp_extract(raw, {q(P.ACCESS_LINE)}, 5), '2') THEN 'INFO' ELSE 'ERROR' END,
    coalesce(nullif(regexp_extract(raw, {q(P.ACCESS_LINE)}, 4), ''), raw),
    nullif(coalesce(nullif(regexp_extract(raw, {q(P.ACCESS_LINE)}, 1), ''),
      regexp_extract(raw, {q(P.ACCESS_LINE)}, 2)), '-'), NULL,
    regexp_extract(raw, {q(P.ACCESS_LINE)}, 5), NULL
  FROM typed WHERE log_type = 'apache_nginx'
  UNION ALL
  SELECT line_no, ts, host, raw, log_type, "timestamp", coalesce(tag, {service_of('message')}),
    {norm_level('word')}, message, {ip_of('raw')}, {user_of('raw')}, {status_of('raw')}, NULL
  FROM p_app4
  UNION ALL
  SELECT line_no, ts, host, raw, log_type,
    substr(replace(regexp_extract(raw, {q(P.ANY_STAMP)}, 1), 'T', ' '), 1, 19),
    {service_of('raw')}, 'INFO', raw, {ip_of('raw')}, {user_of('raw')}, {status_of('raw')}, NULL
  FROM typed WHERE log_type = 'plain'
), parsed AS (
  SELECT 'log-' || line_no AS id, *,
    try_strptime(replace("timestamp", 'T', ' '), '%Y-%m-%d %H:%M:%S') AS event_ts,
    coalesce(nullif(message, ''), raw) AS said
  FROM parsed_fields)"""

NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"


def clean(text: str, stop: bool = True) -> str:
    """The cleaned form of a text expression."""
    out = f"trim(lower(coalesce({text}, '')))"
    for pattern in P.CLEANING_STAMPS:
        out = f"regexp_replace({out}, {q(pattern)}, ' ', 'g')"
    out = f"regexp_replace({out}, {q(NOT_WORD)}, ' ', 'g')"
    out = f"trim(regexp_replace({out}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    if not stop:
        return out
    words = ", ".join(q(w) for w in P.CLEANING_STOPWORDS)
    return (f"array_to_string(list_filter(string_split({out}, ' '), "
            f"lambda w: w NOT IN ({words})), ' ')")


PROCESSED = PARSED + f""", processed AS (
  SELECT *, {clean("log_level || ' ' || said")} AS cleaned_message FROM parsed)"""


def rule_flag(name: str, text: str) -> str:
    return matches(text, {
        "critical_error": P.CRITICAL_ERROR, "login_failure": P.LOGIN_FAILURE,
        "brute_force": P.BRUTE_FORCE, "database_connection_failure": P.DB_FAILURE,
        "unauthorized_access": P.UNAUTHORIZED, "known_attack_pattern": P.KNOWN_ATTACK,
    }[name])


SUSPICIOUS = (
    f"({any_like('lower(message || raw)', P.AUTH_WORDS)} AND ("
    + " OR ".join(
        f"starts_with(coalesce(nullif(ip_address, ''), regexp_extract(message || raw, {q(P.IP_UNBOUNDED)})), {q(p)})"
        for p in P.SUSPICIOUS_PREFIXES
    ) + "))"
)

RULED = PROCESSED + f""", flagged AS (
  SELECT *, {rule_flag('login_failure', "lower(message || ' ' || raw)")} AS login_hit,
    coalesce(nullif(ip_address, ''), regexp_extract(message || raw, {q(P.IP_UNBOUNDED)})) AS seen_ip,
    {SUSPICIOUS} AS ip_hit, {rule_flag('known_attack_pattern', 'lower(message || raw)')} AS attack_hit
  FROM processed
), counted AS (
  SELECT *, sum(CASE WHEN login_hit THEN 1 ELSE 0 END)
      OVER (ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS failures,
    count(*) OVER (ORDER BY line_no ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS requests
  FROM flagged
), ruled AS (
  SELECT *, CASE
    WHEN {rule_flag('critical_error', 'lower(said)')} THEN 'critical_error'
    WHEN {rule_flag('login_failure', 'lower(said)')} THEN 'login_failure'
    WHEN {rule_flag('brute_force', 'lower(said)')} THEN 'brute_force'
    WHEN {rule_flag('database_connection_failure', 'lower(said)')} THEN 'database_connection_failure'
    WHEN {rule_flag('unauthorized_access', 'lower(said)')} THEN 'unauthorized_access'
    WHEN ip_hit THEN 'suspicious_ip'
    WHEN attack_hit THEN 'known_attack_pattern'
    WHEN failures >= 3 THEN 'repeated_login_failures'
    WHEN requests > 30 THEN 'unusual_request_frequency' END AS rule_name
  FROM counted
), hits AS (
  SELECT *, CASE rule_name
    WHEN 'critical_error' THEN 'Critical error detected'
    WHEN 'login_failure' THEN 'Login failure detected'
    WHEN 'brute_force' THEN 'Brute force attempt detected'
    WHEN 'database_connection_failure' THEN 'Database connection failure detected'
    WHEN 'unauthorized_access' THEN 'Unauthorized access detected'
    WHEN 'suspicious_ip' THEN 'Suspicious internal IP in auth context: ' || seen_ip
    WHEN 'known_attack_pattern' THEN 'Known attack pattern detected'
    WHEN 'repeated_login_failures' THEN 'Multiple login failures (' || failures || ') detected'
    WHEN 'unusual_request_frequency' THEN 'Unusual request frequency: ' || requests || ' in window'
    END AS rule_message,
    CASE WHEN rule_name IS NULL THEN NULL WHEN rule_name = 'suspicious_ip' THEN 'MEDIUM' ELSE 'HIGH' END AS severity
  FROM ruled)"""

# Verdicts without a model: every line counts as Normal with confidence 0.5.
VERDICTS = RULED + """, verdicts AS (
  SELECT *, CASE WHEN dataset_label = 1 THEN 'Anomaly' WHEN dataset_label = 0 THEN 'Normal'
      WHEN rule_name IS NOT NULL THEN 'Anomaly' ELSE 'Normal' END AS prediction,
    CAST(0.5 AS DOUBLE) AS confidence,
    CASE WHEN dataset_label IN (0, 1) THEN 'Dataset label'
      WHEN rule_name IS NOT NULL THEN 'Rules' ELSE 'ML' END AS source,
    CASE WHEN dataset_label IN (0, 1) THEN 'BGL benchmark label'
      WHEN rule_name IS NOT NULL THEN rule_message ELSE 'Normal' END AS detection_reason,
    rule_name IS NOT NULL AS rule_triggered
  FROM hits)"""


def template(text: str) -> str:
    out = text
    for pattern in (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b0x[0-9a-fA-F]+\b",
                    r"\b\d+(?:\.\d+)?\b", r"/[A-Za-z0-9_./\-]+"):
        out = f"regexp_replace({out}, {q(pattern)}, '<*>', 'g')"
    return f"trim(regexp_replace({out}, {q(r'(?:<\*>\s*)+')}, '<*> ', 'g'))"


def template_passes(text: str) -> str:
    """The masked values, pass after pass, as one list."""
    out, lists = text, []
    for pattern in (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b0x[0-9a-fA-F]+\b",
                    r"\b\d+(?:\.\d+)?\b", r"/[A-Za-z0-9_./\-]+"):
        lists.append(f"regexp_extract_all({out}, {q(pattern)})")
        out = f"regexp_replace({out}, {q(pattern)}, '<*>', 'g')"
    return "list_concat(list_concat(list_concat({}, {}), {}), {})".format(*lists)


_CLIENT_LEVEL = rf"(?i)\b({'|'.join(P.CLIENT_LEVEL_WORDS)})\b"
CLIENT = RAW + f""", c1 AS (
  SELECT line_no, ts, host, {strip('line')} AS whole FROM raw_logs WHERE {strip('line')} <> ''
), c2 AS (
  SELECT *, regexp_extract(whole, {q(P.CLIENT_STAMP)}, 0) AS lead,
    regexp_extract(whole, {q(_CLIENT_LEVEL)}, 1) AS word FROM c1
), c3 AS (
  SELECT *, substr(whole, length(lead) + 1) AS rest FROM c2
), c4 AS (
  SELECT *, trim(regexp_replace(trim(CASE WHEN word = '' OR instr(rest, word) = 0 THEN rest
      ELSE substr(rest, 1, instr(rest, word) - 1) || substr(rest, instr(rest, word) + length(word)) END),
      '^[\\s\\-:|\\[\\]]+', '')) AS msg FROM c3
), client AS (
  SELECT line_no, ts, host, 'uploaded-' || line_no AS id,
    replace(nullif(regexp_extract(whole, {q(P.CLIENT_STAMP)}, 1), ''), 'T', ' ') AS "timestamp",
    {norm_level_client('word')} AS level, coalesce(nullif(msg, ''), whole) AS raw,
    {template('msg')} AS template, {template_passes('msg')} AS params,
    {first_named('msg', P.CLIENT_COMPONENTS, 'System')} AS component
  FROM c4)"""

_R_IP = IP
_R_STATUS = r"\b[1-5]\d{2}\b"
RECORDS = RAW + f""", r1 AS (
  SELECT line_no, ts, host, line, nullif(regexp_extract(line, {q(P.RECORD_STAMP)}), '') AS stamp,
    CASE {' '.join(f"WHEN contains(upper(line), '{n}') THEN '{n}'" for n in P.RECORD_LEVELS)} END AS log_level
  FROM raw_logs
), r2 AS (
  SELECT *, CASE WHEN stamp IS NULL THEN {strip('line')} ELSE {strip(f"replace({strip('line')}, stamp, '')")} END AS c1 FROM r1
), records AS MATERIALIZED (
  SELECT line_no, ts, host, try_strptime(stamp, '%Y-%m-%d %H:%M:%S') AS record_ts, log_level,
    nullif(regexp_extract(line, {q(_R_IP)}), '') AS ip_address,
    nullif(regexp_extract(line, {q(P.RECORD_USER)}, 1), '') AS "user",
    TRY_CAST(nullif(regexp_extract(line, {q(_R_STATUS)}), '') AS INTEGER) AS status_code,
    CASE WHEN log_level IS NULL THEN c1 ELSE {strip("replace(c1, log_level, '')")} END AS content
  FROM r2)"""


def select(parts: str, body: str) -> str:
    return f"WITH {parts} {body}"
