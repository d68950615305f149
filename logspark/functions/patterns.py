"""Regular expressions and word lists.

All values below are fixed by the log formats and rules the engine has to recognise.
They are written for Java's regex engine. Word boundaries are spelled out, because ``\\b``
means different things in different JDKs once a letter has an accent.
"""

import re

# A letter, digit or underscore in any script, and the two edges of such a word.
WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"

# Every character that counts as white space at the ends of a line.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---- fixed values: log levels -------------------------------------------------------
LEVEL_WORDS = (
    "EMERG", "ALERT", "CRIT", "CRITICAL", "FATAL", "ERROR", "ERR", "WARNING", "WARN",
    "NOTICE", "INFO", "DEBUG", "TRACE", "SEVERE",
)
CLIENT_LEVEL_WORDS = (
    "INFO", "WARN", "WARNING", "ERROR", "DEBUG", "TRACE", "FATAL", "CRITICAL",
)
RECORD_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "CRITICAL", "FATAL")
SEVERE_LEVELS = ("ERROR", "CRITICAL", "FATAL")

_LEVELS = "|".join(LEVEL_WORDS)
LEVEL = rf"(?i)(?=[ACDEFINSTW]){WORD_START}({_LEVELS}){WORD_END}"

# ---- fixed values: time stamps ------------------------------------------------------
STAMP = (
    r"\d{4}[-/.]\d{2}[-/.]\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
    r"|\d{4}[-/.]\d{2}[-/.]\d{2}"
    r"|\d{2,6}[\s-]\d{2}:?\d{2}:?\d{2}"
    r"|\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
)
LEADING_STAMP = rf"^({STAMP})\s*"
ANY_STAMP = rf"({STAMP})"
CLIENT_STAMP = r"^(\d{4}[-/]\d{2}[-/]\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s*"
RECORD_STAMP = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"

# ---- fixed values: line shapes ------------------------------------------------------
# Four tokens before the bracket (client address third), or the common three (first).
ACCESS_LINE = (
    r'^(?:\S+ \S+ (\S+) \S+|(\S+) \S+ \S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (?:\d+|-)?'
)
BGL_LINE = (
    r"(?i)^\S+\s+\d+\s+\d{4}\.\d{2}\.\d{2}\s+\S+\s+"
    r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+\s+\S+\s+\S+\s+\S+\s+"
    rf"(?:{_LEVELS}){WORD_END}"
)
# One CSV field: quoted (quotes doubled inside; an unclosed quote runs to the end) or bare.
CSV_FIELD = r'"[^"]*+(?:""[^"]*+)*+(?:"[^,]*+|$)|[^",][^,]*+|'
CSV_LINE = rf"^({CSV_FIELD}),({CSV_FIELD}),({CSV_FIELD}),({CSV_FIELD})(?:,|$)"

# ---- fixed values: entities ---------------------------------------------------------
# A cheap look at the next character comes before the look behind.
IP = rf"(?=\d){WORD_START}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{WORD_END}"
IP_UNBOUNDED = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
USER = r"""(?i)(?:user|userId|user_id|username)[\s=:]+['"]?([a-zA-Z0-9_-]+)['"]?"""
STATUS_BY_KEY = r"(?i)(?:status|code|status_code)[\s=:]+(\d{3})"
STATUS_BY_VALUE = (
    rf"(?=[2-5]){WORD_START}(200|201|301|302|400|401|403|404|500|502|503){WORD_END}"
)
RECORD_USER = r"(?i)user\s+([a-zA-Z0-9_]+)"
RECORD_STATUS = rf"(?=\d){WORD_START}[1-5]\d{{2}}{WORD_END}"

# ---- fixed values: template variables, in masking order (ASCII words) ---------------
_A_START, _A_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
TEMPLATE_VARIABLES = (
    rf"{_A_START}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_A_END}",
    rf"{_A_START}0x[0-9a-fA-F]+{_A_END}",
    rf"{_A_START}\d+(?:\.\d+)?{_A_END}",
    r"/[A-Za-z0-9_./\-]+",
)
CLIENT_LEVEL = rf"(?i){_A_START}({'|'.join(CLIENT_LEVEL_WORDS)}){_A_END}"

# ---- fixed values: service names by substring, first hit wins -----------------------
SERVICES = (
    ("AuthService", ("auth", "login", "token")),
    ("BlockManager", ("block", "replica")),
    ("DataPipeline", ("pipeline", "stage")),
    ("APIGateway", ("api", "endpoint", "request")),
    ("CacheService", ("cache", "hit", "miss")),
    ("DatabaseService", ("database", "query", "sql", "connection pool")),
    ("PaymentService", ("payment",)),
    ("NotificationService", ("notification", "email")),
    ("NetworkService", ("network", "timeout", "socket")),
)
CLIENT_COMPONENTS = (
    ("AuthService", ("auth", "login", "token")),
    ("BlockManager", ("block", "replica")),
    ("DataPipeline", ("pipeline", "stage")),
    ("APIGateway", ("api", "endpoint", "request")),
    ("CacheLayer", ("cache", "hit", "miss")),
    ("Scheduler", ("schedule", "cron", "task")),
    ("StorageEngine", ("disk", "storage", "memory", "volume")),
    ("NetworkIO", ("connect", "timeout", "network", "socket")),
    ("Database", ("database", "query", "sql")),
)

# ---- fixed values: cleaning ---------------------------------------------------------
CLEANING_STAMPS = (
    r"\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"\d{4}[-/]\d{2}[-/]\d{2}",
    r"\[.*?\]",
)
CLEANING_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
    "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
    "info", "debug", "success", "request", "response", "http", "https", "com", "org",
    "net", "ms", "us", "ok", "true", "false", "null", "undefined",
)
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
SPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"

# ---- fixed values: vector normalisation ---------------------------------------------
VECTOR_STAMPS = (
    r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}",
    r"\d{2}:\d{2}:\d{2}",
)
VECTOR_MASKS = (
    (IP, "<IP>"),
    (rf"{WORD_START}\d{{8,}}{WORD_END}", "<LONGNUM>"),
    (rf"{WORD_START}[1-5]\d{{2}}{WORD_END}", "<STATUS>"),
    (rf"{WORD_START}port\s+\d+{WORD_END}", "<PORT>"),
)

# ---- fixed values: signatures (matched on lower-case text unless noted) -------------
LOGIN_FAILURE = (
    r"authentication\s+failed", r"login\s+failed", r"invalid\s+credentials",
    r"access\s+denied", r"failed\s+login", r"login\s+failure", r"authentication\s+error",
    r"bad\s+credentials", r"wrong\s+password", r"failed\s+authentication",
)
BRUTE_FORCE = (
    r"brute\s+force", r"multiple\s+login\s+attempts", r"too\s+many\s+failed\s+attempts",
    r"suspicious\s+login\s+activity",
)
DB_FAILURE = (
    r"database\s+connection\s+(?:failed|refused|timeout)", r"connection\s+pool\s+exhausted",
    r"db\s+(?:unreachable|connection)", r"sql\s+(?:error|exception)",
    r"connection\s+refused", r"database\s+node\s+unreachable", r"database\s+timeout",
)
UNAUTHORIZED = (
    r"unauthorized\s+access", r"permission\s+denied", r"access\s+denied", r"forbidden",
    r"unauthorized\s+attempt",
)
CRITICAL_ERROR = (
    r"critical\s+", r"fatal\s+", r"service\s+(?:crashed|failed|error)",
    r"system\s+(?:crashed|failed|error)", r"application\s+(?:crashed|failed|error)",
    r"out\s+of\s+memory", r"stack\s+overflow", r"memory\s+(?:corruption|leak)",
    r"error.*failed", r"crashed",
)
KNOWN_ATTACK = (r"sql\s+injection", r"xss\s+attempt", r"path\s+traversal")
SUSPICIOUS_PREFIXES = ("10.", "192.168.", "172.16.", "0.0.0.0")
AUTH_WORDS = ("auth", "login", "failed")

# ---- fixed values: label heuristics and model confidence ----------------------------
SILVER_WORDS = (
    "failed", "failure", "timeout", "unauthorized", "forbidden", "exception", "critical",
    "attack", "injection", "refused", "overload",
)
SILVER_PHRASES = (
    rf"{WORD_START}authentication\s+failed{WORD_END}",
    rf"{WORD_START}connection\s+refused{WORD_END}",
    rf"{WORD_START}sql\s+injection{WORD_END}",
    rf"{WORD_START}heartbeat\s+failure{WORD_END}",
)
STRONG_WORDS = (
    "failed", "failure", "timeout", "error", "exception", "critical", "fatal", "refused",
    "unauthorized", "forbidden", "injection", "attack", "breach", "overflow", "crash",
    "panic", "abort",
)


def any_of(patterns, ignore_case: bool = False) -> str:
    """One pattern that matches where any of the given ones does.

    Where all begin with two letters, a cheap look at the next one comes before the choice.
    """
    firm = all(re.match("[a-z]{2}", p) and "|" not in re.sub(r"\([^()]*\)", "", p) for p in patterns)
    look = f"(?=[{''.join(sorted({p[0] for p in patterns}))}])" if firm else ""
    return ("(?i)" if ignore_case else "") + look + "(?:" + "|".join(patterns) + ")"

# ---- fixed values: English stop words of the vectoriser, 181 words --------------------
ENGLISH_STOP_WORDS = tuple((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd "
    "he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought "
    "that's there's what's when's where's who's why's would "
).split())
