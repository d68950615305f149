"""Secret scans: a random forest removes the false positives, in DataFrame functions.

Candidates are found by one regular expression: whole values after a word such as password
or token and ``=`` or ``:`` (quoted, or to the next white space or the next ``name=``),
whatever they are made of; runs of at least twelve characters of tokens with a digit; and
digit-free runs of at least twenty letters. Each is described by its length, character
transitions, how much of it dictionary words cover, whether it looks like a path or a known
harmless form, and the words beside it. A random forest, trained from labelled findings,
decides which candidates are secrets. Its trees become one Column expression, so a text is
scanned, judged and redacted in its own row: nothing is exploded, joined or shuffled, and a
text with many candidates weighs only on its own row. The text is put together again from
its pieces, so a secret is masked at the place where it was judged, in one pass.

Nulls and edge cases: a null text stays null and has no candidates; an empty text has none;
an empty table gives an empty one; texts of any length are scanned whole; a value that occurs
several times is judged at each place by the words beside it there; equal rows get equal
results; extra columns pass through, result columns replace columns of the same name. A
single lower-case word after a password word is taken for prose, not for a password.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.frames import settle
from .common import SPACE, stored

CHARS = r"A-Za-z0-9_+/=.~\-"
MASK = "[SECRET]"

# Words that stand beside secrets, and beside what only looks like one.
HOT_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key",
             "access_key", "private_key", "credential", "credentials", "bearer", "authorization", "auth",
             "passphrase")
COLD_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "revision", "uuid",
              "guid", "id", "build", "version", "isbn", "phone", "card", "order", "serial", "etag")
_KEY = "[A-Za-z0-9_./\\-]"
# A name that ends in a hot word, then = or : and what may stand before the value.
ASSIGNED = (rf"{_KEY}{{0,40}}?(?i:{'|'.join(HOT_WORDS)})[\"']?[ \t]*[=:][ \t]*"
            r"(?:(?i:bearer|basic|token)[ \t]+)?")
_STOP = r"[&,;](?![A-Za-z_]\w*[\"']?[=:])"  # not before the next name
VALUE = rf"(?:\"[^\"\n]++\"|'[^'\n]++'|[^\s&,;]++(?:{_STOP}[^\s&,;]*+)*+)"
# A run that has a digit and is at least twelve long, not inside another run.
RUN = rf"(?<![{CHARS}])(?=[A-Za-z_+/=.~\-]*+[0-9])[{CHARS}]{{12,}}"
LETTERS = rf"(?<![{CHARS}])[A-Za-z][A-Za-z+_\-]{{19,}}+(?![{CHARS}])"
# Most words are no such name: they fail at the first sign after them, before the hot words.
NAMED = rf"(?<!{_KEY})(?={_KEY}++[\"']?[ \t]*[=:]){ASSIGNED}"
CANDIDATE = rf"{NAMED}{VALUE}|{RUN}|{LETTERS}"
_END = r"\"',;.)\]}>"
# Words that make up names, paths and placeholders.
DICTIONARY = ("example sample test dummy placeholder changeme change your here none null true false "
              "file path user name home local data image images version release index main master "
              "branch config default server client service module package library build number "
              "message content content-type charset utf http https www com org net html json yaml "
              "xml text document page table column value values the and for with that this from "
              "mail email address phone date time year month day hour january february march april "
              "june july august september october november december").split()


def _share(value: Column, pattern: str) -> Column:
    """The share of characters that belong to matches of the pattern."""
    size = F.greatest(F.length(value), F.lit(1))
    return (size - F.length(F.regexp_replace(value, pattern, ""))) / size


FEATURES = (
    "length", "transitions", "distinct", "digits", "upper", "lower", "hex", "coverage",
    "path", "formed", "hot", "cold", "assigned", "quoted", "prefixed", "placeholder", "special",
    "clusters",
)


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """What the forest sees of a candidate, the text just before and just after it."""
    size = F.greatest(F.length(value), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, "[A-Z]+", "\u0001"), "[a-z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001\u0002\u0003]+", "\u0004")
    near = F.lower(before)
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    word = lambda words: rf"(?:^|[^a-z0-9])(?:{'|'.join(words)})[^a-z0-9]*(?:is|was|=|:)?[^a-z0-9]*$"
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    return {
        "length": F.least(size, F.lit(200)).cast("double"),
        "transitions": (F.length(kinds) - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "digits": _share(value, "[0-9]+"),
        "upper": _share(value, "[A-Z]+"),
        "lower": _share(value, "[a-z]+"),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "coverage": _share(F.lower(value), f"(?:{words})"),
        "path": _share(value, r"[./]+") + flag(value.rlike(r"^(?:https?:|www\.|/|\./|[\w.-]+/[\w.-]+/)")),
        "formed": flag(value.rlike(
            r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^\+?[0-9.\-]+$|^\d{4}-\d{2}-\d{2}")
            | after.rlike("^@") | before.rlike("@$")),
        "hot": flag(near.rlike(word(HOT_WORDS))),
        "cold": flag(near.rlike(word(COLD_WORDS))),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "prefixed": flag(value.rlike(
            r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|eyJ|SG\.|npm_|hf_)")),
        "special": _share(value, f"[^{CHARS}]+"),
        "clusters": _share(F.lower(value), "[bcdfghjklmnpqrstvwxz]{4,}"),
        "placeholder": flag(value.rlike(r"(?i)x{6,}|0{8,}|1234567|abcdef|example|your[_-]|changeme")),
    }


SYLLABLES = ("ba", "co", "di", "fu", "ga", "he", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "ver", "ung",
             "ent", "mar", "tel", "ster", "hor", "bat", "rec", "sta", "ple", "gen", "lich", "tion")

# Labelled findings: (before, value, after, is a secret). {h}, {H}, {b}, {d}, {u} and {w}
# stand for hexadecimal, upper-case, mixed, decimal, UUID and word fillings; {l}, {B} and {p}
# for lower-case letters, mixed letters and passwords with signs, {s} and {S} for invented
# words of so many syllables, lower-case or with a capital; {W} is a word with a capital.
FINDINGS = (
    ('token = "', "{h40}", '"', 1), ("token=", "{h40}", " ", 1), ("password=", "{h18}", " ", 1),
    ("password=", "{h16}", "\n", 1), ("password: ", "{b16}", " ", 1), ("passwd=", "{h20}", " ", 1),
    ("pwd = ", "{b14}", ";", 1), ('api_key = "', "{b32}", '"', 1), ("apikey: ", "{h32}", ",", 1),
    ('secret: "', "{b40}", '"', 1), ("secret=", "{h24}", " ", 1), ("Authorization: Bearer ", "{b48}", "\n", 1),
    ("the key ", "AKIA{H16}", " in", 1), ("", "AKIA{H16}", "", 1), ("and ", "ghp_{b36}", ".", 1),
    ("use ", "sk_live_{b24}", " ", 1), ("with ", "xoxb-{d12}-{b24}", " ", 1), (" ", "AIza{b35}", " ", 1),
    ("access_key=", "{b40}", "&", 1), ('private_key: "', "{b64}", '"', 1), ("credentials: ", "{b22}", " ", 1),
    ("auth token is ", "{h32}", " ", 1), ("jwt ", "eyJ{b36}.eyJ{b60}.{b43}", " ", 1), ("password=", "{h12}", " ", 1),
    ("commit ", "{h40}", "\n", 0), ("md5: ", "{h32}", " ", 0), ("sha256 ", "{h64}", " ", 0), ("checksum=", "{h40}", " ", 0),
    ("revision ", "{h40}", ",", 0), ("hash ", "{h32}", " ", 0), ("build ", "{h12}", " ", 0), ("etag: \"", "{h32}", '"', 0),
    ("uuid ", "{u}", " ", 0), ("id=", "{u}", "&", 0), (" ", "{u}", " ", 0), ("and ", "{d16}", " ", 0),
    (" ", "{d16}", " of", 0), ("+1 ", "{d3}-555-{d4}", " ", 0), (" card ", "{d16}", ".", 0), ("", "{d3}.{d3}.{d3}.{d3}", " ", 0),
    ("see ", "https://www.example.com/{w}/{w}/{d4}.html", " ", 0), ("", "/home/user/{w}/{w}{d2}.txt", " ", 0),
    ("in ", "src/main/{w}/{w}{d1}.java", ":", 0), ("version ", "{w}-{d1}.{d2}.{d1}", " ", 0), ("", "2024-01-{d2}T10:{d2}", " ", 0),
    ("from ", "{w}.{w}{d2}", "@mail.example.com", 0), (".{d2}@", "mail{d1}.example.com", " ", 0), ("the ", "{w}{w}{d2}", " ", 0),
    ("and ", "{w}{w}{w}.{d2}", " ", 0), (" ", "{w}_{w}_{d4}", " ", 0), ('password = "', "your_password_here{d1}", '"', 0),
    ('token = "', "xxxxxxxxxxxxxxxx{d2}", '"', 0), ("api_key=", "example_api_key_{d4}", " ", 0), ("secret: ", "changeme12345678", " ", 0),
    ("image ", "img-{d8}-{d4}.png", " ", 0), ("isbn ", "978-{d1}-{d4}-{d4}-{d1}", " ", 0), ("serial ", "{H4}-{H4}-{H4}-{d4}", " ", 0),
    ("-- ", "====={d2}=======", " ", 0), (" ", "{w}---{d4}---{w}", " ", 0), (" ", "1-2-3-4-5-6-7-8-9", " ", 0),
    ("password=", "{s2}{s2}{s2}{s2}", " ", 1), ("password: ", "{w}{s2}{s2}{s2}", "\n", 1), ("passphrase: ", "{s2}-{s3}-{s2}-{s2}", " ", 1),
    ('token = "', "{l32}", '"', 1), ('token = "', "{B32}", '"', 1), ("secret=", "{B20}", " ", 1), ("api_key: ", "{B40}", ",", 1),
    ("Authorization: Bearer ", "{B40}", "\n", 1), ("Authorization: Bearer ", "{l36}", "\n", 1), ("with ", "{B40}", " ", 1),
    ("the key ", "{B32}", ".", 1), ("auth: ", "{l24}", " ", 1), ("bearer ", "{B44}", " ", 1), ("passwd: ", "{l16}", " ", 1),
    ("pwd: ", "{s3}{d1}{l1}", " ", 1), ("pwd=", "{s2}{d2}", "&", 1), ("password=", "{b8}", " ", 1), ("password: ", "{b10}", " ", 1),
    ("secret=", "{l1}@{l4}{d5}", " ", 1), ("password=", "{p12}", " ", 1), ('password: "', "{p16}", '"', 1), ("pwd=", "{p9}", " ", 1),
    ("password=", "{S2}{d1}{l3}&{d1}!{l3}", " ", 1), ("passwd=", "{S3}!{d4}", "\n", 1), ("password = '", "{S2}#{s2}{d2}", "'", 1),
    ("credentials: ", "{p20}", " ", 1), ("secret: ", "{S3}${S2}", " ", 1), ("passwd: ", "{S2}{d3}", " ", 1),
    ("password: ", "{w}", " ", 0), ("password: ", "{s3}", " ", 0), ("secret: ", "{s2}", ",", 0), ("token: ", "{s4}", " ", 0),
    ("secret: ", "{S3}", " ", 0), ("credentials: ", "{S2}", ".", 0), ("password: ", "{s1}", " ", 0), ("auth: ", "{w}", "\n", 0),
    ("tokens: ", "{d3}", " ", 0), ("token: ", "{d4}", ",", 0), ("auth=", "{d1}", " ", 0), ("token=", "{d2}", "&", 0),
    ('password: "', "{w} {w} {w}", '"', 0), ('"token": "', "{s3} {s2}", '"', 0), ("password=", "<{w}>", " ", 0), ("secret=", "${{w}}", " ", 0),
    ("password=", "********", " ", 0), ("token: ", "{w}({w})", " ", 0), ("password: ", "null", ",", 0), ("password=", "your-{w}-here", " ", 0),
    (" ", "{s9}", " ", 0), ("the ", "{S10}", " ", 0), ("in ", "{S3}{S3}{S4}{S3}", "(", 0), (" ", "{s3}-{s3}-{s4}-{s3}", " ", 0),
    ("call ", "{s2}{W}{W}{S2}{W}", "(", 0), ("", "{W}{W}{S3}{W}{S2}", " ", 0), ("new ", "{S2}{S2}{W}{S2}{W}", "(", 0), (" ", "{w}{S2}{S3}{W}{S3}", " ", 0),
    ("call ", "{s3}_{s3}_{w}_{s3}", " ", 0), (" ", "{s4}-{s5}-{s3}", ".", 0), ("a ", "{S4}-{S5}-{s3}", " ", 0), (" ", "----------{s1}-----------", "\n", 0),
    ("by ", "{d2}-{w}-{w}-{w}", " ", 0), ("pages ", "{d4}-{d4}/{d4}", " ", 0), (" ", "{d20}", " ", 0), ("order ", "{H2}{d12}", " ", 0),
)
_FILLING = r"^\{([hHbduwWlBpsS])(\d*)\}$"


def _filled(template: Column, seed: Column) -> Column:
    """A template whose fillings are made from the seed and their place."""
    pick = lambda words, seed: F.element_at(
        F.array(*[F.lit(w) for w in words]), F.pmod(F.hash(seed), F.lit(len(words))) + 1)

    def fill(piece, place):
        own = F.concat_ws("/", seed, place.cast("string"))
        kind = F.regexp_extract(piece, _FILLING, 1)
        size = F.coalesce(F.regexp_extract(piece, _FILLING, 2).try_cast("int"), F.lit(0))
        hexed = F.concat(F.sha2(own, 256), F.sha2(F.concat(own, F.lit("+")), 256))
        mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[+/=]", "")
        spoken = F.array_join(F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: pick(SYLLABLES, F.concat_ws("/", own, i.cast("string")))), "")
        word = pick(DICTIONARY, own)
        cut = lambda c: F.when(size > 0, F.substr(c, F.lit(1), size)).otherwise(c)
        made = {
            "h": cut(hexed), "H": cut(F.upper(F.regexp_replace(mixed, "[a-z]", "7"))), "b": cut(mixed),
            "d": cut(F.translate(hexed, "abcdef", "012345")),
            "l": cut(F.translate(hexed, "0123456789", "ghjkmpqtwz")),
            "B": cut(F.regexp_replace(mixed, "[0-9]", "")),
            "p": cut(F.translate(mixed, "aeiouAEIOUxyz", "!@#$%&*?^!@#$")),
            "u": F.concat_ws("-", *[F.substring(hexed, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
            "w": word, "W": F.initcap(word), "s": spoken, "S": F.initcap(spoken),
        }
        chosen = piece
        for name, value in made.items():
            chosen = F.when(kind == name, value).otherwise(chosen)
        return chosen

    return F.array_join(F.transform(F.split(template, r"(?=\{)|(?<=\})"), fill), "")


def labelled_findings(spark: SparkSession, each: int = 12) -> DataFrame:
    """Rows (before, value, after, label): ``each`` fillings of every labelled template.
    Runs a job that writes them."""
    templates = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(before).alias("b"), F.lit(value).alias("v"),
                 F.lit(after).alias("after"), F.lit(float(label)).alias("label"))
        for i, (before, value, after, label) in enumerate(FINDINGS)])
    rows = spark.range(each, numPartitions=1).select("id", F.inline(templates))
    seed = lambda part: F.concat_ws("/", F.lit(part), F.col("i").cast("string"), F.col("id").cast("string"))
    return stored(rows.select(
        _filled(F.col("b"), seed("before")).alias("before"), _filled(F.col("v"), seed("value")).alias("value"),
        "after", "label"), "findings")


def train(findings: DataFrame, trees: int = 25, depth: int = 8, seed: int = 42):
    """A random forest over labelled findings (before, value, after, label). Runs jobs."""
    made = features(F.col("value"), F.col("before"), F.col("after"))
    table = findings.select("label", *[made[name].alias(name) for name in FEATURES]).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed,
        subsamplingRate=0.8).fit(rows.select("label", "features"))


def _votes(tree_text: str, named) -> Column:
    """The class a tree predicts, from its description."""
    lines = [line.strip() for line in tree_text.splitlines()[1:] if line.strip()]

    def read(at: int):
        if lines[at].startswith("Predict:"):
            return F.lit(float(lines[at].split(":")[1])), at + 1
        number, border = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", lines[at]).groups()
        below, at = read(at + 1)
        above, at = read(at + 1)
        return F.when(named(int(number)) <= float(border), below).otherwise(above), at

    return read(0)[0]


def forest_score(model, named) -> Column:
    """The share of trees that call it a secret, as one expression; ``named`` gives the
    Column of a feature by number."""
    trees = [_votes(tree.toDebugString, named) for tree in model.trees]
    total = trees[0]
    for tree in trees[1:]:
        total = total + tree
    return total / len(trees)


def scan(df: DataFrame, text: str, model, least: float = 0.5, mask: str = MASK) -> DataFrame:
    """All columns, and what was found: ``n_candidates``, ``secrets`` (an array, in order of
    place, a value as often as it stands there) and ``redacted``, the text with each secret
    replaced by the mask."""
    whole = F.col(text).cast("string")
    made = ("n_candidates", "secrets", "redacted")
    kept = [c for c in df.columns if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    # One pass finds the few texts with a candidate; only those are cut up. Cut at the
    # candidates, piece i stands before candidate i and piece i + 1 after it.
    has = whole.rlike(CANDIDATE)
    found = settle(df.select(
        row, whole.alias("_text"),
        F.when(has, F.regexp_extract_all(whole, F.lit(f"({CANDIDATE})"), F.lit(1))).alias("_values"),
        F.when(has, F.split(whole, CANDIDATE)).alias("_around")))
    pieces = F.transform("_values", lambda value, i: F.struct(
        value.alias("value"),
        F.substring_index(F.substring(F.get("_around", i), -120, 120), "\n", -1).alias("before"),
        F.substring(F.get("_around", i + 1), 1, 8).alias("after")))
    cut = settle(found.select("_row", "_text", "_around", pieces.alias("_pieces")))
    # A key before its value belongs to the words before; what closes it to those after.
    lead = lambda v: F.regexp_extract(
        v, rf"^({ASSIGNED}(?:[\"'](?=.))?|[A-Za-z_.\-]{{2,30}}=(?=.{{8,}}))", 1)
    led = settle(cut.select("_row", "_text", F.col("_around"), F.transform("_pieces", lambda p: F.struct(
        lead(p["value"]).alias("lead"), p["value"].alias("value"), p["before"].alias("before"),
        p["after"].alias("after"))).alias("_pieces")))
    rest = F.transform("_pieces", lambda p: F.struct(
        p["lead"].alias("lead"), p["before"].alias("before"), p["after"].alias("after"),
        F.substr(p["value"], F.length(p["lead"]) + 1).alias("rest")))
    opened = settle(led.select("_row", "_text", "_around", rest.alias("_pieces")))

    def closing(p):
        quote = F.regexp_extract(p["lead"], "[\"']$", 0)
        return F.when((quote != "") & p["rest"].endswith(quote), quote).otherwise(
            F.regexp_extract(p["rest"], rf"(?<![{_END}])[{_END}]++$", 0))

    closed = settle(opened.select("_row", "_text", "_around", F.transform("_pieces", lambda p: F.struct(
        p["lead"].alias("lead"), p["before"].alias("before"), p["after"].alias("after"),
        p["rest"].alias("rest"), closing(p).alias("tail"))).alias("_pieces")))
    seen = settle(closed.select("_row", "_text", "_around", F.transform("_pieces", lambda p: F.struct(
        F.substr(p["rest"], F.lit(1), F.length(p["rest"]) - F.length(p["tail"])).alias("value"),
        F.concat(p["before"], p["lead"]).alias("before"), F.concat(p["tail"], p["after"]).alias("after"),
        p["lead"].alias("lead"), p["tail"].alias("tail"))).alias("_pieces")))

    def described(p):
        made = features(p["value"], p["before"], p["after"])
        return F.struct(*[p[name].alias(name) for name in ("value", "lead", "tail")],
                        *[made[name].alias(name) for name in FEATURES])

    known = settle(seen.select("_row", "_text", "_around", F.transform("_pieces", described).alias("_known")))
    verdict = lambda x: (x["value"] != "") & (
        forest_score(model, lambda i: x[FEATURES[i]]) >= least)
    judged = settle(known.select("_row", "_text", "_around", F.transform("_known", lambda x: F.struct(
        *[x[name].alias(name) for name in ("value", "lead", "tail")], verdict(x).alias("secret"))).alias("_known")))
    secret = F.transform(F.filter("_known", lambda x: x["secret"]), lambda x: x["value"])
    redacted = F.concat(
        F.array_join(F.transform("_known", lambda x, i: F.concat(
            F.get("_around", i), x["lead"], F.when(x["secret"], F.lit(mask)).otherwise(x["value"]), x["tail"])), ""),
        F.element_at("_around", -1))
    return judged.select(
        "_row.*", F.greatest(F.coalesce(F.size("_known"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_candidates"),
        F.coalesce(secret, F.array().cast("array<string>")).alias("secrets"),
        F.coalesce(redacted, F.col("_text")).alias("redacted"))


def redact(df: DataFrame, text: str, model, size: str | None = None, **settings) -> DataFrame:
    """The same columns with secrets masked; ``size`` names the column of text lengths."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all")
    found = scan(df.select(row, F.col(text).alias("scanned")), "scanned", model, **settings)
    changed = F.size("secrets") > 0
    columns = []
    for name in df.columns:
        old = F.col("all").getField(name)
        if name == text:
            old = F.when(changed, F.col("redacted")).otherwise(old)
        elif name == size:
            old = F.when(changed, F.length("redacted").cast(df.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return found.select(*columns)
