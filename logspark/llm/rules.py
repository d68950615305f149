"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule looks at a number of a text and votes good, votes bad or abstains. No rule decides
alone: expectation-maximisation over the pattern of votes estimates how often each rule is
right and how common good texts are, and a text is kept when the probability that it is
good, given its votes, is at least one half. A few base rules are still absolute.

All numbers of a text are computed in its row, so nothing of a text is shuffled. Votes are
counted by pattern before anything leaves the tasks: with R rules there are at most 3^R
patterns, whatever the number of texts.

Nulls and edge cases: a null text has no words and no lines; a text with fewer than ten
words fails the base rules; texts of any length are read whole; repeated rows stay repeated
and count as often as they occur; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.frames import settle
from .common import SPACE, stored

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

# name -> (the number, bad below, good from, good to, bad above); None: no such border.
RULES = {
    "repeats": ("n_repeat_words / n_words", None, 0.0, 0.05, 0.15),
    "symbols": ("n_symbols / n_words", None, 0.0, 0.05, 0.3),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", None, 0.0, 0.1, 0.3),
    "word_length": ("word_chars / n_words", 2.0, 2.8, 9.0, 12.0),
    "variety": ("n_distinct / sqrt(n_words)", 1.5, 2.5, None, None),
    "letters": ("n_letter_words / n_words", 0.55, 0.75, None, None),
    "shouting": ("n_upper / word_chars", None, 0.0, 0.2, 0.5),
    "length": ("n_words", 15, 30, 100_000, None),
}


def _matches(text: Column, pattern: str) -> Column:
    """How many characters are left when all others are taken out."""
    return F.length(F.regexp_replace(text, f"[^{pattern[1:-1]}]+", "")).cast("bigint")


def numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text: its key and what the rules look at, as longs."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(whole, SPACE + "+"), "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(f"[^{SPACE[1:-1]}]"))
    row = settle(df.select(
        F.col(key).alias("key"), words.alias("words"), lines.alias("lines"),
        _matches(whole, SYMBOLS).alias("n_symbols"),
        _matches(whole, r"[\p{Lu}]").alias("n_upper"),
        F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("bigint").alias("word_chars"),
    ))
    n = F.size("words")
    later = lambda i, k: F.get(F.col("words"), i + k)
    windows = F.transform(
        F.slice("words", 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda word, i: F.xxhash64(word, *[later(i, k) for k in range(1, WINDOW)]))
    counted = settle(row.select(
        "key", "n_symbols", "n_upper", "word_chars", n.cast("bigint").alias("n_words"),
        windows.alias("windows"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.size(F.filter("words", lambda w: w.rlike(r"^\p{L}+[.,;:!?]*$"))).cast("bigint").alias("n_letter_words"),
    ))
    # Windows in the order of their hash: equal ones are neighbours. Only texts in which
    # some window repeats get this far.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = settle(counted.withColumn("placed", placed).drop("windows"))
    same = lambda i, k: F.coalesce(F.get("placed", i + k)["h"] == F.get("placed", i)["h"], F.lit(False))
    # get() of place -1 is null, so the first window has no neighbour before it.
    again = F.array_sort(F.transform(
        F.filter(F.col("placed"), lambda x, i: same(i, 1) | same(i, -1)), lambda x: x["i"]))
    begun = settle(sorted_.withColumn("again", again).drop("placed"))
    # A word counts once: a window adds what the window before does not cover.
    covered = F.aggregate(
        "again", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda state, i: F.struct(
            (state["n"] + F.least(F.lit(WINDOW), i - state["last"])).alias("n"), i.alias("last")),
        lambda state: state["n"].cast("bigint"))
    return begun.select(
        "key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
        "n_lines", "n_distinct", "n_letter_words", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vote(rule: str) -> Column:
    """1 good, 0 bad, null abstains."""
    number, bad_below, good_from, good_to, bad_above = RULES[rule]
    # A text without words has no ratios: all rules on them abstain.
    value = F.expr(number) if rule == "length" else F.when(F.col("n_words") > 0, F.expr(
        number.replace("/ word_chars", "/ greatest(word_chars, 1)").replace("/ n_words", "/ greatest(n_words, 1)").replace("sqrt(n_words)", "sqrt(greatest(n_words, 1))")))
    bad = F.lit(False)
    if bad_below is not None:
        bad = bad | (value < bad_below)
    if bad_above is not None:
        bad = bad | (value > bad_above)
    good = value >= good_from
    if good_to is not None:
        good = good & (value <= good_to)
    return F.when(bad, 0).when(good, 1)


def estimate(patterns, rules: int, steps: int = 100, share: float = 0.8, content: float = 0.97,
             missed: float = 0.8):
    """Expectation-maximisation over (votes, count): share of good texts, and per rule the
    probabilities of voting good among its votes on good and on bad texts.

    At first a good text is thought to content a rule with probability ``content`` and a
    bad one with ``missed``: a bad text need not break many rules. Two made-up votes for
    that keep each probability inside (0, 1).
    """
    good, on_good, on_bad = share, [content] * rules, [missed] * rules
    total = sum(count for _, count in patterns)
    for _ in range(steps if total else 0):
        mass, yes, seen = 0.0, [[0.0, 0.0] for _ in range(rules)], [[0.0, 0.0] for _ in range(rules)]
        for votes, count in patterns:
            p = posterior(votes, good, on_good, on_bad)
            mass += p * count
            for rule, given in enumerate(votes):
                if given is not None:
                    for side, part in enumerate((p, 1 - p)):
                        seen[rule][side] += part * count
                        yes[rule][side] += part * count * given
        good = min(max((mass + share) / (total + 1), 0.01), 0.99)
        on_good = [(yes[r][0] + 2 * content) / (seen[r][0] + 2) for r in range(rules)]
        on_bad = [(yes[r][1] + 2 * missed) / (seen[r][1] + 2) for r in range(rules)]
    return good, on_good, on_bad


def evidence(good: float, on_good, on_bad):
    """Log odds: of a good text at first, and what a good and a bad vote of a rule add."""
    return log(good / (1 - good)), [
        (log(g / b), log((1 - g) / (1 - b))) for g, b in zip(on_good, on_bad)]


def posterior(votes, good: float, on_good, on_bad) -> float:
    """The probability that a text with these votes is good."""
    odds, adds = evidence(good, on_good, on_bad)
    odds += sum(add[0] if given else add[1] for given, add in zip(votes, adds) if given is not None)
    return 1 / (1 + exp(-max(-700.0, min(700.0, odds))))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, numbers, base_failed, kept, posterior): one for each input row. Runs jobs.

    The texts are read once; their numbers are written and read again.
    """
    voted = numbers(df, key, text).select("*", *[vote(rule).alias(f"v_{rule}") for rule in RULES])
    table = stored(voted, "quality-numbers")
    names = [f"v_{rule}" for rule in RULES]
    # At most 3 ** len(RULES) rows, whatever the number of texts.
    counts = table.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted(
        (([row[name] for name in names], row["n"]) for row in counts),
        key=lambda p: [-1 if v is None else v for v in p[0]])
    odds, adds = evidence(*estimate(patterns, len(names)))
    summed = F.lit(odds)
    for name, (yes, no) in zip(names, adds):
        summed = summed + F.when(F.col(name) == 1, yes).when(F.col(name) == 0, no).otherwise(0.0)
    good = 1 / (1 + F.exp(-summed))
    return table.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (good >= 0.5)).alias("kept"), good.alias("posterior"))
