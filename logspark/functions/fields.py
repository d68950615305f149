"""Levels, services, entities and labels from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(text, F.lit(P.SPACES))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def first_named(text: Column, table, default: str) -> Column:
    """The name of the first table row one of whose words occurs in the text."""
    lowered = F.lower(text)
    choice = None
    for name, words in table:
        test = contains_any(lowered, words)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return choice.otherwise(default)


def normalize_level(word: Column, client: bool = False) -> Column:
    """Map a level word to ERROR, WARN, INFO or DEBUG; unknown words count as INFO.

    The two dialects differ: the client one raises WARNING to ERROR and knows fewer words.
    """
    word = F.upper(word)
    if client:
        return (
            F.when(word.isin("WARNING", "CRITICAL", "FATAL", "ERROR"), "ERROR")
            .when(word == "TRACE", "DEBUG")
            .when(word.isin("WARN", "DEBUG"), word)
            .otherwise("INFO")
        )
    return (
        F.when(
            word.isin("EMERG", "ALERT", "CRIT", "CRITICAL", "FATAL", "SEVERE", "ERR", "ERROR"),
            "ERROR",
        )
        .when(word.isin("WARNING", "NOTICE", "WARN"), "WARN")
        .when(word.isin("TRACE", "DEBUG"), "DEBUG")
        .otherwise("INFO")
    )


def guess_service(message: Column, client: bool = False) -> Column:
    return first_named(message, P.CLIENT_COMPONENTS if client else P.SERVICES, "System")


def extract_ip(text: Column) -> Column:
    return found(text, P.IP)


def extract_user(text: Column) -> Column:
    return found(text, P.USER, 1)


def extract_status(text: Column) -> Column:
    """A three-digit code after a status keyword, else the first well-known HTTP code."""
    return F.coalesce(found(text, P.STATUS_BY_KEY, 1), found(text, P.STATUS_BY_VALUE, 1))


def parse_label(value: Column) -> Column:
    """Read a 0/1 label from text or number; anything else is null."""
    word = F.lower(strip(value.cast("string")))
    return (
        F.when(word.isin("0", "false", "normal"), 0)
        .when(word.isin("1", "true", "anomaly"), 1)
        .when(word.rlike(r"^[+-]?\d+$") & word.cast("double").isin(0.0, 1.0),
              word.cast("double").cast("int"))
    ).cast("int")


def mask_template(message: Column) -> Column:
    """The message with addresses, hex, numbers and paths replaced by ``<*>``.

    Runs of placeholders collapse in two steps, each without a nested repetition, so that a
    line with many thousands of them does not exhaust the regex engine's stack.
    """
    text = message
    for pattern in P.TEMPLATE_VARIABLES:
        text = F.regexp_replace(text, pattern, "<*>")
    text = F.regexp_replace(text, r"<\*>\s*", "<*> ")
    return strip(F.regexp_replace(text, r"(?:<\*> )+", "<*> "))


def template_params(message: Column) -> Column:
    """What the template masks, pass by pass, each pass over the text of the one before."""
    text, found_values = message, []
    for pattern in P.TEMPLATE_VARIABLES:
        found_values.append(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        text = F.regexp_replace(text, pattern, "<*>")
    return F.concat(*found_values)
