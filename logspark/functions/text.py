"""Message cleaning and the normalisation in front of the vectoriser."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .fields import strip


def squeeze(text: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return strip(F.regexp_replace(text, P.SPACE_RUN, " "))


def clean_message(
    text: Column,
    remove_stop: bool = True,
    keep_spaces: bool = True,
    custom_stopwords=(),
) -> Column:
    """Lower-case words of a message without stamps, brackets, punctuation and stop words.

    Stamps go after lower-casing, so the ``T`` of an ISO stamp keeps it from matching as a
    whole; its time and date parts still go. Null gives the empty string.
    """
    text = strip(F.lower(F.coalesce(text, F.lit(""))))
    for pattern in P.CLEANING_STAMPS:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, P.NOT_WORD_OR_SPACE, " " if keep_spaces else "")
    text = squeeze(text)
    if not remove_stop:
        return text
    stop = sorted({*P.CLEANING_STOPWORDS, *custom_stopwords})
    words = F.filter(F.split(text, " "), lambda word: ~word.isin(*stop))
    return F.array_join(words, " ")


def normalize_for_vectors(text: Column) -> Column:
    """Lower case, no stamps, masks for addresses, long numbers, status codes and ports."""
    text = F.lower(text)
    for pattern in P.VECTOR_STAMPS:
        text = F.regexp_replace(text, pattern, "")
    for pattern, mask in P.VECTOR_MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return squeeze(text)


def message_or_raw(message: str = "message", raw: str = "raw") -> Column:
    """The message, or the raw line where the message is null or empty."""
    return F.coalesce(F.nullif(F.col(message), F.lit("")), F.col(raw), F.lit(""))


def message_text(cleaned: str = "cleaned_message", message: str = "message") -> Column:
    """What the models see: the cleaned message, else the message."""
    return strip(
        F.coalesce(F.nullif(F.col(cleaned), F.lit("")), F.col(message), F.lit(""))
    )
