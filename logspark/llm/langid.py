"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every other character is a space. Each 1-, 2- and 3-gram is hashed
into one of ``2 ** BITS`` buckets; a language is a row of log probabilities over buckets.
Counting is one pass over all training texts with sums per language and bucket; the matrix
(languages times buckets) is broadcast, and texts are scored in numpy, many at a time.

Nulls and edge cases: a null text or one without a letter gets ``und`` and score 0; rows
without a language are not learned from; without any language to learn everything is
``und``; ties go to the language first by code point; repeated rows count as often as they
occur; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 16
GRAMS = 3
PIECE = 1 << 19  # characters handled together
MAX_LANGUAGES = 1000


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray   # (languages,)
    log_prob: np.ndarray    # (languages, buckets)


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        if (char := chr(code)).isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _state(shared) -> dict:
    state = shared.value  # one object for all tasks of a worker process
    if "letters" not in state:
        state["letters"] = _letters()
    return state


def _codes(texts, letters: np.ndarray):
    """Texts as one array of codes, two spaces after each; starts and ends of the texts."""
    coded = [(t or "").encode("utf-32-le") for t in texts]
    sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
    joined = b"\x20\0\0\0\x20\0\0\0".join(coded) + b"\x20\0\0\0\x20\0\0\0"
    codes = letters[np.frombuffer(joined, dtype=np.uint32)]
    starts = np.cumsum(sizes + 2) - sizes - 2
    return codes, starts, starts + sizes


def _buckets(codes: np.ndarray):
    """For each n the bucket of the n-gram that begins at each place."""
    gram = np.zeros_like(codes)
    for n in range(1, GRAMS + 1):
        after = np.full_like(codes, 32)
        after[:len(codes) - n + 1] = codes[n - 1:]
        gram = gram * np.uint32(2654435761) + after + np.uint32(n)
        mixed = gram ^ (gram >> np.uint32(15))
        yield (mixed * np.uint32(2246822519)) >> np.uint32(32 - BITS)


def _in_pieces(texts):
    """Runs of texts with about ``PIECE`` characters in all; a longer text stands alone."""
    run, size = [], 0
    for at, text in enumerate(texts):
        run.append(at)
        size += len(text or "") + 2
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def fit(df: DataFrame, text: str, language: str, max_languages: int = MAX_LANGUAGES) -> Model:
    """Count all given texts. Runs a job; what comes back is languages times buckets."""
    known = df.where(F.col(language).isNotNull()).select(
        F.col(language).cast("string").alias("lang"), F.col(text).alias("text"))
    docs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(
        max_languages + 1).collect()
    if len(docs) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    if not docs:
        return Model([], np.zeros(0), np.zeros((0, 1 << BITS)))
    languages = [row["lang"] for row in docs]
    number = {name: i for i, name in enumerate(languages)}
    shared = df.sparkSession.sparkContext.broadcast({})

    def count(batches):
        letters, sums = _state(shared)["letters"], {}
        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            by = {}
            for at, name in enumerate(own):
                by.setdefault(number[name], []).append(texts[at])
            for lang, mine in by.items():
                total = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for run in _in_pieces(mine):
                    codes, starts, ends = _codes([mine[i] for i in run], letters)
                    inside = np.ones(len(codes), dtype=bool)
                    inside[ends] = inside[ends + 1] = False
                    for bucket in _buckets(codes):
                        total += np.bincount(bucket[inside], minlength=1 << BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)),
                 pa.array(total[at])], ["lang", "bucket", "n"])

    counted = known.mapInArrow(count, "lang int, bucket int, n bigint").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.ones((len(languages), 1 << BITS))
    matrix[counted["lang"].to_numpy(dtype=int), counted["bucket"].to_numpy(dtype=int)] += counted["n"].to_numpy()
    sizes = np.array([row["n"] for row in docs], dtype=float)
    return Model(languages, np.log(sizes / sizes.sum()),
                 np.log(matrix / matrix.sum(axis=1, keepdims=True)))


def _scores(texts, model: dict, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scores (texts, languages) and whether a text has a letter."""
    matrix, prior = model["log_prob"], model["log_prior"]
    out = np.tile(prior, (len(texts), 1))
    some = np.zeros(len(texts), dtype=bool)
    for run in _in_pieces(texts):
        codes, starts, ends = _codes([texts[i] for i in run], letters)
        if len(run) == 1:
            size = ends[0]
            some[run[0]] = bool((codes[:size] != 32).any())
            for bucket in _buckets(codes):
                out[run[0]] += matrix @ np.bincount(bucket[:size], minlength=1 << BITS)
            continue
        edges = np.stack([starts, ends], axis=1).ravel()
        some[run] = np.add.reduceat(codes != 32, edges)[::2] * (ends > starts) > 0
        for bucket in _buckets(codes):
            for lang in range(len(matrix)):
                sums = np.add.reduceat(matrix[lang][bucket], edges)[::2]
                out[run, lang] += np.where(ends > starts, sums, 0.0)
    return out, some


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Rows (key, lang_pred, score): the likeliest language and its posterior probability."""
    shared = df.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def work(batches):
        state = _state(shared)
        names = np.array([*state["languages"], "und"], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if state["languages"]:
                logs, some = _scores(texts, state, state["letters"])
                best = logs.argmax(axis=1)
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                score = np.where(some, 1.0 / odds.sum(axis=1), 0.0)
                best = np.where(some, best, len(names) - 1)
            else:
                best, score = np.zeros(len(texts), dtype=int), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                [key, "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(
        work, f"`{key}` {kind}, lang_pred string, score double")
