"""Sequence models: how often a run of messages was seen, and how its words vary.

Runs are taken over row frames of bounded blocks. A run is identified by the md5 of the md5s
of its messages, each taken once where the frames are, so frames and shuffles carry digests
instead of the messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import frames

UNSEEN = 0.8


def _digest(digests: Column) -> Column:
    return F.md5(F.array_join(digests, ""))


def _runs(
    df: DataFrame, order: str, by, length: int, columns: dict, numbered: bool
) -> DataFrame:
    """Every row with arrays ``_run_<name>`` of the given columns over the last ``length`` rows.

    The columns are made after the rows have moved. ``_full`` says that the run has
    ``length`` rows.
    """
    by = list(by)
    seq = order if numbered else "_seq"
    indexed = df if numbered else frames.line_index(df, order, by, name=seq)
    wide = frames.with_halo(indexed, seq, before=length - 1, by=by).withColumns(
        {f"_one_{name}": value for name, value in columns.items()})
    frame = frames.block_window(seq, by, -(length - 1), 0)
    runs = wide.withColumns({f"_run_{c}": F.collect_list(f"_one_{c}").over(frame) for c in columns})
    return frames.own_rows(runs).withColumn("_full", F.col(seq) >= length - 1)


def sequence_keys(
    df: DataFrame, order: str, message: str, by=(), length: int = 5, numbered: bool = False,
    with_run: bool = True,
) -> DataFrame:
    """Add ``run_key`` (null for the first ``length`` - 1 rows) and ``run``, the messages.

    Fitting needs the messages of a run; scoring does without (``with_run``).
    """
    said = F.coalesce(F.col(message), F.lit(""))
    columns = {"digest": F.md5(said), **({"said": said} if with_run else {})}
    runs = _runs(df, order, by, length, columns, numbered)
    run = [F.when(F.col("_full"), F.col("_run_said")).alias("run")] if with_run else []
    key = F.when(F.col("_full"), _digest(F.col("_run_digest"))).alias("run_key")
    return frames.settle(runs.select(*df.columns, *run, key))


def sequence_fit(keyed: DataFrame, min_count: int = 2) -> DataFrame:
    """Runs seen at least ``min_count`` times: run_key, run, seen, and the total of all runs."""
    # The messages follow from the key; as a part of it they are hashed, not sorted.
    counted = keyed.where(F.col("run_key").isNotNull()).groupBy("run_key", "run").agg(
        F.count(F.lit(1)).alias("seen"))
    total = keyed.agg(F.count("run_key"))
    return counted.where(F.col("seen") >= min_count).withColumn("total", total.scalar())


def sequence_score(keyed: DataFrame, patterns: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Add ``sequence_score``: rare runs score high, unknown ones 1, incomplete ones 0."""
    known = patterns.select("run_key", "seen", "total")
    share = F.col("seen") / F.col("total")
    score = F.when(F.col("run_key").isNull(), 0.0).when(F.col("seen").isNull(), 1.0).otherwise(1 - share)
    return keyed.join(known, "run_key", "left").withColumn("sequence_score", score).drop("seen", "total")


def sequence_stats(keyed: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: all runs, kept patterns, their least, most and mean count, and coverage."""
    total = keyed.agg(F.count("run_key"))
    made = patterns.agg(
        F.count(F.lit(1)).alias("unique_sequences"),
        F.coalesce(F.min("seen"), F.lit(0)).alias("min_frequency"),
        F.coalesce(F.max("seen"), F.lit(0)).alias("max_frequency"),
        F.coalesce(F.avg("seen"), F.lit(0.0)).alias("avg_frequency"),
    ).withColumn("total_sequences", total.scalar())
    return made.withColumn(
        "coverage",
        F.when(F.col("total_sequences") > 0, F.col("unique_sequences") / F.col("total_sequences"))
        .otherwise(0.0),
    )


def build_vocabulary(df: DataFrame, message: str, min_count: int = 2) -> DataFrame:
    """Words seen at least ``min_count`` times, with their place in sorted order."""
    words = df.select(F.explode(_words(F.col(message))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("seen")).where(
        F.col("seen") >= min_count
    )
    one = counted.withColumn("_one", F.lit(1))
    ranked = frames.running_totals(one, "word", ["_one"])
    return ranked.select("word", "seen", (F.col("cum__one") - 1).alias("word_index"))


def _words(message: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(message, F.lit(""))), r"[\s\x1c-\x1f\x85\p{Z}]+"), "")


def _first_word_indices(
    df: DataFrame, key: str, message: str, vocabulary: DataFrame, length: int
) -> DataFrame:
    """Per row the indices of the first ``length`` words of its message; unknown words 0.

    Looked up once per distinct beginning of a message, not once per line.
    """
    # Words hold no blanks.
    beginning = frames.settle(df.select(
        key, F.array_join(F.slice(_words(F.col(message)), 1, length), " ").alias("_begin")
    )).withColumn("_begin_key", F.md5(F.col("_begin")))
    distinct = beginning.where(F.col("_begin") != "").select("_begin_key", "_begin").distinct()
    placed = distinct.select("_begin_key", F.posexplode(F.split("_begin", " ")).alias("_at", "word"))
    looked_up = placed.join(vocabulary.select("word", "word_index"), "word", "left")
    arrays = looked_up.groupBy("_begin_key").agg(
        F.sort_array(F.collect_list(F.struct(
            "_at", F.coalesce("word_index", F.lit(0)).alias("_i")))).alias("_a")
    ).select("_begin_key", F.col("_a._i").alias("_indices"))
    empty = F.array().cast("array<bigint>")
    return beginning.select(key, "_begin_key").join(arrays, "_begin_key", "left").select(
        key, F.coalesce("_indices", empty).alias("_indices")
    )


def pattern_rows(
    df: DataFrame, order: str, message: str, vocabulary: DataFrame, by=(), length: int = 10,
    key_chars: int = 50, numbered: bool = False,
) -> DataFrame:
    """Add ``pattern_key`` and ``word_run`` for every full run of ``length`` messages.

    The key is made of the first ``key_chars`` characters of each message; the word run
    holds the indices of the first ``length`` words of the run, filled up with zeros.
    ``order`` is unique over the table.
    """
    indexed = _first_word_indices(df, order, message, vocabulary, length)
    joined = df.join(indexed, order)
    short = F.md5(F.substring(F.coalesce(F.col(message), F.lit("")), 1, key_chars))
    runs = _runs(joined, order, by, length, {"short": short, "indices": F.col("_indices")}, numbered)
    flat = F.slice(F.flatten("_run_indices"), 1, length)
    padded = F.slice(F.concat(flat, F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length)
    keyed = runs.withColumns({
        "pattern_key": F.when(F.col("_full"), _digest(F.col("_run_short"))),
        "word_run": F.when(F.col("_full"), padded),
    })
    return frames.settle(keyed.select(*df.columns, "pattern_key", "word_run"))


def pattern_fit(rows: DataFrame, length: int = 10, min_count: int = 2) -> DataFrame:
    """Per repeated pattern key the mean and population deviation at every word position."""
    full = rows.where(F.col("pattern_key").isNotNull())
    aggregates = [F.count(F.lit(1)).alias("seen")]
    for at in range(length):
        aggregates += [
            F.avg(F.col("word_run")[at]).alias(f"_m{at}"),
            F.stddev_pop(F.col("word_run")[at]).alias(f"_s{at}"),
        ]
    counted = full.groupBy("pattern_key").agg(*aggregates).where(F.col("seen") >= min_count)
    return counted.select(
        "pattern_key", "seen",
        F.array(*[f"_m{at}" for at in range(length)]).alias("means"),
        F.array(*[f"_s{at}" for at in range(length)]).alias("deviations"),
    )


def pattern_score(rows: DataFrame, patterns: DataFrame, length: int = 10) -> DataFrame:
    """Add ``pattern_score``: tanh of half the mean normalised distance to the pattern."""
    joined = rows.join(patterns.drop("seen"), "pattern_key", "left")
    distances = [
        F.abs(F.col("word_run")[at] - F.col("means")[at]) / (F.col("deviations")[at] + F.lit(1e-8))
        for at in range(length)
    ]
    distance = sum(distances[1:], distances[0]) / F.lit(float(length))
    score = F.when(F.col("pattern_key").isNull(), 0.0).when(
        F.col("means").isNull(), UNSEEN
    ).otherwise(F.tanh(distance / 2.0))
    return joined.withColumn("pattern_score", score).drop("means", "deviations")


@dataclass
class SequenceModel:
    """Both fitted models: repeated runs, the word index, and the patterns of word indices."""

    runs: DataFrame
    vocabulary: DataFrame
    patterns: DataFrame
    length: int = 10
    weights: tuple = (0.6, 0.4)
    threshold: float = 0.7

    def score(self, df: DataFrame, order: str, message: str, by=(), numbered: bool = False) -> DataFrame:
        """Both scores of each row, their blend and a flag."""
        keyed = sequence_keys(df, order, message, by, self.length, numbered, with_run=False)
        by_frequency = sequence_score(keyed, self.runs)
        rows = pattern_rows(df, order, message, self.vocabulary, by, self.length, numbered=numbered)
        by_pattern = pattern_score(rows, self.patterns, self.length)
        both = by_frequency.select(*df.columns, "sequence_score").join(
            by_pattern.select(order, "pattern_score"), order
        )
        blend = self.weights[0] * F.col("sequence_score") + self.weights[1] * F.col("pattern_score")
        return both.withColumn("ensemble_score", blend).withColumn(
            "is_anomaly", (F.col("ensemble_score") > self.threshold).cast("int")
        )


def sequence_model(
    df: DataFrame, order: str, message: str, by=(), length: int = 10, weights=(0.6, 0.4),
    threshold: float = 0.7, numbered: bool = False,
) -> SequenceModel:
    """Both models of a table, as lazy plans; save and load them to score other rows."""
    keyed = sequence_keys(df, order, message, by, length, numbered)
    vocabulary = build_vocabulary(df, message)
    rows = pattern_rows(df, order, message, vocabulary, by, length, numbered=numbered)
    return SequenceModel(
        sequence_fit(keyed), vocabulary, pattern_fit(rows, length), length, tuple(weights), threshold)


def sequence_ensemble(
    df: DataFrame, order: str, message: str, by=(), length: int = 10, weights=(0.6, 0.4),
    threshold: float = 0.7, numbered: bool = False, fit_on: DataFrame | None = None,
) -> DataFrame:
    """Both scores of each row, their blend and a flag.

    Both models are fitted on ``fit_on`` (the training part), else on the table itself.
    """
    learned = df if fit_on is None else fit_on
    model = sequence_model(learned, order, message, by, length, weights, threshold, numbered)
    return model.score(df, order, message, by, numbered)


def model_info(
    vocabulary: DataFrame, keyed: DataFrame, sequence_patterns: DataFrame,
    pattern_patterns: DataFrame, length: int, weights=(0.6, 0.4),
) -> DataFrame:
    """One row about a fitted pair of models."""
    stats = sequence_stats(keyed, sequence_patterns)
    return stats.select(
        "*",
        vocabulary.agg(F.count(F.lit(1))).scalar().alias("vocab_size"),
        pattern_patterns.agg(F.count(F.lit(1))).scalar().alias("learned_patterns"),
        F.lit(length).alias("sequence_length"),
        F.lit(float(weights[0])).alias("frequency_weight"),
        F.lit(float(weights[1])).alias("pattern_weight"),
    )
