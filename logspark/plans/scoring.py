"""From lines to verdicts: one lazy plan, with a fitted text model or without."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.confidence import ml_confidence
from ..functions.text import clean_message, message_text
from ..operators import forest as trees, parse, prepare, rules, tfidf
from ..operators.frames import settle
from ..session import materialize
from ..sources import stores

REMEMBERED = 100_000  # texts a task remembers the scores of, about
HELD = 8 << 20        # and characters of them, about


@dataclass
class TextModel:
    """A vocabulary of at most ``max_features`` terms and a forest over its weights."""

    vocabulary: DataFrame
    forest: trees.Forest
    max_features: int = 5000

    def save(self, path: str) -> None:
        stores.save_model(path, self.vocabulary, self.forest)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextModel":
        vocabulary, forest = stores.load_model(spark, path)
        return cls(vocabulary, forest, forest.size)


def text_vectors(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, max_features: int):
    """(key, positions, values, empty) for every text, also those without known terms."""
    vectors = tfidf.tfidf_vectors(texts, vocabulary, key, text, max_features=max_features)
    return vectors.withColumn("empty", F.size("positions") == 0)


def fit_text_model(
    texts: DataFrame, key: str, text: str, max_features: int = 5000, trees_count: int = 150,
    contamination: float = 0.15, seed: int = 42,
) -> TextModel:
    """TF-IDF and an isolation forest on the texts. Runs Spark jobs."""
    vocabulary = materialize(tfidf.tfidf_fit(texts, key, text, max_features))
    rows = materialize(text_vectors(texts, key, text, vocabulary, max_features).drop("empty"))
    forest = trees.isolation_forest_fit(
        rows, key, max_features, trees_count, 256, contamination, seed)
    return TextModel(vocabulary, forest, max_features)


def score_texts(df: DataFrame, text: str, model: TextModel | None, key: str) -> DataFrame:
    """Add ``ml_prediction`` and ``confidence``; Normal at 0.5 without a model.

    Scored in the row, in one pass over the input: nothing is joined or shuffled, whatever
    text is frequent. A task remembers texts it has scored, so equal ones are scored once
    there: logs repeat themselves. How many words are weighed and how many characters are
    remembered at a time is bounded, however long texts are.
    """
    if model is None:
        return df.withColumns({"ml_prediction": F.lit("Normal"), "confidence": F.lit(0.5)})
    kept = df.columns
    worded = settle(df.select(
        *kept, F.col(text).cast("string").alias("_text"),
        tfidf.words_of(F.col(text), tfidf.english_stop_words()).alias("_words")))
    known = tfidf.weigher(model.vocabulary, model.max_features)
    scorer = trees.RowScorer(model.forest)
    shared = df.sparkSession.sparkContext.broadcast((known, scorer))

    def score(batches):
        known, scorer = shared.value
        memory, held = {}, 0
        for batch in (part for whole in batches for part in tfidf._parts(whole, len(kept) + 1)):
            coded = batch.column(len(kept)).dictionary_encode()
            texts = coded.dictionary.to_pylist() + [None]
            at = pc.fill_null(coded.indices, len(texts) - 1).to_numpy(zero_copy_only=False)
            if len(memory) > REMEMBERED or held > HELD:
                memory.clear()
                held = 0
            fresh = [i for i in np.unique(at) if texts[i] not in memory]
            if fresh:
                first = np.full(len(texts), -1)
                first[at[::-1]] = np.arange(len(at))[::-1]
                words = batch.column(len(kept) + 1).take(pa.array(first[fresh]))
                row, place, weight = known.weigh(words)
                made = scorer.score(row, known.index[place], weight, len(fresh))
                empty = np.bincount(row, minlength=len(fresh)) == 0
                memory.update(zip([texts[i] for i in fresh], zip(made.tolist(), empty.tolist())))
                held += sum(len(texts[i] or "") for i in fresh)
            found = [memory[texts[i]] for i in at]
            score, empty = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(score, pa.float64()), pa.array(empty, pa.bool_())],
                [*kept, "_score", "_empty"])

    schema = T.StructType([*df.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_empty", T.BooleanType())])
    scored = worded.mapInArrow(score, schema)
    verdicts = ml_confidence(F.col("_score"), F.col("_score") < 0, F.col("_empty"), F.col(text))
    there = F.col(text).isNotNull()  # no verdict without a text
    return scored.select(*kept, *[F.when(there, c).alias(n) for n, c in verdicts.items()])


def ingest(
    lines: DataFrame, model: TextModel | None = None, line: str = "line",
    line_no: str = "line_no", by=(),
) -> DataFrame:
    """Parse, clean, score, apply the rules and fuse: one row per line with its verdict.

    ``by`` names the file or host column inside which lines follow each other; the rules
    that look at neighbours stay inside it.
    """
    numbered = parse.number_lines(lines, line, line_no, by)
    logs = prepare.process_logs(parse.parse_logs(numbered, line, line_no))
    ruled = rules.run_rules(logs, order="seq", by=by, numbered=True)
    texted = ruled.withColumn("_said", message_text())
    judged = score_texts(texted, "_said", model, "seq").drop("_said")
    return rules.combine_rule_ml(judged)


def analyze_messages(messages: DataFrame, key: str, message: str, model: TextModel | None = None) -> DataFrame:
    """A verdict per single message, each its own context.

    The model sees the cleaned message, or the message where cleaning leaves nothing. A
    message of several lines is judged by its first one that gives a record; without a
    record the message as it is stands for it.
    """
    cleaned = F.coalesce(F.nullif(clean_message(F.col(message)), F.lit("")), F.col(message), F.lit(""))
    texts = messages.select(key, F.col(message).alias("_message"), cleaned.alias("_cleaned"))
    scored = score_texts(texts, "_cleaned", model, key)
    lines = parse.split_lines(messages.select(key, F.col(message).alias("line")), "line", "line_no", "_l")
    records = parse.parse_logs(lines, "_l", "line_no", ("message", "raw", "ip_address"))
    first = records.groupBy(key).agg(F.min_by(
        F.struct("message", "raw", "ip_address"), "line_no").alias("_r")).select(key, "_r.*")
    whole = F.coalesce(F.col("_message"), F.lit(""))
    records = texts.select(key, "_message").join(first, key, "left").select(
        key, F.coalesce("message", F.when(F.col("raw").isNull(), whole)).alias("message"),
        F.coalesce("raw", whole).alias("raw"), "ip_address")
    ruled = rules.run_rules(records, order=None).select(key, "rule")
    fused = rules.combine_rule_ml(scored.join(ruled, key, "left"), label_override=False)
    return fused.select(
        key, F.col("_message").alias("message"), "prediction", "confidence", "source")
