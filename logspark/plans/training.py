"""Training and evaluation jobs. These run Spark jobs and return metric tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import message_text
from ..operators import (
    evaluate, features, fuse, grid as grids, parse, prepare, rules, sequence, splits, tfidf,
)
from ..session import materialize
from . import scoring


def training_texts(lines: DataFrame, by=("path",), longer_than: int = 3) -> DataFrame:
    """(key, text): the model texts of lines, without very short ones."""
    logs = prepare.process_logs(parse.parse_logs(lines))
    kept = prepare.filter_messages(logs, longer_than)
    return kept.select(
        F.concat_ws(":", *[F.col(c) for c in by], F.col("id")).alias("key"),
        message_text().alias("text"),
    )


def split_lines(lines: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Lines of files with ``part``; blank lines do not count."""
    spoken = lines.where(F.trim("line") != "").withColumn(
        "_key", F.concat_ws(":", "path", F.col("line_no").cast("string")))
    return splits.holdout_per_file(spoken, "path", "_key", ratio, seed).drop("_key")


def train_split(lines: DataFrame, ratio: float = 0.2, seed: int = 42, **options):
    """Fit on the train part of every file: (model, lines with part, counts per file)."""
    parted = materialize(split_lines(lines, ratio, seed))
    texts = materialize(training_texts(parted.where("part = 'train'").drop("part")))
    model = scoring.fit_text_model(texts, "key", "text", seed=seed, **options)
    report = parted.groupBy("path").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum((F.col("part") == "train").cast("int")).alias("train_records"),
        F.sum((F.col("part") == "test").cast("int")).alias("test_records"),
    )
    return model, parted, report


def judged_lines(lines: DataFrame, model) -> DataFrame:
    """Lines with silver label, model label and hybrid label."""
    scored = scoring.ingest(lines, model, by=["path"])
    labeled = evaluate.silver_labels(scored)
    ml = labeled.withColumn("ml_label", (F.col("ml_prediction") == "Anomaly").cast("int"))
    return evaluate.hybrid_predictions(ml)


def evaluate_split(lines: DataFrame, model) -> DataFrame:
    """ML-only and hybrid metrics against silver labels, in one aggregation."""
    judged = judged_lines(lines, model)
    both = judged.select("silver", F.inline(F.array(
        F.struct(F.lit("ml_only").alias("model"), F.col("ml_label").alias("pred")),
        F.struct(F.lit("hybrid_ml_rules").alias("model"), F.col("hybrid_label").alias("pred")),
    )))
    return evaluate.evaluate_binary(both, "silver", "pred", by=["model"])


def evaluate_gold(gold: DataFrame, model) -> DataFrame:
    """Both metrics against gold labels: (raw, cleaned, label) from ``read_gold_csv``."""
    keyed = gold.withColumn("_key", F.md5(F.col("raw")))
    messages = keyed.groupBy("_key").agg(F.first("raw").alias("raw"))
    rated = scoring.analyze_messages(messages, "_key", "raw", model).select("_key", "prediction", "source")
    judged = keyed.join(rated, "_key")
    flagged = F.col("prediction") == "Anomaly"
    both = judged.select("label", F.inline(F.array(
        F.struct(F.lit("ml_only").alias("model"),
                 (flagged & F.col("source").contains("ML")).cast("int").alias("pred")),
        F.struct(F.lit("hybrid_ml_rules").alias("model"), flagged.cast("int").alias("pred")),
    )))
    return evaluate.evaluate_binary(both, "label", "pred", by=["model"])


def metrics_with_gold(silver: DataFrame, gold_metrics: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold metrics where the gold table has five rows and both classes, else silver ones."""
    use_gold = evaluate.choose_gold(gold)
    both = silver.withColumn("labeling", F.lit("silver")).unionByName(
        gold_metrics.withColumn("labeling", F.lit("gold")))
    wanted = F.when(F.col("_gold"), "gold").otherwise("silver")
    return both.withColumn("_gold", use_gold).where(F.col("labeling") == wanted).drop("_gold")


def train_basic(lines: DataFrame, gold: DataFrame | None = None, ratio: float = 0.2, **options):
    """Fit on the train part, evaluate on the test part, refit on everything.

    Returns the final model and the metrics of the evaluated one.
    """
    model, parted, _ = train_split(lines, ratio, **options)
    metrics = evaluate_split(parted.where("part = 'test'").drop("part"), model)
    if gold is not None:
        metrics = metrics_with_gold(metrics, evaluate_gold(gold, model), gold)
    metrics = materialize(metrics)
    texts = materialize(training_texts(lines, longer_than=0))
    return scoring.fit_text_model(texts, "key", "text", **options), metrics


@dataclass
class AdvancedResult:
    metrics: DataFrame      # per verdict: metrics and ROC area
    best: DataFrame         # best model per family
    grid_metrics: DataFrame
    scores: DataFrame       # per test row: all scores and flags


def train_advanced(
    lines: DataFrame, order: str = "line_no", test_ratio: float = 0.2, svd: int = 300,
    max_features: int = 10_000, sequence_length: int = 10, sample: int | None = None,
    small: bool = False, seed: int = 42, **grid_options,
) -> AdvancedResult:
    """Features, text, model grid, sequence and rules; six verdicts on the last rows.

    ``sample`` trains on that many rows (the sampled variant, with ``small`` weights). The
    split is by order and models see the train part only.
    """
    if sample is not None:
        # Written, since everything below reads it and would choose it from all lines again.
        lines = materialize(splits.sample_rows(lines.select(order, "line"), order, sample, seed))
    chosen = splits.chronological_split(lines.select(order, "line"), order, test_ratio)
    records = materialize(parse.parse_feature_record(chosen))
    made = materialize(features.all_features(records, "record_ts", order))
    texts = materialize(records.select(order, F.col("content").alias("text"), "part"))
    train_texts = texts.where("part = 'train'").drop("part")
    vocabulary = materialize(tfidf.tfidf_fit(train_texts, order, "text", max_features, min_df=2))
    vectors = materialize(scoring.text_vectors(
        texts.drop("part"), order, "text", vocabulary, max_features).drop("empty"))
    in_train = train_texts.select(order)
    components, _ = tfidf.svd_components(
        vectors.join(in_train, order, "left_semi"), max_features, min(svd, max_features), seed=seed)
    coordinates = tfidf.project(vectors, order, components)
    numbers = F.array(*[F.col(c) for c in features.ALL_FEATURES])
    whole = made.select(order, "part", numbers.alias("_n"), "content", "log_level", "ip_address").join(
        coordinates, order).withColumn("vector", F.concat("_n", "features"))
    whole = materialize(whole.drop("_n", "features"))
    rows = materialize(tfidf.standardize(whole, "vector", fit_on=whole.where("part = 'train'")))
    train = rows.where("part = 'train'")
    test = rows.where("part = 'test'")

    ruled = rules.evaluate_rules_all(
        test.withColumns({"message": F.col("content"), "raw": F.lit("")}))
    labels = evaluate.heuristic_labels(ruled).select(
        order, "label", rules.rule_score().alias("rule_score"))
    fitted = grids.model_grid(train, order, "vector", seed=seed, **grid_options)
    trees = grid_options.get("trees", grids.TREES)
    scores = materialize(grids.score_grid(test, fitted, "vector", trees))
    grid_metrics = materialize(grids.evaluate_grid(scores, labels, order, "label"))
    best = materialize(evaluate.best_models(grid_metrics))
    chosen_scores = scores.join(F.broadcast(best.select("model")), "model")  # three rows
    votes = grids.ensemble(chosen_scores, order)
    # Decision values fall with anomaly; turned round, all scores point the same way.
    means = chosen_scores.groupBy(order).agg((-F.avg("score")).alias("ml_score"))
    sequences = sequence.sequence_ensemble(
        test.select(order, "content"), order, "content", length=sequence_length,
        fit_on=train.select(order, "content"),
    ).select(order, F.col("ensemble_score").alias("sequence_score"))
    parts = labels.join(votes, order).join(means, order).join(sequences, order)
    fused = fuse.fused_scores(parts, small=small)
    hybrid = fuse.hybrid(fused, ml="ensemble_pred")
    final = materialize(hybrid)
    hybrid_rules = ("ml_rules_pred", "ml_rules_score") if small else ("hybrid_pred", "full_score")
    verdicts = {
        "ML_Ensemble": ("ensemble_pred", "ml_score"),
        "ML_Best_Ensemble": ("ml_best_pred", "ml_score"),
        "Sequence_Detector": ("_sequence_pred", "sequence_score"),
        "Hybrid_ML_Rules": hybrid_rules,
        "Hybrid_ML_Sequence": ("ml_sequence_pred", "ml_sequence_score"),
        "Hybrid_Full": ("full_pred", "full_score"),
    }
    flagged = final.withColumn("_sequence_pred", (F.col("sequence_score") > 0.7).cast("int"))
    long = flagged.select("label", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(pred).alias("pred"), F.col(score).alias("score"))
        for name, (pred, score) in verdicts.items()
    ])))
    metrics = evaluate.evaluate_binary(long, "label", "pred", by=["model"]).join(
        evaluate.curve_metrics(long, "label", "score", by=["model"]), "model")
    return AdvancedResult(metrics, best, grid_metrics, final)


def train_sampled(lines: DataFrame, order: str = "line_no", sample: int = 10_000, **options) -> AdvancedResult:
    """The sampled variant: 30 percent test rows, its own sizes and blend weights."""
    options = {"svd": 200, "max_features": 5000, "sequence_length": 5, **options}
    return train_advanced(lines, order, test_ratio=0.3, sample=sample, small=True, **options)
