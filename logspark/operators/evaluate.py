"""Labels, classification metrics, curves, and comparisons between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from ..functions.fields import contains_any
from ..functions.text import message_or_raw
from . import frames

METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")


def silver_labels(df: DataFrame) -> DataFrame:
    """Add ``silver``: the dataset label, else whether a rule, level, word or phrase hits.

    Expects ``rule`` from ``run_rules``.
    """
    text = F.lower(message_or_raw())
    hit = (
        F.col("rule").isNotNull()
        | F.upper("log_level").isin(*P.SEVERE_LEVELS)
        | contains_any(text, P.SILVER_WORDS)
        | text.rlike(P.any_of(P.SILVER_PHRASES))
    )
    guessed = F.coalesce(hit, F.lit(False)).cast("int")
    return df.withColumn(
        "silver", F.when(F.col("dataset_label").isin(0, 1), F.col("dataset_label")).otherwise(guessed)
    )


def heuristic_labels(df: DataFrame, text: str = "content", rules: str = "rule_names") -> DataFrame:
    """Add ``label``: any rule name, a severe level, or failed, timeout or error in the text."""
    hit = (
        (F.size(rules) > 0)
        | F.col("log_level").isin(*P.SEVERE_LEVELS)
        | contains_any(F.lower(text), ("failed", "timeout", "error"))
    )
    return df.withColumn("label", F.coalesce(hit, F.lit(False)).cast("int"))


def hybrid_predictions(df: DataFrame, ml_label: str = "ml_label") -> DataFrame:
    """Add ``hybrid_label``: 1 where a rule fired or the model says so."""
    return df.withColumn(
        "hybrid_label", (F.col("rule").isNotNull() | (F.col(ml_label) == 1)).cast("int")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def evaluate_binary(
    df: DataFrame, label: str, pred: str, by=(), digits: int | None = 4
) -> DataFrame:
    """Accuracy, precision, recall, F1, the confusion counts and the support, per group.

    A ratio without cases is 0. One aggregation, whatever the number of models.
    """
    truth, guess = F.col(label), F.col(pred)

    def cell(t: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((truth == t) & (guess == p), 1).otherwise(0)), F.lit(0))

    counted = df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    ratios = {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": precision,
        "recall": recall, "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    if digits is not None:
        ratios = {name: F.round(value, digits) for name, value in ratios.items()}
    return counted.select(
        *by, *[value.alias(name) for name, value in ratios.items()], "tn", "fp", "fn", "tp",
        (tn + fp).alias("support_normal"), (tp + fn).alias("support_anomaly"),
        (tn + fp + fn + tp).alias("support_total"),
    )


def score_curve(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """Distinct scores from high to low with the labels at and above them.

    Columns: pos, neg (at the score), cum_pos, cum_neg (at or above), all_pos, all_neg.
    """
    by = list(by)
    per_score = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    curve = frames.running_totals(per_score, score, ["pos", "neg"], by, descending=True)
    totals = per_score.groupBy(*by).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")
    )
    if by:
        return frames.null_safe_join(curve, totals, by)
    return curve.withColumn("_t", totals.select(F.struct("*")).scalar()).select("*", "_t.*").drop("_t")


def curve_metrics(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """ROC area, precision-recall area and the threshold with the best tpr - fpr.

    Higher scores mean anomalous. Ties count half; with one class the ROC area is 0.5.
    """
    curve = score_curve(df, label, score, by)
    pos, neg, cum_pos, cum_neg, all_pos, all_neg = (
        F.col(c) for c in ("pos", "neg", "cum_pos", "cum_neg", "all_pos", "all_neg")
    )
    below = all_neg - cum_neg
    here = _ratio(cum_pos, cum_pos + cum_neg)
    last_pos, last_all = cum_pos - pos, cum_pos - pos + cum_neg - neg
    before = F.when(last_all == 0, 1.0).otherwise(last_pos / last_all)
    lead = cum_pos * all_neg - cum_neg * all_pos  # (tpr - fpr) times both totals
    summed = curve.groupBy(*by).agg(
        F.sum(pos * (below + neg / F.lit(2.0))).alias("_wins"),
        F.sum(pos * (here + before) / F.lit(2.0)).alias("_area"),
        F.max(F.struct(lead.alias("lead"), F.col(score).alias("at"))).alias("_best"),
        F.first("all_pos").alias("_p"), F.first("all_neg").alias("_n"),
    )
    p, n = F.col("_p"), F.col("_n")
    both = (p > 0) & (n > 0)
    gap = F.col("_best.lead") / (p * n)
    return summed.select(
        *by,
        F.when(both, F.col("_wins") / (p * n)).otherwise(0.5).alias("roc_auc"),
        F.when(p > 0, F.col("_area") / p).otherwise(0.0).alias("pr_auc"),
        F.when(F.col("_best.lead") > 0, F.col("_best.at").cast("double"))
        .otherwise(F.lit(float("inf"))).alias("optimal_threshold"),
        F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)).alias("max_tpr_minus_fpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return curve_metrics(df, label, score, by).select(*by, "roc_auc")


def pr_auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return curve_metrics(df, label, score, by).select(*by, "pr_auc")


def optimal_threshold(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return curve_metrics(df, label, score, by).select(*by, "optimal_threshold", "max_tpr_minus_fpr")


def compare_models(metrics: DataFrame, model: str = "model", names=METRICS) -> DataFrame:
    """Rank of every model under every metric, best first, ties by name.

    One row per model goes in, so the ranking sees as many rows as there are models.
    """
    present = [name for name in names if name in metrics.columns]
    long = metrics.select(model, *[F.col(n).cast("double").alias(n) for n in present]).unpivot(
        [model], present, "metric", "value"
    )
    order = Window.partitionBy("metric").orderBy(F.desc("value"), model)
    return long.withColumn("place", F.row_number().over(order)).withColumn(
        "is_best", F.col("place") == 1
    )


def comparison_table(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Metrics per model in report order, four decimals."""
    order = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc",
             "support_normal", "support_anomaly")
    first = [c for c in order if c in metrics.columns]
    rest = [c for c in metrics.columns if c not in first and c != model]
    kinds = dict(metrics.dtypes)
    return metrics.select(model, *[
        F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in [*first, *rest]
    ])


def improvement_summary(base: DataFrame, new: DataFrame, names=METRICS) -> DataFrame:
    """Percent change per metric between two one-row tables, and the overall reading.

    A change beyond 10 percent is significant. Metrics that were 0 are left out.
    """
    present = [n for n in names if n in base.columns and n in new.columns]

    def long(df, value):
        return df.select(*[F.col(n).cast("double").alias(n) for n in present]).unpivot(
            [], present, "metric", value)

    joined = long(base, "baseline").join(long(new, "improved"), "metric").where("baseline > 0")
    change = (F.col("improved") - F.col("baseline")) / F.col("baseline") * 100
    judged = joined.withColumn("change_percent", change).withColumn(
        "direction", F.when(F.col("change_percent") > 0, "improvement")
        .when(F.col("change_percent") < 0, "degradation").otherwise("same")
    ).withColumn("significant", F.abs("change_percent") > 10)
    whole = Window.partitionBy()  # one row per metric
    balance = (
        F.sum(F.when(F.col("direction") == "improvement", 1).otherwise(0)).over(whole)
        - F.sum(F.when(F.col("direction") == "degradation", 1).otherwise(0)).over(whole)
    )
    return judged.withColumn(
        "overall",
        F.when(balance > 0, "Overall improvement achieved")
        .when(balance < 0, "Overall performance degraded")
        .otherwise("Mixed results - trade-offs between metrics"),
    )


def best_models(metrics: DataFrame, metric: str = "f1_score", model: str = "model") -> DataFrame:
    """The best model of each family by a metric; ties by name."""
    family = (
        F.when(F.col(model).startswith("IF_"), "IsolationForest")
        .when(F.col(model).startswith("LOF_"), "LOF")
        .when(F.col(model).startswith("OCSVM_"), "OneClassSVM")
    )
    known = metrics.withColumn("family", family).where(F.col("family").isNotNull())
    best = Window.partitionBy("family").orderBy(F.desc(metric), model)
    return known.withColumn("_place", F.row_number().over(best)).where("_place = 1").select(
        "family", model, metric
    )


def choose_gold(gold: DataFrame, label: str = "label", least: int = 5) -> Column:
    """Whether a gold table has enough rows and both classes, as a scalar column."""
    return gold.where(F.col(label).isNotNull()).agg(
        (F.count(F.lit(1)) >= least) & (F.count_distinct(label) >= 2)
    ).scalar()
