"""Blends of model, rule and sequence scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import frames


def hybrid(
    df: DataFrame, ml: str = "ml_pred", rule: str = "rule_score", rule_weight: float = 0.4,
    method: str = "weighted_average", reference_formula: bool = False,
) -> DataFrame:
    """Add ``hybrid_score`` and ``hybrid_pred`` from a 0/1 model verdict and a 0-100 rule score.

    The score rises with the verdict; ``reference_formula`` takes one minus the verdict, as
    published. ``weighted_average`` flags scores above the 90th percentile,
    ``adaptive_threshold`` those above 0.1, or 0.05 where rules fire often.
    """
    part = 1 - F.col(ml) if reference_formula else F.col(ml)
    scaled = F.col(rule) / F.lit(100.0)
    score = part * F.lit(1.0 - rule_weight) + scaled * F.lit(rule_weight)
    scored = df.withColumn("hybrid_score", score)
    if method == "weighted_average":
        cut = frames.exact_quantiles(scored, "hybrid_score", {"cut": 0.9})
    elif method == "adaptive_threshold":
        cut = df.agg(F.when(F.avg(scaled) > 0.05, 0.05).otherwise(0.1).alias("cut"))
    else:
        raise ValueError(f"unknown method {method}")
    return scored.withColumn("_cut", cut.scalar()).withColumn(
        "hybrid_pred", (F.col("hybrid_score") > F.col("_cut")).cast("int")
    ).drop("_cut")


def fused_scores(
    df: DataFrame, ml: str = "ml_score", rule: str = "rule_score", sequence: str = "sequence_score",
    small: bool = False, reference_formula: bool = False,
) -> DataFrame:
    """Blends of the three scores with their flags; all scores higher = more anomalous.

    ``ml_sequence`` (0.6, 0.4) and ``ml_best`` flag above the 90th percentile;
    ``reference_formula`` flags below it, as published. ``full`` is 0.4, 0.3, 0.3 above 0.5,
    or with ``small`` 0.5, 0.3, 0.2 above 0.4; ``ml_rules`` is 0.7, 0.3 above 0.5.
    """
    m, s = F.col(ml), F.col(sequence)
    r = F.col(rule) / F.lit(100.0)
    weights, limit = ((0.5, 0.3, 0.2), 0.4) if small else ((0.4, 0.3, 0.3), 0.5)
    scored = df.withColumns({
        "ml_best_score": m,
        "ml_sequence_score": m * 0.6 + s * 0.4,
        "ml_rules_score": m * 0.7 + r * 0.3,
        "full_score": m * weights[0] + r * weights[1] + s * weights[2],
    })
    best = frames.exact_quantiles(scored, "ml_best_score", {"cut": 0.9}).scalar()
    blend = frames.exact_quantiles(scored, "ml_sequence_score", {"cut": 0.9}).scalar()

    def beyond(score: str, cut: str):
        test = F.col(score) < F.col(cut) if reference_formula else F.col(score) > F.col(cut)
        return test.cast("int")

    return scored.withColumns({"_best": best, "_blend": blend}).withColumns({
        "ml_best_pred": beyond("ml_best_score", "_best"),
        "ml_sequence_pred": beyond("ml_sequence_score", "_blend"),
        "ml_rules_pred": (F.col("ml_rules_score") > 0.5).cast("int"),
        "full_pred": (F.col("full_score") > limit).cast("int"),
    }).drop("_best", "_blend")
