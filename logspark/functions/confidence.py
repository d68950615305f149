"""The confidence shown next to a model verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P


def ml_confidence(score: Column, flagged: Column, empty: Column, text: Column) -> dict:
    """Verdict and confidence from a decision score (below 0 is anomalous).

    The score is scaled from [-0.3, 0.2], turned round for anomalies and squeezed for
    normal lines, put through a sigmoid of slope 4 and kept within [0.1, 0.9]. A text
    without known terms is an anomaly at 0.92 or more; strong words make one and raise it.
    """
    scaled = F.least(F.greatest((score + 0.3) / F.lit(0.5), F.lit(0.0)), F.lit(1.0))
    toward = F.when(flagged, 1 - scaled).otherwise(scaled * 0.6 + 0.1)
    curve = 1 / (1 + F.exp(-4 * (toward - 0.5)))
    base = F.least(F.greatest(curve, F.lit(0.1)), F.lit(0.9))
    lowered = F.lower(text)
    strong = sum(lowered.contains(word).cast("int") for word in P.STRONG_WORDS)
    boost = F.least(strong * 0.1 + 0.15, F.lit(0.4))
    confidence = (
        F.when(empty, F.greatest(base, F.lit(0.92)))
        .when(strong > 0, F.least(F.greatest(base, F.lit(0.6)) + boost, F.lit(0.95)))
        .otherwise(base)
    )
    anomalous = flagged | empty | (strong > 0)
    return {
        "ml_prediction": F.when(anomalous, "Anomaly").otherwise("Normal"),
        "confidence": F.round(confidence, 2),
    }
