"""Quality classifier by positive-unlabelled learning.

Trusted good texts are the positives, web text of unknown quality is the unlabelled set, and
the share of good texts in it (the class prior) is estimated. The classifier minimises the
non-negative unbiased risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

with the sigmoid loss: the second part is the risk on bad texts, which cannot be negative,
so when it falls below zero only the first part is followed. g is linear over text
statistics, each cut into bins at quantiles, so it can bend without being deep.

Fitting reads at most ``positives`` labelled rows (smallest hashes) and about ``unlabelled``
rows of the training fold, chosen by hash; both bounds are parameters. Scoring reads every
whole text in place, without a shuffle.

Nulls and edge cases: a null text is an empty one; empty texts have a score like any other;
labels without a document or with nulls are left out, of several labels the largest counts;
rows that repeat a key count once in learning, so what the driver gathers is bounded by keys;
without a positive or an unlabelled text the score is the prior for all, 0.5 unless it can
be estimated; repeated rows stay, extra columns pass through ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import labelled_sample

SYMBOLS = "#*$%&|<>"
BINS = 8
NAMES = (
    "log_words", "word_length", "distinct", "symbols", "upper", "letters", "exclaimed",
    "stops", "commas", "top_share", "same_as_last", "distinct_pairs", "repeated_lines",
    "words_per_line", "digits",
)


def statistics(text: str | None) -> tuple:
    """The numbers the classifier sees; zeros for a text without a word."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    return (
        np.log1p(n),
        len(text) / n,
        len(counts) / n,
        sum(map(text.count, SYMBOLS)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        text.count("!") / n,
        text.count(".") / n,
        text.count(",") / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(map(text.count, "0123456789")) / n,
    )


@dataclass
class Model:
    prior: float
    edges: np.ndarray    # (statistics, BINS - 1)
    weights: np.ndarray  # (statistics, BINS)
    bias: float


def _bins(table: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack(
        [np.searchsorted(edges[i], table[:, i], side="right") for i in range(table.shape[1])], axis=1)


def _margin(bins: np.ndarray, model: Model) -> np.ndarray:
    return model.weights[np.arange(bins.shape[1]), bins].sum(axis=1) + model.bias


def scores(texts, model: Model) -> np.ndarray:
    """The probability of good quality of each text."""
    if not len(model.edges):
        return np.full(len(texts), model.prior)
    table = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
    return 1 / (1 + np.exp(-_margin(_bins(table, model.edges), model)))


def minimise(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400,
    rate: float = 0.05, decay: float = 1e-4,
) -> Model:
    """Fit the classifier to two tables of statistics, by Adam on the whole tables."""
    every = np.concatenate([positive, unlabelled])
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    # Half of the edges are quantiles, half cut the range: rare values need an edge too.
    edges = np.stack([
        np.sort(np.concatenate([
            np.quantile(every[:, i], inner[::2]),
            np.linspace(every[:, i].min(), every[:, i].max(), BINS - len(inner[::2]) + 1)[1:-1],
        ])) for i in range(every.shape[1])])
    width = edges.shape[1] + 1
    model = Model(prior, edges, np.zeros((every.shape[1], width)), 0.0)
    flat = np.arange(every.shape[1]) * width
    p, u = _bins(positive, edges) + flat, _bins(unlabelled, edges) + flat
    size = every.shape[1] * width
    theta, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)

    def slope(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        grad = np.bincount(rows.ravel(), np.repeat(weight, rows.shape[1]), size)
        return np.append(grad, weight.sum())

    for step in range(1, steps + 1):
        gp, gu = theta[p].sum(axis=1) + theta[-1], theta[u].sum(axis=1) + theta[-1]
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        bad = su.mean() - prior * sp.mean()
        gradient = slope(p, -prior * sp * (1 - sp) / len(p))
        if bad > 0:
            gradient += slope(u, su * (1 - su) / len(u)) - slope(p, prior * sp * (1 - sp) / len(p))
        gradient[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    model.weights, model.bias = theta[:-1].reshape(-1, width), float(theta[-1])
    return model


def fit(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column,
    prior: float | None = None, positives: int = 20_000, unlabelled: int = 40_000,
) -> Model:
    """Fit on trusted positives and unlabelled texts of the training fold. Runs jobs.

    The prior is the share of good ones among the labelled training rows, unless given.
    """
    if prior is None:
        seen = labels.where(train & F.col(label).isNotNull()).agg(
            F.avg(F.col(label).cast("double")).alias("share"), F.min(label).alias("least")).first()
        known = seen["share"] is not None and seen["least"] < 1
        prior = min(max(seen["share"], 0.02), 0.98) if known else 0.5
    ids = labelled_sample(labels, key, label, 1, train, positives).withColumn("_p", F.lit(True))
    rows = df.where(train).select(F.col(key), F.col(text).alias("_text"))
    share = min(1.0, unlabelled / max(1, df.count()))
    unknown = F.pmod(F.xxhash64(F.col(key), F.lit("unlabelled")), F.lit(1 << 31)) < int(share * (1 << 31))
    chosen = rows.join(F.broadcast(ids), key, "left").select(
        F.col(key).alias("key"), F.coalesce("_p", F.lit(False)).alias("p"), unknown.alias("u"),
        "_text").where("p OR u")

    def work(batches):
        for batch in batches:
            table = np.array([statistics(t) for t in batch.column(3).to_pylist()], dtype=float)
            table = table.reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(list(table), pa.list_(pa.float64()))],
                ["key", "p", "u", "x"])

    kind = df.schema[key].dataType.simpleString()
    measured = chosen.mapInArrow(work, f"key {kind}, p boolean, u boolean, x array<double>")
    got = measured.groupBy("key", "p", "u").agg(F.min("x").alias("x")).toPandas()
    table = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    # The same rows in the same order in every run.
    order = np.lexsort(table.T) if len(table) else slice(0)
    table, p, u = table[order], got["p"].to_numpy(bool)[order], got["u"].to_numpy(bool)[order]
    if not p.any() or not u.any():
        return Model(prior, np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    return minimise(table[p], table[u], prior)


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Rows (key, score, predicted)."""
    def work(batches):
        for batch in batches:
            made = scores(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made), pa.array((made >= 0.5).astype(np.int32))],
                [key, "score", "predicted"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(
        work, f"`{key}` {kind}, score double, predicted int")


def keep_good(df: DataFrame, text: str, model: Model) -> DataFrame:
    """The rows whose text is predicted to be good, with all their columns."""
    at = df.columns.index(text)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), model) >= 0.5))

    return df.mapInArrow(work, df.schema)
