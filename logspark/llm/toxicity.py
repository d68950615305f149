"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, or any other word. Insults
are a small fixed list and what the labelled texts teach: words, and beginnings of words,
that are far commoner in toxic texts. Three transducers read the symbols of a clause and are
composed into one machine: negation turns a denied insult or threat into a weak one, reported
speech into a quoted one, and a target near an insult or a threat into an attack. Every arc
has a weight; the weight of a clause is that of its one path, so the same word counts for
little when denied or quoted and for more when aimed at someone. A text's score is a logistic
curve, fitted to labelled texts, over the summed weight of its matched clauses.

Learning reads at most ``per_class`` labelled texts of each class (smallest hashes, a
parameter), one text for each key. Equal texts count once, and a word must prove itself in different contexts, so
copies of one toxic text do not make all its words toxic. Scoring reads every whole text in
place, without a shuffle.

Nulls and edge cases: a null or empty text has no clause and the lowest score; labels without
a document or with nulls are left out, of several labels the largest counts; without labels
of both classes the fixed words and a fixed curve are used; repeated rows stay; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import labelled_sample

# The closed word lists of the grammar.
INSULTS = ("idiot idiots moron morons stupid loser losers scum trash worthless pathetic "
           "disgusting clown imbecile dumbass bastard").split()
THREATS = "kill hurt destroy murder stab shoot beat smash strangle".split()
TARGETS = "you your yours u he she him her they them tu vous du dich ihr usted vosotros".split()
NEGATIONS = "not no never neither nor nobody pas jamais nicht kein keine nunca ni".split()
REPORTS = "said says say called calls quoted wrote claimed reported dit sagte dijo".split()

WORDS = re.compile(r"[^\W\d_]+").findall
CLAUSES = re.compile(r"[^.!?;\n]+").findall
PREFIXES = (4, 5, 6)  # lengths of learned beginnings of longer words

# Weights of what a path gives out. Symbols: i insult, t threat, y target, n negation,
# r report, w any other word; outputs: d denied, q quoted, a aimed insult, k aimed threat.
OUTPUTS = {"i": 1.0, "a": 1.6, "k": 1.6, "d": 0.3, "q": 0.4, "t": 0.0}


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output); other symbols pass unchanged
    and lead where ``rest`` says."""
    arcs: dict
    rest: dict
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """One machine that does what the first and then the second do, over reachable states."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            one, given = first.step(state[0], symbol)
            two, out = second.step(state[1], given)
            arcs[state, symbol] = ((one, two), out)
            if (one, two) not in seen:
                seen.add((one, two))
                todo.append((one, two))
    return Transducer(arcs, {}, start)


def grammar() -> Transducer:
    """Negation, reported speech and target, composed."""
    near = 3  # words a negation reaches
    deny = Transducer(
        {**{(s, "n"): (near, "n") for s in range(near + 1)},
         **{(s, c): (0, "d") for s in range(1, near + 1) for c in "it"}},
        {s: max(0, s - 1) for s in range(near + 1)})
    quote = Transducer({(0, "r"): (1, "r"), (1, "i"): (1, "q"), (1, "t"): (1, "q")}, {})
    reach = 5  # words between a target and what is aimed at it
    aim = Transducer(
        {**{((s, h), "y"): ((reach, 0), "k" if h else "y")
            for s in range(reach + 1) for h in range(reach + 1)},
         **{((s, h), "i"): ((max(0, s - 1), 0), "a")
            for s in range(1, reach + 1) for h in range(reach + 1)},
         **{((s, h), "t"): ((max(0, s - 1), reach), "t")
            for s in range(reach + 1) for h in range(reach + 1)}},
        {(s, h): (max(0, s - 1), max(0, h - 1)) for s in range(reach + 1) for h in range(reach + 1)},
        (0, 0))
    return compose(compose(deny, quote, "ityrnw"), aim, "ityrnw")


@dataclass
class Model:
    words: dict = field(default_factory=lambda: {w: 1.0 for w in INSULTS})
    prefixes: dict = field(default_factory=dict)
    slope: float = 4.0
    bias: float = -2.0


class Scorer:
    """A model with its machine, made once per worker."""

    def __init__(self, model: Model):
        self.model, self.machine = model, grammar()
        self.fixed = {w: s for words, s in ((REPORTS, "r"), (NEGATIONS, "n"), (TARGETS, "y"), (THREATS, "t")) for w in words}
        self.loud = model.words.keys() | set(THREATS)
        self.starts = model.prefixes.keys()

    def insult(self, word: str) -> float:
        """The learned weight of a word, else of its longest learned beginning."""
        if (weight := self.model.words.get(word)) is not None:
            return weight
        for size in sorted(PREFIXES, reverse=True):
            if len(word) > size and (weight := self.model.prefixes.get(word[:size])) is not None:
                return weight
        return 0.0

    def clause(self, words) -> float:
        state, total = self.machine.start, 0.0
        for word in words:
            weight = self.insult(word)
            symbol = "i" if weight else self.fixed.get(word, "w")
            state, out = self.machine.step(state, symbol)
            # The end of a threat has the weight of one insult.
            total += OUTPUTS.get(out, 0.0) * (weight or 1.0)
        return total

    def weight(self, text: str | None) -> float:
        """The summed weight of the matched clauses of a text."""
        low = (text or "").lower()
        words = set(WORDS(low))
        hits = words & self.loud
        if self.starts:
            for size in PREFIXES:
                beginnings = {w[:size] for w in words if len(w) > size} & self.starts
                hits |= {w for w in words if w[:size] in beginnings} if beginnings else set()
        if not hits:
            return 0.0
        total = 0.0
        for clause in CLAUSES(low):
            own = WORDS(clause)
            if not hits.isdisjoint(own):
                total += self.clause(own)
        return total

    def score(self, weight: float) -> float:
        z = self.model.slope * log(1 + weight) + self.model.bias
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set:
    words = set(WORDS(text.lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def _surprise(a, b, toxic: float, clean: float):
    """Log-likelihood ratio of a term's texts being toxic more often than texts are."""
    share = toxic / (toxic + clean)
    n, p = a + b, a / (a + b)
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-12)), 0.0)
    return 2 * (part(a, p) + part(b, 1 - p) - a * np.log(share) - b * np.log(1 - share))


def fit(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column,
    per_class: int = 10_000, most_terms: int = 20_000, ratio: float = 20.0,
) -> Model:
    """Learn insults and the curve from labelled training texts. Runs jobs.

    What comes back to the driver is at most ``most_terms`` terms and a number per text.
    """
    ids = labelled_sample(labels, key, label, 1, train, per_class).withColumn("toxic", F.lit(1)).unionByName(
        labelled_sample(labels, key, label, 0, train, per_class).withColumn("toxic", F.lit(0)))
    chosen = df.select(key, F.col(text).alias("text")).where(train & F.col("text").isNotNull()).join(
        F.broadcast(ids), key)
    # One text for each key, equal texts once: the sample is bounded, whatever repeats a key.
    single = chosen.groupBy(key).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = single.groupBy(F.sha2("text", 256).alias("h")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model()
    if len(sizes) < 2:
        return model

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                seen[toxic].update(_terms(text))
                if sum(map(len, seen)) > 2_000_000:
                    yield rows(seen)
                    seen = (Counter(), Counter())
        yield rows(seen)

    def rows(seen):
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()),
             pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "a", "b"])

    counted = texts.mapInArrow(count, "term string, a bigint, b bigint").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") + F.col("b")).alias("n"))
    # A term has to be far commoner in toxic texts; how many may pass by chance is small.
    common = (F.col("a") + 0.5) / (sizes[1] + 1.0) >= ratio * (F.col("b") + 0.5) / (sizes[0] + 1.0)
    often = counted.where(common & (F.col("a") >= 4))
    total = counted.where("n >= 4").count()  # terms that could pass
    found = often.orderBy(F.desc("a"), "b", "term").limit(most_terms).toPandas()
    least = 2 * log(max(total, 1)) + 6
    if len(found):
        found = found[_surprise(found["a"].to_numpy(float), found["b"].to_numpy(float), sizes[1], sizes[0]) > least]
    if len(found):
        terms = frozenset(found["term"])

        def contexts(batches):
            seen = set()
            for batch in batches:
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    if not toxic:
                        continue
                    words = ["", *WORDS(text.lower()), ""]
                    for before, word, after in zip(words, words[1:], words[2:]):
                        for term in (word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]):
                            if term in terms:
                                seen.add((term, f"{before} {after}"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in seen], pa.string()), pa.array([s[1] for s in seen], pa.string())],
                ["term", "context"])

        places = texts.mapInArrow(contexts, "term string, context string").distinct().groupBy(
            "term").count().toPandas().set_index("term")["count"]
        found["own"] = np.minimum(found["a"], found["term"].map(places).fillna(0))
        proved = found["own"].to_numpy(float) > 0
        found = found[proved]
        found = found[_surprise(found["own"].to_numpy(float), found["b"].to_numpy(float), sizes[1], sizes[0]) > least]
        for term in found["term"]:
            if term.endswith("*"):
                model.prefixes[term[:-1]] = 1.0
            else:
                model.words[term] = 1.0
        # A beginning stands for its words; a longer one within a shorter one says nothing new.
        model.prefixes = {p: w for p, w in model.prefixes.items()
                          if not any(p[:n] in model.prefixes for n in PREFIXES if n < len(p))}
    curve = _weights(texts, model).toPandas()
    share = labels.where(train & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = min(max(share, 0.001), 0.999)
    y = curve["toxic"].to_numpy(float)
    x = np.log1p(curve["weight"].to_numpy(float))
    order = np.lexsort((y, x))
    model.slope, model.bias = _curve(x[order], y[order], share)
    return model


def _curve(x: np.ndarray, y: np.ndarray, share: float, steps: int = 50) -> tuple[float, float]:
    """Logistic regression with a small ridge, the classes weighted to their true shares."""
    w = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    theta, inputs = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    ridge = np.diag([1e-3, 1e-4]) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(inputs @ theta, -30, 30)))
        gradient = inputs.T @ (w * (p - y)) + ridge @ theta
        hessian = (inputs * (w * p * (1 - p))[:, None]).T @ inputs + ridge
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(theta[0]), float(theta[1])


def _weights(texts: DataFrame, model: Model) -> DataFrame:
    def work(batches):
        scorer = Scorer(model)
        for batch in batches:
            made = [scorer.weight(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.float64())], ["toxic", "weight"])

    return texts.select("text", "toxic").mapInArrow(work, "toxic int, weight double")


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Rows (key, score, predicted, weight of the matched clauses)."""
    def work(batches):
        scorer = Scorer(model)
        for batch in batches:
            weights = [scorer.weight(t) for t in batch.column(1).to_pylist()]
            made = [scorer.score(w) for w in weights]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.float64()),
                 pa.array([int(s >= 0.5) for s in made], pa.int32()), pa.array(weights, pa.float64())],
                [key, "score", "predicted", "clause_weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(
        work, f"`{key}` {kind}, score double, predicted int, clause_weight double")
