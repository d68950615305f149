"""Sequence models over event types and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence
from ..session import scratch_path
from ..sources import models
from . import query
from .inputs import table

L = 5
_RUNS = """runs AS (
  SELECT event_id, CASE WHEN event_id >= 4 THEN list(event_type) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS run
  FROM events
), total AS (SELECT count(run) AS total FROM runs), pat AS (
  SELECT run, count(*) AS seen FROM runs WHERE run IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)"""


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type")


def keyed(spark, sf_dir):
    return sequence.sequence_keys(events(spark, sf_dir), "event_id", "event_type", length=L)


@query("sequence_fit", f"""WITH {_RUNS} SELECT array_to_string(run, '>') AS run, seen,
  (SELECT total FROM total) AS total FROM pat""")
def sequence_fit(spark, sf_dir):
    patterns = sequence.sequence_fit(keyed(spark, sf_dir))
    return patterns.select(F.array_join("run", ">").alias("run"), "seen", "total")


@query("sequence_score", f"""WITH {_RUNS} SELECT event_id, round(CASE WHEN runs.run IS NULL THEN 0::DOUBLE WHEN seen IS NULL THEN 1
  ELSE 1 - seen / (SELECT total FROM total) END, 6) AS sequence_score FROM runs LEFT JOIN pat ON pat.run = runs.run""")
def sequence_score(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    scored = sequence.sequence_score(rows, sequence.sequence_fit(rows))
    return scored.select("event_id", F.round("sequence_score", 6).alias("sequence_score"))


@query("sequence_score_by_conversation", """WITH runs AS (
  SELECT conv_id, turn, row_number() OVER c AS rn, list(role) OVER (c ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run
  FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)
), full_runs AS (SELECT * FROM runs WHERE rn >= 3), pat AS (SELECT run, count(*) AS seen FROM full_runs GROUP BY 1 HAVING count(*) >= 2)
SELECT r.conv_id, r.turn, round(CASE WHEN rn < 3 THEN 0::DOUBLE WHEN seen IS NULL THEN 1
  ELSE 1 - seen / (SELECT count(*) FROM full_runs) END, 6) AS sequence_score
FROM runs r LEFT JOIN pat ON r.rn >= 3 AND pat.run = r.run""")
def sequence_score_by_conversation(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows = sequence.sequence_keys(turns, "turn", "role", by=["conv_id"], length=3)
    scored = sequence.sequence_score(rows, sequence.sequence_fit(rows))
    return scored.select("conv_id", "turn", F.round("sequence_score", 6).alias("sequence_score"))


@query("sequence_stats", f"""WITH {_RUNS} SELECT (SELECT total FROM total) AS total_sequences, count(*) AS unique_sequences,
  min(seen) AS min_frequency, max(seen) AS max_frequency, round(avg(seen), 6) AS avg_frequency,
  round(count(*) / (SELECT total FROM total), 6) AS coverage FROM pat""")
def sequence_stats(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return sequence.sequence_stats(rows, sequence.sequence_fit(rows)).withColumns({
        "avg_frequency": F.round("avg_frequency", 6), "coverage": F.round("coverage", 6)})


@query("build_vocabulary", """
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda x: x <> '')) AS word FROM documents)
SELECT word, count(*) AS seen, row_number() OVER (ORDER BY word) - 1 AS word_index FROM w GROUP BY 1 HAVING count(*) >= 2""")
def build_vocabulary(spark, sf_dir):
    return sequence.build_vocabulary(table(spark, sf_dir, "documents"), "text")


# Messages of two kinds, alike for over fifty characters, whose last word differs by user.
PL, CHARS = 10, 50
_MESSAGE = """concat(CASE WHEN event_type = 'purchase' THEN 'gateway finished the request of a customer in good order for'
  ELSE 'worker reports the usual state of its queue to the log for' END, CASE WHEN user_id % 7 = 0 THEN ' guest' ELSE ' member' END)"""
_PLACES = range(1, PL + 1)
_PATTERN = f"""msg AS (SELECT event_id, {_MESSAGE} AS m FROM events),
said AS (SELECT event_id, unnest(string_split(m, ' ')) AS word, generate_subscripts(string_split(m, ' '), 1) AS pos FROM msg),
voc AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT word FROM said GROUP BY 1 HAVING count(*) >= 2)),
idx AS (SELECT event_id, list(coalesce(i, 0) ORDER BY pos) AS ix FROM said LEFT JOIN voc USING (word) WHERE pos <= {PL} GROUP BY 1),
prow AS (SELECT event_id, CASE WHEN event_id >= {PL - 1} THEN array_to_string(list(substr(m, 1, {CHARS})) OVER o, '|') END AS k,
  flatten(list(ix) OVER o) AS x FROM msg JOIN idx USING (event_id) WINDOW o AS (ORDER BY event_id ROWS BETWEEN {PL - 1} PRECEDING AND CURRENT ROW)),
pfit AS (SELECT k, count(*) AS seen, {', '.join(f'avg(x[{n}]) AS m{n - 1}, stddev_pop(x[{n}]) AS s{n - 1}' for n in _PLACES)}
  FROM prow WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
pscore AS (SELECT event_id, CASE WHEN prow.k IS NULL THEN 0::DOUBLE WHEN seen IS NULL THEN 0.8::DOUBLE ELSE
  tanh(({' + '.join(f'abs(x[{n}] - m{n - 1}) / (s{n - 1} + 1e-8)' for n in _PLACES)}) / {PL} / 2) END AS pattern_score
  FROM prow LEFT JOIN pfit ON pfit.k = prow.k)"""


def messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_MESSAGE).alias("m"))


def pattern_rows(spark, sf_dir):
    made = messages(spark, sf_dir)
    vocabulary = sequence.build_vocabulary(made, "m")
    return sequence.pattern_rows(
        made, "event_id", "m", vocabulary, length=PL, key_chars=CHARS)


@query("pattern_fit", f"""WITH {_PATTERN} SELECT seen, {', '.join(f'round(m{n}, 6) AS m{n}, round(s{n}, 6) AS s{n}' for n in range(PL))} FROM pfit""")
def pattern_fit(spark, sf_dir):
    patterns = sequence.pattern_fit(pattern_rows(spark, sf_dir), PL)
    return patterns.select(
        "seen", *[F.round(F.col("means")[i], 6).alias(f"m{i}") for i in range(PL)],
        *[F.round(F.col("deviations")[i], 6).alias(f"s{i}") for i in range(PL)])


@query("pattern_score", f"WITH {_PATTERN} SELECT event_id, round(pattern_score, 6) AS pattern_score FROM pscore")
def pattern_score(spark, sf_dir):
    rows = pattern_rows(spark, sf_dir)
    scored = sequence.pattern_score(rows, sequence.pattern_fit(rows, PL), PL)
    return scored.select("event_id", F.round("pattern_score", 6).alias("pattern_score"))


_ENSEMBLE = _PATTERN + f""", frun AS (
  SELECT event_id, CASE WHEN event_id >= {PL - 1} THEN array_to_string(list(m) OVER o, '|') END AS k
  FROM msg WINDOW o AS (ORDER BY event_id ROWS BETWEEN {PL - 1} PRECEDING AND CURRENT ROW)
), fpat AS (SELECT k, count(*) AS seen FROM frun WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
fscore AS (SELECT event_id, CASE WHEN frun.k IS NULL THEN 0::DOUBLE WHEN seen IS NULL THEN 1
  ELSE 1 - seen / (SELECT count(k) FROM frun) END AS sequence_score FROM frun LEFT JOIN fpat ON fpat.k = frun.k)"""


_VERDICTS = f"""WITH {_ENSEMBLE} SELECT f.event_id, round(sequence_score, 6) AS sequence_score, round(pattern_score, 6) AS pattern_score,
  round(0.6::DOUBLE * sequence_score + 0.4::DOUBLE * pattern_score, 6) AS ensemble_score,
  CASE WHEN 0.6::DOUBLE * sequence_score + 0.4::DOUBLE * pattern_score > 0.7 THEN 1 ELSE 0 END AS is_anomaly
FROM fscore f JOIN pscore p ON p.event_id = f.event_id"""


def _verdicts(made):
    return made.select("event_id", *[
        F.round(c, 6).alias(c) for c in ("sequence_score", "pattern_score", "ensemble_score")
    ], "is_anomaly")


@query("sequence_ensemble", _VERDICTS)
def sequence_ensemble(spark, sf_dir):
    return _verdicts(sequence.sequence_ensemble(messages(spark, sf_dir), "event_id", "m", length=PL))


@query("save_load_sequence_scores", _VERDICTS)
def save_load_sequence_scores(spark, sf_dir):
    """The verdicts of saved and loaded sequence models."""
    path = scratch_path(spark, "sequence_model")
    models.save_sequence_model(path, sequence.sequence_model(messages(spark, sf_dir), "event_id", "m", length=PL))
    loaded = models.load_sequence_model(spark, path)
    return _verdicts(loaded.score(messages(spark, sf_dir), "event_id", "m"))


@query("model_info", f"""WITH {_ENSEMBLE} SELECT (SELECT count(k) FROM frun) AS total_sequences, count(*) AS unique_sequences,
  min(seen) AS min_frequency, max(seen) AS max_frequency, round(avg(seen), 6) AS avg_frequency,
  round(count(*) / (SELECT count(k) FROM frun), 6) AS coverage, (SELECT count(*) FROM voc) AS vocab_size,
  (SELECT count(*) FROM pfit) AS learned_patterns, {PL} AS sequence_length, 0.6::DOUBLE AS frequency_weight, 0.4::DOUBLE AS pattern_weight
FROM fpat""")
def model_info(spark, sf_dir):
    made = messages(spark, sf_dir)
    rows = sequence.sequence_keys(made, "event_id", "m", length=PL)
    vocabulary = sequence.build_vocabulary(made, "m")
    patterned = sequence.pattern_rows(made, "event_id", "m", vocabulary, length=PL)
    info = sequence.model_info(
        vocabulary, rows, sequence.sequence_fit(rows), sequence.pattern_fit(patterned, PL), PL)
    return info.withColumns({
        "avg_frequency": F.round("avg_frequency", 6), "coverage": F.round("coverage", 6)})
