"""The corpus pipeline: documents in, token ids of the final mix out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. Each stage works on all its predecessor kept; the result is written as Parquet
and read again as the next one's docs.

* quality: documents the positive-unlabelled classifier rejects go (learned from labels of
  the training fold and the texts at hand);
* near_duplicates: one document of each group of near copies stays, that of the smallest id;
  fingerprints of four-word shingles link at 4 or fewer differing bits;
* secrets: what the forest takes for a secret is masked in the text, n_chars follows;
* mixture: each document as often as the target weights of the sources ask for;
* tokens: the byte-level BPE ids of each text, and whether decoding them gives it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from logspark.llm import bpe, mixing, quality, secrets, simhash
from logspark.llm.common import fold, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark, docs, sf_dir):
    model = quality.fit(
        docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", fold("doc_id", 3) != 1)
    return quality.keep_good(docs, "text", model)


def near_duplicates(spark, docs, sf_dir):
    return simhash.keep_one(docs, "doc_id", "text", width=4, distance=4)


def without_secrets(spark, docs, sf_dir):
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.redact(docs, "text", model, size="n_chars")


def mixture(spark, docs, sf_dir):
    return mixing.mix(docs, "doc_id", "text", "source")


def tokens(spark, docs, sf_dir):
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.encode(docs.select("doc_id", "source", "text"), "text", path, pattern, back="round_trip")
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]
# Classifiers, fingerprints, forests and merges have no SQL; brute-force tests cover them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the documents, each written and read again.

    The last stage's flags are read here: texts that decoding does not give back are an error.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    lost = docs.where("NOT round_trip").count()
    if lost:
        raise ValueError(f"decoding does not give back {lost} texts")
    return docs.drop("round_trip")
