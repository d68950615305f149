"""Sharding, hard negatives and source divergence against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import md5

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import divergence, negatives, queries, sharding


def sql_rows(query, **tables):
    with duckdb.connect() as db:
        for name, frame in tables.items():
            db.register(name, frame.toArrow())
        return Counter(db.execute(queries.ORACLES[query]).fetchall())


def draws(key, count):
    said = "null" if key is None else f"k{key}"
    return [int(md5(f"{said}/{i // 4}".encode()).hexdigest()[8 * (i % 4):8 * (i % 4) + 8], 16) for i in range(count)]


def brute_shard(key, weights):
    scores = [math.log((d + 0.5) / 2 ** 32) / w for d, w in zip(draws(key, len(weights)), weights)]
    return max(range(len(weights)), key=lambda i: (scores[i], -i))


@pytest.mark.parametrize("weights,grown", [([1.0] * 24, 1.0), ([2.0, 1.0, 0.5], 1.5), ([3.0], None)])
def test_shards(spark, odd, weights, grown):
    rows = sharding.assign(odd, "doc_id", "text", weights, grown).collect()
    said = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                   for r in odd.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == said
    slots = {}
    for r in rows:
        assert r["law"] == "key" and r["shard"] == brute_shard(r["doc_id"], weights)
        after = None if grown is None else brute_shard(r["doc_id"], [*weights, grown])
        assert r["grown_shard"] == after and after in (None, r["shard"], len(weights))
        slots.setdefault(r["shard"], []).append(
            (r["slot"], (r["doc_id"] is None, r["doc_id"] or 0), r["size"], r["text_crc32"]))
    for own in slots.values():
        own.sort()
        assert [o[0] for o in own] == list(range(len(own)))
        assert [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_shards_follow_their_weights_and_a_hot_key_is_cut(spark, empty, tmp_path):
    keys = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = Counter(r["shard"] for r in sharding.assign(keys, "doc_id", "text", [2.0, 1.0, 1.0]).collect())
    assert abs(counts[0] - 15_000) < 500 and abs(counts[1] - 7_500) < 400
    hot = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign(hot, "doc_id", "text", [1.0] * 24, 1.0).collect()
    assert {(r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] == 7} == {
        (brute_shard(7, [1.0] * 24), brute_shard(7, [1.0] * 25))}
    for shard in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.assign(empty, "doc_id", "text", [1.0]).count() == 0
    sharding.write_shards(hot, "doc_id", [1.0, 1.0, 1.0], str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in hot.collect())
    assert all(r["shard"] == brute_shard(r["doc_id"], [1.0] * 3) for r in back.collect())
    with pytest.raises(ValueError):
        sharding.assign(hot, "doc_id", "text", [1.0, 0.0])


def test_shards_equal_sql(spark, odd, odd_folder):
    got = queries.op11_rendezvous_sharding(spark, odd_folder)
    assert Counter(map(tuple, got.collect())) == sql_rows("op11_rendezvous_sharding", documents=odd.select("doc_id", "text"))


def brute_negatives(rows, k=5, n=5):
    """rows of (id, label, vector of whole numbers)."""
    out = Counter()
    for a, label, v in sorted({(i, l, tuple(x)) for i, l, x in rows if i % 100 == 0}):
        scored = sorted((-sum(p * q for p, q in zip(v, x)), i, l) for i, l, x in rows if i != a and len(x) == len(v))
        for ps, p in [(-s, i) for s, i, l in scored if l == label][:k]:
            fits = [(-s, i) for s, i, l in scored if l != label and 80 * ps <= -100 * s <= 100 * ps][:n]
            out.update((a, p, rank, i, ps, s) for rank, (s, i) in enumerate(fits, 1))
    return out


ODD_VECTORS = [
    (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1),
    (5, [1.0, 1.0], None), (8, [1.0], 1), (10, [], 2), (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [0.0, 1.0], 2),
    (200, [], 2), (11, [1.0, 0.5], 1), (12, [0.9, 0.5], 2), (12, [0.9, 0.5], 2), (13, [0.9, -0.5], 2), (14, [-1.0, 0.0], 1),
    (15, [-0.9, 0.0], 2), (300, [0.0, 0.0], 3), (16, [0.0, 0.0], 3), (17, [2.0, 0.0], 3), (400, [-0.5, -1.0], 4), (18, [0.5, 0.0], 4)]


@pytest.mark.parametrize("tile", [8, 1 << 21])
def test_negatives(spark, monkeypatch, tile):
    """Small tiles and blocks, ties, repeated rows, vectors that take no part."""
    dice = random.Random(5)
    rows = [(i, [dice.choice([0.0, 0.1, 0.2, 0.4, -0.1]) for _ in range(6)], dice.randrange(3)) for i in range(700)]
    rows += [(i, [0.3] * 6, 1) for i in range(700, 760)] + ODD_VECTORS
    whole = [(i, l, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, l in rows
             if i is not None and l is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "BLOCK", 300 if tile == 8 else 1 << 24)
    frame = spark.createDataFrame([(*r, 1.0, "x", 2) for r in rows],
                                  "vec_id bigint, embedding array<float>, label int, score double, anchor string, id int")
    got = negatives.mine(negatives.prepare(frame.repartition(5), "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(whole)
    if tile != 8:
        none = negatives.mine(negatives.prepare(frame.limit(0), "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0)
        assert none.count() == 0 and none.columns == got.columns


def test_negatives_with_large_numbers(spark):
    rows = [(100 * i, [3.0e5 + i, -6.0e4 * i], i % 2) for i in range(1, 9)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = [(i, l, [math.floor(256 * c) for c in x]) for i, x, l in rows]
    mined = lambda f: negatives.mine(negatives.prepare(f, "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0)
    assert Counter(map(tuple, mined(frame).collect())) == brute_negatives(whole)
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [1e12], 1)], frame.schema))


def brute_divergence(rows, least=3, top=200):
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", Counter(term.findall((text or "").translate(lower)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]
        counts = {d[1]: Counter() for d in docs if d[0] == lang}
        for own, source, found in docs:
            if own == lang:
                counts[source].update({t: n for t, n in found.items() if seen[t] >= least})

        def shares(count):
            total = sum(count.values()) + len(kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // total for t in kept}

        whole = shares(sum(counts.values(), Counter()))
        own = {source: shares(count) for source, count in counts.items()}
        apart = lambda p, q: (p - q) ** 2 // q
        for source, p in own.items():
            pairs = [(-sum(apart(p[t], q[t]) for t in kept), o) for o, q in own.items() if o != source]
            terms = [(-apart(p[t], whole[t]), t) for t in kept if counts[source][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda f: (f[0], f[1].encode()))[:most]
                out += [(lang, source, part, item, -value, i) for i, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, odd, monkeypatch, small):
    if small:  # many stretches of terms, counts sent out often: workers see patched values
        monkeypatch.setattr(divergence, "POSTINGS", 7)
        monkeypatch.setattr(divergence, "ENTRIES", 5)
    dice = random.Random(3)
    words = [f"{a}{b}" for a in "abcdeé日" for b in "ABCDß"] + ["x1y", "z_z", "q-q"]
    rows = [(" ".join(dice.choice(words[: 5 + 3 * (i % 9)]) for _ in range(dice.randrange(30))), dice.choice(["en", "de", None]),
             dice.choice(["a", "b", "é", "z", None, "A"])) for i in range(150)]
    rows += [("rare", "xx", "a"), ("rarer", "xx", "b"), (None, "yy", "a")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, value int, term string")
    for table in (frame.repartition(4), odd):
        want = brute_divergence([tuple(r) for r in table.select("text", "lang", "source").collect()])
        got = divergence.audit(table)
        assert Counter(map(tuple, got.collect())) == want
    assert divergence.audit(frame.limit(0)).count() == 0


def test_divergence_equals_sql(spark, odd, odd_folder):
    got = queries.op13_source_divergence(spark, odd_folder).collect()
    assert Counter(map(tuple, got)) == sql_rows("op13_source_divergence", documents=odd.select("text", "lang", "source"))
