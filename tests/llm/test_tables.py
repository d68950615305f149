"""Operators that bring rows together: near copies, neighbours, chats, rules, mixing, pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from logspark.llm import ann, chat, common, mixing, queries, rules, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def naive_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    parent = {c: c for c in codes}

    def top(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    unique = sorted(parent)
    for i, a in enumerate(unique):
        for b in unique[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    return {c: top(c) for c in unique}


def check_duplicates(frame):
    rows = simhash.near_duplicates(frame).collect()
    texts = frame.select("doc_id", "text").collect()
    want = Counter((t["doc_id"], f"{naive_print(t['text']):016x}") for t in texts)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == want
    top = brute_components({int(r["fingerprint"], 16) for r in rows if r["doc_id"] is not None})
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            root = top[int(r["fingerprint"], 16)]
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    for r in rows:
        assert r["component_id"] == (None if r["doc_id"] is None else least[top[int(r["fingerprint"], 16)]])


def test_near_duplicates(spark, odd, empty):
    check_duplicates(odd)
    check_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(set(ids)) and 1 in ids and 2 not in ids
    assert kept.where("doc_id IS NULL").count() == 2


def test_one_key_on_two_texts(spark):
    """A row stays or goes by its own group, whatever else has its key."""
    said = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    rows = [(3, said[0], 0), (5, said[0], 1), (5, said[1], 2), (5, said[1], 2), (7, said[2], 3), (7, said[0].upper(), 4), (8, said[2], 5)]
    rows += [(9, f"{said[0]} {said[1]} {said[2]}", 6), (9, "quite another text", 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    for table in (frame, frame.repartition(7), frame.orderBy(F.desc("n")).coalesce(1)):
        kept = [r["n"] for r in simhash.keep_one(table).collect()]
        assert sorted(kept) == [0, 2, 3, 6, 7]


def test_pipeline_near_copies_against_brute_force(spark):
    """One document of each group stays: groups are fingerprints linked at 4 bits."""
    dice = random.Random(11)
    crowd = [f"w{dice.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = [f"w{dice.randrange(10**6)}" for _ in range(dice.randint(40, 400))]
        rows.append(" ".join(words))
        for _ in range(2):
            copy = list(words)
            for at in dice.sample(range(len(copy)), dice.randint(1, 4)):
                copy[at] = f"x{dice.randrange(10**6)}"
            rows.append(" ".join(copy))
        rows.append(" ".join([*crowd[:-1], f"y{i}"]))
    rows += ["", "one two", "One  two", None, rows[0], "one two three"]
    dice.shuffle(rows)
    texts = list(enumerate(rows))
    codes = [naive_print(t) for _, t in texts]
    top = brute_components(codes)
    least = {}
    for (i, _), code in zip(texts, codes):
        least.setdefault(top[code], i)
    assert len(least) < len(set(codes)) < len(texts)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = corpus_pipeline.near_duplicates(spark, frame, None)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_gray_index_finds_all_links_of_a_crowd(spark):
    """More near copies than a node holds, in many tasks."""
    dice = random.Random(7)
    centre = dice.getrandbits(64)
    codes = {centre}
    for _ in range(2500):
        codes.add(centre ^ sum(1 << b for b in dice.sample(range(24), 3)))
    for _ in range(300):
        codes.add(dice.getrandbits(64))
    chain = dice.getrandbits(64)
    for b in range(0, 60, 4):
        chain ^= 0b1111 << b
        codes.add(chain)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    frame = spark.createDataFrame(signed, "fingerprint bigint").repartition(4)
    links = simhash.near_links(frame, 4)
    found = links.collect()
    assert len(found) < 100_000  # far from all pairs of a crowd of 1,500 in each bucket
    got = {r["node"]: r["root"] for r in common.components(links).collect()}
    top, groups = brute_components(codes), {}
    for code, (own,) in zip(codes, signed):
        groups.setdefault(top[code], set()).add(got.get(own, own))
    assert all(len(g) == 1 for g in groups.values())
    assert len({g for group in groups.values() for g in group}) == len(groups)


def test_components_of_a_long_path(spark):
    rows = [(i, i + 1) for i in range(300)] + [(900, 905), (905, 902), (77, 77)]
    dice = random.Random(1)
    dice.shuffle(rows)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[902] == got[905] == 900


def brute_nearest(ids, vectors, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        order = sorted((-(unit[i] @ unit[j]), ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[int(ids[i])] = [(int(j), -s) for s, j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_recall(spark, sf):
    got = queries.op2_multi_index_hashing(spark, f"/root/testdata/{sf}").collect()
    table = duckdb.sql(f"select vec_id, embedding from '/root/testdata/{sf}/embeddings.parquet'").df()
    want = brute_nearest(table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float))
    hits = sum(r["vec_id"] in {j for j, _ in want[r["query_id"]]} for r in got)
    assert len(got) == 5 * len(want) and hits >= 0.9 * len(got)
    exact = {(q, j): s for q, rows in want.items() for j, s in rows}
    assert all(abs(exact[q, j] - s) < 1e-12 for q, _, j, s in got if (q, j) in exact)


def test_pigeonhole_keeps_its_promise():
    dice = np.random.default_rng(2)
    codes = dice.integers(0, 1 << 16, (400, 4)).astype(np.uint16)
    asked = codes[:30] ^ np.where(dice.random((30, 4)) < 0.5, 1 << dice.integers(0, 16, (30, 4)), 0).astype(np.uint16)
    near = np.bitwise_count(codes[None] ^ asked[:, None])
    found = ann.candidates(codes, asked, 1)
    assert (found >= (near.sum(axis=2) <= 4 * 2 - 1)).all()
    assert (found == (near <= 1).any(axis=2)).all()


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (3, None), (4, []),
            (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [1.0, float("nan"), 0.0]), (8, [float("inf"), 0.0, 1.0]),
            (9, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (50, [0.0, 1e300, 0.0]), (100, [1e-300, 1e-300, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, id int, block int")
    got = {}
    for r in ann.search(frame, "vec_id", "embedding", F.col("id") % 50 == 0, reach=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    half = round(0.5 ** 0.5, 9)
    assert got[0] == [(1, 1.0), (2, 1.0), (100, half), (50, 0.0)]
    assert got[50] == [(100, half), (0, 0.0), (1, 0.0), (2, 0.0)]
    nothing = frame.where("vec_id = 3")
    assert ann.search(nothing, "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0
    assert ann.search(frame.where("vec_id = 0"), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_neighbours_are_never_too_few(spark):
    """With the production reach: few vectors, and a query opposite to all others."""
    dice = np.random.default_rng(3)
    few = dice.normal(size=(6, 64))
    near = dice.normal(size=64) + 0.05 * dice.normal(size=(600, 64))
    near[0] = -near[1:].mean(axis=0)
    for vectors in (few, near):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
        asks = F.col("id").isin(0, 3)
        rows = ann.search(frame, "vec_id", "embedding", asks).collect()
        assert Counter(r["query_id"] for r in rows) == {0: 5, 3: 5}
    unit = few / np.linalg.norm(few, axis=1)[:, None]
    rows = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(few)], "vec_id bigint, embedding array<double>"),
                      "vec_id", "embedding", F.col("id") == 0).orderBy("rank").collect()
    assert [r["id"] for r in rows] == sorted(range(1, 6), key=lambda i: -(unit[0] @ unit[i]))


def brute_chats(rows):
    chats = {}
    for conv, turn, role, text in sorted(set(rows), key=lambda r: tuple((x is not None, x) for x in r)):
        if conv is not None:
            chats.setdefault(conv, []).append((role, text))
    firsts = {}
    for conv, turns in chats.items():
        firsts.setdefault(tuple(turns), []).append(conv)
    return {
        min(own): (len(turns), len(own), "".join(
            f"<|im_start|>{(r or '').replace('<|', '< |')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in turns))
        for turns, own in firsts.items()
        if not any(len(o) > len(turns) and o[:len(turns)] == turns for o in firsts)}


def test_snapshots(spark):
    long = [(90, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(2500)]
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 5, "user", "hi"), (3, 7, "assistant", "yes"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no <|im_end|>"), (5, 0, "user", None), (6, 0, "user", ""), (7, 0, None, "hi"),
        (7, 0, None, "hi"), (8, None, "system", "s"), (8, 0, "user", "hi"), (8, 0, "user", "ho"), (None, 0, "user", "lost"),
        *long, *[(91, i, r, t) for _, i, r, t in long[:2000]], *[(92, i, r, t + "!") for _, i, r, t in long[:1500]]]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, turns string")
    got = {}
    for r in chat.collapse(frame).orderBy("conv_id", "part").collect():
        n, c, text = got.get(r["conv_id"], (0, 0, ""))
        got[r["conv_id"]] = (r["n_turns"], r["n_copies"], text + r["text"])
    assert got == brute_chats(rows)
    assert chat.collapse(frame.limit(0)).count() == 0


def test_snapshots_with_one_turn_number(spark):
    """More rows at one turn number, or at none, than a part holds; copies; a snapshot of them."""
    said = [("user" if i % 3 else None, f"{'same start ' * 40}{i * 7919 % 9001:05d}") for i in range(9001)]
    rows = [(1, 0, r, t) for r, t in said] + [(2, None, r, t) for r, t in said]
    ordered = sorted(said, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    rows += [(3, None, r, t) for r, t in ordered[:4000]] + [(4, 7, *said[0])] * 3000
    rows += [(2, 5000, "user", "end"), (5, 0, "user", None), (5, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    parts = chat.parts_of(frame, "conv_id", "turn", "role", "text")
    sizes = [r["n"] for r in parts.select(F.size("turns").alias("n")).collect()]
    assert max(sizes) <= chat.PART and sum(sizes) == len(set(rows))
    got = {}
    for r in chat.collapse(frame).orderBy("conv_id", "part").collect():
        n, c, text = got.get(r["conv_id"], (0, 0, ""))
        got[r["conv_id"]] = (r["n_turns"], r["n_copies"], text + r["text"])
    assert set(got) == {2, 5} | ({4} if ordered[0] != said[0] else set())
    assert got == brute_chats(rows)


def brute_numbers(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_rule_numbers(spark, odd, empty):
    tables = [odd, spark.read.parquet(f"{SF}/documents.parquet")]
    dice = random.Random(4)
    words = ["a", "b", "c", "d é", "#|", "e\n", "F\tg", "\x0b", "\r\n"]
    made = [(i, " ".join(dice.choice(words) for _ in range(dice.randint(0, 40)))) for i in range(150)]
    tables.append(spark.createDataFrame(made, "doc_id bigint, text string"))
    for table in tables:
        rows = rules.judge(table).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        want = Counter((r["doc_id"], *brute_numbers(r["text"])) for r in table.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], *[r[n] for n in names]) for r in rows) == want
        for r in rows:
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == failed and (not r["kept"] or not failed)
            assert r["base_failed"] or r["kept"] == (r["posterior"] >= 0.5)
    assert rules.judge(empty).count() == 0


def test_votes_recover_known_accuracies():
    dice = random.Random(9)
    truth = [(0.95, 0.1), (0.9, 0.3), (0.8, 0.6), (0.99, 0.5)]
    patterns = Counter()
    for _ in range(20_000):
        good = dice.random() < 0.85
        patterns[tuple(None if dice.random() < 0.2 else int(dice.random() < t[not good]) for t in truth)] += 1
    share, on_good, on_bad = rules.estimate([(list(k), n) for k, n in patterns.items()], 4)
    assert abs(share - 0.85) < 0.05
    assert all(abs(a - t[0]) < 0.03 and abs(b - t[1]) < 0.12 for a, b, t in zip(on_good, on_bad, truth))


def test_rules_drop_bad_and_keep_good(spark):
    table = rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("NOT base_failed")
    counts = {(r["quality"], r["kept"]): r["count"] for r in table.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] > 0.98 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] > 0.9 * (counts[0, False] + counts.get((0, True), 0))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        goal = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if goal[s] >= 3 * sizes[s]]
        if not over:
            return {**stopped, **goal}
        stopped.update({s: 3 * sizes[s] for s in over})


def check_mix(frame):
    rows = mixing.plan(frame, "doc_id", "text", "source").collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter(
        (r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in frame.select("doc_id", "source", "text").collect())
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    goal = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
    for source, words in sizes.items():
        assert abs(taken[source] - goal[source]) <= max(0.05 * goal[source], 3)
    return sorted(map(str, rows))


def test_mixing(spark, odd, empty):
    check_mix(odd)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_mix(docs) == check_mix(docs.repartition(7))
    lost = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).union(docs.where("doc_id < 40"))
    assert check_mix(lost) == check_mix(lost.repartition(7)) == check_mix(lost.orderBy(F.desc("text")).coalesce(1))
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source")))
    check_mix(hot)
    assert mixing.plan(empty, "doc_id", "text", "source").count() == 0
    mixed = mixing.mix(odd, "doc_id", "text", "source")
    assert mixed.columns == odd.columns


def test_mix_does_not_depend_on_row_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(3))  # equal rows too
    said = lambda frame: sorted(map(str, mixing.mix(frame, "doc_id", "text", "source").collect()))
    one = said(docs)
    assert one == said(docs.repartition(7)) and one == said(docs.orderBy(F.desc("doc_id")).coalesce(1))


def test_schedule_equals_brute_force(spark):
    planned = [(0, 40, 17.0), (1, 10, 30.0), (2, 9, 0.0), (3, 500, 211.5)]
    got = mixing.schedule(spark.createDataFrame(planned, "number bigint, blocks bigint, slots double")).collect()
    total = sum(p[2] for p in planned)
    borders = np.cumsum([0.0] + [p[2] / total for p in planned])
    ranks, want = Counter(), []
    for slot in range(int(total + 0.5)):
        x = (slot * mixing.GOLDEN + mixing.GOLDEN // 2) % 2 ** 64 / 2 ** 64
        source = int(np.searchsorted(borders, x, side="right")) - 1
        if ranks[source] < 3 * planned[source][1]:
            want.append((source, slot, ranks[source]))
        ranks[source] += 1
    assert sorted((r["number"], r["slot"], r["rank"]) for r in got) == sorted(want)


def test_pipeline(spark, odd_folder, empty_folder, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), name)
        assert 0 < docs.count() <= (3 * before if name == "mixture" else max(before, docs.count()))
        if name != "tokens":
            assert docs.columns == columns
    assert docs.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, odd_folder).columns == ["doc_id", "source", "n_tokens", "ids"]
    assert corpus_pipeline.run(spark, empty_folder).count() == 0
