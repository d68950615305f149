"""Properties of the seeded models, and exact searches against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logspark.functions.confidence import ml_confidence
from logspark.operators import forest, grid, neighbours, oneclass, sequence, tfidf
from logspark.plans import scoring
from logspark.session import scratch_path
from logspark.sources import models


def cloud(spark, n=400, size=6, seed=0, copies=0):
    chance = np.random.default_rng(seed)
    points = chance.normal(size=(n, size))
    points[:5] += 12  # planted outliers
    if copies:
        points[n - copies:] = points[10]
    frame = pd.DataFrame({"key": np.arange(n), "vector": [list(map(float, p)) for p in points]})
    return spark.createDataFrame(frame, "key bigint, vector array<double>").cache(), points


def test_forest_is_repeatable_and_finds_outliers(spark):
    rows, _ = cloud(spark)
    made = forest.isolation_forest_fit(rows, "key", 6, trees=60, contamination=0.05)
    again = forest.isolation_forest_fit(rows, "key", 6, trees=60, contamination=0.05)
    a = forest.isolation_forest_score(rows, "key", made).orderBy("key").toPandas()
    b = forest.isolation_forest_score(rows, "key", again).orderBy("key").toPandas()
    assert np.array_equal(a["score"], b["score"])
    assert set(a.nsmallest(5, "score")["key"]) == set(range(5))
    assert abs(a["flagged"].sum() - 0.05 * len(a)) <= 1
    path = scratch_path(spark, "forest")
    made.save(path)
    loaded = forest.Forest.load(spark, path)
    c = forest.isolation_forest_score(rows, "key", loaded).orderBy("key").toPandas()
    assert np.array_equal(a["score"], c["score"])
    nodes = made.nodes.toPandas()
    leaves = nodes[nodes["left"] < 0]
    assert leaves["path"].max() <= 9 + float(forest.average_path(256))


def test_offset_scores_every_row_once(spark):
    rows, _ = cloud(spark)
    scored = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scored.add(len(batch))
            yield batch

    made = forest.isolation_forest_fit(rows, "key", 6, trees=10, contamination=None)
    watched = rows.mapInPandas(seen, rows.schema)
    forest._with_offset(made, watched, "key", 0.1)
    assert scored.value == 400


def test_share_forests_grow_without_a_cap(spark, monkeypatch):
    """Trees on a share of the rows: whole, repeatable (also from sparse rows), and different
    shares differ."""
    monkeypatch.setattr(forest, "GROUP_ROWS", 100)
    monkeypatch.setattr(forest.levels, "BATCH_BYTES", 120_000)  # two batches of trees
    rows, points = cloud(spark, n=600, copies=200)
    sparse = rows.select("key", F.sequence(F.lit(0), F.lit(5)).alias("positions"), F.col("vector").alias("values"))
    fit = lambda table, share: forest.isolation_forest_fit(table, "key", 6, trees=6, sample=share, contamination=None)
    made, again, other = fit(rows, 0.8), fit(sparse, 0.8), fit(rows.where("key % 2 = 0"), 0.6)
    assert made.sample == 480 and other.sample == 180
    monkeypatch.setattr(forest.levels, "BATCH_BYTES", 20_000)  # several passes
    assert len(forest._batches(made, 6)) > 1
    made = forest._with_offset(made, rows, "key", 0.05)
    order = ["tree", "node"]
    nodes = made.nodes.toPandas().sort_values(order).reset_index(drop=True)
    assert nodes.equals(again.nodes.toPandas().sort_values(order).reset_index(drop=True))
    assert len(nodes) > 1.5 * other.nodes.count()
    scored = forest.isolation_forest_score(rows, "key", made).toPandas()
    assert set(scored.nsmallest(5, "score")["key"]) == set(range(5))
    assert scored[scored["key"] >= 400]["score"].nunique() == 1  # copies are one leaf
    assert abs(scored["flagged"].sum() - 0.05 * len(scored)) <= 1
    for tree, table in nodes.groupby("tree"):
        table = table.set_index("node")
        assert sorted(table.index) == list(range(len(table)))
        inner = table[table["feature"] >= 0]
        assert sorted([*inner["left"], *inner["right"], 0]) == list(range(len(table)))
        # Every row's way ends in a leaf, and the path lengths give the score.
        at = np.zeros(len(points), int)
        for _ in range(9):
            here = table.loc[at]
            split = (here["feature"] >= 0).to_numpy()
            go_left = points[np.arange(len(points)), np.maximum(here["feature"], 0)] <= here["threshold"].to_numpy()
            at = np.where(split, np.where(go_left, here["left"], here["right"]), at)
        assert (table.loc[at, "feature"] < 0).all()
        want = table.loc[at, "path"].to_numpy() if tree == 0 else want + table.loc[at, "path"].to_numpy()
    score = -np.power(2.0, -(want / 6) / float(forest.average_path(480))) - made.offset
    assert np.allclose(scored.sort_values("key")["score"], score)


def test_share_forests_take_levels_together(spark, monkeypatch):
    """The passes over the rows do not grow with the number of trees, and a leaf's path is
    that of the rows in it, also where a subtree was grown in a task."""
    monkeypatch.setattr(forest, "GROUP_ROWS", 100)
    monkeypatch.setattr(forest.levels, "BATCH_BYTES", 1 << 20)
    written, write = [], forest.levels._written
    monkeypatch.setattr(forest.levels, "_written", lambda df, name: written.append(name) or write(df, name))
    rows, points = cloud(spark, n=600, copies=200)
    made = forest.isolation_forest_fit(rows, "key", 6, trees=40, sample=0.8, contamination=None)
    assert written.count("tree-rows") <= 20 and written.count("subtrees") == 1
    cut = int(0.8 * (1 << 30)) + 1
    inside = np.stack(rows.orderBy("key").select(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda t: F.pmod(
        F.xxhash64(F.lit(42), t, F.col("key")), F.lit(1 << 30)) < cut).alias("i")).toPandas()["i"])
    for tree, table in made.nodes.where("tree < 4").toPandas().groupby("tree"):
        table = table.sort_values("node").reset_index(drop=True)
        at, depth = np.zeros(600, int), np.zeros(600, int)
        for _ in range(9):
            here = table.loc[at]
            split = (here["feature"] >= 0).to_numpy()
            left = points[np.arange(600), np.maximum(here["feature"], 0)] <= here["threshold"].to_numpy()
            at, depth = np.where(split, np.where(left, here["left"], here["right"]), at), depth + split
        held = np.bincount(at[inside[:, tree]], minlength=len(table))
        assert np.allclose(table.loc[at, "path"], depth + forest.average_path(held[at]))


def test_sparse_and_dense_rows_score_alike(spark):
    rows, _ = cloud(spark)
    made = forest.isolation_forest_fit(rows, "key", 6, trees=20)
    sparse = rows.select("key", F.sequence(F.lit(0), F.lit(5)).alias("positions"), F.col("vector").alias("values"))
    a = forest.isolation_forest_score(rows, "key", made).orderBy("key").toPandas()
    b = forest.isolation_forest_score(sparse, "key", made).orderBy("key").toPandas()
    assert np.allclose(a["score"], b["score"])


@pytest.mark.parametrize("pivots,chunk", [(1, 1024), (7, 16), (40, 64)])
def test_nearest_equals_brute_force(spark, pivots, chunk):
    rows, points = cloud(spark, n=300, copies=90)
    distinct = neighbours.distinct_points(rows, "key", "vector")
    found = neighbours.nearest(distinct, distinct, 8, exclude_self=True, pivots=pivots, chunk=chunk)
    got = found.groupBy("rep").agg(
        F.max("distance").alias("far"), F.sum("used").alias("n")).toPandas().set_index("rep")
    assert (got["n"] == 8).all()
    away = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(away, np.inf)
    want = np.sort(away, axis=1)[:, 7]
    for rep, row in got.iterrows():
        assert abs(row["far"] - want[int(rep)]) < 1e-9


def test_nearest_in_blocks_moves_no_vector_per_cell(spark, monkeypatch):
    """Several blocks, a cell cut over some of them, keys that are null: as brute force; and the
    plan has no join of queries with the cells they visit."""
    rows, points = cloud(spark, n=300, copies=90)
    rows = rows.withColumn("key", F.when(F.col("key") != 7, F.col("key")))
    distinct = neighbours.distinct_points(rows, "key", "vector")
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 6 * 25)
    found = neighbours.nearest(distinct, distinct, 8, pivots=3, chunk=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan
    got = found.groupBy("rep").agg(F.max("distance").alias("far"), F.sum("used").alias("n")).collect()
    away = np.sort(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), axis=1)[:, 7]
    far = {r["rep"]: r["far"] for r in got}
    assert len(got) == 210 and all(r["n"] == 8 for r in got)
    assert all(abs(far[rep] - away[7 if rep is None else rep]) < 1e-9 for rep in far)


def test_lof_with_copies_equals_brute_force(spark):
    rows, points = cloud(spark, n=200, copies=6)
    distinct = neighbours.distinct_points(rows, "key", "vector")
    fitted = neighbours.lof_fit(distinct, 10).select("rep", "factor")
    got = neighbours.back_to_rows(rows, "key", "vector", distinct, fitted).orderBy("key").toPandas()
    away = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(away, np.inf)
    near = np.argsort(away, axis=1, kind="stable")[:, :10]
    k_distance = np.take_along_axis(away, near[:, -1:], 1)[:, 0]
    reach = np.maximum(np.take_along_axis(away, near, 1), k_distance[near])
    density = 1 / (reach.mean(1) + 1e-10)
    assert np.allclose(got["factor"], density[near].mean(1) / density, rtol=1e-6)


def test_svd_reconstructs(spark):
    chance = np.random.default_rng(2)
    matrix = chance.normal(size=(120, 4)) @ chance.normal(size=(4, 30))
    rows = spark.createDataFrame(pd.DataFrame({
        "key": np.arange(120), "positions": [list(range(30))] * 120, "values": [list(r) for r in matrix],
    }), "key bigint, positions array<int>, values array<double>")
    components, values = tfidf.svd_components(rows, 30, 4)
    assert np.all(np.diff(values) <= 1e-9)
    assert np.allclose(values, np.linalg.svd(matrix)[1][:4])
    assert np.allclose(matrix @ components @ components.T, matrix)


def test_singular_values_of_a_wide_spread(spark):
    """To 1e-6 of the largest exact value each, over seven orders of size, in sparse rows."""
    chance = np.random.default_rng(3)
    left, right = np.linalg.qr(chance.normal(size=(300, 12)))[0], np.linalg.qr(chance.normal(size=(40, 12)))[0]
    matrix = left * np.logspace(0, -7, 12) @ right.T
    matrix[::7] = 0  # texts without terms
    rows = spark.createDataFrame(
        [(i, [j for j in range(40) if r[j]], [float(x) for x in r if x]) for i, r in enumerate(matrix)],
        "key bigint, positions array<int>, values array<double>").repartition(7)
    components, values = tfidf.svd_components(rows, 40, 12)
    want = np.linalg.svd(matrix)[1][:12]
    assert np.allclose(values, want, rtol=1e-6)
    got = {r["key"]: r["features"] for r in tfidf.project(rows, "key", components).collect()}
    assert np.allclose([got[i] for i in range(300)], matrix @ components)
    none, zero = tfidf.svd_components(rows.limit(0), 40, 3)
    assert none.shape == (40, 3) and not zero.any()


def test_svd_moves_no_more_with_more_partitions(spark):
    """A pass sends one part per core and term, not one per partition and term."""
    rows = spark.createDataFrame(
        [(i, [i % 7, 7 + i % 5], [1.0 + i % 3, 0.5 * (i % 4)]) for i in range(400)],
        "id bigint, positions array<int>, values array<double>")
    sent = []
    basis = np.eye(12, 3)
    original = type(rows).mapInPandas

    def watched(frame, *args, **options):
        made = original(frame, *args, **options)
        sent.append(made.rdd.getNumPartitions())
        return made

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "mapInPandas", watched)
        few, many = (tfidf._gram_times(rows.repartition(n), basis) for n in (2, 50))
    assert sent == [2, spark.sparkContext.defaultParallelism]
    assert np.allclose(few, many)


def test_one_class_prefers_the_crowd(spark):
    rows, _ = cloud(spark)
    model = oneclass.one_class_fit(rows, "key", "vector", nus=(0.1,), gammas=("scale",), kernels=("rbf",))
    got = oneclass.one_class_margins(rows, "key", "vector", model).toPandas()
    assert set(got.nsmallest(5, "margin")["key"]) == set(range(5))


def test_one_class_stops_by_its_gap_and_flags_nu(spark):
    """Combinations converge, and rows that were not fitted are flagged at the rate nu."""
    chance = np.random.default_rng(5)
    points = np.concatenate([chance.normal(size=(24_000, 3)), chance.normal(size=(16_000, 3)) * 0.4 + 4])
    chance.shuffle(points)
    rows = spark.createDataFrame(
        pd.DataFrame({"key": np.arange(len(points)), "vector": list(points)})).repartition(5).cache()
    fitted = rows.where("key % 2 = 0")
    model = oneclass.one_class_fit(fitted, "key", "vector", gammas=("scale", 0.1))
    assert model.converged.all() and model.passes < 60 and (model.gap <= 1e-3).all()
    got = oneclass.one_class_margins(rows.where("key % 2 = 1"), "key", "vector", model)
    share = {r["model"]: r["share"] for r in got.groupBy("model").agg(F.avg("pred").alias("share")).collect()}
    for name, _, _, nu in model.configs:
        assert abs(share[name] - nu) <= 0.01, (name, share[name])
    stopped = oneclass.one_class_fit(fitted, "key", "vector", nus=(0.1,), steps=2)
    assert not stopped.converged.all() and stopped.passes == 2


def test_one_class_reaches_the_least_objective(spark):
    """Against a long subgradient descent on the same features."""
    rows, _ = cloud(spark, n=300)
    model = oneclass.one_class_fit(rows, "key", "vector", nus=(0.1,), gammas=("scale",), kernels=("rbf",), landmarks=20)
    x = np.stack(rows.toPandas()["vector"].to_numpy()).astype(float)
    phi = oneclass._features(x, model)[("rbf", "scale")]

    def objective(w):
        margins = np.sort(phi @ w)
        level = margins[int(np.ceil(0.1 * len(x))) - 1]
        return w @ w / 2 - level + np.maximum(0, level - margins).mean() / 0.1

    w = phi.mean(0)
    least = objective(w)
    for step in range(20_000):
        worst = np.argsort(phi @ w)[:int(np.ceil(0.1 * len(x)))]
        w = w - (w - phi[worst].mean(0)) / (step + 2)
        least = min(least, objective(w))
    assert objective(model.weights[0]) <= least + 1e-3 * abs(least)


def test_grid_shapes_and_rates(spark):
    rows, _ = cloud(spark, n=150)
    made = grid.model_grid(rows, "key", "vector", trees=(10, 20), ks=(5,), landmarks=16, steps=3)
    scores = grid.score_grid(rows, made, "vector", trees=(10, 20)).toPandas()
    assert scores["model"].nunique() == 3 * 2 * 3 + 3 + 24
    forests = scores[scores["family"] == "IsolationForest"]
    share = forests.groupby("model")["pred"].mean()
    for name, value in share.items():
        rate = float(name.split("cont_")[1].split("_")[0])
        assert abs(value - rate) <= 1.5 / 150
    # Saved and loaded, over the first save: the same verdicts for rows it was not fitted on.
    path = scratch_path(spark, "grid")
    models.save_grid(path, made)
    models.save_grid(path, made)
    loaded = models.load_grid(spark, path)
    assert list(loaded.forests) == list(made.forests) and list(loaded.references) == [5]
    assert loaded.one_class.configs == made.one_class.configs
    assert np.array_equal(loaded.one_class.converged, made.one_class.converged)
    fresh, _ = cloud(spark, n=60, seed=3)
    judged = [
        grid.score_grid(fresh, m, "vector", trees=(10, 20)).orderBy("key", "model").toPandas() for m in (made, loaded)]
    assert len(judged[0]) == 60 * 45
    assert np.allclose(judged[0]["score"], judged[1]["score"], atol=1e-9) and judged[0]["pred"].equals(judged[1]["pred"])


def test_saved_svd_and_scaler(spark):
    rows = spark.createDataFrame(
        [(i, [i % 7, 7 + i % 5], [1.0 + i % 3, 0.5 * (i % 4)]) for i in range(80)],
        "id bigint, positions array<int>, values array<double>")
    components, values = tfidf.svd_components(rows, 12, 4)
    made = tfidf.project(rows, "id", components)
    path = scratch_path(spark, "svd")
    models.save_svd(spark, path, components, values, tfidf.scaler_fit(made, "features"))
    loaded, found, scaler = models.load_svd(spark, path)
    assert np.array_equal(loaded, components) and np.array_equal(found, values)
    a = tfidf.standardize(made, "features").orderBy("id").toPandas()
    b = tfidf.scale(tfidf.project(rows, "id", loaded), "features", scaler).orderBy("id").toPandas()
    assert np.allclose(np.stack(a["features"]), np.stack(b["features"]), atol=1e-9)


def test_saved_sequence_models_score_other_logs(spark):
    learned = spark.createDataFrame(list(enumerate(["a x", "b y", "c z"] * 6)), "at bigint, m string")
    other = spark.createDataFrame(list(enumerate(["a x", "b y", "c z", "a x", "new", None])), "at bigint, m string")
    path = scratch_path(spark, "sequences")
    models.save_sequence_model(path, sequence.sequence_model(learned, "at", "m", length=3))
    loaded = models.load_sequence_model(spark, path)
    got = [tuple(r) for r in loaded.score(other, "at", "m").orderBy("at").collect()]
    want = [tuple(r) for r in sequence.sequence_ensemble(other, "at", "m", length=3, fit_on=learned).orderBy("at").collect()]
    assert got == want and got[4][2] == 1.0 and got[2][2] < 1.0


def test_sequence_models_on_a_small_log(spark):
    messages = ["a x", "b y", "c z"] * 5 + ["odd"]
    rows = spark.createDataFrame(list(enumerate(messages)), "at bigint, m string")
    made = sequence.sequence_ensemble(rows, "at", "m", length=3).orderBy("at").toPandas()
    assert (made["sequence_score"][:2] == 0).all()
    assert made["sequence_score"].iloc[-1] == 1.0 and made["pattern_score"].iloc[-1] == 0.8
    assert abs(made["sequence_score"][2] - (1 - 5 / 14)) < 1e-9
    assert made["is_anomaly"].iloc[-1] == 1


def test_verdicts_in_the_row_equal_scored_vectors(spark, monkeypatch):
    """Equal texts, texts without known terms, nulls, and a memory that is cleared."""
    said = ["disk error on node seven", "login failed for root", "user root logged in", "fatal disk failure", "", "the of", None, "zebra"]
    texts = spark.createDataFrame([(i, said[i % len(said)], "x") for i in range(200)], "id bigint, text string, other string")
    model = scoring.fit_text_model(texts.where("text IS NOT NULL"), "id", "text", 50, 20)
    vectors = scoring.text_vectors(texts, "id", "text", model.vocabulary, 50)
    want = {r["id"]: r for r in forest.isolation_forest_score(vectors, "id", model.forest).join(texts, "id").select(
        "id", *[c.alias(n) for n, c in ml_confidence(F.col("score"), F.col("flagged"), F.col("empty"), F.col("text")).items()]).collect()}
    for most in (100_000, 2):
        monkeypatch.setattr(scoring, "REMEMBERED", most)
        got = scoring.score_texts(texts.repartition(3), "text", model, "id")
        assert got.columns == ["id", "text", "other", "ml_prediction", "confidence"]
        assert "Join" not in got._jdf.queryExecution().toString()
        for r in got.collect():
            verdict = (r["ml_prediction"], r["confidence"])
            assert verdict == ((None, None) if r["text"] is None else (want[r["id"]]["ml_prediction"], want[r["id"]]["confidence"]))
    assert scoring.score_texts(texts.limit(0), "text", model, "id").count() == 0


def test_long_texts_are_weighed_a_few_at_a_time(spark, monkeypatch):
    """Long texts in one batch: no more words together than allowed, and the same verdicts."""
    said = [" ".join(f"w{(i * j) % 97}x" for j in range(200)) for i in range(120)]
    texts = spark.createDataFrame(list(enumerate(said)), "id bigint, text string")
    model = scoring.fit_text_model(texts, "id", "text", 50, 20)
    made = []
    original = type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda df, f, *a, **k: made.append((df, f)) or original(df, f, *a, **k))
    scoring.score_texts(texts, "text", model, "id")
    frame, score = made[-1]
    batch = frame.toArrow().combine_chunks().to_batches()[0]
    want = [r for part in score([batch]) for r in part.to_pylist()]
    together = []
    weigh = tfidf.Weigher.weigh
    monkeypatch.setattr(tfidf, "WORDS", 1000)
    monkeypatch.setattr(scoring, "HELD", 2000)
    monkeypatch.setattr(tfidf.Weigher, "weigh", lambda self, lists: together.append(len(lists.flatten())) or weigh(self, lists))
    assert [r for part in score([batch]) for r in part.to_pylist()] == want and len(want) == 120
    assert max(together) <= 1000 and len(together) >= 24


def test_text_vectors_in_the_row_equal_the_weights_table(spark):
    texts = spark.createDataFrame(
        [(1, "Disk error on node seven, disk error"), (2, "login failed for root"), (3, None),
         (4, ""), (5, "login failed for root"), (6, "unseen zebra"), (7, "error " * 5000)],
        "id bigint, text string")
    vocabulary = tfidf.tfidf_fit(texts.where("id <> 6"), "id", "text", max_features=50)
    counts = {r["term"]: (r["corpus_count"], r["doc_count"]) for r in vocabulary.collect()}
    assert counts["disk"] == (2, 1) and counts["login failed"] == (2, 2)
    assert counts["error"] == (5002, 2) and counts["error error"] == (4999, 1)
    wanted = {(r["id"], r["term_index"]): r["weight"] for r in tfidf.tfidf_transform(
        texts, vocabulary, "id", "text", max_features=50).collect()}
    rows = tfidf.tfidf_vectors(texts, vocabulary, "id", "text", max_features=50).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5, 6, 7]
    assert all(r["positions"] == sorted(r["positions"]) for r in rows)
    found = {(r["id"], p): v for r in rows for p, v in zip(r["positions"], r["values"])}
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)
    assert not any(r["positions"] for r in rows if r["id"] in (3, 4, 6))
    plan = tfidf.tfidf_vectors(texts, vocabulary, "id", "text")._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        tfidf.tfidf_vectors(texts, vocabulary, "id", "text", max_features=2)


def test_runs_are_keyed_by_digests(spark):
    """Runs that read alike when put together differ; frames of a scoring hold no messages."""
    said = ["ab", "c", "a", "bc", "ab", "c", "", None, "ab", "c", None, ""] * 2
    rows = spark.createDataFrame(list(enumerate(said)), "at bigint, m string")
    fitted = sequence.sequence_fit(sequence.sequence_keys(rows, "at", "m", length=2))
    pairs = [(a or "", b or "") for a, b in zip(said, said[1:])]
    want = {p: pairs.count(p) for p in pairs if pairs.count(p) > 1}
    assert {tuple(r["run"]): r["seen"] for r in fitted.collect()} == want
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan(fitted)
    model = sequence.sequence_model(rows, "at", "m", length=2)
    path = scratch_path(spark, "digests")
    models.save_sequence_model(path, model)
    scored = models.load_sequence_model(spark, path).score(rows, "at", "m")
    assert "_run_said" not in plan(scored) and "SortAggregate" not in plan(model.vocabulary)
    assert scored.count() == len(said)


def test_beginnings_of_messages(spark):
    said = ["  Two  words ", "two WORDS three", "", None, " ", "two"]
    rows = spark.createDataFrame(list(enumerate(said)), "at bigint, m string")
    vocabulary = spark.createDataFrame([("three", 1), ("two", 2), ("words", 3)], "word string, word_index bigint")
    made = sequence._first_word_indices(rows, "at", "m", vocabulary, 2).orderBy("at")
    assert [r["_indices"] for r in made.collect()] == [[2, 3], [2, 3], [], [], [], [2]]
    assert "array_join" in made._jdf.queryExecution().analyzed().toString()
