"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes: iterative quantisation learns rotations of the unit vectors that bring them close to
the corners of a cube (on a bounded, documented sample); the signs after several rotations
are the code. Index: the code is split into 16-bit substrings, each with its own table from
value to rows. Search: a query probes, in every table, all values within ``reach`` bits of
its own substring. By the pigeonhole every code within ``tables * (reach + 1) - 1`` bits is
found, and further ones that share a close substring. A query that finds fewer than ``k``
rows of a block probes it again with the least reach that gives ``k`` (or all its rows). All
found rows are reranked by their exact cosine on the original vectors.

Every row is indexed. The rows are dealt into blocks of bounded size and the queries into
chunks of bounded size; a task indexes one block, probes it for one chunk and gives back
``k`` rows for each query. The best of all blocks is a bounded rank per query.

Nulls and edge cases: rows with a null id, and vectors that are null, empty, zero, hold a
null or non-finite component or are not of the most frequent length, take no part; rows that
repeat an id count once, with their smallest vector; equal vectors tie and the smaller id
comes first; a query with fewer candidates has fewer rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

BITS = 16  # of a substring


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row (id, vector) per id, only vectors that can be compared."""
    number = F.col(vector).cast("array<double>")
    good = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).alias("id"), number.alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    good = good.where((F.size("vector") > 0) & fine & F.exists("vector", lambda x: x != 0))
    most = good.groupBy(F.size("vector").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).limit(1).select("size")
    good = good.where(F.size("vector") == most.scalar())
    return good.groupBy("id").agg(F.min("vector").alias("vector"))


def learn_rotations(sample: np.ndarray, rotations: int, steps: int = 20, seed: int = 42):
    """A (dimensions, bits) matrix of ``rotations`` learned orthogonal maps, side by side."""
    width = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    random, found = np.random.default_rng(seed), []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(random.normal(size=(width, width)))
        for _ in range(steps):
            left, _, right = np.linalg.svd(unit.T @ np.sign(unit @ turn))
            turn = left @ right
        found.append(turn)
    return np.concatenate(found, axis=1)


def substrings(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows, tables) substring values of the binary codes."""
    signs = (vectors @ turn) > 0
    signs = signs[:, :signs.shape[1] // BITS * BITS]
    return np.packbits(signs, axis=1).view(np.uint16).reshape(len(vectors), -1)


def _probes(reach: int) -> np.ndarray:
    """All 16-bit masks with at most ``reach`` ones."""
    return np.array([sum(1 << b for b in bits) for n in range(reach + 1)
                     for bits in combinations(range(BITS), n)], dtype=np.uint16)


def candidates(index: np.ndarray, asked: np.ndarray, reach: int) -> np.ndarray:
    """(queries, rows) true where a substring of the row lies within ``reach`` of the query's."""
    found = np.zeros((len(asked), len(index)), dtype=bool)
    masks = _probes(reach)
    for table in range(index.shape[1]):
        rows = np.argsort(index[:, table], kind="stable")
        begin = np.searchsorted(index[rows, table], np.arange((1 << BITS) + 1))
        probes = asked[:, table, None] ^ masks[None, :]
        low, size = begin[probes], begin[probes.astype(np.int64) + 1] - begin[probes]
        query, probe = np.nonzero(size)
        low, size = low[query, probe], size[query, probe]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found[np.repeat(query, size), rows[np.repeat(low, size) + at]] = True
    return found


def widened(index: np.ndarray, one: np.ndarray, usable: np.ndarray, least: int) -> np.ndarray:
    """Places of the usable rows within the smallest reach that gives ``least`` of them."""
    reach = np.bitwise_count(index ^ one).min(axis=1)
    own = np.sort(reach[usable])
    return np.flatnonzero(usable & (reach <= own[least - 1]))


def cosines(rows: np.ndarray, norms: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosines of rows with one vector; equal rows give equal numbers wherever they stand."""
    return (rows * one).sum(axis=1) / (norms * np.sqrt((one * one).sum()))


def search(
    df: DataFrame, key: str, vector: str, asks: Column, k: int = 5, rotations: int = 8,
    reach: int = 3, sample: int = 4096, block: int = 32_768, chunk: int = 2048,
) -> DataFrame:
    """Rows (query_id, rank, id, score) of the ``k`` nearest found for the rows that ``asks``.

    ``asks`` is a condition on the column ``id``. The rotations are learned on the ``sample``
    vectors with the smallest id hash. Runs jobs.
    """
    rows = stored(usable(df, key, vector), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    head = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(head):
        return rows.sparkSession.createDataFrame(
            [], f"query_id {kind}, rank int, id {kind}, score double")
    learned = np.stack(head["vector"].to_numpy())
    scale = 2.0 ** -np.floor(np.log2(np.abs(learned).max(axis=1, keepdims=True)))
    tables = max(1, learned.shape[1] * rotations // BITS)
    enough = -(-tables * BITS // learned.shape[1])
    turn = learn_rotations(learned * scale, max(rotations, enough))

    total, asked = rows.count(), rows.where(asks).count()
    blocks, chunks = max(12, -(-total // block)), max(1, -(-asked // chunk))
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    index = rows.select(part(blocks, "block").alias("block"), F.explode(every).alias("chunk"), "id", "vector")
    queries = rows.where(asks).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        part(chunks, "chunk").alias("chunk"), "id", "vector")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asks_ = left.column("id").to_pylist(), right.column("id").to_pylist()
        out = ([], [], [])
        if ids and asks_:
            unpack = lambda t: np.stack(t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
            own, other = unpack(left), unpack(right)
            # Exact powers of two keep the squares of very large and small numbers finite.
            own = own * 2.0 ** -np.floor(np.log2(np.abs(own).max(axis=1, keepdims=True)))
            other = other * 2.0 ** -np.floor(np.log2(np.abs(other).max(axis=1, keepdims=True)))
            norms = np.sqrt((own * own).sum(axis=1))
            codes, sought = substrings(own, turn), substrings(other, turn)
            order = np.array(ids, dtype=object if kind == "string" else None)
            for first in range(0, len(asks_), 128):
                near = candidates(codes, sought[first:first + 128], reach)
                for i, hit in enumerate(near, first):
                    usable_ = order != asks_[i]
                    at = np.flatnonzero(hit & usable_)
                    enough_ = min(k, int(usable_.sum()))
                    if not enough_:
                        continue
                    if len(at) < enough_:
                        at = widened(codes, sought[i], usable_, enough_)
                    score = cosines(own[at], norms[at], other[i])
                    if len(at) > 4 * k:  # ties with the k-th stay in
                        least = np.partition(score, len(at) - k)[len(at) - k]
                        at, score = at[score >= least], score[score >= least]
                    best = sorted(zip(-score, (ids[a] for a in at)))[:k]
                    out[0].extend([asks_[i]] * len(best))
                    out[1].extend(b[1] for b in best)
                    out[2].extend(-b[0] for b in best)
        return pa.table({
            "query_id": pa.array(out[0], left.schema.field("id").type),
            "id": pa.array(out[1], left.schema.field("id").type),
            "score": pa.array(out[2], pa.float64())})

    found = index.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(
        find, f"query_id {kind}, id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
