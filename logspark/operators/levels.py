"""Isolation trees over a share of the rows, grown level by level where the rows are.

A tree on 0.8 of a table has as many leaves as rows, so it cannot be grown in one task.
Here every row carries the number of the node it stands in, for each tree of a batch. A
level is two passes: one aggregation per node gives the number of its rows and the span of
a few features drawn for it; the splits follow, and a pass over the rows sends each to a
child. No task holds a tree, and a hot vector is one leaf as soon as a node holds nothing
else.

Only nodes of more than ``whole`` rows take part in levels, so a level has few nodes and all
trees fit into one batch (``BATCH_BYTES`` of nodes; the driver sees no others). The rows of
a smaller node move once, to the task that grows its subtree by the same steps in memory.

Where all rows fit into one broadcast (``ROWS_BYTES``) no row moves: every task grows whole
trees by the same steps (``grow_at_once``), and the trees are the same. A grown tree is
kept as one row of byte strings (``PACKED``); ``unpacked`` gives its nodes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import drop_scratch, scratch_path

BATCH_BYTES = 128 << 20
ROWS_BYTES = 64 << 20  # of vectors broadcast together, in double precision
TASK_BYTES = 32 << 20  # of packed trees in a task
PACKED_BYTES = 20      # of a packed node
NODE_BYTES = 40
DRAWN = 4             # features looked at together for a node
PAIRS = 1 << 20       # rows times trees looked at together in a task
NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"
PACKED = "tree int, feature binary, value binary, left binary, right binary"
GRAIN = 1 << 30


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _sliced(batches):
    """Batches of at most ``PAIRS`` rows times trees."""
    for batch in batches:
        if len(batch):
            step = max(1, PAIRS // max(len(batch["at"].iloc[0]), 1))
            for first in range(0, len(batch), step):
                yield batch.iloc[first:first + step]


def _node_spans(at, points, marks, features) -> dict | None:
    """Columns (node, n, h0, h1, lo*, hi*) over the rows of a matrix, or None without any."""
    row, tree = np.nonzero(at >= 0)
    node = at[row, tree]
    order = np.argsort(node, kind="stable")
    return _sorted_spans(row[order], node[order], points, marks, features)


def _sorted_spans(row, node, points, marks, features) -> dict | None:
    """``_node_spans`` of rows in the order of their nodes."""
    if not len(node):
        return None
    hashes = marks[row]
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    made = {"node": node[starts].astype(np.int64), "n": np.diff(np.append(starts, len(node))).astype(np.int64),
            "h0": np.minimum.reduceat(hashes, starts), "h1": np.maximum.reduceat(hashes, starts)}
    flat, first = points.ravel(), row * points.shape[1]
    for j in range(DRAWN):
        seen = flat.take(first + features[:, j].take(node))
        made[f"lo{j}"] = np.minimum.reduceat(seen, starts)
        made[f"hi{j}"] = np.maximum.reduceat(seen, starts)
    return made


def _moved(at, points, splits) -> np.ndarray:
    """The children the rows of a matrix go to."""
    feature, threshold, left, right = splits
    row, tree = np.nonzero(at >= 0)
    node = at[row, tree]
    seen = points[row, np.maximum(feature[node], 0)]
    at = at.copy()
    at[row, tree] = np.where(seen <= threshold[node], left[node], right[node])
    return at


def _spans(state: DataFrame, features, size: int, matrix) -> pd.DataFrame:
    """Rows (node, n, h0, h1, lo*, hi*): size, row hashes and feature spans of each node.

    ``features`` is a broadcast table (node by place) of the features drawn.
    """
    names = [f"{end}{j}" for end in ("lo", "hi") for j in range(DRAWN)]

    def partial(batches):
        for batch in _sliced(batches):
            made = _node_spans(
                np.stack(batch["at"].to_numpy()), matrix(batch, size), batch["mark"].to_numpy(), features.value)
            if made:
                yield pd.DataFrame(made)

    schema = "node bigint, n bigint, h0 bigint, h1 bigint, " + ", ".join(f"{c} double" for c in names)
    parts = state.mapInPandas(partial, schema)
    merged = parts.groupBy("node").agg(
        F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"),
        *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in names])
    return merged.toPandas().sort_values("node")


def _step(state: DataFrame, splits, size: int, matrix) -> DataFrame:
    """Every row in the child of its node; ``splits`` has (feature, threshold, left, right)
    by node, children -1 for a leaf, below that for a node grown in a task, and feature -1
    for a node that is not split."""
    def move(batches):
        for batch in _sliced(batches):
            at = _moved(np.stack(batch["at"].to_numpy()), matrix(batch, size), splits.value)
            yield batch.assign(at=list(at))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    return state.mapInPandas(move, fields)


class _Table:
    """The rows of a batch of trees as a written table."""

    def __init__(self, state: DataFrame, path: str, size: int, matrix):
        self.state, self.path, self.size, self.matrix = state, path, size, matrix
        self.context = state.sparkSession.sparkContext

    def spans(self, drawn: np.ndarray) -> pd.DataFrame:
        shared = self.context.broadcast(drawn)
        found = _spans(self.state, shared, self.size, self.matrix)
        shared.unpersist()
        return found

    def step(self, splits: tuple) -> None:
        shared, old = self.context.broadcast(splits), self.path
        self.state, self.path = _written(_step(self.state, shared, self.size, self.matrix), "tree-rows")
        drop_scratch(self.state.sparkSession, old)
        shared.unpersist()


class _Memory:
    """The rows of one tree or subtree in a task; those that left it stand in ``at``."""

    def __init__(self, points: np.ndarray, marks: np.ndarray):
        self.points, self.marks, self.at = points, marks, np.full(len(points), -1)
        self.row, self.node = np.arange(len(points)), np.zeros(len(points), np.int64)

    def spans(self, drawn: np.ndarray) -> dict:
        # Two bytes are sorted by radix.
        order = np.argsort(self.node.astype(np.uint16) if len(drawn) <= 1 << 16 else self.node, kind="stable")
        self.row, self.node = self.row[order], self.node[order]
        return _sorted_spans(self.row, self.node, self.points, self.marks, drawn)

    def step(self, splits: tuple) -> None:
        feature, threshold, left, right = splits
        seen = self.points.ravel().take(
            self.row * self.points.shape[1] + np.maximum(feature, 0).take(self.node))
        to = np.where(seen <= threshold.take(self.node), left.take(self.node), right.take(self.node))
        gone = to < 0
        self.at[self.row[gone]] = to[gone]
        self.row, self.node = self.row[~gone], to[~gone].astype(np.int64)


def _in_tree(key: str, seed: int, tree, share: float):
    """Whether a row is one of the tree's."""
    cut = min(GRAIN, int(share * GRAIN) + 1)
    return F.pmod(F.xxhash64(F.lit(seed), tree, F.col(key)), F.lit(GRAIN)) < cut


def _mark(columns):
    """A hash of a row; zero and minus zero are one number to a split."""
    return F.xxhash64(*[F.transform(c, lambda x: x + 0.0) if c != "positions" else F.col(c) for c in columns])


def _most_rows(whole: int, size: int) -> int:
    """Rows of a subtree of its own; a dense matrix of them stays small also where rows are wide."""
    return max(1, min(whole, BATCH_BYTES // (16 * size)))


def tree_tasks(rows: int, trees: int) -> int:
    """How many partitions ``trees`` trees on ``rows`` rows are dealt over."""
    return -(-trees // max(1, min(8, TASK_BYTES // (2 * rows * PACKED_BYTES))))


def grow(
    rows: DataFrame, key: str, size: int, trees: int, share: float, expected: int, seed: int,
    average_path, matrix, whole: int,
) -> DataFrame:
    """The node table of ``trees`` trees on rows kept by hash, each with chance ``share``.

    ``expected`` is the number of rows a tree gets; it limits the depth. ``matrix`` makes a
    dense matrix of a batch. Nodes of at most ``whole`` rows are grown in a task each. Runs
    jobs: two a level. The table is written.
    """
    spark = rows.sparkSession
    limit = math.ceil(math.log2(max(expected, 2)))
    whole = _most_rows(whole, size)
    columns = [c for c in ("vector", "positions", "values") if c in rows.columns]
    out = scratch_path(spark, "trees")
    # A level splits at most expected / whole nodes of a tree, into two each.
    most = 2 * limit * (max(expected, 1) // whole + 1)
    together = max(1, BATCH_BYTES // (most * NODE_BYTES))
    for first in range(0, trees, together):
        batch = range(first, min(first + together, trees))
        at = F.transform(
            F.sequence(F.lit(batch[0]), F.lit(batch[-1])),
            lambda t: F.when(_in_tree(key, seed, t, share), t - batch[0]).otherwise(-1).cast("int"))
        start = rows.select(*columns, at.alias("at"), _mark(columns).alias("mark"))
        table = _Table(*_written(start, "tree-rows"), size, matrix)
        count = len(batch)
        roots = (np.arange(count), np.zeros(count, np.int64), np.zeros(count, np.int64))
        made, small, following = _grow_nodes(
            table, roots, batch[0], np.ones(count, np.int64), size, limit, seed, average_path, whole)
        spark.createDataFrame(made).write.mode("append").parquet(out)
        if len(small[0]):
            below, path = _subtrees(
                table.state, columns, small, batch[0], following, size, limit, seed, average_path, matrix)
            below.write.mode("append").parquet(out)
            drop_scratch(spark, path)
        drop_scratch(spark, table.path)
    return spark.read.parquet(out)


def fits_at_once(rows: DataFrame, size: int, total: int) -> bool:
    """Whether the rows are dense and so few that a broadcast holds them all."""
    return "vector" in rows.columns and 8 * size * total <= ROWS_BYTES


def grow_at_once(
    rows: DataFrame, key: str, size: int, trees: int, share: float, expected: int, seed: int,
    average_path, whole: int,
) -> DataFrame:
    """The trees of ``grow`` as ``PACKED`` rows, grown from one broadcast of all rows."""
    spark, whole = rows.sparkSession, _most_rows(whole, size)
    limit = math.ceil(math.log2(max(expected, 2)))
    inside = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _in_tree(key, seed, t, share))
    found = rows.select("vector", _mark(["vector"]).alias("mark"), inside.alias("inside")).toArrow()
    held = [np.packbits(list_rows(part.column("inside")), axis=1)
            for part in found.to_batches() if part.num_rows]
    points, marks = dense(found, size), found.column("mark").to_numpy()
    del found
    shared = spark.sparkContext.broadcast((points, marks, np.concatenate(held)))
    del points, marks, held

    def plant(batches):
        points, marks, held = shared.value
        for batch in batches:
            for tree in batch["id"].tolist():
                chosen = np.flatnonzero((held[:, tree >> 3] >> (7 - (tree & 7))) & 1)
                made = _grow_tree(points[chosen], marks[chosen], tree, size, limit, seed, average_path, whole)
                yield pd.DataFrame([packed(tree, *made)])

    grown = spark.range(0, trees, 1, tree_tasks(expected, trees)).mapInPandas(plant, PACKED)
    made, _ = _written(grown, "subtrees")
    shared.destroy()
    return made


def _grow_tree(points, marks, tree, size, limit, seed, average_path, whole) -> tuple:
    """Feature (-1 for a leaf), threshold or path, left and right child by node of a tree."""
    rows = _Memory(points, marks)
    start = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
    made, (_, heads, depths), following = _grow_nodes(
        rows, start, tree, np.ones(1, np.int64), size, limit, seed, average_path, whole)
    parts, free = [made], int(following[0])
    for i, (head, depth) in enumerate(zip(heads.tolist(), depths.tolist())):
        chosen = np.flatnonzero(rows.at == -2 - i)
        start = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, depth))
        below, _, _ = _grow_nodes(
            _Memory(points[chosen], marks[chosen]), start, tree, np.ones(1, np.int64), size, limit,
            _own_seed(seed, tree, head), average_path, 0)
        for name in ("node", "left", "right"):
            number = below[name].to_numpy()
            real = np.where(number < 0, -1, np.where(number == 0, head, free + number - 1))
            below = below.set_column(below.schema.get_field_index(name), name, pa.array(real, pa.int32()))
        parts.append(below)
        free += len(below) - 1
    table = pa.concat_tables(parts)
    order = np.argsort(table["node"].to_numpy(), kind="stable")
    feature, left, right, threshold, path = (
        table[name].to_numpy()[order] for name in ("feature", "left", "right", "threshold", "path"))
    return feature, np.where(left < 0, path, threshold), left, right


def packed(tree: int, feature, value, left, right) -> dict:
    """A row of ``PACKED``: nodes by number, ``value`` the threshold of a split or the path of a leaf."""
    whole = lambda part: np.asarray(part, np.int32).tobytes()
    return {"tree": tree, "feature": whole(feature), "value": np.asarray(value, float).tobytes(),
            "left": whole(left), "right": whole(right)}


def opened(row) -> tuple:
    """(feature, value, left, right) of a row of ``PACKED``."""
    whole = lambda part: np.frombuffer(part, np.int32)
    return whole(row["feature"]), np.frombuffer(row["value"]), whole(row["left"]), whole(row["right"])


def unpacked(trees: DataFrame) -> DataFrame:
    """The node table of ``PACKED`` rows."""
    def nodes(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                feature, value, left, right = opened(row)
                leaf = left < 0
                yield pd.DataFrame({
                    "tree": np.int32(row["tree"]), "node": np.arange(len(left), dtype=np.int32), "feature": feature,
                    "threshold": np.where(leaf, 0.0, value), "left": left, "right": right,
                    "path": np.where(leaf, value, 0.0)})

    return trees.mapInPandas(nodes, NODES)


def list_rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; its lists must be of one length."""
    lengths = pc.list_value_length(column)
    if lengths.null_count or pc.count_distinct(lengths).as_py() > 1:
        raise ValueError("vectors are missing or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def dense(table: pa.Table, size: int, name: str = "vector") -> np.ndarray:
    """The vectors of a table as a matrix."""
    points, first = np.empty((table.num_rows, size)), 0
    for part in table.select([name]).to_batches():
        if part.num_rows:
            points[first:first + part.num_rows] = list_rows(part.column(name))
            first += part.num_rows
    return points


def _own_seed(seed: int, tree: int, number: int) -> int:
    """For other draws than those of the tree's upper nodes, and of its other subtrees."""
    return int(_mixed([seed], [tree], [number], [4])[0] >> np.uint64(2))


def _subtrees(state, columns, small, base, following, size, limit, seed, average_path, matrix) -> tuple[DataFrame, str]:
    """The nodes below (and of) the nodes ``small``, one group of rows each.

    A subtree numbers its nodes from 0; the real numbers go on from those of the tree, one
    subtree after the other. Also gives the path of the table they are read from.
    """
    spark = state.sparkSession
    tree, number, depth = small
    shared = spark.sparkContext.broadcast((tree, number, depth))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        which = int(group["subtree"].iloc[0])
        tree, number, depth = (int(part[which]) for part in shared.value)
        rows = _Memory(matrix(group, size), group["mark"].to_numpy())
        start = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, depth))
        own = _own_seed(seed, tree + base, number)
        made, _, _ = _grow_nodes(rows, start, tree + base, np.ones(1, np.int64), size, limit, own, average_path, 0)
        return made.to_pandas().assign(subtree=which)

    marked = F.explode(F.filter("at", lambda x: x < -1))
    moved = state.select(*columns, "mark", marked.alias("_at")).withColumn("subtree", -2 - F.col("_at")).drop("_at")
    nodes, path = _written(moved.groupBy("subtree").applyInPandas(finish, NODES + ", subtree int"), "subtrees")
    heads = spark.createDataFrame(pa.table({
        "subtree": pa.array(np.arange(len(tree)), pa.int32()), "tree": pa.array(tree + base, pa.int32()),
        "head": pa.array(number, pa.int32()), "free": pa.array(following[tree], pa.int32())}))
    sizes = nodes.groupBy("subtree").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum(F.col("_n") - 1).over(Window.partitionBy("tree").orderBy("subtree")) - (F.col("_n") - 1)
    bases = heads.join(sizes, "subtree").select(
        "subtree", "head", (F.col("free") + before).cast("int").alias("_base"))

    def real(name):
        place = F.col("_base") + F.col(name) - 1
        return F.when(F.col(name) < 0, -1).when(F.col(name) == 0, F.col("head")).otherwise(place).alias(name)

    return nodes.join(bases, "subtree").select(
        "tree", real("node"), "feature", "threshold", real("left"), real("right"), "path"), path


def _grow_nodes(rows, roots, first_tree, following, size, limit, seed, average_path, whole):
    """Grow the nodes ``roots`` (tree, number, depth), ``rows`` giving spans and moving on.

    ``following`` has the next free number of each tree. Returns the nodes grown, those of at
    most ``whole`` rows that were left (rows in the i-th of them stand at -2 - i), and the
    numbers that are free then.
    """
    # The nodes rows stand in: their tree, number in the tree, depth and draws so far.
    tree, number, depth = roots
    count, tried = len(following), np.zeros(len(tree), np.int64)
    begin, stride = _walks(tree + first_tree, number, size, seed)
    made, left_out, outside = [], [[], [], []], 0
    while len(tree):
        places = tried[:, None] * DRAWN + np.arange(DRAWN)[None, :]
        drawn = (begin[:, None] + places * stride[:, None]) % size
        found = rows.spans(drawn)
        n = np.zeros(len(tree), np.int64)
        same = np.ones(len(tree), bool)
        low, high = np.zeros((len(tree), DRAWN)), np.zeros((len(tree), DRAWN))
        if found is not None:
            seen = np.asarray(found["node"])
            n[seen] = found["n"]
            same[seen] = np.asarray(found["h0"]) == np.asarray(found["h1"])
            for j in range(DRAWN):
                low[seen, j], high[seen, j] = found[f"lo{j}"], found[f"hi{j}"]
        usable = high > low
        pick = usable.argmax(axis=1)
        every = np.arange(len(tree))
        tried = tried + 1
        leaf = (n <= 1) | same | (depth >= limit) | (~usable.any(axis=1) & (tried * DRAWN >= size))
        small = ~leaf & (n <= whole)
        split = ~leaf & ~small & usable.any(axis=1)
        waits = ~leaf & ~small & ~split
        lo, hi = low[every, pick], high[every, pick]
        threshold = lo + _chance(tree + first_tree, number, seed) * (hi - lo)
        threshold = np.where(threshold >= hi, lo, threshold)
        # New numbers: two for each split, in the order of the nodes of a tree.
        rank = np.zeros(len(tree), np.int64)
        order = np.lexsort((number, tree))
        own = split[order].astype(np.int64)
        before = np.cumsum(own) - own
        heads = np.searchsorted(tree[order], np.arange(count))
        base = np.append(before, own.sum())[heads]
        rank[order] = before - base[tree[order]]
        left = following[tree] + 2 * rank
        following = following + 2 * np.bincount(tree[split], minlength=count)
        done = leaf | split
        made.append(pa.table({
            "tree": pa.array((tree + first_tree)[done], pa.int32()), "node": pa.array(number[done], pa.int32()),
            "feature": pa.array(np.where(split, drawn[every, pick], -1)[done], pa.int32()),
            "threshold": pa.array(np.where(split, threshold, 0.0)[done]),
            "left": pa.array(np.where(split, left, -1)[done], pa.int32()),
            "right": pa.array(np.where(split, left + 1, -1)[done], pa.int32()),
            "path": pa.array(np.where(split, 0.0, depth + average_path(n))[done])}))
        # The nodes of the next level: both children of a split, and nodes that wait.
        one, two, three = np.flatnonzero(split), np.flatnonzero(waits), np.flatnonzero(small)
        to_left, to_right = np.full(len(tree), -1), np.full(len(tree), -1)
        to_left[one], to_right[one] = np.arange(len(one)), len(one) + np.arange(len(one))
        to_left[two] = to_right[two] = 2 * len(one) + np.arange(len(two))
        to_left[three] = to_right[three] = -2 - outside - np.arange(len(three))
        outside += len(three)
        for held, part in zip(left_out, (tree, number, depth)):
            held.append(part[three])
        splits = (np.where(split, drawn[every, pick], -1), threshold,
                  to_left.astype(np.int32), to_right.astype(np.int32))
        tree, depth, tried, number, begin, stride = (
            np.concatenate([tree[one], tree[one], tree[two]]),
            np.concatenate([depth[one] + 1, depth[one] + 1, depth[two]]),
            np.concatenate([np.zeros(2 * len(one), np.int64), tried[two]]),
            np.concatenate([left[one], left[one] + 1, number[two]]),
            begin[two], stride[two])
        fresh = _walks(tree[:2 * len(one)] + first_tree, number[:2 * len(one)], size, seed)
        begin, stride = np.concatenate([fresh[0], begin]), np.concatenate([fresh[1], stride])
        if len(tree) or len(three):
            rows.step(splits)
    return pa.concat_tables(made), tuple(np.concatenate(part) for part in left_out), following


def _mixed(*parts) -> np.ndarray:
    """A hash of whole numbers that does not depend on how nodes are listed."""
    state = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            state = (state ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(29)
            state *= np.uint64(0xBF58476D1CE4E5B9)
            state ^= state >> np.uint64(32)
    return state


def _walks(tree, number, size: int, seed: int):
    """Where a node begins to draw features, and by which step it goes through all of them."""
    steps = np.array([s for s in range(1, size + 1) if math.gcd(s, size) == 1], np.int64)
    same = np.full(len(tree), seed)
    begin = (_mixed(same, tree, number, np.full(len(tree), 1)) % np.uint64(size)).astype(np.int64)
    step = steps[(_mixed(same, tree, number, np.full(len(tree), 2)) % np.uint64(len(steps))).astype(np.int64)]
    return begin, step


def _chance(tree, number, seed: int) -> np.ndarray:
    same = np.full(len(tree), seed)
    return (_mixed(same, tree, number, np.full(len(tree), 3)) >> np.uint64(11)).astype(float) / float(1 << 53)
