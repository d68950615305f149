"""Hard negatives by a secondary sort: rows of an anchor arrive best score first.

An anchor's positives are its best rows of the same label; for each of them the best rows of
other labels whose score lies between a share of the positive's score and that score are its
hard negatives. Scores of an anchor with the rows are packed into keys (anchor, descending
score, positives first, id), repartitioned by anchor and sorted inside the partitions, and a
streaming iterator walks them: a row of the anchor's label opens a window at its score,
every later row of another label goes to the open windows, and a window closes when it is
full or the score falls below its floor. What the iterator remembers is one anchor's open
windows, never its rows.

Not every pair has to be shuffled. Anchors are a stated query set; blocks of at most
``BLOCK`` bytes of them are broadcast in turn, and each task multiplies a block with its own
rows, which do not move. A first walk keeps a task's best rows of the anchor's label, from
which the anchors' windows follow; a second walk keeps a task's best rows in each window. A
row that is not among the best of its own task cannot be among the best of all, so nothing
is lost, and a task sends out at most k + k * n rows for each anchor.

Scores are exact: components become floor(scale * x), and products are summed as doubles
while they stay below 2^53, as 64-bit integers beyond; a table whose scores might not fit 64
bits is an error.

Nulls and edge cases: rows with a null id, label or vector, or with a component that is null
or not finite take no part; vectors of another length than the anchor's have no product with
it and are passed over; an anchor's own id is never its positive or negative; repeated rows
are rows of their own as candidates, an anchor that is repeated whole asks once, anchors that
share only their id ask each for themselves; ties of the score go to the smaller id; empty vectors score zero; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

BLOCK = 16 << 20   # bytes of anchors broadcast together
TILE = 1 << 21     # scores computed together
_PACKED = "anchor bigint, down bigint, negative int, id bigint, name bigint"


def prepare(df: DataFrame, key: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """Rows (id, label, x) of the rows that take part, x as whole numbers."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~broken).select("id", "label", whole.alias("x"))


def _matrix(column) -> np.ndarray:
    """The vectors of equal length as one matrix of whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch):
    """A batch cut into ids, labels and matrix for each length of vector."""
    sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        yield int(size), part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))


def _scores(one: np.ndarray, two: np.ndarray, exact_doubles: bool) -> np.ndarray:
    if exact_doubles:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    return one @ two.T


class _Best:
    """The k best (score, id) for each of n slots, of all that was offered."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.have = np.zeros((n, 0), bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, fits: np.ndarray, at: np.ndarray) -> None:
        """Offer the rows ``ids`` to the slots ``at``; scores and flags are slot by row."""
        n = len(self.score)
        if self.score.shape[1] == self.k:
            # Only rows that beat the last one kept, or fill a place.
            floor = np.where(self.have[at, -1], self.score[at, -1], np.iinfo(np.int64).min)
            fits = fits & (score >= floor[:, None])
        slot, row = np.nonzero(fits)
        if not len(slot):
            return
        kept_slot, _ = np.nonzero(self.have)
        slots = np.concatenate([kept_slot, at[slot]])
        scores = np.concatenate([self.score[self.have], score[slot, row]])
        names = np.concatenate([self.id[self.have], ids[row]])
        order = np.lexsort((names, ~scores, slots))
        slots, scores, names = slots[order], scores[order], names[order]
        begin = np.searchsorted(slots, slots)
        rank = np.arange(len(slots)) - begin
        first = rank < self.k
        slots, rank = slots[first], rank[first]
        self.score, self.id = np.zeros((n, self.k), np.int64), np.zeros((n, self.k), np.int64)
        self.have = np.zeros((n, self.k), bool)
        self.score[slots, rank], self.id[slots, rank], self.have[slots, rank] = scores[first], names[first], True

    def rows(self):
        slot, _ = np.nonzero(self.have)
        return slot, self.score[self.have], self.id[self.have]


def _packed(asked, slot, score, negative: bool, ids) -> pa.RecordBatch:
    """Keys of scored rows; ``asked`` are the anchors (number, id, label, vector) of the slots."""
    return pa.RecordBatch.from_arrays(
        [pa.array(asked[0][slot]), pa.array(~score), pa.array(np.full(len(ids), int(negative), np.int32)),
         pa.array(ids), pa.array(asked[1][slot])], ["anchor", "down", "negative", "id", "name"])


def _positives(rows: DataFrame, block, k: int, exact_doubles: bool) -> DataFrame:
    """Each task's best rows of the label of each anchor, packed."""
    def work(batches):
        best = {size: _Best(len(asked[0]), k) for size, asked in block.value.items()}
        for batch in batches:
            for size, ids, labels, x in _by_length(batch):
                if size not in best:
                    continue
                _, names, groups, anchors = block.value[size]
                for group in np.unique(labels):
                    at, own = np.flatnonzero(groups == group), np.flatnonzero(labels == group)
                    step = max(1, TILE // max(1, len(at)))
                    for first in range(0, len(own) if len(at) else 0, step):
                        part = own[first:first + step]
                        fits = names[at][:, None] != ids[part][None, :]
                        best[size].offer(_scores(anchors[at], x[part], exact_doubles), ids[part], fits, at)
        for size, found in best.items():
            slot, score, ids = found.rows()
            yield _packed(block.value[size], slot, score, False, ids)

    return rows.mapInArrow(work, _PACKED)


def _negatives(rows: DataFrame, block, windows, k: int, floor: int, exact_doubles: bool) -> DataFrame:
    """Each task's best rows of other labels in each window of each anchor, packed.

    ``windows`` has, by length of vector, the positives' scores (anchor by place) and which
    places are taken.
    """
    def work(batches):
        best = {}
        for size, (top, _) in windows.value.items():
            best[size] = [_Best(len(top), k) for _ in range(top.shape[1])]
        for batch in batches:
            for size, ids, labels, x in _by_length(batch):
                if size not in best:
                    continue
                _, names, groups, anchors = block.value[size]
                top, taken = windows.value[size]
                step = max(1, TILE // len(names))
                every = np.arange(len(names))
                for first in range(0, len(ids), step):
                    part = slice(first, first + step)
                    score = _scores(anchors, x[part], exact_doubles)
                    other = (groups[:, None] != labels[part][None, :]) & (names[:, None] != ids[part][None, :])
                    for place, found in enumerate(best[size]):
                        high = top[:, place]
                        low = -((-floor * high) // 100)
                        fits = other & (score <= high[:, None]) & (score >= low[:, None]) & taken[:, place][:, None]
                        found.offer(score, ids[part], fits, every)
        for size, several in best.items():
            # Windows of an anchor overlap: a row is sent once, as often as it stands there.
            sent = {}
            for found in several:
                counts = {}
                for one in zip(*(a.tolist() for a in found.rows())):
                    counts[one] = counts.get(one, 0) + 1
                for one, n in counts.items():
                    sent[one] = max(n, sent.get(one, 0))
            flat = [one for one, n in sent.items() for _ in range(n)]
            slot, score, ids = (np.array(c, np.int64) for c in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
            yield _packed(block.value[size], slot, score, True, ids)

    return rows.mapInArrow(work, _PACKED)


def _sorted(packed: DataFrame) -> DataFrame:
    """The secondary sort: partitioned by anchor, sorted by the whole key."""
    return packed.repartition("anchor").sortWithinPartitions("anchor", "down", "negative", "id")


def _first_positives(packed: DataFrame, k: int) -> DataFrame:
    """The first k positives of each anchor, off the sorted rows."""
    def walk(batches):
        anchor, left = None, 0
        for batch in batches:
            keep = []
            for i, name in enumerate(batch.column(0).to_pylist()):
                if name != anchor:
                    anchor, left = name, k
                if left:
                    keep.append(i)
                    left -= 1
            yield batch.take(pa.array(keep, pa.int64()))

    return _sorted(packed).mapInArrow(walk, _PACKED)


def _mined(packed: DataFrame, k: int, n: int, floor: int) -> DataFrame:
    """The negatives of each open window, in one pass over the sorted rows."""
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def walk(batches):
        anchor, opened, windows = None, 0, []
        for batch in batches:
            out = []
            for number, down, negative, row, name in zip(*(c.to_pylist() for c in batch.columns)):
                if number != anchor:
                    anchor, opened, windows = number, 0, []
                score = ~down
                if not negative:
                    if opened < k:
                        opened += 1
                        windows.append([row, score, 0])
                    continue
                windows = [w for w in windows if w[2] < n and 100 * score >= floor * w[1]]
                for window in windows:
                    # A score below zero has its floor above itself: an empty window.
                    window[2] += 1
                    out.append((name, window[0], window[2], row, window[1], score))
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], list(names))

    return _sorted(packed).mapInArrow(
        walk, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def mine(rows: DataFrame, anchors: Column, k: int = 5, n: int = 5, floor: int = 80) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` is what ``prepare`` gives, ``anchors`` says which of them ask. Each of the first
    ``k`` rows of the anchor's label has up to ``n`` negatives with a score from ``floor``
    percent of its own to its own. Runs jobs: for each block of anchors, rows are read twice.
    """
    spark = rows.sparkSession
    rows = stored(rows, "whole-vectors")
    asked = stored(rows.where(anchors).distinct(), "anchors")
    about = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("size")).first()
    far = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("far"), F.max(F.size("x")).alias("size")).first()
    bound = (far["far"] or 0) ** 2 * max(1, far["size"] or 0)
    if 100 * bound >= 1 << 63 or (far["far"] or 0) < 0:
        raise ValueError("scores may not fit 64 bits")
    exact_doubles = bound < 1 << 53
    blocks = -(-about["n"] * (8 * (about["size"] or 0) + 64) // BLOCK)
    number = F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))
    mined = None
    for i in range(blocks):
        block = {}
        # A block of at most about BLOCK bytes: the only rows the driver sees.
        own = asked.where(number == i).select("id", "label", "x").toArrow().combine_chunks()
        for size, ids, labels, x in (part for batch in own.to_batches() for part in _by_length(batch)):
            done = sum(len(asked[0]) for asked in block.values())
            block[size] = (np.arange(done, done + len(ids)), ids, labels, x)
        shared = spark.sparkContext.broadcast(block)
        first = stored(_first_positives(_positives(rows, shared, k, exact_doubles), k), "positives")
        table = first.toArrow()  # at most k rows for each anchor of the block
        at = {}
        for one, down in zip(table.column("anchor").to_pylist(), table.column("down").to_pylist()):
            at.setdefault(one, []).append(~down)
        windows = {}
        for size, (numbers, *_) in block.items():
            top, taken = np.zeros((len(numbers), k), np.int64), np.zeros((len(numbers), k), bool)
            for j, one in enumerate(numbers.tolist()):
                for place, score in enumerate(sorted(at.get(one, ()), reverse=True)):
                    top[j, place], taken[j, place] = score, True
            windows[size] = (top, taken)
        second = _negatives(rows, shared, spark.sparkContext.broadcast(windows), n, floor, exact_doubles)
        part = stored(_mined(first.unionByName(second), k, n, floor), "mined")
        mined = part if mined is None else mined.unionByName(part)
    if mined is None:
        return _mined(spark.createDataFrame([], _PACKED), k, n, floor)
    return mined
