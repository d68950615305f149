"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

A text becomes a 64-bit fingerprint: the majority, per bit, of the hashes of its word
shingles. Texts with fingerprints that differ in few bits are linked.

Equal fingerprints are one entry with a smallest document, so copies never meet in pairs.
Entries are dealt out by the pigeonhole: of ``distance`` + 2 bands, two fingerprints within
the distance agree in two at least, so each pair of bands is a bucket number. Inside a
bucket the fingerprints stand in the order of their rank in the Gray code, where
neighbours share most bits. Runs of at most ``NODE`` of them form a tree: a node keeps the
bits on which all its members agree (mask and pattern), and two nodes whose shared bits
already differ in more places than allowed are dropped with all their members. Nodes of one
bucket that lie in different tasks meet by a join on the bucket, pruned the same way. Each
search gives back a spanning forest of its links, never all pairs of a group.

Nulls and edge cases: a null text is an empty one and has fingerprint zero, which links
like any other; rows with a null key get a fingerprint but no component and link nothing;
repeated rows stay repeated rows; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import components, row_hash, stored, unused

NODE = 1024        # fingerprints under one top node
FAN = 8            # children of an inner node
PAIRS = 4_000_000  # leaf pairs looked at together, at most
CHUNK = 32_768     # hashes counted together


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of the word shingles of a UTF-8 text, as often as they stand there."""
    words = (text or b"").lower().split()  # both only touch ASCII
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        grams, count = [b" ".join(words)], 1
    else:
        count = len(words) - width + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64, count)


def simhash(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    count = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, count, CHUNK):
        part = hashes[first:first + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str, text: str, width: int = 4) -> DataFrame:
    """Rows (key, fingerprint); the fingerprint is a long with the same 64 bits."""
    def work(batches):
        for batch in batches:
            made = np.fromiter(
                (simhash(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made.view(np.int64))], ["key", "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(
        work, f"key {kind}, fingerprint bigint")


def gray_rank(code: Column) -> Column:
    """The rank of a 64-bit word in the Gray code, as a long that sorts as unsigned."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def bucket_keys(code: Column, distance: int) -> Column:
    """The bucket numbers of a fingerprint: one for each pair of bands."""
    bands = distance + 2
    width, extra = divmod(64, bands)
    parts, low = [], 0
    for i in range(bands):
        size = width + (i < extra)
        parts.append((F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << size) - 1)), size))
        low += size
    keys = []
    for number, ((a, _), (b, size)) in enumerate(combinations(parts, 2)):
        keys.append(F.shiftleft(F.shiftleft(F.lit(number).cast("bigint"), 26)
                                .bitwiseOR(a), size).bitwiseOR(b))
    return F.array(*keys)


def _tree(codes: np.ndarray, starts: np.ndarray):
    """Levels of a forest over sorted codes; ``starts`` are the first leaves of the roots.

    A level is (mask, pattern, first child, end of children); the first level is the leaves.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = len(codes)
    levels = [(np.full(n, full), codes, np.arange(n), np.arange(n))]
    both, some, first = codes, codes, starts
    root = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    while len(both) > len(starts):
        place = np.arange(len(both)) - first[root]
        cut = np.flatnonzero(place % FAN == 0)
        both, some = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(some, cut)
        ends = np.append(cut[1:], len(root))
        levels.append((~(both ^ some), both, cut, ends))
        root = root[cut]
        first = np.searchsorted(root, np.arange(len(starts)))
    return levels


def _search(levels, left: np.ndarray, right: np.ndarray, distance: int):
    """Leaf pairs (i < j) within the distance under the given pairs of roots."""
    for depth in range(len(levels) - 1, 0, -1):
        _, _, first, end = levels[depth]
        mask, pattern, _, _ = levels[depth - 1]
        wide = end[right] - first[right]
        count = (end[left] - first[left]) * wide
        pair = np.repeat(np.arange(len(left)), count)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        one, two = first[left][pair] + at // wide[pair], first[right][pair] + at % wide[pair]
        keep = one < two if depth == 1 else one <= two
        one, two = one[keep], two[keep]
        differ = np.bitwise_count((pattern[one] ^ pattern[two]) & mask[one] & mask[two])
        near = differ <= distance
        left, right = one[near], two[near]
    keep = left < right
    return left[keep], right[keep]


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each index is connected to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(codes: np.ndarray, starts: np.ndarray, pairs, distance: int):
    """Spanning links (code, code) among the given pairs of roots."""
    levels = _tree(codes, starts)
    a, b = _search(levels, *pairs, distance)
    label = _forest(len(codes), a, b)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _inside(codes: np.ndarray, starts: np.ndarray, distance: int):
    """Spanning links inside every root, a few million leaf pairs at a time."""
    sizes = np.diff(np.append(starts, len(codes)))
    several = np.flatnonzero(sizes > 1)
    group = np.cumsum(sizes[several].astype(np.int64) ** 2) // PAIRS
    found = []
    for part in np.split(several, np.flatnonzero(np.diff(group)) + 1) if len(several) else ():
        size = sizes[part]
        begin = np.cumsum(size) - size
        index = np.repeat(starts[part] - begin, size) + np.arange(size.sum())
        roots = np.arange(len(part))
        found.append(_links(codes[index], begin, (roots, roots), distance))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_FOUND = "a bigint, b bigint, bucket bigint, mask bigint, pattern bigint, members binary"


def near_links(codes: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect all ``fingerprint`` values within ``distance`` bits.

    Not every near pair has a row: the rows of a group span it. Runs jobs.
    """
    def search(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            code = batch.column(1).to_numpy().view(np.uint64)
            runs = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            place = np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))
            starts = np.flatnonzero(place % NODE == 0)
            a, b = _inside(code, starts, distance)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none, none,
                 pa.nulls(len(a), pa.binary())],
                ["a", "b", "bucket", "mask", "pattern", "members"])
            # Buckets that may have members elsewhere: at the edges, or with several nodes.
            ends = np.append(starts[1:], len(code))
            own = bucket[starts]
            open_ = (own == bucket[0]) | (own == bucket[-1])
            open_[1:] |= own[1:] == own[:-1]
            open_[:-1] |= own[1:] == own[:-1]
            rows = []
            for s, e in zip(starts[open_], ends[open_]):
                every = np.bitwise_and.reduce(code[s:e])
                mask = ~(every ^ np.bitwise_or.reduce(code[s:e]))
                rows.append((int(bucket[s]), int(mask.view(np.int64)),
                             int(every.view(np.int64)), code[s:e].tobytes()))
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, *[pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]],
                     pa.array([r[3] for r in rows], pa.binary())],
                    ["a", "b", "bucket", "mask", "pattern", "members"])

    def across(batches):
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, two = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                a, b = _links(np.concatenate([one, two]), np.array([0, len(one)]),
                              (np.array([0]), np.array([1])), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    code = F.col("fingerprint")
    keyed = codes.select("fingerprint", F.explode(bucket_keys(code, distance)).alias("bucket"))
    ranked = keyed.select("bucket", "fingerprint", gray_rank(code).alias("rank"))
    ordered = ranked.repartitionByRange("bucket", "rank").sortWithinPartitions("bucket", "rank")
    found = stored(ordered.select("bucket", "fingerprint").mapInArrow(search, _FOUND), "gray-index")
    nodes = found.where("bucket IS NOT NULL").withColumn(
        "id", F.xxhash64("members"))
    other = nodes.select(*[F.col(c).alias(f"o_{c}") for c in ("bucket", "mask", "pattern", "members", "id")])
    differ = F.col("pattern").bitwiseXOR(F.col("o_pattern")).bitwiseAND(
        F.col("mask")).bitwiseAND(F.col("o_mask"))
    meet = nodes.join(other, (F.col("bucket") == F.col("o_bucket")) & (F.col("id") < F.col("o_id"))
                      & (F.bit_count(differ) <= distance))
    crossing = meet.select("members", "o_members").mapInArrow(across, "a bigint, b bigint")
    return found.where("a IS NOT NULL").select("a", "b").union(crossing)


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """Rows (key, fingerprint as 16 hex digits, component_id): one for each input row.

    ``component_id`` is the smallest key reachable over links, the row's own included.
    """
    prints = stored(fingerprints(df, key, text, width), "fingerprints")
    classes = stored(
        prints.where("key IS NOT NULL").groupBy("fingerprint").agg(F.min("key").alias("first")),
        "classes")
    parts = components(near_links(classes.select("fingerprint"), distance))
    rooted = classes.join(parts, classes["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Joined per class, where no key is hot, before the rows of hot classes come in.
    named = rooted.join(lowest, "root").select("fingerprint", "component_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint", "left").select(
        F.col("key").alias(key), hexed.alias("fingerprint"),
        F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """One row for each group of linked fingerprints, all its columns: that of the smallest
    key, of equal keys that of the smallest text hash.

    Rows are chosen, not keys: a key that stands at texts of several groups stays in each
    where it is the smallest. Rows without a key link nothing and stay; an empty table gives
    an empty one; long texts are fingerprinted whole.
    """
    row = unused(df, "_row_hash")
    marked = df.withColumn(row, row_hash(df))
    keyed = marked.where(F.col(key).isNotNull())
    one = F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("said"), F.col(row).alias("row"))
    texts = keyed.select(one.alias("one"), F.col(text).alias("text"))
    prints = stored(fingerprints(texts, "one", "text", width), "fingerprints")
    classes = stored(prints.groupBy("fingerprint").agg(F.min("key").alias("first")), "classes")
    parts = components(near_links(classes.select("fingerprint"), distance))
    rooted = classes.join(parts, classes["fingerprint"] == parts["node"], "left").select(
        "first", F.coalesce("root", "fingerprint").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias(key), F.col("first.row").alias(row))
    # Rows that are equal in all columns are one.
    kept = keyed.join(stay, [key, row], "left_semi").dropDuplicates([key, row])
    return kept.select(*df.columns).unionByName(df.where(F.col(key).isNull()))
