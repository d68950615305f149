"""Sharding by weighted rendezvous hashing, in DataFrame functions.

Every shard draws a number for every key, and the key goes to the shard with the best draw.
A draw depends on nothing but the key and the shard's own number, so a new shard takes the
keys it draws best and no key moves between the old ones; a shard of twice the weight gets
twice the keys. ``shard_of`` is an expression over one row: nothing moves and nothing is
remembered to place a record.

Draws are 32-bit words of MD5 over the key and a group number, four shards a digest, so
other engines can repeat them.

``assign`` also numbers the records of each shard without gaps. Its narrow rows are ranged
once by (shard, key, size, checksum, a hash of the place), so a key or a text that a third
of all rows share, or one shard with most of them, is cut over as many tasks as it needs; a
slot is then the place in the task plus the counts of the tasks before.

Nulls and edge cases: a null key is a key of its own; a null text has no bytes and the
checksum of none, zero; rows with equal keys are in one shard, whatever their texts; equal
rows are interchangeable, each with a slot of its own; very long texts only give a length
and a checksum; an empty table gives an empty one; other columns are ignored by ``assign``
and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, unused

EXTRA = 8             # bytes a record takes beside its text
DRAWS = float(1 << 32)


def _draws(key: Column, count: int) -> list[Column]:
    """A 32-bit draw of each shard for the key, as a long."""
    said = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    digests = [F.md5(F.concat(said, F.lit(f"/{group}")).cast("binary")) for group in range(-(-count // 4))]
    return [F.conv(F.substring(digests[i // 4], 1 + 8 * (i % 4), 8), 16, 10).cast("bigint") for i in range(count)]


def shard_of(key: Column, weights: Sequence[float], more: Sequence[float] = ()) -> list[Column]:
    """The shard of a key, and its shard after the shards of the weights ``more`` are added
    one by one: ``1 + len(more)`` ints. Of equal draws the lower shard's counts.

    With u the draw as a fraction, a shard of weight w scores ln(u) / w; the largest wins.
    """
    every = [float(w) for w in (*weights, *more)]
    if not weights or min(every) <= 0 or max(every) == float("inf"):
        raise ValueError("there must be shards, and their weights positive and finite")
    equal = len(set(every)) == 1
    scored = []
    for i, (draw, weight) in enumerate(zip(_draws(key, len(every)), every)):
        # Equal weights leave the order of the draws as it is.
        score = draw if equal else F.log((draw + 0.5) / DRAWS) / weight
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("place")))
    best = scored[0] if len(weights) == 1 else F.greatest(*scored[:len(weights)])
    found = [best]
    for extra in scored[len(weights):]:
        found.append(F.greatest(found[-1], extra))
    return [-one["place"] for one in found]


def assign(
    df: DataFrame, key: str, text: str, weights: Sequence[float], grown: float | None = None
) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard): one for each input row.

    ``size`` is the UTF-8 bytes of the text plus 8, ``slot`` counts from 0 inside a shard in
    the order of key, size and checksum, ``grown_shard`` is the shard after one more of the
    weight ``grown`` is added (null without). Runs jobs; the texts are read once.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    shards = shard_of(F.col(key), weights, () if grown is None else (grown,))
    after = shards[1] if grown is not None else F.lit(None).cast("int")
    sized = stored(df.select(
        F.col(key).alias("key"), (F.length(said) + EXTRA).cast("bigint").alias("size"),
        F.crc32(said).alias("text_crc32"), shards[0].alias("shard"), after.alias("grown_shard"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place")), "sharded")
    order = [F.col("shard"), F.col("key").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("place")]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    # Ids count up from the partition's first one in the order of its rows.
    ranked = stored(ranged.select(
        "key", "size", "text_crc32", "shard", "grown_shard",
        F.monotonically_increasing_id().alias("id")), "ranked")
    part = F.shiftright(F.col("id"), 33)
    counts = ranked.groupBy("shard", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    bases = _before(counts)
    placed = ranked.withColumn("part", part).join(bases, ["shard", "part"])
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("id") - F.col("first") + F.col("base")).cast("bigint").alias("slot"), "grown_shard")


def _before(counts: DataFrame) -> DataFrame:
    """Rows (shard, part, first, base): how many rows of a shard stand in parts before.

    ``counts`` has at most a row for each task and each shard: ranged rows of a task belong
    to shards that follow one another.
    """
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str, spread: int = 8) -> None:
    """The whole rows as Parquet under ``path``/shard=N/.

    A shard is dealt over ``spread`` tasks by a hash of the rows' places, so neither a shard
    of great weight nor a key with many rows is one task.
    """
    shard, part = unused(df, "shard"), unused(df, "_part")
    placed = df.withColumn(shard, shard_of(F.col(key), weights)[0]).withColumn(
        part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(spread)))
    placed.repartition(len(weights) * spread, shard, part).drop(part).write.partitionBy(shard).parquet(path)
