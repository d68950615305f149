"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions.

Every source has a target number of words. Its documents, shuffled by a hash, lie end to end
and are cut into equal blocks. Slot k of the schedule stands at the k-th point of the golden
ratio sequence, mapped through the cumulative shares of the sources: any stretch of the
schedule holds each source close to its share. The r-th slot of a source takes its block r,
over and over, at most ``most`` times each. Documents join the slots by block; what a
document gives is the sum of its parts of the blocks taken.

No task holds a source: running sums go by hash ranges inside a source, ranks of slots by
stretches of the schedule, and a source's stretch of the unit interval by equal cells, so a
source with a third of all words is spread like any other.

Nulls and edge cases: a null or empty text has size 0 and nothing is taken of it; a null
source is a source of its own, the last; a null key is a key like others, and documents with
equal keys are placed by their texts; equal rows are interchangeable and told apart by a
number; a very long text spans many blocks; an empty table gives an empty one; a source
without words has target 0; other columns pass through ``mix`` and are ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.frames import null_safe_join
from .common import SPACE, row_hash, stored, unused

GOLDEN = 0x9E3779B97F4A7C15  # the golden ratio's fraction, in parts of 2^64, odd
STRETCH = 4096   # slots ranked together
CELLS = 1024     # equal cells of the unit interval
SHARE = 20_000   # rows of a source summed together, about


def size_of(text: str) -> Column:
    """The number of words."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(whole, SPACE + "+"), "")).cast("bigint")


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """Rows (number, source, source_size, target) from rows (source, size).

    The sources, by code point with null last, weigh ``weights`` in turn and share all
    words; a target stops at ``most`` times its source and the rest goes to the others.
    Each round of the loop is one aggregation; at least one source stops in it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source. Sources are counted in order by ranges, not in one window.
    ranged = by.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(
        F.col("source").asc_nulls_last())
    numbered = stored(ranged.select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "sources")
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("_part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("_id") - F.col("first") + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    known = stored(numbered.join(starts, "_part").select(
        place.alias("number"), "source", "source_size", weight.alias("weight"),
        (F.col("source_size") * most).cast("double").alias("cap")), "weights")
    total = float(known.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        stopped = F.col("cap") <= F.col("weight") * F.lit(level)
        left = known.agg(
            F.sum(F.when(~stopped, F.col("weight"))).alias("w"),
            F.sum(F.when(stopped, F.col("cap"))).alias("c")).first()
        if not left["w"]:
            break
        new = (total - (left["c"] or 0.0)) / left["w"]
        if new <= level:
            break
        level = new
    return known.select("number", "source", "source_size", F.least(
        F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _offsets(sized: DataFrame) -> DataFrame:
    """Where each document of a source begins when they lie end to end in hash order."""
    total = sized.count()
    parts = max(1, -(-total // SHARE))
    hashed = F.col("order")
    # The hash as a fraction of the unit interval, cut into equal parts in the same order.
    spread = ((hashed / F.lit(float(1 << 63))) + 1.0) / 2.0
    rows = sized.where("size > 0").withColumn("h", hashed).withColumn(
        "part", F.least(F.floor(spread * parts), F.lit(parts - 1)))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("h", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    local = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return null_safe_join(local, bases, ["source", "part"]).select(
        "row", "key", "source", "size", (F.col("base") + F.col("inner")).cast("bigint").alias("offset"))


def schedule(planned: DataFrame, most: int = 3) -> DataFrame:
    """Rows (source, slot, rank): the slots in order and each slot's rank in its source.

    ``planned`` has a row per source: number of its blocks and how many slots it needs.
    """
    needs = planned.where("slots > 0")
    total = needs.agg(F.sum("slots").alias("s")).first()["s"] or 0.0
    count = int(total + 0.5)
    spark = planned.sparkSession
    # Cumulative shares: a running sum over sources, by number, in two levels.
    low = Window.partitionBy("group").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    grouped = needs.withColumn("group", F.floor(F.col("number") / STRETCH))
    sums = grouped.groupBy("group").agg(F.sum("slots").alias("n"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row per 4,096 sources
    bases = sums.select("group", F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("base"))
    begun = grouped.join(bases, "group").withColumn(
        "from", (F.col("base") + F.coalesce(F.sum("slots").over(low), F.lit(0.0))) / F.lit(total or 1.0))
    spans = begun.select("number", "blocks", "from",
                         (F.col("from") + F.col("slots") / F.lit(total or 1.0)).alias("to"))
    cells = max(CELLS, count // STRETCH)
    cell = lambda x: F.least(F.greatest(F.floor(x * cells), F.lit(0)), F.lit(cells - 1))
    spread = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))))
    # Whole numbers modulo 2^64: neighbours stay apart however many slots there are.
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    point = (F.col("id").cast("decimal(17,0)") * number(GOLDEN) + number(GOLDEN // 2)) % number(1 << 64)
    slots = spark.range(count).select(
        F.col("id").alias("slot"), (point.cast("double") / F.lit(2.0 ** 64)).alias("x"))
    slots = slots.withColumn("cell", cell(F.col("x")))
    # Neighbouring spans share their border, so each point falls into one of them; the
    # first begins at zero and the rounding of the last border is left open.
    last = spans.agg(F.max("to")).first()[0] or 1.0
    inside = (F.col("x") >= F.col("from")) & ((F.col("x") < F.col("to")) | (F.col("to") >= F.lit(last)))
    chosen = slots.join(spread, "cell").where(inside).select("number", "blocks", "slot")
    staged = chosen.withColumn("part", F.floor(F.col("slot") / STRETCH))
    many = staged.groupBy("number", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = many.select("number", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("number", "part").orderBy("slot")
    ranked = staged.withColumn("inner", F.row_number().over(inner) - 1).join(bases, ["number", "part"])
    rank = (F.col("base") + F.col("inner")).cast("bigint")
    return ranked.select("number", "blocks", "slot", rank.alias("rank")).where(
        F.col("rank") < F.col("blocks") * most)


def plan(
    df: DataFrame, key: str, text: str, source: str, weights=(5, 2, 1), most: int = 3,
    block: int = 64, least: int = 256,
) -> DataFrame:
    """Rows (key, source, size, source_size, target, taken): one for each input row.

    A block has ``block`` words, or fewer where a source would have under ``least`` blocks.
    Runs jobs; the texts are read once.
    """
    marked = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"), size_of(text).alias("size"),
        row_hash(df.select(key, text, source)).alias("h"))
    return _taken(_ordered(marked), weights, most, block, least).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken")


def _ordered(marked: DataFrame) -> DataFrame:
    """Rows (row, key, source, size, h) with ``order``, a hash that is the same wherever the
    rows stand: of h, and of a number that tells rows of one h apart.

    The numbers come in two levels, by the partitions the rows stand in, then inside.
    """
    hashed = stored(marked.withColumn("part", F.shiftright("row", 33)), "hashes")
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.groupBy("h").agg(F.sum("n").alias("all")).where("all > 1").select("h")
    bases = counts.join(repeated, "h", "left_semi").select(
        "h", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("h", "part").orderBy("row")
    numbers = hashed.select("row", "h", "part").join(bases, ["h", "part"]).select(
        "row", (F.col("base") + F.row_number().over(inside) - 1).cast("bigint").alias("number"))
    ordered = hashed.join(numbers, "row", "left").select(
        "row", "key", "source", "size",
        F.xxhash64("h", F.coalesce("number", F.lit(0).cast("bigint"))).alias("order"))
    return stored(ordered, "sizes")


def _taken(sized: DataFrame, weights=(5, 2, 1), most: int = 3, block: int = 64, least: int = 256) -> DataFrame:
    """The plan of written rows (key, source, size, order, row), shuffled by ``order``."""
    goal = targets(sized, weights, most)
    width = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / least))).cast("bigint")
    planned = stored(goal.select(
        "*", width.alias("width"), F.ceil(F.col("source_size") / width).cast("bigint").alias("blocks"),
        (F.col("target") / width).alias("slots")), "targets")
    slots = schedule(planned, most)
    takes = slots.groupBy("number", (F.col("rank") % F.col("blocks")).alias("block")).agg(
        F.count(F.lit(1)).alias("times"))
    placed = null_safe_join(_offsets(sized), planned.select("source", "number", "width"), ["source"])
    end = F.col("offset") + F.col("size")
    pieces = placed.withColumn("block", F.explode(F.sequence(
        F.expr("offset div width"), F.expr("(offset + size - 1) div width"))))
    words = F.least(end, (F.col("block") + 1) * F.col("width")) - F.greatest(F.col("offset"), F.col("block") * F.col("width"))
    taken = pieces.join(takes, ["number", "block"]).groupBy("row").agg(
        F.sum(words * F.col("times")).cast("bigint").alias("taken"))
    known = null_safe_join(sized, planned.select("source", "source_size", "target"), ["source"])
    return known.join(taken, "row", "left").select(
        "key", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))


def mix(df: DataFrame, key: str, text: str, source: str, **settings) -> DataFrame:
    """The documents of the mix, whole: each as often as the plan takes it, rounded, with
    all columns. A document of which less than half is taken is not in the mix.

    The shuffle follows the hash of key, text and the other columns, so the same rows give
    the same mix wherever they stand. Equal rows are told apart by a number.
    """
    mark = unused(df, "_mix_row")
    marked = stored(df.withColumn(mark, F.monotonically_increasing_id()), "to-mix")
    planned = _taken(_ordered(marked.select(
        F.col(mark).alias("row"), F.col(mark).alias("key"), F.col(source).cast("string").alias("source"),
        size_of(text).alias("size"), row_hash(df).alias("h"))), **settings)
    copies = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    times = unused(df, "_mix_copies")
    chosen = planned.select(F.col("key").alias("_r"), copies.alias(times)).where(F.col(times) > 0)
    joined = marked.join(chosen, marked[mark] == chosen["_r"])
    repeated = joined.select(*[marked[c] for c in df.columns], F.explode(F.sequence(F.lit(1), chosen[times])))
    return repeated.select(*df.columns)
