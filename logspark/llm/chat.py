"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions.

Chat logs often hold a conversation once per answer, each time with all turns so far. A
conversation whose turns are the first turns of a longer one is dropped, and of equal ones
the one with the smallest id stays. What is left is rendered.

Every prefix of a conversation has a rolling hash: the sum, over its turns, of two 64-bit
hashes of place, role and text. Conversations with the same whole hash are one entry before
they meet the prefixes, so copies of one conversation or of one first turn never meet in
pairs; an anti-join on (length, hash) keeps the maximal ones.

A conversation is cut into parts of ``PART`` turn numbers; where more than ``PART`` rows share
such a range (equal or null turn numbers), they are ranked by a ranged sort and cut again by
rank. A part is gathered in one row and rendered there; places and running sums cross parts in
two levels, so a conversation with a third of all turns is spread over as many tasks as it has
parts, whatever its turn numbers are. The ranged sort deals rows out by turn, 64 characters of
the role and 256 of the text, and sorts by the whole values: only texts of one conversation
and turn number that all begin with the same 256 characters share a task, which spills.

Nulls and edge cases: turns without a conversation id are left out; a null turn number comes
first; turns with the same number follow each other by role and text; exact repeats of a
turn (all four columns equal) count once; a null role or text differs from an empty one and
is rendered as an empty one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

PART = 1024


def _marked(column: str) -> Column:
    """Text that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def parts_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, part, turns): the ordered turns of a part, at most ``PART``; parts are
    ordered structs (range of turn numbers, number inside it). Runs jobs that write tables."""
    number = F.col(turn).cast("bigint")
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.coalesce(F.floor(number / PART), F.lit(-(1 << 53))).alias("span"),
        number.alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    group = ["conv", "span"]
    crowded = stored(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select(*group), "crowded")
    calm = rows.join(crowded, group, "left_anti").withColumn("sub", F.lit(0).cast("bigint"))
    many = _numbered(rows.join(crowded, group, "left_semi"), group)
    return calm.unionByName(many).groupBy("conv", F.struct("span", "sub").alias("part")).agg(
        F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))  # nulls first


def _numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """The different rows with ``sub``, their rank by (turn, role, text) in the group over PART."""
    ranges = [*group, "turn", F.substring("role", 1, 64), F.substring("text", 1, 256)]
    placed = stored(
        rows.distinct().repartitionByRange(*ranges).sortWithinPartitions(*group, "turn", "role", "text")
        .withColumn("at", F.monotonically_increasing_id()), "ranked")
    # A task's rows of a group follow each other; the id's upper bits number the task.
    placed = placed.withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy(*group, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*group, "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    ranked = placed.join(starts, [*group, "task"])
    return ranked.withColumn("sub", F.floor((F.col("at") + F.col("shift")) / PART)).drop("task", "at", "shift")


def prefix_hashes(parts: DataFrame) -> DataFrame:
    """Rows (conv, length, a, b): the rolling hash of every prefix."""
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select("conv", "part", F.size("turns").alias("n"))
    starts = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    said = F.transform("turns", lambda t: F.xxhash64(
        t["role"].isNull(), F.coalesce(t["role"], F.lit("")),
        t["text"].isNull(), F.coalesce(t["text"], F.lit(""))))
    also = F.transform("turns", lambda t: F.xxhash64(
        F.coalesce(t["text"], F.lit("")), F.coalesce(t["role"], F.lit("")), F.lit("second")))
    turns = parts.select("conv", "part", F.posexplode(F.arrays_zip(said.alias("x"), also.alias("y"))).alias("at", "h"))
    place = (F.col("start") + F.col("at") + 1).cast("bigint")
    placed = turns.join(starts, ["conv", "part"]).select(
        "conv", "part", place.alias("length"),
        F.xxhash64(place, "h.x").cast("decimal(38,0)").alias("a"),
        F.xxhash64("h.y", place).cast("decimal(38,0)").alias("b"))
    totals = placed.groupBy("conv", "part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    bases = totals.select("conv", "part", *[
        F.coalesce(F.sum(t).over(before), F.lit(0)).cast("decimal(38,0)").alias(n) for t, n in (("ta", "ba"), ("tb", "bb"))])
    inside = Window.partitionBy("conv", "part").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv", "part", "length", F.sum("a").over(inside).alias("la"), F.sum("b").over(inside).alias("lb"))
    whole = lambda x, y: (F.col(x) + F.col(y)).cast("decimal(38,0)")
    return local.join(bases, ["conv", "part"]).select(
        "conv", "length", whole("la", "ba").alias("a"), whole("lb", "bb").alias("b"))


def maximal(hashes: DataFrame) -> DataFrame:
    """Rows (conv, n_turns, n_copies) of conversations that prefix no other."""
    lengths = hashes.groupBy("conv").agg(F.max("length").alias("length"))
    wholes = hashes.join(lengths, ["conv", "length"]).groupBy("length", "a", "b").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    first = wholes.select("conv", F.col("length").alias("n_turns"))
    # Only one of several equal conversations brings in its prefixes.
    proper = hashes.join(first, "conv").where(F.col("length") < F.col("n_turns")).select(
        "length", "a", "b").distinct()
    return wholes.join(proper, ["length", "a", "b"], "left_anti").select(
        "conv", F.col("length").alias("n_turns"), "n_copies")


def rendered(turns: Column) -> Column:
    """The turns between role markers; a marker inside a text is taken apart."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n"))), "")


def collapse(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conv, part, n_turns, n_copies, text): the maximal conversations, rendered.

    Parts of a conversation are numbered from 0 and follow each other; a conversation of
    ordinary length has one. Runs a job that writes the gathered turns.
    """
    parts = stored(parts_of(df, conv, turn, role, text), "turns")
    hashes = stored(prefix_hashes(parts), "prefixes")
    kept = maximal(hashes)
    number = F.row_number().over(Window.partitionBy("conv").orderBy("part")) - 1
    numbered = parts.select("conv", "part").withColumn("number", number)
    texts = parts.join(kept, "conv").select("conv", "part", "n_turns", "n_copies", rendered(F.col("turns")).alias("text"))
    return texts.join(numbered, ["conv", "part"]).select(
        F.col("conv").alias(conv), F.col("number").cast("bigint").alias("part"), "n_turns", "n_copies", "text")
