"""Ordered computations without a one-task window.

Log order is global: a rule looks at the ten lines before a line, a curve needs a running
sum over all scores. A plain window over such an order puts every row into one task. The
helpers here cut the order into blocks of bounded size instead:

* ``line_index`` numbers rows without gaps, from block counts and a two-level running total;
* ``with_halo`` copies the few rows near a block edge into the neighbour block, so that a
  row frame can be computed inside blocks;
* ``running_totals`` gives running sums over any sortable key, by range buckets;
* ``exact_quantiles`` reads quantiles off those running sums.

No block, and so no task, holds more than the block size, however the rows are spread over
files or hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 2048
SPAN = 4096


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns here, once, whatever reads or filters them later.

    The optimizer pushes a filter below the projection that defines its column by
    repeating the definition. For a chain of regexes that multiplies the work. A generator
    over a one-element array stops it; it runs in the same stage and moves no data.
    """
    row = F.explode(F.array(F.struct(*df.columns))).alias("_row")
    return df.select(row).select("_row.*")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for key in keys:
        test = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def sums_along(table: DataFrame, pos: str, values, by=(), inclusive: bool = False) -> DataFrame:
    """Running sums over integer positions, unique per ``by`` but not dense.

    Two levels: totals of spans of positions, then sums inside a span. The one window
    without a partition key sees a row per span of positions. Gives ``cum_<value>``,
    without the row itself unless ``inclusive``.
    """
    spanned = table.withColumn("_span", F.floor(F.col(pos) / SPAN))
    totals = spanned.groupBy(*by, "_span").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = totals.select(
        *by, "_span",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values],
    )
    inside = Window.partitionBy(*by, "_span").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = spanned.select(
        *by, pos, "_span",
        *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_l_{v}") for v in values],
    )
    joined = null_safe_join(local, bases, [*by, "_span"])
    return joined.select(
        *by, pos, *[(F.col(f"_b_{v}") + F.col(f"_l_{v}")).alias(f"cum_{v}") for v in values]
    )


def line_index(
    df: DataFrame, order: str, by=(), name: str = "seq", block: int = BLOCK
) -> DataFrame:
    """Number the rows 0, 1, 2, ... along an integer column, inside each ``by`` group.

    Values of ``order`` are unique inside a group but may have gaps (blank lines). The
    rows are read twice, once for the block counts: number lines before parsing them.
    """
    by = list(by)
    keyed = df.withColumn("_blk", F.floor(F.col(order) / block))
    counts = keyed.groupBy(*by, "_blk").agg(F.count(F.lit(1)).alias("n"))
    starts = sums_along(counts, "_blk", ["n"], by)
    numbered = rank_in_place(keyed, [*by, "_blk"], order, starts, ["cum_n"])
    return numbered.select(
        *df.columns, (F.col("cum_n") + F.col("_rn") - 1).cast("bigint").alias(name)
    )


def rank_in_place(df: DataFrame, keys, order: str, facts: DataFrame, columns) -> DataFrame:
    """Rank rows inside their block and add facts about the block.

    The rows move once: rank and join use the same key, a struct, in which null equals
    null. The hint keeps a small input from being broadcast to the few rows of ``facts``,
    which would leave all later work to their few tasks.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = df.withColumn("_place", F.struct(*keys)).repartition(width, "_place")
    inside = Window.partitionBy("_place").orderBy(order)
    ranked = placed.withColumn("_rn", F.row_number().over(inside))
    known = facts.select(F.struct(*keys).alias("_place"), *columns)
    return ranked.hint("merge").join(known, "_place").drop("_place")


def by_block(df: DataFrame, by=()) -> DataFrame:
    """Place rows by block, in as many partitions as the session shuffles into.

    Windows over the block need no further shuffle. The number is given, so that AQE does
    not merge the partitions: what follows is work per row, not per byte.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(width, *by, "_blk")


def with_halo(
    df: DataFrame, seq: str, before: int = 0, after: int = 0, by=(), block: int = BLOCK
) -> DataFrame:
    """Add ``_blk`` and ``_own``: every row in its block, edge rows also in the next one.

    A row frame of ``before`` rows back and ``after`` rows ahead, computed per ``_blk``,
    equals the frame over the whole order for the rows with ``_own``.
    """
    block = max(block, before, after)
    own = F.floor(F.col(seq) / block)
    homes = F.array_distinct(F.array(
        own,
        F.floor((F.col(seq) + before) / block),
        F.floor((F.col(seq) - after) / block),
    ))
    copied = (
        df.withColumn("_home", own)
        .withColumn("_blk", F.explode(homes))
        .withColumn("_own", F.col("_blk") == F.col("_home"))
        .drop("_home")
    )
    return by_block(copied, by)


def block_window(seq: str, by=(), first: int = 0, last: int = 0):
    """The row frame [first, last] around a row, for a table that went through with_halo."""
    return Window.partitionBy(*by, "_blk").orderBy(seq).rowsBetween(first, last)


def block_order(seq: str, by=()):
    return Window.partitionBy(*by, "_blk").orderBy(seq)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_blk")


def range_bucket(df: DataFrame, key: str, buckets: int | None = None) -> Column:
    """A bucket number that grows with the key, from borders sampled by hash.

    The sample is the rows with the smallest key hash, 64 per bucket, so the borders are
    the same in every run. They enter the plan as a scalar subquery of bounded size.
    """
    if buckets is None:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = max(16, min(width, 2048))
    sample = df.select(key).orderBy(F.xxhash64(key)).limit(buckets * 64)
    borders = sample.agg(F.sort_array(F.collect_list(key)).alias("keys")).select(
        F.filter(F.col("keys"), lambda _, i: i % 64 == 63)
    )
    return borders.scalar()


def with_range_bucket(df: DataFrame, key: str, name: str = "_bucket", buckets=None) -> DataFrame:
    bordered = df.withColumn("_borders", range_bucket(df, key, buckets))
    return bordered.withColumn(
        name, F.size(F.filter(F.col("_borders"), lambda border: border <= F.col(key)))
    ).drop("_borders")


def running_totals(
    df: DataFrame, key: str, values, by=(), descending: bool = False, buckets=None
) -> DataFrame:
    """Inclusive running sums ``cum_<value>`` along a key that is unique inside ``by``."""
    by, values = list(by), list(values)
    bucketed = with_range_bucket(df, key, buckets=buckets)
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = bucketed.groupBy(*by, "_bucket").agg(
        *[F.sum(v).alias(f"_t_{v}") for v in values]
    )
    before = Window.partitionBy(*by).orderBy(way("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = totals.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(way(key)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = bucketed.select("*", *[F.sum(v).over(inside).alias(f"_l_{v}") for v in values])
    return null_safe_join(local, bases, [*by, "_bucket"]).select(
        *df.columns,
        *[(F.col(f"_b_{v}") + F.col(f"_l_{v}")).alias(f"cum_{v}") for v in values],
    )


def ranked_counts(df: DataFrame, value: str, by=(), weight: str | None = None) -> DataFrame:
    """Distinct values with their count ``n``, the count up to them ``cum_n`` and ``_size``.

    The value at 0-based rank r is the smallest one with cum_n > r. A row counts as often as
    its whole-number ``weight`` says; rows of weight 0 or null count not at all.
    """
    by = list(by)
    present = df.where(F.col(value).isNotNull())
    if weight is None:
        counts = present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    else:
        weighed = present.where(F.col(weight) > 0)
        counts = weighed.groupBy(*by, value).agg(F.sum(F.col(weight).cast("bigint")).alias("n"))
    ranked = running_totals(counts, value, ["n"], by)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    if by:
        return null_safe_join(ranked, sizes, by)
    return ranked.withColumn("_size", sizes.scalar())


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict, by=(), weight: str | None = None
) -> DataFrame:
    """One row per ``by`` group with linearly interpolated quantiles, exactly; a row with a
    ``weight`` stands for so many equal ones.

    ``quantiles`` maps an output name to a fraction. Equal values are counted first, then
    ranked by running totals, so no task holds the values of a group.
    """
    by = list(by)
    picks, out = [], []
    for name, fraction in quantiles.items():
        place = (F.col("_size") - 1) * F.lit(float(fraction))
        low, high = F.floor(place), F.ceil(place)
        picks += [
            F.min(F.when(F.col("cum_n") > low, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > high, F.col(value))).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_fr_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * F.col(f"_fr_{name}")).alias(name))
    return ranked_counts(df, value, by, weight).groupBy(*by).agg(*picks).select(*by, *out)


def hash_rank_filter(
    df: DataFrame, by, hash_col: str, wanted: Column, size: str = "_n", rank: str = "chosen"
) -> DataFrame:
    """Flag the ``wanted`` rows of each group with the smallest hash.

    ``hash_col`` is a hex digest; its first three digits cut a group into 4,096 even
    parts. Only part counts cross groups, and a rank is taken inside one part.
    ``wanted`` may use the group size, available as ``size``.
    """
    by = list(by)
    parts = df.withColumn("_part", F.conv(F.substring(hash_col, 1, 3), 16, 10).cast("int"))
    counts = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    starts = counts.select(
        *by, "_part",
        F.sum("_c").over(whole).alias(size),
        F.coalesce(
            F.sum("_c").over(
                whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0),
        ).alias("_before"),
    )
    ranked = rank_in_place(parts, [*by, "_part"], hash_col, starts, [size, "_before"])
    return ranked.withColumn(
        rank, F.col("_before") + F.col("_rn") <= wanted
    ).drop("_part", "_rn", "_before")
