"""What several operators share: tables, folds, written intermediates, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

# The white space that separates words, as a Java class; bytes.split() uses the same six.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int):
    """Arrow batches cut into smaller ones, so that what is made of a batch stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that tells null from a skipped column."""
    parts = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*[x for part in parts for x in (part.isNull(), part)])


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def held_out(key: str, parts: int, remainder: int) -> Column:
    """Whether a row belongs to the held-out fold; rows without a key do not."""
    return F.coalesce(fold(key, parts) == remainder, F.lit(False))


def labelled_sample(
    labels: DataFrame, key: str, label: str, value: int, train: Column, most: int
) -> DataFrame:
    """Ids of at most ``most`` labelled rows of one class, those with the smallest hash.

    A key with several labels has the largest of them.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
    one = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    return one.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(most)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b) of longs: rows (node, root), root the smallest
    node that is reachable. Nodes without a link have no row.

    Large-star and small-star steps: each hangs neighbours on the smallest one known, so
    the number of rounds grows with the logarithm of the longest path. Links never leave
    the executors; a round is a written table.
    """
    edges = stored(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least).distinct(), name)
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == (state["n"], state["x"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state["n"], state["x"])
