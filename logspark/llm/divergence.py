"""How far the sources of a language are from one another, by the terms they use.

A source of a language is a sparse row of term counts, and all rows of a language against
one another is a sparse matrix product. It is done row by row, as Gustavson's method does:
the postings of a stretch of terms, term-major, are an index in a task; each source walks its
own terms through the index and adds what it finds into one dense array with a place per
peer. No pair of postings becomes a row: a task sends out one sum per pair of sources.

A term that a source lacks is no zero, since every kept term has a smoothed share, so the
products are corrected. With f the difference of two shares, p0 and q0 the shares of a term
that does not occur, the sum over all kept terms is

    V f(p0, q0) + sum over own terms (f(p, q0) - f(p0, q0))
                + sum over the peer's terms (f(p0, q) - f(p0, q0))
                + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).

Only the last sum needs both rows. The others depend on a source's histogram of shares,
which is short: many terms occur equally often.

All numbers are whole: shares are floor(10^9 (count + 1) / (all + V)) + 1, and sums are kept
in two halves, so that they stay exact whatever the table's size.

Nulls and edge cases: a null text, language or source is an empty one; a text without terms
still makes its source occur; a language without kept terms gives pairs of value 0 and no
terms; a language with one source gives no pairs; repeated rows are documents of their own;
very long texts are read whole, very long terms are terms like others; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

UNIT = 1_000_000_000
ENTRIES = 400_000      # counts a task keeps before it sends them out
DOCS = (1 << 24) - 1   # documents it counts at most before it does
POSTINGS = 1_000_000   # postings of an index, about
# Bytes of terms, A-Z as a-z; all others part terms. Bytes of 128 and more are terms' bytes.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, as often as they stand there."""
    return (text or b"").translate(_FOLD).split()


def count_terms(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Rows (lang, source, term, count, docs), and one with a null term for each source.

    Counts are combined in the task that reads the texts before they are shuffled.
    """
    def work(batches):
        counts, size, read = {}, 0, 0

        def drain():
            nonlocal size
            for (language, group), own in counts.items():
                terms, both = [None, *own], np.array([0, *own.values()], np.int64)
                names = (pa.array([name], pa.string()) for name in (language, group))
                names = [n.take(pa.array(np.zeros(len(terms), np.int64))) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*names, pa.array(terms, pa.binary()), pa.array(both >> 24), pa.array(both & DOCS)],
                    ["lang", "source", "term", "count", "docs"])
            counts.clear()
            size = 0

        for batch in batches:
            for language, group, said in zip(*(c.to_pylist() for c in batch.columns)):
                own = counts.setdefault((language, group), {})
                before = len(own)
                # One number holds both: occurrences above, documents in the low 24 bits.
                for term, n in Counter(terms_of(said)).items():
                    own[term] = own.get(term, 0) + (n << 24) + 1
                size += len(own) - before
                read += 1
                if size > ENTRIES or read == DOCS:
                    yield from drain()
                    read = 0
        yield from drain()

    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = df.select(text_of(lang).alias("lang"), text_of(source).alias("source"), F.col(text).cast("binary").alias("text"))
    partial = found.mapInArrow(work, "lang string, source string, term binary, count bigint, docs bigint")
    return partial.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term in parts of ``UNIT``, as a long."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    below = (total + kept).cast("decimal(20,0)")
    return F.when(total + kept > 0, F.call_function("div", top, below)).otherwise(F.lit(0)).cast("bigint") + 1


def _apart(p: Column, q: Column) -> Column:
    """(p - q)^2 / q, rounded down; shares are at most 10^9 + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _apart_in_numpy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _common(postings: DataFrame) -> DataFrame:
    """Rows (lang, source, peer, high, low): the last sum of the module's formula.

    ``postings`` has (lang, term, source, p, p0); all postings of a term are together. A
    task's index holds whole terms of one language, about ``POSTINGS`` of them.
    """
    def products(lang, term, names, at, p, p0):
        """One index, and each of its sources walked through it."""
        zero = np.zeros(len(names), np.int64)
        zero[at] = p0
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        ends = np.append(starts[1:], len(term))
        which = np.repeat(np.arange(len(starts)), ends - starts)
        mine = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[mine], np.arange(len(names) + 1))
        for row, name in enumerate(names):
            own = mine[bounds[row]:bounds[row + 1]]
            begin, width = starts[which[own]], (ends - starts)[which[own]]
            # The postings of the source's terms, one term after the other.
            step = np.repeat(np.cumsum(width) - width, width)
            place = np.repeat(begin, width) + np.arange(len(step)) - step
            peer, q = at[place], p[place]
            here, none = np.repeat(p[own], width), zero[row]
            part = (_apart_in_numpy(here, q) - _apart_in_numpy(here, zero[peer])
                    - _apart_in_numpy(none, q) + _apart_in_numpy(none, zero[peer]))
            high, low = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            np.add.at(high, peer, part >> 32)
            np.add.at(low, peer, part & 0xFFFFFFFF)
            met = np.flatnonzero(np.bincount(peer, minlength=len(names)))
            met = met[met != row]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(met), pa.string()), pa.array([name] * len(met), pa.string()),
                 pa.array(names[met], pa.string()), pa.array(high[met]), pa.array(low[met])],
                ["lang", "source", "peer", "high", "low"])

    def work(batches):
        held, rows, last = [], 0, None

        def drain(parts):
            whole = pa.Table.from_batches(parts).combine_chunks()
            coded = lambda c: whole.column(c).combine_chunks().dictionary_encode()
            source, term = coded("source"), coded("term")
            names = np.array(source.dictionary.to_pylist(), object)
            numbers = [whole.column(c).to_numpy() for c in ("p", "p0")]
            yield from products(
                whole.column("lang")[0].as_py(), term.indices.to_numpy(), names, source.indices.to_numpy(), *numbers)

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, terms = batch.column("lang").to_pylist(), batch.column("term").to_pylist()
            first = 0
            for i in range(batch.num_rows):
                known = (langs[i - 1], terms[i - 1]) if i else last
                if known is None or (langs[i], terms[i]) == known:
                    continue
                # Between two terms the index may end; between two languages it must.
                if langs[i] != known[0] or rows + i - first >= POSTINGS:
                    yield from drain([*held, batch.slice(first, i - first)])
                    held, rows, first = [], 0, i
            held.append(batch.slice(first))
            rows += batch.num_rows - first
            last = (langs[-1], terms[-1])
        if held:
            yield from drain(held)

    ordered = postings.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.select("lang", "term", "source", "p", "p0").mapInArrow(
        work, "lang string, source string, peer string, high bigint, low bigint")


def audit(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = 3, top: int = 200,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: how far each other source of the language is, summed over all terms that
    stand in ``least`` of the language's documents. Part ``term``: the ``top`` terms of which
    the source has more than the language. Runs jobs; the texts are read once.
    """
    every = stored(count_terms(df, text, lang, source), "term-counts")
    known = every.where("term IS NOT NULL")
    lexicon = known.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(
        F.col("docs") >= least)
    kept = stored(known.join(lexicon.drop("docs"), ["lang", "term"]).drop("docs"), "kept-terms")
    # One row per source and per language; sources without kept terms count.
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    terms = kept.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("lang_count").alias("lang_total"))
    groups = every.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(
        terms, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "lang_total")])
    none = F.lit(0).cast("bigint")
    groups = stored(groups.withColumn("p0", _share(none, F.col("total"), F.col("kept"))), "sources")
    shares = stored(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", _share(F.col("count"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q")), "shares")

    high = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", high).where(F.col("rank") <= top)

    wide = lambda c: c.cast("decimal(38,0)")
    histogram = stored(shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("n")), "histograms")
    bare = groups.select("lang", "source", "p0", "kept")
    peers = bare.select("lang", F.col("source").alias("peer"), F.col("p0").alias("q0"))
    other = (F.col("source") != F.col("peer"))
    ends = bare.join(peers, "lang").where(other)
    baseline = ends.select("lang", "source", "peer", (wide(F.col("kept")) * wide(_apart(F.col("p0"), F.col("q0")))).alias("value"))
    own = histogram.join(peers, "lang").where(other).select("lang", "source", "peer", (wide(F.col("n")) * wide(
        _apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q0")))).alias("value"))
    theirs = histogram.select("lang", F.col("source").alias("peer"), F.col("p0").alias("q0"), F.col("p").alias("q"), "n")
    theirs = theirs.join(bare.drop("kept"), "lang").where(other).select("lang", "source", "peer", (wide(F.col("n")) * wide(
        _apart(F.col("p0"), F.col("q")) - _apart(F.col("p0"), F.col("q0")))).alias("value"))
    common = _common(shares).select("lang", "source", "peer", (
        wide(F.col("high")) * F.lit(1 << 32).cast("decimal(11,0)") + wide(F.col("low"))).alias("value"))
    # Each part is summed for itself, so that few rows of it are shuffled.
    sides = [p.groupBy("lang", "source", "peer").agg(F.sum(wide(F.col("value"))).alias("value")) for p in (own, theirs, common)]
    pairs = baseline.select("lang", "source", "peer", wide(F.col("value")).alias("value"))
    for side in sides:
        pairs = pairs.unionByName(side.withColumn("value", wide(F.col("value"))))
    pairs = pairs.groupBy("lang", "source", "peer").agg(F.sum("value").cast("bigint").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value")
    return pairs.withColumn("rank", high).unionByName(terms)
