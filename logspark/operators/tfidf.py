"""TF-IDF as long tables, and what is built on it: top terms, SVD, sentence vectors.

A vocabulary is a table of at most ``max_features`` rows, so it may be broadcast. Weights
are rows (id, term, term_index, weight); nothing is ever dense over the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from ..session import materialize
from .frames import settle

MAX_BROADCAST_TERMS = 100_000
WORDS = 250_000  # words counted or weighed together, about
FAN = 32     # triangles stacked together


def english_stop_words() -> list[str]:
    """The English list the vectoriser leaves out."""
    return list(P.ENGLISH_STOP_WORDS)


def words_of(text: Column, stop_words=()) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"({P.WORD}{{2,}})"), F.lit(1))
    if not stop_words:
        return words
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def terms_of(words: Column, ngrams=(1, 2)) -> Column:
    """Words and, if asked for, pairs of neighbouring words."""
    low, high = ngrams
    parts = [words] if low == 1 else []
    if high == 2:
        ahead = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        behind = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        parts.append(F.zip_with(behind, ahead, lambda a, b: F.concat_ws(" ", a, b)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _worded(df: DataFrame, columns, text: str, stop_words) -> DataFrame:
    """The columns and the words of each text, found once."""
    return settle(df.select(*columns, words_of(F.col(text), stop_words).alias("_words")))


def _in_rows(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch one after the other, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _parts(batch: pa.RecordBatch, column: int):
    """A batch cut where about ``WORDS`` words are together; a longer text is a part by itself."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        end = int(np.searchsorted(ends, ends[first] - sizes[first] + WORDS, side="right"))
        end = max(first + 1, end)
        yield batch.slice(first, end - first)
        first = end


def _counts(lists: pa.ListArray, ngrams) -> pa.RecordBatch:
    """(term, corpus_count, doc_count) of the texts of a batch."""
    flat, rows = _in_rows(lists)
    coded = flat.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    low, high = ngrams
    parts = []
    for length in range(low, high + 1):
        ids, row = code, rows
        if length == 2:
            beside = rows[1:] == rows[:-1]
            ids, row = (code[:-1] * len(words) + code[1:])[beside], rows[1:][beside]
        terms, at, often = np.unique(ids, return_inverse=True, return_counts=True)
        # A term counts once for each text it stands in.
        texts = np.bincount(np.unique(at * len(lists) + row) // max(len(lists), 1), minlength=len(terms))
        if length == 1:
            names = words.take(pa.array(terms))
        else:
            first, second = np.divmod(terms, max(len(words), 1))
            names = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
        parts.append((names.cast(pa.string()), often, texts))
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([p[0] for p in parts]), *[pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in (1, 2)]],
        ["term", "corpus_count", "doc_count"])


class Weigher:
    """A vocabulary ready to weigh batches of words: words and pairs are numbers."""

    def __init__(self, known: pd.DataFrame, ngrams, sublinear: bool):
        known = known.sort_values("term_index")
        self.terms = known["term"].tolist()
        self.index = known["term_index"].to_numpy(dtype=np.int64)
        self.idf = known["idf"].to_numpy(dtype=float)
        self.ngrams, self.sublinear = ngrams, sublinear
        split = [term.split(" ") for term in self.terms]
        self.words = sorted({word for words in split for word in words})
        number = {word: i for i, word in enumerate(self.words)}
        self.single = np.full(len(self.words), -1)
        pairs = []
        for place, words in enumerate(split):
            if len(words) == 1:
                self.single[number[words[0]]] = place
            else:
                pairs.append((number[words[0]] * len(self.words) + number[words[1]], place))
        self.pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)

    def weigh(self, lists: pa.ListArray):
        """(row, place in the vocabulary, weight), sorted, rows of unit length."""
        flat, rows = _in_rows(lists)
        code = pc.fill_null(pc.index_in(flat, value_set=pa.array(self.words, flat.type)), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        low, high = self.ngrams
        row, at = [], []
        if low == 1 and len(self.words):
            place = np.where(code >= 0, self.single[code], -1)
            row.append(rows[place >= 0])
            at.append(place[place >= 0])
        if high == 2 and len(self.pairs):
            both = (rows[1:] == rows[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
            pair, beside = (code[:-1] * len(self.words) + code[1:])[both], rows[1:][both]
            near = np.minimum(np.searchsorted(self.pairs[:, 0], pair), len(self.pairs) - 1)
            hit = self.pairs[near, 0] == pair
            row.append(beside[hit])
            at.append(self.pairs[near[hit], 1])
        size = max(len(self.terms), 1)
        both = np.concatenate(row) * size + np.concatenate(at) if row else np.zeros(0, np.int64)
        found, tf = np.unique(both, return_counts=True)
        row, at = np.divmod(found, size)
        weight = (np.log(tf) + 1 if self.sublinear else tf) * self.idf[at]
        norm = np.sqrt(np.bincount(row, weight * weight, len(lists)))
        return row, at, weight / norm[row]


def weigher(vocabulary: DataFrame, max_features: int, ngrams=(1, 2), sublinear: bool = True) -> Weigher:
    """The vocabulary, read now; more than ``max_features`` terms are an error."""
    known = vocabulary.select("term", "term_index", "idf").limit(max_features + 1).toPandas()
    if len(known) > max_features:
        raise ValueError(f"more than {max_features} terms; raise max_features")
    return Weigher(known, ngrams, sublinear)


def tfidf_fit(
    df: DataFrame, key: str, text: str, max_features: int = 5000, ngrams=(1, 2),
    min_df: int = 1, max_df: float = 0.95, stop_words=None,
) -> DataFrame:
    """The vocabulary: term, term_index, corpus count, document count and idf.

    Keeps the ``max_features`` most frequent terms among those in at least ``min_df``
    documents and at most the share ``max_df`` of them; ties by term. A row is a document.
    Terms are counted batch by batch where the texts are; only counts per term move.
    """
    stop_words = english_stop_words() if stop_words is None else list(stop_words)
    total = df.agg(F.count(F.lit(1)))

    def count(batches):
        for batch in batches:
            for part in _parts(batch, 0):
                yield _counts(part.column(0), ngrams)

    counted = _worded(df, [], text, stop_words).mapInArrow(
        count, "term string, corpus_count bigint, doc_count bigint")
    counted = counted.groupBy("term").agg(
        F.sum("corpus_count").alias("corpus_count"), F.sum("doc_count").alias("doc_count")
    ).withColumn("_n", total.scalar())
    kept = counted.where(
        (F.col("doc_count") >= min_df) & (F.col("doc_count") <= F.col("_n") * F.lit(max_df))
    ).orderBy(F.desc("corpus_count"), "term").limit(max_features)
    index = F.row_number().over(Window.orderBy("term")) - 1  # at most max_features rows
    idf = F.log((F.col("_n") + 1) / (F.col("doc_count") + 1)) + 1
    return kept.select(
        "term", index.alias("term_index"), "corpus_count", "doc_count", idf.alias("idf")
    )


def tfidf_transform(
    df: DataFrame, vocabulary: DataFrame, key: str, text: str, ngrams=(1, 2),
    stop_words=None, sublinear: bool = True, max_features: int = 5000,
) -> DataFrame:
    """Unit-length TF-IDF weights, rows (key, term, term_index, weight).

    A row is a document; a text without known terms has no rows. The weights are made where
    the text is, without a shuffle; the vocabulary, of at most ``max_features`` terms, is
    read when this is called.
    """
    made = _vectors(df, vocabulary, key, text, ngrams, stop_words, sublinear, max_features, True)
    zipped = F.arrays_zip("term", "term_index", "weight")
    return made.toDF(key, "term_index", "weight", "term").select(key, F.inline(zipped).alias("term", "term_index", "weight"))


def tfidf_vectors(
    df: DataFrame, vocabulary: DataFrame, key: str, text: str, ngrams=(1, 2),
    stop_words=None, sublinear: bool = True, max_features: int = 5000,
) -> DataFrame:
    """(key, positions, values) of every text: unit-length weights, sorted by position.

    Everything happens in the row, without a shuffle. The vocabulary goes to the workers;
    more than ``max_features`` terms are an error. A text without known terms has empty
    arrays. Reads the vocabulary when called.
    """
    return _vectors(df, vocabulary, key, text, ngrams, stop_words, sublinear, max_features, False)


def _vectors(df, vocabulary, key, text, ngrams, stop_words, sublinear, max_features, named: bool) -> DataFrame:
    """(key, positions, values) and, if ``named``, the terms."""
    stop_words = english_stop_words() if stop_words is None else list(stop_words)
    shared = df.sparkSession.sparkContext.broadcast(weigher(vocabulary, max_features, ngrams, sublinear))

    def weigh(batches):
        known = shared.value
        for whole in batches:
            for batch in _parts(whole, 1):
                row, at, weight = known.weigh(batch.column(1))
                count = np.bincount(row, minlength=batch.num_rows)
                ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                columns = [pa.array(known.index[at], pa.int32()), pa.array(weight, pa.float64())]
                if named:
                    columns.append(pa.array(known.terms, pa.string()).take(pa.array(at)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.ListArray.from_arrays(ends, c) for c in columns]],
                    [key, "positions", "values", *(["terms"] if named else [])])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, positions array<int>, values array<double>"
    return _worded(df, [key], text, stop_words).mapInArrow(
        weigh, schema + (", terms array<string>" if named else ""))


def top_terms(weights: DataFrame, documents: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` terms with the highest mean weight over all documents."""
    total = documents.agg(F.count(F.lit(1)))
    summed = weights.groupBy("term").agg(F.sum("weight").alias("_sum"))
    return summed.select(
        "term", (F.col("_sum") / total.scalar()).alias("mean_weight")
    ).orderBy(F.desc("mean_weight"), "term").limit(k)


def sparse_vectors(weights: DataFrame, key: str) -> DataFrame:
    """Weights of a text as two arrays, positions and values, sorted by position."""
    pairs = F.sort_array(F.collect_list(F.struct("term_index", "weight")))
    return weights.groupBy(key).agg(pairs.alias("_p")).select(
        key, F.col("_p.term_index").alias("positions"), F.col("_p.weight").alias("values")
    )


def _blocks(batch: pd.DataFrame):
    """A batch of sparse rows as dense blocks (first, end, positions, block), the columns
    those that occur; a block has about 8,192 weights and 256 rows at most, a longer row is one by itself."""
    sizes = batch["positions"].map(len).to_numpy()
    ends = np.cumsum(sizes)
    first = 0
    while first < len(batch):
        start = ends[first] - sizes[first]
        end = max(first + 1, int(np.searchsorted(ends, start + 8192, side="right")))
        end = min(end, first + 256)
        part = batch.iloc[first:end]
        at = np.concatenate(part["positions"].to_numpy()).astype(np.int64)
        used, place = np.unique(at, return_inverse=True)
        block = np.zeros((end - first, len(used)))
        block[np.repeat(np.arange(end - first), sizes[first:end]), place] = np.concatenate(part["values"].to_numpy())
        yield first, end, used, block
        first = end


def _gram_times(vectors: DataFrame, basis: np.ndarray) -> np.ndarray:
    """X'X times a thin basis, X being the weight matrix. One Spark job.

    A task multiplies blocks of its rows, two matrix products a block, and adds them up; the
    sums per term are added by groups of terms. There are no more tasks than cores, each
    reading several partitions: what moves is at most a matrix of vocabulary size times basis
    width per core, what comes back one such matrix, however many rows there are.
    """
    size, width = basis.shape
    vectors = vectors.coalesce(vectors.sparkSession.sparkContext.defaultParallelism)
    shared = vectors.sparkSession.sparkContext.broadcast(basis)

    def partial(batches):
        sums, seen = np.zeros((size, width)), np.zeros(size, dtype=bool)
        for batch in batches:
            for _, _, used, block in _blocks(batch):
                sums[used] += block.T @ (block @ shared.value[used])
                seen[used] = True
        terms = np.flatnonzero(seen)
        yield pd.DataFrame({"term_index": terms, "part": list(sums[terms])})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = np.stack(group["part"].to_numpy())
        terms, where = np.unique(group["term_index"].to_numpy(), return_inverse=True)
        total = np.zeros((len(terms), width))
        np.add.at(total, where, parts)
        return pd.DataFrame({"term_index": terms, "part": list(total)})

    schema = "term_index bigint, part array<double>"
    rows = vectors.select("positions", "values").mapInPandas(partial, schema)
    bucket = F.floor(F.col("term_index") / 256)
    added = rows.groupBy(bucket.alias("_b")).applyInPandas(add, schema).toPandas()
    result = np.zeros((size, width))
    if len(added):
        result[added["term_index"].to_numpy(dtype=int)] = np.stack(added["part"].to_numpy())
    shared.unpersist()
    return result


def _triangle(vectors: DataFrame, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of X times the basis, a tall and thin matrix.

    Every task keeps only the triangle of the rows it has seen; triangles are stacked and
    decomposed again, ``FAN`` at a time, until few are left. The Gram matrix, which squares
    the spread of the singular values, is never made.
    """
    width = basis.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(basis)
    schema = "part bigint, rows array<double>"

    def partial(batches):
        held = np.zeros((0, width))
        for batch in batches:
            for _, _, used, block in _blocks(batch):
                held = np.vstack([held, block @ shared.value[used]])
                if len(held) >= 4 * width:
                    held = np.linalg.qr(held, mode="r")
        yield pd.DataFrame({"part": [0], "rows": [np.linalg.qr(held, mode="r").ravel()]})

    def stack(group: pd.DataFrame) -> pd.DataFrame:
        whole = np.vstack([r.reshape(-1, width) for r in group["rows"]])
        return pd.DataFrame({"part": [group["part"].iloc[0]], "rows": [np.linalg.qr(whole, mode="r").ravel()]})

    left = materialize(vectors.select("positions", "values").mapInPandas(partial, schema).withColumn(
        "part", F.spark_partition_id().cast("bigint")))
    number = left.count()
    while number > FAN:
        left = left.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(stack, schema)
        left = materialize(left)
        fewer = left.count()
        if fewer == number:
            break
        number = fewer
    found = [np.asarray(r["rows"]).reshape(-1, width) for r in left.orderBy("part").collect()]
    shared.unpersist()
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, width))


def svd_components(
    vectors: DataFrame, size: int, k: int, passes: int = 5, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (``size`` x ``k``) and singular values of the weight matrix.

    Randomised subspace iteration: ``passes`` jobs over the rows, each multiplying the Gram
    matrix with a basis a little wider than ``k``, and one for the triangle whose singular
    values are those of the rows.
    """
    width = min(k + 10, size)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))
    for _ in range(passes):
        basis, _ = np.linalg.qr(_gram_times(vectors, basis))
    _, found, turned = np.linalg.svd(_triangle(vectors, basis), full_matrices=True)
    values = np.zeros(width)
    values[:len(found)] = found
    components = basis @ turned[:k].T
    # The largest entry of a component is positive, so that signs do not depend on chance.
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    return components * np.where(signs == 0, 1, signs), values[:k]


def project(vectors: DataFrame, key: str, components: np.ndarray) -> DataFrame:
    """The coordinates of every text along the components, as ``features``."""
    shared = vectors.sparkSession.sparkContext.broadcast(components)
    kind = vectors.schema[key].dataType.simpleString()

    def coordinates(batches):
        matrix = shared.value
        for batch in batches:
            made = np.zeros((len(batch), matrix.shape[1]))
            for first, end, used, block in _blocks(batch):
                made[first:end] = block @ matrix[used]
            yield pd.DataFrame({key: batch[key], "features": list(made)})

    return vectors.mapInPandas(coordinates, f"{key} {kind}, features array<double>")


def scaler_fit(df: DataFrame, vector: str) -> DataFrame:
    """Rows (dim, mean, std): mean and population deviation of each dimension."""
    long = df.select(F.posexplode(vector).alias("dim", "_x"))
    return long.groupBy("dim").agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))


def scale(df: DataFrame, vector: str, scaler: DataFrame, name: str | None = None) -> DataFrame:
    """Each dimension minus its mean over its deviation; constant ones give 0."""
    ordered = scaler.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    scaled = F.zip_with(
        F.col(vector), F.col("_stats"),
        lambda x, s: (x.cast("double") - s["mean"])
        / F.when(s["std"] == 0, 1.0).otherwise(s["std"]),
    )
    return df.withColumn("_stats", ordered.scalar()).withColumn(name or vector, scaled).drop("_stats")


def standardize(
    df: DataFrame, vector: str, name: str | None = None, fit_on: DataFrame | None = None
) -> DataFrame:
    """Scaled by mean and deviation of ``fit_on`` (the training part), else of the table."""
    return scale(df, vector, scaler_fit(df if fit_on is None else fit_on, vector), name)


def svd_features(vectors: DataFrame, key: str, size: int, k: int = 300) -> DataFrame:
    """Truncated SVD coordinates of ``tfidf_vectors``, standardised. Runs the SVD jobs."""
    vectors = materialize(vectors)
    components, _ = svd_components(vectors, size, min(k, size))
    return standardize(materialize(project(vectors, key, components)), "features")


def word_vectors(vocabulary: DataFrame, dim: int = 300) -> DataFrame:
    """Non-zero entries of each word's vector: character codes and three shape slots."""
    characters = F.slice(F.split("term", ""), 1, dim - 3)
    entries = F.concat(
        F.transform(characters, lambda c, i: F.struct(
            i.cast("int").alias("dim"), (F.ascii(c) / F.lit(255.0)).alias("value"))),
        F.array(
            F.struct(F.lit(dim - 3).alias("dim"), (F.length("term") / F.lit(20.0)).alias("value")),
            F.struct(F.lit(dim - 2).alias("dim"),
                     F.col("term").contains("@").cast("double").alias("value")),
            F.struct(F.lit(dim - 1).alias("dim"),
                     F.col("term").rlike(r"^\p{Nd}+$").cast("double").alias("value")),
        ),
    )
    return vocabulary.select("term", F.inline(entries)).where(F.col("value") != 0)


def sentence_embedding(
    weights: DataFrame, vocabulary: DataFrame, key: str, dim: int = 300,
    max_features: int = 5000,
) -> DataFrame:
    """The TF-IDF weighted mean of word vectors, as rows (id, dim, value) without zeros."""
    vectors = word_vectors(vocabulary, dim)
    if max_features <= MAX_BROADCAST_TERMS:
        vectors = F.broadcast(vectors)
    total = F.sum("weight").over(Window.partitionBy(key))
    shares = weights.select(key, "term", (F.col("weight") / total).alias("_share"))
    return shares.join(vectors, "term").groupBy(key, "dim").agg(
        F.sum(F.col("_share") * F.col("value")).alias("value")
    )
