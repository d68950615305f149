"""Documents with everything that may go wrong, as a table and as a folder of tables."""

import pytest

EXTRA = "score double, key string, size bigint, _text string, words array<string>, id bigint, predicted int, `row` int, offset string, secrets string, block int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion"


def with_extra(rows):
    return [(*r, None if r[1] is None else len(r[1]), 0.5, "k", 1, "t", ["w"], 9, 7, 3, "o", "s", 2) for r in rows]


ODD = with_extra([
    (1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (3, PLAIN + " now", "en", None),
    (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t ", "de", "b"), (7, "one", "fr", "b"),
    (8, "12345 67890 ###", "es", "c"), (None, PLAIN, "en", "a"), (None, None, None, None),
    (9, "ein langer text ohne ende und mit vielen worten " * 4000, "de", "c"),
    (10, "same line\nsame line\nsame line\n" * 20, "en", None),
    (11, "you are a stupid idiot", "en", "a"), (12, "é" * 3000, "fr", "c"),
])


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(spark, path, documents):
    """An sf folder with the given documents and few labels, some without a document."""
    documents.write.parquet(f"{path}/documents.parquet")
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 0), (10, 0, 0), (11, 0, 1), (11, 0, 0), (99, 1, 1), (None, 1, 1), (7, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd_folder(spark, odd, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd") / "sf", odd)


@pytest.fixture(scope="session")
def empty_folder(spark, empty, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty") / "sf"
    empty.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)
