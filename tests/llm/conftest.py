import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls, empty and odd texts, ties and repeated rows that every operator must take.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (None, "no id here at all"), (None, None), (6, "é ü 日本 😀 <|endoftext|> x"),
    (7, "same text here for two"), (8, "same text here for two"), (9, "repeated row"), (9, "repeated row"), (10, "long " * 30_000), (11, "A\x00b\x1cc\x85d\u2028e"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns named like those that operators make."""
    names = ["block", "ids", "sizes", "at", "times", "pre", "occurrence", "shard", "first", "n", "o0", "bucket", "digest", "offset", "length", "score", "kept", "n_words", "base_failed", "mark", "words", "node", "kind", "a.b"]
    return odd.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
