import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: documents, and columns whose names an operator might use itself.
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", LongType()), StructField("size", LongType()), StructField("h", StringType()), StructField("kept", StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, None, "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977} and number {i}" for i in range(20_000))
    return make_docs([(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, long + " x"), (6, "one two three four five six"), (6, "one two three four five six"), (7, "One two  three four five six"), (None, "one two three four five six"), (8, "ünïcode 漢字 😀 text", None), (9, "a", "")])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
