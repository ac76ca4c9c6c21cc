import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """``docs_of([(doc_id, text), ...])``: a documents table; longer tuples fill lang and source too."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, one id with two texts."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, long, "en", "a"), (5, "one two three", "en", "a"), (5, "one two three", "en", "a"), (6, "x " * 40, None, None), (6, "another text of this id", "de", None), (None, "a text without an id", "en", "b"), (None, None)])


@pytest.fixture(scope="session")
def nothing(docs_of, spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
