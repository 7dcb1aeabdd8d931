import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text[, source[, lang]]) rows."""
    def make(*rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def words():
    """A long text of words that do not repeat by chance."""
    def make(seed, n, size=50_000):
        import random

        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(size)}" for _ in range(n))

    return make
