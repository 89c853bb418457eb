import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from texts or (doc_id, text) pairs, with optional languages."""
    def make(rows, langs=None, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, langs[k] if langs else "en", None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA).repartition(parts, "doc_id")
    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The whole documents table at the smallest scale."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, junk and very long texts."""
    import random
    rng = random.Random(5)
    words = ["the", "of", "and", "ener", "eau", "é", "汉字", "x1", "mail@a.example.com", "1.2.3.4", "+1 (743) 555-3824",
             "4316522678525456", "<|endoftext|>", "don't", " ", "\n"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    passage = line(160)
    return ([None, "", None, " \n\t ", "a", "a", "!!!", "a" * 3000, "ab " * 700, "\n" * 50, passage, passage,
             line(30) + "\n" + passage, passage + "\n" + line(40), line(9000)] + [line(rng.randint(1, 120)) for _ in range(25)])
