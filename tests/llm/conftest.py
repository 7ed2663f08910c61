import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "Gamma", "delta.", "éta", "the", "of", "über", "x1", "don't", "naïve", "7", "it's,"]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd spaces."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 12, 40, 200, 200, 900)]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(base)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, " \n\t ", "en", None, 4), (23, base[3], "en", "s1", 1), (23, base[3], "en", "s1", 1),
             (24, base[4][:300] + " other " + base[4][300:], "fr", "s1", 5), (None, base[2], "en", "s1", 3), (None, None, None, None, None),
             (25, prose(rng, 60_000), "en", "s2", 0), (26, "a  b\n c d  \x1c e\x85f \n", "en", "s2", 0), (27, base[1], "en", "s2", 0), (27, base[2], "en", "s2", 0),
             (28, "one two", "en", "s2", 7), (29, "Ça va? “Quotes” 日本語 \U0001f600 ok" * 3, "en", "s2", 7)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_rows(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
