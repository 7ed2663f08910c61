import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(docs, items, best=20):
    """(item number, item_id, rank, doc_id, score) by the definition; rows of equal score and id are interchangeable."""
    terms = [(d, Counter(TERM.findall((x or "").translate(LOWER)))) for d, x in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        asked, sums = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, c in terms:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                sums.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(sums)[:best], 1)]
    return Counter(out)


def found(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def odd_items(odd_rows):
    texts = ["The alpha ÉTA don't 7 7 7", odd_rows[3][1], odd_rows[5][1], "", None, "~~~ nothing-known-here", "日本語 ok", "alpha alpha beta", "the"]
    return [(i, x) for i, x in enumerate(texts)] + [(7, "delta of"), (7, "delta of"), (None, "gamma x1")]


@pytest.mark.parametrize("bits, bundle, most", [(11, 512, 2_000_000), (1, 3, 9)])
def test_odd_rows(spark, odd_docs, odd_rows, odd_items, monkeypatch, bits, bundle, most):
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "MOST_ITEM_TERMS", most)
    monkeypatch.setattr(lexical, "BLOCK_BITS", bits)
    items = spark.createDataFrame(odd_items, ITEMS).withColumn("score", F.lit("x")).withColumn("number", F.lit(1))
    docs = odd_docs.withColumnsRenamed({"lang": "rank", "source": "item", "n_chars": "row"})
    got = found(lexical.search(docs, items, best=4))
    assert got == brute([r[:2] for r in odd_rows], odd_items, 4)


def test_owners_keep_the_best(spark, sf, sf_rows, monkeypatch):
    """Sums are dropped between owners, never results."""
    monkeypatch.setattr(lexical, "SHARES", (1 / 200, 1 / 30, 1 / 5))
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert found(lexical.search(docs, items, best=5)) == brute(sf_rows, [tuple(r) for r in items.select("item_id", "text").collect()], 5)


def test_many_ties(spark):
    docs = [(i % 50, "one two three") for i in range(300)] + [(900, "three")] + [(1000 + i, "four") for i in range(400)]
    items = [(1, "one three three"), (2, "four")]
    got = found(lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEMS)))
    assert got == brute(docs, items)


def test_empty_tables(spark, odd_docs, no_docs, odd_items):
    items = spark.createDataFrame(odd_items, ITEMS)
    assert not found(lexical.search(no_docs, items))
    assert not found(lexical.search(odd_docs, spark.createDataFrame([], ITEMS)))
    assert not found(lexical.search(spark.createDataFrame([(1, " . "), (2, None)], "doc_id long, text string"), items))
