"""Whole-text similarity against plain Python, and labels that must not depend on how the edits are counted."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import labelers as L
from riskloom.operators.similarity import gram_similarity, with_similarity

WORDS = ["the", "The", "rate", "of", "loss", "é", "in", "2020,", "fell", "rose", "by", "$3"]


def made_pairs():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        a = [rng.choice(WORDS) for _ in range(rng.choice([0, 1, 4, 30, 120]))]
        b = [w for w in a if rng.random() < 0.8] + [rng.choice(WORDS) for _ in range(rng.choice([0, 2, 9]))]
        rows.append((i, " ".join(a), "  ".join(b)))
    return [*rows, (900, None, "x"), (901, "x", None), (902, "", ""), (903, " \n", "x"), (904, "x y", "x y")]


def plain_grams(text, n):
    words = re.findall(r"[^\s]+", text)
    if not words:
        return Counter()
    return Counter(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


@pytest.mark.parametrize("n", [1, 3])
def test_gram_similarity(spark, n):
    rows = made_pairs()
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)
    got = {r.id: (r.dice, r.cosine) for r in gram_similarity(df, ["id"], "a", "b", n).collect()}
    want = {}
    for i, a, b in rows:
        if a is None or b is None:
            continue
        x, y = plain_grams(a, n), plain_grams(b, n)
        size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        both = not x and not y
        want[i] = (1.0 if both else 2 * (x & y).total() / (x.total() + y.total()),
                   1.0 if both else sum(x[g] * y[g] for g in x) / size if size else 0.0)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12), rows[i]


def test_with_similarity_keeps_every_row(spark):
    df = spark.createDataFrame(made_pairs(), "id int, a string, b string")
    got = with_similarity(df, ["id"], F.col("a"), F.col("b"), "s").collect()
    assert len(got) == 125 and {r.id for r in got if r.s is None} == {900, 901}


def test_long_pairs_take_seconds(spark):
    """A million characters a side: grams, and bounds that rule a pair out without a comparison."""
    rng = random.Random(4)
    a = " ".join(rng.choice(WORDS) + str(rng.randrange(2000)) for _ in range(125_000))
    b = a[:500_000] + "zzz" + a[500_050:]
    df = spark.createDataFrame([(1, a, b)], "id int, a string, b string")
    start = time.time()
    assert gram_similarity(df, ["id"], "a", "b").first().dice > 0.999
    short, none = df.select(tx.edit_at_least(F.col("a"), F.substring("b", 1, 300_000), F.lit(0.4)),
                            tx.edit_at_least(F.col("a"), F.col("b"), F.lit(1.01))).first()
    assert short is None and none is None
    assert time.time() - start < 60


def test_edit_at_least_is_edit_where_it_reaches(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 7, 60, 700])))
        b = "".join(c for c in a if rng.random() < 0.9) + "x" * rng.choice([0, 1, 40])
        rows.append((a, b, rng.choice([-0.5, 0.0, 0.3, 0.6, 0.9, 1.0, 1.3])))
    df = spark.createDataFrame([*rows, (None, "a", 0.5), ("a", None, 0.5)], "a string, b string, least double")
    a, b, least = F.col("a"), F.col("b"), F.col("least")
    got = df.select(tx.edit_ratio(a, b).alias("full"), least, tx.edit_at_least(a, b, least).alias("got")).collect()
    for r in got:
        assert r.got == (r.full if r.full is not None and r.full >= r.least else None)


@pytest.mark.parametrize("rule", [L.FINANCE, L.MEDICAL, L.GROUNDED], ids=["finance", "medicine", "grounded"])
def test_banded_labels_are_edit_labels(spark, rule):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        a = [rng.choice(WORDS) + "x" for _ in range(rng.choice([1, 6, 40]))]
        b = [w if rng.random() < 0.5 else rng.choice(["unrelated", "words", w[::-1]]) for w in a]
        rows.append((i, " ".join(a), " ".join(b) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "id int, response string, truth string")

    def labels(mode):
        c = L.LabelInputs(response=F.col("response"), truth=F.col("truth"), similarity=mode)
        return {r.id: r.label.hallucination_label for r in L.label_with(df, c, rule).collect()}

    banded, edit = labels("banded"), labels("edit")
    assert banded == edit and set(edit.values()) == {0, 1}


def test_grams_must_be_computed_first(spark):
    df = spark.createDataFrame([("a", "b")], "response string, truth string")
    c = L.LabelInputs(response=F.col("response"), truth=F.col("truth"), similarity="grams")
    with pytest.raises(ValueError, match="with_grams"):
        L.label_with(df, c, L.FINANCE)
