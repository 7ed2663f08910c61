"""Column builders on hand-derived cases."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from riskloom.functions import choice, features, logprobs, numbers, prompts, text, vectors


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("value, want", [
    ("The total is $1,200.50.", 1200.5), ("It took 3 days and 42.", 42.0), ("between 10-5", -5.0),
    ("95%", 95.0), ("none", None), (None, None), ("", None)])
def test_last_number(spark, value, want):
    assert one(spark, value, numbers.last_number) == want


@pytest.mark.parametrize("value, want", [
    ("steps #### 42", "42"), ("a #### 1 #### 2 ", "2"), ("plain", "plain"), (None, None)])
def test_final_answer(spark, value, want):
    assert one(spark, value, numbers.final_answer) == want


@pytest.mark.parametrize("value, amount, unit", [
    ("$1.45 billion", 1.45e9, "billion"), ("3 books", 3000.0, "k"), ("7", 7.0, None), ("a million", None, None),
    ("5 mn", 5e6, "mn"), ("2 trillion", 2e12, "trillion")])
def test_units(spark, value, amount, unit):
    assert one(spark, value, numbers.scaled_number) == amount
    assert one(spark, value, numbers.unit_of) == unit


def test_whole_word_units(spark):
    assert one(spark, "3 books", lambda c: numbers.unit_of(c, whole_words=True)) is None
    assert one(spark, "3 k", lambda c: numbers.unit_of(c, whole_words=True)) == "k"


@pytest.mark.parametrize("value, want", [
    ("revenue in USD millions?", "million"), ("in thousands", "thousand"), ("how much", None), (None, None)])
def test_prompt_unit(spark, value, want):
    assert one(spark, value, numbers.prompt_unit) == want


@pytest.mark.parametrize("value, want", [
    ("B", "B"), ("The answer is C", "C"), ("(D) since", "D"), ("Answer: C", "A"), ("This is a D", "A"),
    ("I think it is 3", None), ("  c", "C"), ("", None), ("I pické d", "D"), ("xaé yy", None)])
def test_option_letter(spark, value, want):
    assert one(spark, value, choice.option_letter) == want


def test_option_letter_strict(spark):
    strict = lambda c: choice.option_letter(c, strict=True)
    assert one(spark, "Answer: C", strict) == "C"
    assert one(spark, "This is a D", strict) == "D"


@pytest.mark.parametrize("value, want", [
    ("Show me which one", "how"), ("What is it and why", "what"), ("tell me", "other"), ("", "other"), ("WHERE", "where")])
def test_question_word(spark, value, want):
    assert one(spark, value, features.question_word) == want


@pytest.mark.parametrize("name, want", [
    ("paris", -0.587787), ("acme", -0.470004), ("ninechars", -0.336472), ("elevenchars", -0.182322)])
def test_entity_rarity(spark, name, want):
    got = one(spark, name, lambda c: features.entity_rarity(features.entity_frequency(c)))
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("domain, want", [
    ("Medicine", "Medicine"), ("statistics", "IS"), ("math", "Math"), ("law", None)])
def test_domain_match(spark, domain, want):
    assert one(spark, domain, features.domain_match) == want


def test_overlap_and_words(spark):
    df = spark.createDataFrame([("The cat sat  on", "the dog sat"), ("", ""), ("a", "  ")], "a string, b string")
    rows = df.select(text.overlap(text.terms(F.col("a")), text.terms(F.col("b"))).alias("r")).collect()
    assert [round(r.r, 6) for r in rows] == [round(2 / 3, 6), 0.0, 0.0]


def test_matcher_ratio_is_whole_text(spark):
    a, b = "x" * 3000 + "tail of the answer", "y" * 3000 + "tail of the answer"
    df = spark.createDataFrame([(a, b), ("abc", None)], "a string, b string")
    got = [r.r for r in df.select(text.similarity("matcher", F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[0] == pytest.approx(SequenceMatcher(None, a, b).ratio()) and got[1] is None
    with pytest.raises(ValueError):
        text.similarity("nope", F.col("a"), F.col("b"))


def test_edit_ratio(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("é", "e")], "a string, b string")
    got = [r.r for r in df.select(text.edit_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [pytest.approx(1 - 3 / 7), 1.0, 0.0]


def test_options_prompt(spark):
    literal = """{'1': 'no', '0': "it's", '10': 'x', 'correct answer': 'no'}"""
    got = one(spark, literal, lambda c: prompts.mcq_prompt(F.lit("Q?"), prompts.parse_options(c)))
    assert got == prompts.MCQ_HEAD + "Question: Q?\nA) it's\nB) no\nK) x\n\nAnswer:"


def test_logprob_forms(spark):
    df = spark.createDataFrame([([-0.1, float("nan"), -2.0, None, -0.5], None), (None, [{"a": -1.0, "b": -0.2}, {"c": -3.0}]), ([], None)],
                               "t array<double>, top array<map<string,double>>")
    got = df.select(logprobs.token_logprobs(F.col("t"), F.col("top")).alias("a")).select(
        "a", logprobs.energy(F.col("a")).alias("e"), logprobs.energy(F.col("a"), "mean").alias("m"),
        logprobs.placeholder_entropy(F.col("a")).alias("k")).collect()
    assert got[0].a == [-0.1, -2.0, -0.5] and got[1].a == [-0.2, -3.0]
    assert got[0].e == pytest.approx(-0.498775, abs=1e-6)
    assert got[2].e is None and got[2].k is None and got[0].k == 0.0
    with pytest.raises(ValueError):
        logprobs.energy(F.col("a"), "max")


def test_position_entropy(spark):
    df = spark.createDataFrame([([{"a": -1.0, "b": -1.0}],)], "top array<map<string,double>>")
    assert df.select(logprobs.position_entropy(F.col("top")).alias("e")).first().e == pytest.approx(0.693147, abs=1e-6)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.r for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [pytest.approx(0.5 ** 0.5), 0.0]


def test_chat_messages(spark):
    df = spark.createDataFrame([("hi", "sys"), ("hi", ""), ("hi", None)], "p string, s string")
    got = [[m.role for m in r.m] for r in df.select(prompts.chat_messages(F.col("p"), F.col("s")).alias("m")).collect()]
    assert got == [["system", "user"], ["user"], ["user"]]


def test_options_with_bare_words(spark):
    read = lambda text: one(spark, text, prompts.parse_options)
    assert read("{'0': None, '1': 'b', '2': True}") == {"0": "None", "1": "b", "2": "True"}
    assert read("{'0': 'x: None, y', '1': \"it's\"}") == {"0": "x: None, y", "1": "it's"}
    assert read("no options") is None and read(None) is None
