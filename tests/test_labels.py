"""Label rules on hand-derived cases and against plain-Python brute force."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from riskloom import config as cfg
from riskloom.operators import labelers as L


def labelled(spark, rows, rule, **extra):
    cols = ["response", "truth", *extra.get("columns", [])]
    kinds = {"correct_index": "int", "prompt": "string", "documents": "string", "existing_label": "int",
             "response_vector": "array<double>", "truth_vector": "array<double>"}
    df = spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols))
    given = {c: F.col(c) for c in cols if c not in ("response", "truth")}
    c = L.LabelInputs(response=F.col("response"), truth=F.col("truth"), similarity=extra.get("similarity", "matcher"),
                      compare_chars=extra.get("compare_chars"), **given)
    return [r.label for r in L.label_with(df, c, rule).collect()]


def test_math(spark):
    got = labelled(spark, [("42", "42.0000001"), ("no idea", "42"), ("42", None), ("42", ""), ("41", "42")], L.MATH)
    assert [(g.hallucination_label, g.confidence, g.method) for g in got] == [
        (0, 1.0, "exact_numerical_match"), (1, 0.5, "numerical_extraction"), (1, 0.0, "null_ground_truth"),
        (1, 0.0, "null_ground_truth"), (1, 1.0, "exact_numerical_match")]
    assert got[4].difference == 1.0


def test_finance_units(spark):
    rows = [("$1.45 billion", "$1577.00", "in USD millions"), ("0", "0", "x"), ("$100", "104", "x"), ("$100", "106", "x")]
    got = labelled(spark, rows, L.FINANCE, columns=["prompt"])
    assert [g.hallucination_label for g in got] == [1, 0, 0, 1]
    assert got[0].truth_unit == "million (inferred)" and got[0].extracted_truth == pytest.approx(1.577e9)
    loose = labelled(spark, rows[:1], L.finance_rule(0.10), columns=["prompt"])
    assert loose[0].hallucination_label == 0


def _finance_score(a, b):
    like = SequenceMatcher(None, a.lower(), b.lower()).ratio()
    stop = set(cfg.FINANCE_STOPWORDS)
    ta, tb = set(a.lower().split()) - stop, set(b.lower().split()) - stop
    shared = len(ta & tb) / len(tb) if tb else 0.0
    return like * 0.6 + shared * 0.4


def test_finance_text_matches_brute_force(spark):
    pairs = [("Sales rose due to new stores", "Because of new stores sales rose"), ("yes", "no"), ("It fell", "Primarily the price of oil"),
             ("Yes 5", "yes 5"), ("", "because")]
    got = labelled(spark, pairs, L.FINANCE)
    for (a, b), g in zip(pairs, got):
        assert g.combined_score == pytest.approx(_finance_score(a, b))
        assert g.hallucination_label == (0 if _finance_score(a, b) >= 0.35 else 1)


def test_mcq(spark):
    got = labelled(spark, [("C", "x", 2), ("B", "x", 2), ("I think it is 3", "x", 2), ("C", None, 2), ("some text", "text", None)],
                   L.MEDICAL, columns=["correct_index"])
    assert [(g.hallucination_label, g.method) for g in got] == [
        (0, "mcq_exact_match"), (1, "mcq_exact_match"), (1, "mcq_parse_failure"), (1, "null_ground_truth"),
        (0, "medical_containment_fallback")]
    assert got[2].response_preview == "I think it is 3"


def test_medical_text(spark):
    a, b = "take two tablets every single day with water", "one tablet taken every day with some water and food"
    got = labelled(spark, [(a, b), ("Use flumazenil.", "Flumazenil")], L.MEDICAL)
    ta, tb = set(a.split()), set(b.split())
    want = (SequenceMatcher(None, a, b).ratio() + len(ta & tb) / len(tb)) / 2
    assert got[0].combined_score == pytest.approx(want)
    assert got[1].method == "medical_containment_fallback" and got[1].hallucination_label == 0


def test_psychology(spark):
    rows = [("x", "True", None, None), ("x", "0", None, None), ("a b", "a b c d", None, None), ("a", "b", [1.0, 0.0], [1.0, 0.1]),
            ("a", "b", [1.0, 0.0], [0.0, 1.0])]
    got = labelled(spark, rows, L.PSYCHOLOGY, columns=["response_vector", "truth_vector"])
    assert [(g.hallucination_label, g.method) for g in got] == [
        (0, "truthfulqa_label"), (1, "truthfulqa_label"), (0, "fallback_word_overlap"), (0, "semantic_similarity"), (1, "semantic_similarity")]


def _grounded_score(a, b, limit=None):
    import string

    a, b = a.lower().strip(), b.lower().strip()
    stop = set(cfg.GROUNDED_STOPWORDS)

    def terms(t):
        return {w.strip(string.punctuation) for w in set(t.split()) - stop if len(w.strip(string.punctuation)) > 2}

    shared = len(terms(a) & terms(b)) / len(terms(b)) if terms(b) else 0.0
    like = SequenceMatcher(None, a[:limit], b[:limit]).ratio()
    return shared * 0.6 + like * 0.4


def test_grounded(spark):
    long_a, long_b = "alpha beta. " * 150 + "end one", "gamma (beta) " * 150 + "end one"
    rows = [("The sky is blue.", "x", "['The sky, today, is very blue!']"), (long_a, long_b, None), ("a", None, ""), ("a", "  ", None)]
    got = labelled(spark, rows, L.GROUNDED, columns=["documents"])
    assert got[0].combined_score == pytest.approx(_grounded_score("The sky is blue.", "The sky, today, is very blue!"))
    assert got[0].used_documents and not got[1].used_documents
    assert got[1].combined_score == pytest.approx(_grounded_score(long_a, long_b))
    assert got[2].method == "null_reference"
    short = labelled(spark, rows, L.GROUNDED, columns=["documents"], compare_chars=1000)
    assert short[1].combined_score == pytest.approx(_grounded_score(long_a, long_b, 1000))


def test_existing(spark):
    got = labelled(spark, [("a", "b", 1), ("a", "b", None)], L.EXISTING, columns=["existing_label"])
    assert [(g.hallucination_label, g.confidence) for g in got] == [(1, 1.0), (0, 0.5)]


def test_dispatch_keeps_domains_apart(spark):
    prompts = spark.createDataFrame(
        [("p1", "Math", "q", "42"), ("p2", "Finance", "q", "42"), ("p3", "Law", "q", "42"), ("p4", "Psychology", "q", "true")],
        "prompt_id string, domain string, prompt string, ground_truth string")
    primary = spark.createDataFrame([("p1", "41"), ("p2", "41"), ("p3", "41"), ("p4", "x")], "prompt_id string, primary_response string")
    got = {r.prompt_id: (r.hallucination_label, r.label_method) for r in L.label_responses(prompts, primary).collect()}
    assert got == {"p1": (1, "exact_numerical_match"), "p2": (0, "numerical_tolerance_unit_aware"), "p4": (0, "truthfulqa_label")}


def test_labels_are_binary_and_filter_stays_small(spark, sf):
    from riskloom.plans.label_queries import labelled as all_labels
    from riskloom.plans.views import Views

    df = all_labels(Views(spark, sf))
    assert df.filter(~F.col("hallucination_label").isin(0, 1)).count() == 0
    plan = df.filter("label_method = 'exact_numerical_match'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000


def test_domains_without_a_rule_are_counted(spark):
    prompts = spark.createDataFrame([(1, "nowhere", "p", "t"), (2, None, "p", "t"), (3, "Math", "p", "1"), (4, "nowhere", "p", "t")],
                                    "prompt_id long, domain string, prompt string, ground_truth string")
    primary = spark.createDataFrame([(1, "r"), (2, "r"), (3, "1"), (4, "r")], "prompt_id long, primary_response string")
    assert {(r.domain, r.n) for r in L.unruled_domains(prompts, primary).collect()} == {("nowhere", 2), (None, 1)}
