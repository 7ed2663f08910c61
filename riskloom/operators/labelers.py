"""Label rules per domain; ``1`` means the response is wrong.

A rule first states facts (numbers read, overlaps, similarities) in stages, each
stage a projection over the one before, and then a label over those facts.
Facts are computed once per row however often the label refers to them, and all
domains share the same few projections.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as cfg
from riskloom.functions import text as tx
from riskloom.functions.choice import option_index, option_letter
from riskloom.functions.numbers import last_number, multiplier, phrase_unit, unit_in
from riskloom.functions.vectors import cosine
from riskloom.operators.similarity import with_similarity

LABEL_FIELDS = {
    "hallucination_label": "int", "confidence": "double", "method": "string", "note": "string",
    "extracted_response": "double", "extracted_truth": "double", "difference": "double",
    "response_unit": "string", "truth_unit": "string", "tolerance_used": "double",
    "similarity_score": "double", "term_overlap": "double", "combined_score": "double",
    "threshold_used": "double", "selected_option": "string", "selected_index": "int",
    "correct_index": "int", "response_preview": "string", "gt_contained": "boolean",
    "truth_word_count": "int", "semantic_similarity": "double", "word_overlap": "double",
    "text_similarity": "double", "used_documents": "boolean",
}


@dataclass
class LabelInputs:
    """Columns a rule may read; the optional ones may be left out."""

    response: Column
    truth: Column
    prompt: Column | None = None
    documents: Column | None = None
    correct_index: Column | None = None
    existing_label: Column | None = None
    response_vector: Column | None = None
    truth_vector: Column | None = None
    # "grams" reads ``like``, which the caller has computed from joined gram counts; "edit" and "matcher" compare
    # whole texts in the row; "banded" gives what "edit" gives wherever that decides the label
    similarity: str = "edit"
    like: Column | None = None
    # None compares whole texts; 1000 gives the published shortcut for grounded answers
    compare_chars: int | None = None


class Facts:
    """Columns of earlier stages by name."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self._prefix}{name}")


Stage = Callable[["LabelInputs", Facts], dict[str, Column]]


Branch = tuple[Column | None, dict[str, Column]]


@dataclass(frozen=True)
class Rule:
    """Stages of facts, then branches ``(condition, fields)``; the first that holds decides."""

    stages: tuple[Stage, ...]
    branches: Callable[["LabelInputs", Facts], list[Branch]]
    # the two texts whose similarity the rule reads, where it reads any
    compared: Callable[["LabelInputs"], tuple[Column, Column]] | None = None


def _like(c: LabelInputs, a: Column, b: Column, least: Column) -> Column:
    """Similarity of two texts; under "banded" NULL below ``least``, the one at which the label turns."""
    if c.similarity == "grams":
        if c.like is None:
            raise ValueError("similarity 'grams' needs the column like; see with_grams")
        return F.when(a.isNotNull() & b.isNotNull(), c.like)
    if c.similarity == "banded":
        return tx.edit_at_least(a, b, least - 1e-9)
    return tx.similarity(c.similarity, a, b)


def label(**given: Column) -> dict[str, Column]:
    unknown = set(given) - set(LABEL_FIELDS)
    if unknown:
        raise ValueError(f"unknown label fields {sorted(unknown)}")
    return given


def _decide(branches: list[Branch], name: str) -> Column:
    """One field over all branches.

    Each field has its own CASE, so a query that uses or filters on one field
    drags along only what that field depends on.
    """
    out = F.lit(None).cast(LABEL_FIELDS[name])
    for condition, given in reversed(branches):
        value = given.get(name, F.lit(None)).cast(LABEL_FIELDS[name])
        out = value if condition is None else F.when(condition, value).otherwise(out)
    return out


def _flag(faithful: Column) -> Column:
    return F.when(faithful, 0).otherwise(1)


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def null_truth(method: str = "null_ground_truth") -> dict[str, Column]:
    what = "documents or ground truth" if method == "null_reference" else "ground truth"
    return label(hallucination_label=F.lit(1), confidence=F.lit(0.0), method=F.lit(method),
                 note=F.lit(f"No {what} available for comparison"))


# --- math ---------------------------------------------------------------------

def _numbers(c: LabelInputs, f: Facts) -> dict[str, Column]:
    return {"got": last_number(c.response), "want": last_number(c.truth)}


def _math_label(c: LabelInputs, f: Facts) -> list[Branch]:
    gap = F.abs(f.got - f.want)
    unread = label(hallucination_label=F.lit(1), confidence=F.lit(0.5), extracted_response=f.got,
                   extracted_truth=f.want, method=F.lit("numerical_extraction"))
    compared = label(hallucination_label=_flag(gap < cfg.MATH_TOLERANCE), confidence=F.lit(1.0),
                     extracted_response=f.got, extracted_truth=f.want, difference=gap,
                     method=F.lit("exact_numerical_match"))
    return [(_missing(c.truth), null_truth()), (f.got.isNull() | f.want.isNull(), unread), (None, compared)]


MATH = Rule((_numbers,), _math_label)


# --- finance ------------------------------------------------------------------

def _finance_texts(c: LabelInputs, f: Facts) -> dict[str, Column]:
    asked = c.prompt if c.prompt is not None else F.lit(None).cast("string")
    return {**_numbers(c, f), "low_response": F.lower(c.response), "low_truth": F.lower(c.truth),
            "low_prompt": F.lower(asked)}


def _units(c: LabelInputs, f: Facts) -> dict[str, Column]:
    """Units stated beside a number, the unit asked for, and whether the truth is prose."""
    wordy = (F.length(c.truth) > cfg.QUALITATIVE_LENGTH) | F.contains(c.truth, F.lit("\n"))
    for mark in cfg.QUALITATIVE_MARKS:
        wordy = wordy | F.contains(f.low_truth, F.lit(mark))
    return {"response_unit": F.when(f.got.isNotNull(), unit_in(f.low_response)),
            "stated": F.when(f.want.isNotNull(), unit_in(f.low_truth)),
            "asked": F.when(f.want.isNotNull(), phrase_unit(f.low_prompt)),
            "numeric": f.got.isNotNull() & f.want.isNotNull() & ~F.coalesce(wordy, F.lit(True))}


def _values(c: LabelInputs, f: Facts) -> dict[str, Column]:
    """Both values in base units; a truth without a unit takes the one the question asks for.

    Only answers that are not numeric pay for the comparison.
    """
    inferred = f.stated.isNull()
    worded = ~_missing(c.truth) & ~f.numeric
    a, b = F.when(worded, f.low_response), F.when(worded, f.low_truth)
    return {
        "got_value": f.got * multiplier(f.response_unit),
        "want_value": f.want * multiplier(F.coalesce(f.stated, f.asked)),
        "truth_unit": F.when(inferred, F.concat(f.asked, F.lit(" (inferred)"))).otherwise(f.stated),
        "ta": tx.without(tx.terms(a), cfg.FINANCE_STOPWORDS),
        "tb": tx.without(tx.terms(b), cfg.FINANCE_STOPWORDS),
        "a": a, "b": b,
    }


def _finance_scores(c: LabelInputs, f: Facts) -> dict[str, Column]:
    return {"shared": tx.overlap(f.ta, f.tb)}


def _finance_like(c: LabelInputs, f: Facts) -> dict[str, Column]:
    return {"like": _like(c, f.a, f.b, (cfg.FINANCE_TEXT_THRESHOLD - f.shared * 0.4) / 0.6)}


def _lowered(c: LabelInputs) -> tuple[Column, Column]:
    return F.lower(c.response), F.when(~_missing(c.truth), F.lower(c.truth))


def _finance_label(c: LabelInputs, f: Facts, tolerance: float = cfg.FINANCE_TOLERANCE) -> list[Branch]:
    allowed = F.when(f.want_value == 0, F.lit(1e-6)).otherwise(F.abs(f.want_value * tolerance))
    gap = F.abs(f.got_value - f.want_value)
    numeric = label(hallucination_label=_flag(gap <= allowed), confidence=F.lit(1.0),
                    extracted_response=f.got_value, extracted_truth=f.want_value,
                    response_unit=f.response_unit, truth_unit=f.truth_unit,
                    tolerance_used=allowed, difference=gap,
                    method=F.lit("numerical_tolerance_unit_aware"))
    score = f.like * 0.6 + f.shared * 0.4
    worded = label(hallucination_label=_flag(score >= cfg.FINANCE_TEXT_THRESHOLD),
                   confidence=F.lit(0.7), similarity_score=f.like, term_overlap=f.shared,
                   combined_score=score, method=F.lit("text_similarity_with_term_overlap"))
    return [(_missing(c.truth), null_truth()), (f.numeric, numeric), (None, worded)]


FINANCE = Rule((_finance_texts, _units, _values, _finance_scores, _finance_like), _finance_label, _lowered)


def finance_rule(tolerance: float) -> Rule:
    return Rule(FINANCE.stages, lambda c, f: _finance_label(c, f, tolerance), FINANCE.compared)


# --- medicine -----------------------------------------------------------------

def _medical_texts(c: LabelInputs, f: Facts) -> dict[str, Column]:
    choice = c.correct_index.isNotNull() if c.correct_index is not None else F.lit(False)
    return {"choice": choice, "letter": F.when(choice, option_letter(c.response)),
            "ca": F.when(~choice, tx.strip_symbols(F.lower(c.response))),
            "cb": F.when(~choice, tx.strip_symbols(F.lower(c.truth)))}


def _medical_words(c: LabelInputs, f: Facts) -> dict[str, Column]:
    return {"wa": F.array_distinct(tx.words(f.ca)), "wb": tx.words(f.cb),
            "inside": F.contains(f.ca, tx.strip(f.cb))}


def _medical_scores(c: LabelInputs, f: Facts) -> dict[str, Column]:
    found = f.inside & (F.size(f.wb) <= cfg.MEDICAL_MAX_CONTAINED_WORDS)
    return {"found": found, "shared": tx.overlap(f.wa, F.array_distinct(f.wb))}


def _medical_like(c: LabelInputs, f: Facts) -> dict[str, Column]:
    worded = ~_missing(c.truth) & ~f.choice & ~f.found
    return {"like": _like(c, F.when(worded, F.lower(c.response)), F.when(worded, F.lower(c.truth)), 2 * cfg.MEDICAL_TEXT_THRESHOLD - f.shared)}


def _medical_compared(c: LabelInputs) -> tuple[Column, Column]:
    response, truth = _lowered(c)
    return response, truth if c.correct_index is None else F.when(c.correct_index.isNull(), truth)


def _medical_label(c: LabelInputs, f: Facts) -> list[Branch]:
    out: list[Branch] = [(_missing(c.truth), null_truth())]
    if c.correct_index is not None:
        index = option_index(f.letter)
        unread = label(hallucination_label=F.lit(1), confidence=F.lit(0.5),
                       method=F.lit("mcq_parse_failure"),
                       note=F.lit("Could not parse option letter from response"),
                       response_preview=F.substring(c.response, 1, 100))
        read = label(hallucination_label=_flag(index == c.correct_index), confidence=F.lit(1.0),
                     selected_option=f.letter, selected_index=index, correct_index=c.correct_index,
                     method=F.lit("mcq_exact_match"))
        out += [(f.choice & f.letter.isNull(), unread), (f.choice, read)]
    score = (f.like + f.shared) / 2
    found = label(hallucination_label=F.lit(0), confidence=F.lit(0.9), gt_contained=F.lit(True),
                  truth_word_count=F.size(f.wb), method=F.lit("medical_containment_fallback"))
    scored = label(hallucination_label=_flag(score >= cfg.MEDICAL_TEXT_THRESHOLD),
                   confidence=F.lit(0.7), similarity_score=f.like, term_overlap=f.shared,
                   combined_score=score, threshold_used=F.lit(cfg.MEDICAL_TEXT_THRESHOLD),
                   method=F.lit("medical_similarity_fallback"))
    return [*out, (f.found, found), (None, scored)]


MEDICAL = Rule((_medical_texts, _medical_words, _medical_scores, _medical_like), _medical_label, _medical_compared)


# --- psychology ---------------------------------------------------------------

# Truths that are themselves a verdict.
TRUE_FLAGS = ["1", "True", "true"]
FALSE_FLAGS = ["0", "False", "false"]


def _psychology_scores(c: LabelInputs, f: Facts) -> dict[str, Column]:
    """Cosine where both vectors exist, word overlap otherwise."""
    like = F.lit(None).cast("double")
    if c.response_vector is not None and c.truth_vector is not None:
        like = cosine(c.response_vector, c.truth_vector)
    return {"like": like, "ta": tx.terms(c.response), "tb": tx.terms(c.truth)}


def _psychology_label(c: LabelInputs, f: Facts) -> list[Branch]:
    flagged = label(hallucination_label=_flag(c.truth.isin(*TRUE_FLAGS)), confidence=F.lit(1.0),
                    method=F.lit("truthfulqa_label"))
    semantic = label(hallucination_label=_flag(f.like >= cfg.SEMANTIC_THRESHOLD), confidence=F.lit(0.8),
                     semantic_similarity=f.like, threshold_used=F.lit(cfg.SEMANTIC_THRESHOLD),
                     method=F.lit("semantic_similarity"))
    shared = tx.overlap(f.ta, f.tb)
    worded = label(hallucination_label=_flag(shared >= cfg.WORD_OVERLAP_THRESHOLD), confidence=F.lit(0.6),
                   word_overlap=shared, method=F.lit("fallback_word_overlap"))
    return [(_missing(c.truth), null_truth()), (c.truth.isin(*TRUE_FLAGS, *FALSE_FLAGS), flagged),
            (f.like.isNotNull(), semantic), (None, worded)]


PSYCHOLOGY = Rule((_psychology_scores,), _psychology_label)


# --- grounded answers ---------------------------------------------------------

def clean_documents(documents: Column) -> Column:
    """Take off one pair of brackets and, inside it, one quote at each end."""
    inner = tx.strip(F.substr(documents, F.lit(2), F.length(documents) - 2))
    bare = F.regexp_replace(inner, r"""\A["']|["']\z""", "")
    listed = F.startswith(documents, F.lit("[")) & F.endswith(documents, F.lit("]"))
    return F.when(listed, bare).otherwise(documents)


def _reference(c: LabelInputs) -> tuple[Column, Column]:
    docs = c.documents if c.documents is not None else F.lit(None).cast("string")
    return docs, F.when(~_missing(docs), docs).otherwise(c.truth)


def _grounded_compared(c: LabelInputs) -> tuple[Column, Column]:
    reference = _reference(c)[1]
    return tx.strip(F.lower(c.response)), F.when(~_missing(reference), tx.strip(F.lower(clean_documents(reference))))


def _grounded_texts(c: LabelInputs, f: Facts) -> dict[str, Column]:
    docs, reference = _reference(c)
    return {"used": docs.isNotNull(), "lost": _missing(reference),
            "a": tx.strip(F.lower(c.response)), "b": tx.strip(F.lower(clean_documents(reference)))}


def _grounded_terms(c: LabelInputs, f: Facts) -> dict[str, Column]:
    semantic = F.lit(None).cast("double")
    if c.response_vector is not None and c.truth_vector is not None:
        semantic = cosine(c.response_vector, c.truth_vector)
    return {"ta": tx.meaningful_terms(f.a, cfg.GROUNDED_STOPWORDS),
            "tb": tx.meaningful_terms(f.b, cfg.GROUNDED_STOPWORDS),
            "semantic": semantic}


def _grounded_scores(c: LabelInputs, f: Facts) -> dict[str, Column]:
    return {"shared": tx.overlap(f.ta, f.tb)}


def _grounded_like(c: LabelInputs, f: Facts) -> dict[str, Column]:
    a, b = f.a, f.b
    if c.compare_chars is not None:
        a, b = F.substring(f.a, 1, c.compare_chars), F.substring(f.b, 1, c.compare_chars)
    least = F.when(f.semantic.isNotNull(), (cfg.GROUNDED_THRESHOLD - f.semantic * 0.5 - f.shared * 0.3) / 0.2) \
        .otherwise((cfg.GROUNDED_THRESHOLD - f.shared * 0.6) / 0.4)
    return {"like": _like(c, F.when(~f.lost, a), F.when(~f.lost, b), least)}


def _grounded_label(c: LabelInputs, f: Facts) -> list[Branch]:
    """Weighted score, with a term for the vectors where both exist."""
    score = F.when(f.semantic.isNotNull(), f.semantic * 0.5 + f.shared * 0.3 + f.like * 0.2) \
        .otherwise(f.shared * 0.6 + f.like * 0.4)
    scored = label(hallucination_label=_flag(score >= cfg.GROUNDED_THRESHOLD), confidence=F.lit(0.7),
                   semantic_similarity=f.semantic, term_overlap=f.shared, text_similarity=f.like,
                   combined_score=score, threshold_used=F.lit(cfg.GROUNDED_THRESHOLD),
                   used_documents=f.used, method=F.lit("document_grounded_consistency"))
    return [(f.lost, null_truth("null_reference")), (None, scored)]


GROUNDED = Rule((_grounded_texts, _grounded_terms, _grounded_scores, _grounded_like), _grounded_label, _grounded_compared)


# --- labels that come with the data -------------------------------------------

def _existing_label(c: LabelInputs, f: Facts) -> list[Branch]:
    missing = label(hallucination_label=F.lit(0), confidence=F.lit(0.5),
                    method=F.lit("existing_label_missing"))
    if c.existing_label is None:
        return [(None, missing)]
    given = label(hallucination_label=c.existing_label, confidence=F.lit(1.0),
                  method=F.lit("existing_label"))
    return [(c.existing_label.isNotNull(), given), (None, missing)]


EXISTING = Rule((), _existing_label)

LABELERS: dict[str, Rule] = {
    "Medicine": MEDICAL,
    "Math": MATH,
    "Finance": FINANCE,
    "IS": GROUNDED,
    "Psychology": PSYCHOLOGY,
}


def apply_rules(df: DataFrame, c: LabelInputs, rules: dict[str, Rule], domain: Column | None = None,
                name: str = "label") -> DataFrame:
    """Add the label struct of each row under ``name``.

    Without ``domain`` the single rule given covers every row.  With it, a rule
    sees response and truth only of its own domain, so one domain's rows never
    pay for another's comparison; a domain without a rule gets NULL fields.
    """
    given = df.columns
    plans = []
    for i, (of, rule) in enumerate(rules.items()):
        mine = None if domain is None else domain == of
        gate = (lambda x: x) if mine is None else (lambda x, m=mine: F.when(m, x))
        plans.append((mine, rule, replace(c, response=gate(c.response), truth=gate(c.truth)), f"_{i}_"))
    out = df
    for level in range(max(len(rule.stages) for rule in rules.values())):
        new = []
        for _, rule, inputs, prefix in plans:
            if level < len(rule.stages):
                facts = rule.stages[level](inputs, Facts(prefix))
                new += [col.alias(prefix + key) for key, col in facts.items()]
        out = out.select("*", *new)
    decided = [(mine, rule.branches(inputs, Facts(prefix))) for mine, rule, inputs, prefix in plans]
    fields = []
    for field in LABEL_FIELDS:
        value = F.lit(None).cast(LABEL_FIELDS[field])
        for mine, branches in reversed(decided):
            got = _decide(branches, field)
            value = got if mine is None else F.when(mine, got).otherwise(value)
        fields.append(value.alias(field))
    return out.select(*given, F.struct(*fields).alias(name))


def label_with(df: DataFrame, c: LabelInputs, rule: Rule, name: str = "label") -> DataFrame:
    return apply_rules(df, c, {"": rule}, None, name)


def with_grams(df: DataFrame, ids: list[str], c: LabelInputs, rules: dict[str, Rule], domain: Column | None = None) -> tuple[DataFrame, LabelInputs]:
    """``df`` with the gram similarity that the rules compare by, and inputs that read it.

    The texts a rule doesn't compare stay out of the join.  ``ids`` must be unique and without NULL.
    """
    a = b = F.lit(None).cast("string")
    for name, rule in rules.items():
        if rule.compared is not None:
            left, right = rule.compared(c)
            mine = F.lit(True) if domain is None else domain == name
            a, b = F.when(mine, left).otherwise(a), F.when(mine, right).otherwise(b)
    return with_similarity(df, ids, a, b, "_like"), replace(c, similarity="grams", like=F.col("_like"))


def label_responses(prompts: DataFrame, primary: DataFrame, similarity: str = "grams",
                    rules: dict[str, Rule] | None = None) -> DataFrame:
    """Label the primary response of every prompt that has one.

    ``prompts`` holds prompt_id, domain, prompt, ground_truth and optionally
    documents, correct_index, existing_label, truth_vector; ``primary`` holds
    prompt_id, primary_response and optionally response_vector.  Prompts
    without a response drop out through the inner join, and domains without a
    rule are left out here and counted by ``unruled_domains``.  ``prompt_id`` must be unique.
    """
    joined = prompts.join(primary, "prompt_id")

    def maybe(name: str) -> Column | None:
        return F.col(name) if name in joined.columns else None

    inputs = LabelInputs(
        response=F.coalesce(F.col("primary_response"), F.lit("")), truth=F.col("ground_truth"),
        prompt=F.col("prompt"), documents=maybe("documents"), correct_index=maybe("correct_index"),
        existing_label=maybe("existing_label"), response_vector=maybe("response_vector"),
        truth_vector=maybe("truth_vector"), similarity=similarity)
    rules = rules or LABELERS
    known = joined.filter(F.col("domain").isin(*rules))
    if similarity == "grams":
        known, inputs = with_grams(known, ["prompt_id"], inputs, rules, F.col("domain"))
    out = apply_rules(known, inputs, rules, F.col("domain"), "_label")
    extras = [f for f in LABEL_FIELDS if f not in ("hallucination_label", "confidence", "method")]
    renamed = {"correct_index": "label_correct_index"}
    return out.select(
        "prompt_id", "domain", "prompt", "ground_truth", "primary_response",
        F.col("_label.hallucination_label").alias("hallucination_label"),
        F.col("_label.confidence").alias("label_confidence"),
        F.col("_label.method").alias("label_method"),
        *[F.col(f"_label.{f}").alias(renamed.get(f, f)) for f in extras])


def unruled_domains(prompts: DataFrame, primary: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """domain, n: answered prompts that ``label_responses`` leaves out because their domain has no rule."""
    ruled = F.coalesce(F.col("domain").isin(*(rules or LABELERS)), F.lit(False))
    return prompts.join(primary, "prompt_id").filter(~ruled).groupBy("domain").agg(F.count("*").alias("n"))
