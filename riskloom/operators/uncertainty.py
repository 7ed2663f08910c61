"""Uncertainty features per prompt from samples and tokens.

Inputs are long tables (one row per token or per sample), so a prompt of any
length is folded by partial aggregation instead of being held in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import EPISTEMIC_COLUMNS, LOG_FLOOR, MCQ_COLUMNS
from riskloom.functions.choice import option_letter
from riskloom.operators.ranking import positions

LETTERS = ("A", "B", "C", "D")


def token_stats(tokens: DataFrame, key: str = "prompt_id", value: str = "logprob") -> DataFrame:
    """key, n_tokens, mean_logprob, min_logprob, max_logprob, std_logprob, log_mass.

    ``log_mass`` is log(sum(exp(lp))).  Tokens fold to one row per key and whole
    step of lp; the steps are then combined around the largest, which is as
    stable as subtracting the maximum but needs no second look at the tokens.
    """
    lp = F.col(value)
    step = F.floor(lp)
    steps = tokens.filter(lp.isNotNull() & ~F.isnan(lp)).groupBy(key, step.alias("_step")).agg(
        F.count("*").alias("_n"), F.sum(lp).alias("_s"), F.min(lp).alias("_lo"), F.max(lp).alias("_hi"),
        F.var_pop(lp).alias("_var"), F.sum(F.exp(lp - step)).alias("_mass"))
    own = Window.partitionBy(key)
    steps = steps.select("*", F.max("_step").over(own).alias("_top"),
                         (F.sum("_s").over(own) / F.sum("_n").over(own)).alias("_mean"))
    spread = F.col("_n") * (F.col("_var") + F.pow(F.col("_s") / F.col("_n") - F.col("_mean"), 2.0))
    return steps.groupBy(key).agg(
        F.sum("_n").alias("n_tokens"), F.max("_mean").alias("mean_logprob"),
        F.min("_lo").alias("min_logprob"), F.max("_hi").alias("max_logprob"),
        F.sqrt(F.sum(spread) / F.sum("_n")).alias("std_logprob"),
        (F.max("_top") + F.log(F.sum(F.col("_mass") * F.exp(F.col("_step") - F.col("_top"))))).alias("log_mass"))


def semantic_energy(method: str = "logsumexp") -> Column:
    """Energy over the columns of ``token_stats``."""
    try:
        return -F.col({"logsumexp": "log_mass", "mean": "mean_logprob", "min": "min_logprob"}[method])
    except KeyError:
        raise ValueError(f"unknown energy method {method!r}") from None


def token_features(tokens: DataFrame, method: str = "logsumexp", key: str = "prompt_id", entropies: DataFrame | None = None) -> DataFrame:
    """Energy, log-probability summaries and the naive confidence baselines.

    ``entropies`` (key, top_k_entropy) comes from stored top lists; without it the entropy is the published
    placeholder, 0 for any prompt with tokens.
    """
    if entropies is not None:
        real = token_features(tokens, method, key).drop("naive_top_k_entropy")
        return real.join(entropies.select(key, F.col("top_k_entropy").alias("naive_top_k_entropy")), key, "left")
    return token_stats(tokens, key).select(
        key, semantic_energy(method).alias("semantic_energy"), "mean_logprob", "min_logprob", "std_logprob",
        F.exp("max_logprob").alias("naive_max_prob"), F.exp(-F.col("mean_logprob")).alias("naive_perplexity"),
        F.lit(0.0).alias("naive_top_k_entropy"))


def letter_features(samples: DataFrame, key: str = "prompt_id", text: str = "text",
                    strict: bool = False) -> DataFrame:
    """Agreement and entropy of the option letters; four counters per prompt."""
    lettered = samples.select(key, option_letter(F.col(text), strict).alias("_l"))
    counts = lettered.groupBy(key).agg(
        F.count("*").alias("_all"), *[F.count_if(F.col("_l") == x).alias(f"_{x}") for x in LETTERS])
    each = [F.col(f"_{x}") for x in LETTERS]
    parsed = sum(each[1:], each[0])
    mode = F.greatest(*each)
    some = parsed > 0
    bits = None
    for n in each:
        p = n / parsed
        term = F.when(n > 0, -p * F.log2(p + F.lit(LOG_FLOOR))).otherwise(F.lit(0.0))
        bits = term if bits is None else bits + term
    unique = sum([(n > 0).cast("int") for n in each[1:]], (each[0] > 0).cast("int"))
    return counts.select(
        key, F.when(some, mode / parsed).otherwise(0.0).alias("mcq_letter_consistency"),
        unique.alias("mcq_num_unique_letters"), (parsed / F.col("_all")).alias("mcq_parseable_ratio"),
        mode.alias("mcq_mode_letter_count"), F.when(some, bits).otherwise(2.0).alias("mcq_letter_entropy"))


def first_token(tokens: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Log-probability of the first token; NaN counts as missing."""
    lp = F.when(~F.isnan("logprob"), F.col("logprob"))
    return tokens.filter(F.col("pos") == 0).select(
        key, lp.alias("mcq_first_token_logprob"), F.exp(lp).alias("mcq_first_token_prob"))


def cluster_entropy(clusters: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Entropy and sizes from cluster assignments (key, cluster_id[, weight]).

    Clusters of equal size fold together, so even a prompt with very many
    clusters leaves only its distinct sizes for the last step.
    """
    weight = F.sum("weight") if "weight" in clusters.columns else F.count("*")
    sizes = clusters.groupBy(key, "cluster_id").agg(weight.alias("_size"))
    tally = sizes.groupBy(key, "_size").agg(F.count("*").alias("_m"))
    n = F.sum(F.col("_size") * F.col("_m")).over(Window.partitionBy(key))
    tally = tally.withColumn("_n", n)
    p = F.col("_size") / F.col("_n")
    out = tally.groupBy(key).agg(
        F.sum(-F.col("_m") * p * F.log2(p + F.lit(LOG_FLOOR))).alias("_bits"),
        F.max("_n").alias("num_samples"), F.sum("_m").alias("num_semantic_clusters"),
        F.max("_size").alias("max_cluster_size"))
    return out.select(
        key, F.when(F.col("num_semantic_clusters") == 1, 0.0).otherwise(F.col("_bits")).alias("semantic_entropy"),
        "num_samples", "num_semantic_clusters",
        (F.col("num_samples") / F.col("num_semantic_clusters")).alias("avg_cluster_size"), "max_cluster_size")


# --- similarity of all sample pairs, without the pairs ------------------------

def partner_counts(samples: DataFrame, key: str = "prompt_id") -> DataFrame:
    """How many samples each one is paired with, before and after it.

    The pair list of a prompt is the grid of its samples in ``sample_id`` order (i < j);
    it grows with the square of the group and is never written out.  Ids may have gaps.
    """
    sizes = samples.groupBy(key).agg(F.count("*").alias("_n"))
    numbered = positions(samples.select(key, "sample_id"), [key], [F.col("sample_id")], "partners_before")
    return numbered.join(sizes, key).select(
        key, "sample_id", "partners_before",
        (F.col("_n") - 1 - F.col("partners_before")).alias("partners_after"),
        (F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint").alias("prompt_pairs"))


def term_pair_similarity(sample_terms: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Mean over a prompt's pairs of the two-way term overlap.

    ``sample_terms``: key, sample_id, terms (array of distinct terms).  With df(t)
    the samples of the prompt that hold t and w(t) the sum of 1/|terms| over
    them, the ordered pair scores add up to sum((df(t) - 1) * w(t)); the work is
    linear in the terms and splits by term.
    """
    sizes = sample_terms.groupBy(key).agg(F.count("*").alias("n_samples"))
    each = sample_terms.filter(F.size("terms") > 0).select(
        key, (F.lit(1.0) / F.size("terms")).alias("_inv"), F.explode("terms").alias("_t"))
    by_term = each.groupBy(key, "_t").agg(F.count("*").alias("_df"), F.sum("_inv").alias("_w"))
    total = by_term.groupBy(key).agg(F.sum((F.col("_df") - 1) * F.col("_w")).alias("_total"))
    n = F.col("n_samples")
    return sizes.join(total, key, "left").select(
        key, "n_samples", F.when(n > 1, F.coalesce("_total", F.lit(0.0)) / (n * (n - 1))).alias("mean_similarity"))


def vector_pair_similarity(vectors: DataFrame, key: str = "prompt_id", vector: str = "vector") -> DataFrame:
    """Mean cosine over a prompt's pairs: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    from riskloom.functions.vectors import unit

    each = vectors.select(key, F.posexplode(unit(F.col(vector))).alias("_d", "_x"))
    sums = each.groupBy(key, "_d").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"),
                                       F.count("*").alias("_n"))
    n = F.max("_n")
    return sums.groupBy(key).agg(
        n.alias("n_samples"),
        F.when(n > 1, (F.sum(F.col("_s") * F.col("_s")) - F.sum("_q")) / (n * (n - 1))).alias("mean_similarity"))


# --- assembly -------------------------------------------------------------------

def epistemic_features(prompts: DataFrame, entropy: DataFrame, tokens: DataFrame,
                       mcq: DataFrame | None = None, first: DataFrame | None = None,
                       method: str = "logsumexp", key: str = "prompt_id") -> DataFrame:
    """One row per prompt; a missing block leaves NULLs.  Every input is hashed on the key."""
    out = prompts.select(key).join(
        entropy.select(key, "semantic_entropy", "num_semantic_clusters", "avg_cluster_size"), key, "left") \
        .join(token_features(tokens, method, key), key, "left")
    names = list(EPISTEMIC_COLUMNS)
    if mcq is not None:
        out = out.join(mcq, key, "left")
        if first is not None:
            out = out.join(first, key, "left")
        names += [c for c in MCQ_COLUMNS if c in out.columns]
    return out.select(key, *names)
