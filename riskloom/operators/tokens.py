"""Long token tables from stored samples, and the entropy of their top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.logprobs import best_of


def token_table(samples: DataFrame, ids: list[str], tokens: str = "logprobs", top: str = "top_logprobs") -> DataFrame:
    """ids, pos, logprob: one row a token, from the token values or else the best of each top list.

    Positions count from 0 in the stored array; NULL and NaN entries give no row but keep their place.
    """
    picked = F.coalesce(F.col(tokens), best_of(F.col(top))) if top in samples.columns else F.col(tokens)
    long = samples.select(*ids, F.posexplode(picked).alias("pos", "logprob"))
    return long.filter(F.col("logprob").isNotNull() & ~F.isnan("logprob"))


def top_table(samples: DataFrame, ids: list[str], k: int = 10, top: str = "top_logprobs") -> DataFrame:
    """ids, pos, place, token, logprob: the ``k`` likeliest entries of each top list, likeliest first, then by token."""
    at = samples.select(*ids, F.posexplode(F.col(top)).alias("pos", "_m"))
    entries = F.filter(F.transform(F.map_entries("_m"), lambda e: F.struct((-e["value"]).alias("cost"), e["key"].alias("token"))),
                       lambda e: e["cost"].isNotNull() & ~F.isnan(e["cost"]))
    best = F.slice(F.sort_array(entries), 1, k)
    return at.select(*ids, "pos", F.posexplode(best).alias("place", "_e")).select(
        *ids, "pos", "place", "_e.token", (-F.col("_e.cost")).alias("logprob"))


def top_k_entropy(top: DataFrame, key: str = "prompt_id", group: list[str] | None = None) -> DataFrame:
    """key, top_k_entropy: mean over positions of the entropy (nats) of their top lists.

    What the list leaves of the probability counts as one more outcome; a list that sums to over 1 is
    renormalised.  ``group`` names the columns that tell positions of a key apart besides ``pos``.
    """
    p = F.exp("logprob")
    plogp = F.when(p > 0, p * F.col("logprob")).otherwise(0.0)
    each = top.groupBy(key, *(group or []), "pos").agg(F.sum(p).alias("_m"), F.sum(plogp).alias("_s"))
    m, s = F.col("_m"), F.col("_s")
    rest = 1.0 - m
    entropy: Column = F.when(m > 1, F.log(m) - s / m).when(rest > 0, -s - rest * F.log(rest)).otherwise(-s)
    return each.groupBy(key).agg(F.avg(entropy).alias("top_k_entropy"))
