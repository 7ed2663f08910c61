"""Token log-probabilities held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_of(top: Column) -> Column:
    """The best value of each position's top list, NaN aside."""
    return F.transform(top, lambda m: F.array_max(F.filter(F.map_values(m), lambda v: ~F.isnan(v))))


def token_logprobs(tokens: Column, top: Column | None = None) -> Column:
    """One ``array<double>``: the token values, else the best value of each position.

    NULL and NaN entries are dropped.
    """
    picked = tokens
    if top is not None:
        picked = F.coalesce(tokens, best_of(top))
    return F.filter(picked, lambda v: v.isNotNull() & ~F.isnan(v))


def energy(values: Column, method: str = "logsumexp") -> Column:
    """Energy of one token array; NULL when it is empty."""
    some = F.size(values) > 0
    if method == "logsumexp":
        top = F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return F.when(some, -(top + F.log(total)))
    if method == "mean":
        return F.when(some, -F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))
    if method == "min":
        return F.when(some, -F.array_min(values))
    raise ValueError(f"unknown energy method {method!r}")


def first_logprob(values: Column) -> Column:
    head = F.try_element_at(values, F.lit(1))
    return F.when(~F.isnan(head), head)


def placeholder_entropy(values: Column) -> Column:
    """The published definition: 0 whenever there is any token, NULL otherwise."""
    return F.when(F.size(values) > 0, F.lit(0.0))


def position_entropy(top: Column) -> Column:
    """Opt-in: mean Shannon entropy (nats) of the renormalised top list per position."""
    def one(m: Column) -> Column:
        probs = F.transform(F.map_values(m), F.exp)
        total = F.aggregate(probs, F.lit(0.0), lambda s, v: s + v)
        return F.aggregate(probs, F.lit(0.0),
                           lambda s, v: s - F.when(v > 0, v / total * F.log(v / total)).otherwise(0.0))

    summed = F.aggregate(F.transform(top, one), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(top) > 0, summed / F.size(top))
