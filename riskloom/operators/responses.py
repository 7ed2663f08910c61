"""Jobs around sampling: plan, cache, primary answers, failures and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import SamplingSpec


def temperatures(spec: SamplingSpec) -> list[float]:
    if spec.n_samples == 1:
        return [(spec.low + spec.high) / 2]
    step = (spec.high - spec.low) / (spec.n_samples - 1)
    grid = [spec.low + i * step for i in range(spec.n_samples)]
    grid[-1] = spec.high
    return grid


def sampling_plan(prompts: DataFrame, spec: SamplingSpec = SamplingSpec()) -> DataFrame:
    """One row per prompt and sample; token log-probabilities only for sample 0.

    The grid is a literal array, so the plan is a narrow explode without a join.
    """
    grid = F.array(*[F.lit(t) for t in temperatures(spec)])
    return (prompts.select("*", F.posexplode(grid).alias("sample_id", "temperature"))
            .withColumn("want_logprobs", F.col("sample_id") == 0))


def request_key(prompt: Column, model: Column, provider: Column, **parameters: Column) -> Column:
    """MD5 of the request as JSON with sorted keys."""
    fields = {"prompt": prompt, "model": model, "provider": provider, **parameters}
    return F.md5(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def pending_requests(plan: DataFrame, cache: DataFrame, key: str = "request_key") -> DataFrame:
    return plan.join(cache.select(key), key, "left_anti")


def cached_responses(plan: DataFrame, cache: DataFrame, key: str = "request_key") -> DataFrame:
    return plan.join(cache, key)


def primary_responses(samples: DataFrame) -> DataFrame:
    """Sample 0 of every prompt; a narrow filter."""
    return samples.filter(F.col("sample_id") == 0).select("prompt_id", F.col("text").alias("primary_response"))


def missing_responses(prompts: DataFrame, samples: DataFrame) -> DataFrame:
    """Prompts without any sample."""
    return prompts.join(samples.select("prompt_id"), "prompt_id", "left_anti")


def joined_samples(prompts: DataFrame, samples: DataFrame) -> DataFrame:
    return prompts.join(samples, "prompt_id")


def generation_errors(samples: DataFrame) -> DataFrame:
    """Per model: requests, failures (an error or an empty text) and their share."""
    failed = F.col("error").isNotNull()
    return samples.groupBy("model").agg(
        F.count("*").alias("n_requests"), F.count_if(failed).alias("n_errors"),
        F.count_if(F.col("text") == "").alias("n_empty"),
        F.avg(failed.cast("double")).alias("error_share"))


def token_usage_cost(samples: DataFrame, price_per_million: Column) -> DataFrame:
    """Token totals per model and their price."""
    out = samples.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    return out.withColumn("cost", F.col("total_tokens") * price_per_million / 1e6)
