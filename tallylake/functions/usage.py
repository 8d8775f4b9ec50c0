"""Costs of attempts and the columns around calls: FLOPs, dollars, sample seeds, trimming, clean-up of logged responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylake.schemas import COST_FIELDS


def single_call_cost(prompt: Column, completion: Column, latency: Column) -> Column:
    """The cost of an attempt of one call: all of the prompt is prefilled, nothing is thought."""
    n = F.lit(1).cast("bigint")
    return F.struct(n.alias("calls"), prompt.alias("prompt_tokens"), prompt.alias("prefill_tokens"), completion.alias("generated_tokens"), F.lit(0).cast("bigint").alias("thinking_tokens"), latency.alias("latency_s"))


def continued_prefill(first_prompt: Column, second_prompt: Column, first_completion: Column) -> Column:
    """Prefill of two calls: what the second prompt adds to the first one and its completion comes anew."""
    return first_prompt + F.greatest(F.lit(0), second_prompt - first_prompt - first_completion)


def cost_sums(cost: str = "cost") -> list[Column]:
    """Aggregates of a cost struct, field by field; a missing counter is 0."""
    return [F.sum(F.coalesce(F.col(f"{cost}.{f}"), F.lit(0))).alias(f) for f in COST_FIELDS]


def flops(params_b: float, prefill: Column, generated: Column) -> Column:
    return F.lit(2 * params_b * 1e9) * (prefill + generated)


def dollars(latency_s: Column, usd_per_gpu_hour: float, num_gpus: int, concurrency: Column | int) -> Column:
    shared = F.greatest(F.lit(concurrency) if isinstance(concurrency, int) else concurrency, F.lit(1))
    return latency_s / F.lit(3600.0) * F.lit(float(num_gpus)) / shared * F.lit(usd_per_gpu_hour)


def sample_seeds(seed: Column, k: int) -> Column:
    """The seeds of an attempt's k samples."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: seed * 1000 + j)


def trimmed_step(name: Column, prompt: Column, text: Column, finish_reason: Column, completion: Column, prompt_chars: int = 200, text_chars: int = 20_000) -> Column:
    """A step for the log: the prompt's end and the text's beginning."""
    return F.struct(name.alias("name"), F.right(prompt, F.lit(prompt_chars)).alias("prompt_tail"), F.left(text, F.lit(text_chars)).alias("text"), finish_reason.alias("finish_reason"), completion.alias("completion_tokens"))


def cleaned_call(response: str = "response") -> Column:
    """A logged response struct as a call: null log-probabilities and empty maps go, empty lists are null, missing usage is 0."""
    r = lambda f: F.col(f"{response}.{f}")
    token = F.filter(r("token_logprobs"), lambda x: x.isNotNull())
    top = F.filter(r("top_logprobs"), lambda m: m.isNotNull() & (F.size(m) > 0))
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.struct(
        F.coalesce(r("text"), F.lit("")).alias("text"), F.coalesce(r("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(r("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(r("finish_reason"), F.lit("unknown")).alias("finish_reason"), some(token).alias("token_logprobs"), some(top).alias("top_logprobs"),
    )
