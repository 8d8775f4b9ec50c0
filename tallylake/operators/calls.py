"""From model calls to attempts: costs over calls, votes over samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.functions.usage import cost_sums
from tallylake.schemas import KEY


def attempt_costs(calls: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per attempt: ``calls, prompt_tokens, prefill_tokens, generated_tokens, thinking_tokens``.

    The first call's prompt is prefilled whole; the second one continues it, so only what goes beyond the first prompt and completion is.
    """
    first, second = F.col("call_no") == 1, F.col("call_no") == 2
    one = lambda c, when: F.max(F.when(when, F.col(c)))
    p1, c1, p2 = one("prompt_tokens", first), one("completion_tokens", first), one("prompt_tokens", second)
    return calls.groupBy(*key).agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        (p1 + F.greatest(F.lit(0), F.coalesce(p2 - p1 - c1, F.lit(0)))).alias("prefill_tokens"), F.sum("completion_tokens").alias("generated_tokens"),
        F.coalesce(F.max(F.when(F.col("step") == "think", F.col("completion_tokens"))), F.lit(0)).alias("thinking_tokens"),
    )


def added_costs(attempts: DataFrame, key: Sequence[str] = KEY, cost: str = "cost") -> DataFrame:
    """Field-wise sums of cost structs."""
    return attempts.groupBy(*key).agg(*cost_sums(cost))


def majority_vote(samples: DataFrame, k: int | Column | None = None, key: Sequence[str] = KEY, vote: str = "vote", means: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Votes over samples (``sample_no``, ``vote``; null does not vote): ``winner, chosen_sample, agreement, distinct_answers``.

    Most votes win, and of equals the vote that came first; the chosen sample is the first with the winning vote, else sample 0. ``agreement`` is over all samples (or ``k``).
    Two small aggregates; texts stay outside and are joined by the chosen sample. ``means`` average over the samples that have a value, ``sums`` add up.
    """
    # Means are carried as sums and counts, so that both levels combine.
    partial = [F.sum(c).alias(f"_sum_{c}") for c in {*means, *sums}] + [F.count(c).alias(f"_n_{c}") for c in means]
    by_vote = samples.groupBy(*key, vote).agg(F.count("*").alias("n"), F.min("sample_no").alias("first"), *partial)
    voted = F.col(vote).isNotNull()
    best = F.max(F.when(voted, F.struct(F.col("n").alias("votes"), (-F.col("first")).alias("early"), F.col(vote).alias("winner"))))
    totals = [(F.sum(f"_sum_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in means] + [F.sum(f"_sum_{c}").alias(f"total_{c}") for c in sums]
    out = by_vote.groupBy(*key).agg(best.alias("b"), F.sum("n").alias("samples"), F.count(F.when(voted, 1)).alias("distinct_answers"), *totals)
    size = F.col("samples") if k is None else F.lit(k) if isinstance(k, int) else k
    votes = F.coalesce("b.votes", F.lit(0))
    return out.select(*key, F.col("b.winner").alias("winner"), F.coalesce(-F.col("b.early"), F.lit(0)).cast("int").alias("chosen_sample"), votes.alias("votes"), (votes / size.cast("double")).alias("agreement"), "distinct_answers", *means, *(f"total_{c}" for c in sums))
