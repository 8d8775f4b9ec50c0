"""Confidence signals of calls as column expressions. A signal that cannot be told is null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import extracted_answer, extracted_code

TAIL = 16
# The names of signals that a router may use, in order.
FEATURES = ("mean_logprob", "min_logprob", "tail_mean_logprob", "frac_low_conf", "mean_topk_entropy", "completion_tokens_log", "finished", "has_answer", "question_chars_log")


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def length_signals(completion: Column, finish_reason: Column) -> dict[str, Column]:
    return {"completion_tokens_log": F.log1p(completion.cast("double")), "finished": F.when(finish_reason == "stop", 1.0).otherwise(0.0)}


def has_answer(kind: Column, text: Column) -> Column:
    math_answer = extracted_answer(text).isNotNull() & F.contains(text, F.lit("\\boxed"))
    code_answer = F.contains(text, F.lit("```")) & (extracted_code(text) != "")
    return F.when(F.when(kind == "math", math_answer).otherwise(code_answer), 1.0).otherwise(0.0)


def logprob_signals(logprobs: Column) -> dict[str, Column]:
    some = lambda c: F.when(F.size(logprobs) > 0, c)
    tail = F.slice(logprobs, F.greatest(F.size(logprobs) - (TAIL - 1), F.lit(1)), TAIL)
    low = F.size(F.filter(logprobs, lambda v: v < math.log(0.5)))
    return {"mean_logprob": mean_of(logprobs), "min_logprob": some(F.array_min(logprobs)), "tail_mean_logprob": some(mean_of(tail)), "frac_low_conf": some(low / F.size(logprobs))}


def topk_entropy(top: Column) -> Column:
    """Mean entropy of the renormalised top-k distributions, token by token."""

    def entropy(m: Column) -> Column:
        p = F.transform(F.map_values(m), lambda v: F.exp(v))
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        return F.aggregate(p, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total + 1e-12))

    return mean_of(F.transform(top, entropy))


def topk_entropy_vectorised(top: Column) -> Column:
    """The same for long answers, as a vectorised function over ``array<map<string,double>>``."""

    def mean_entropy(rows: pd.Series) -> pd.Series:
        def one(row) -> float | None:
            if row is None or not len(row):
                return None
            out = []
            for m in row:
                p = np.exp(np.fromiter((m.values() if isinstance(m, dict) else (v for _, v in m)), float))
                p = p / p.sum()
                out.append(-(p * np.log(p + 1e-12)).sum())
            return float(np.mean(out))

        return rows.map(one).astype("float64")

    return F.pandas_udf(mean_entropy, "double")(top)


def task_signals(question: Column) -> dict[str, Column]:
    return {"question_chars_log": F.log1p(F.char_length(question).cast("double"))}


def thinking_signals(finish_reason: Column, completion: Column) -> dict[str, Column]:
    return {"think_hit_budget": F.when(finish_reason == "length", 1.0).otherwise(0.0), "think_tokens_log": F.log1p(completion.cast("double"))}


def call_signals(kind: Column, text: Column, completion: Column, finish_reason: Column, logprobs: Column, top: Column) -> dict[str, Column]:
    """All signals of one generation."""
    return length_signals(completion, finish_reason) | {"has_answer": has_answer(kind, text)} | logprob_signals(logprobs) | {"mean_topk_entropy": topk_entropy(top)}


def as_map(signals: dict[str, Column]) -> Column:
    """Signals as a map without those that are null."""
    every = F.map_from_arrays(F.array(*map(F.lit, signals)), F.array(*(c.cast("double") for c in signals.values())))
    return F.map_filter(every, lambda _, v: v.isNotNull())
