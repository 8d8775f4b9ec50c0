"""Accuracy and cost summaries. Benchmarks and policies are few and tasks many, so every aggregate first goes by task, with partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.functions.usage import flops
from tallylake.operators.bootstrap import histogram_intervals

COSTS = ("calls", "prefill_tokens", "generated_tokens", "thinking_tokens", "latency_s")


def present(records: DataFrame, names: Sequence[str]) -> list[str]:
    """The names that are columns of the records, in order."""
    return [c for c in names if c in records.columns]


def share(part: Column, whole: Column) -> Column:
    """Two counts as a double, null over nothing."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def per_task(records: DataFrame, value: Column, extra: Sequence[str] = ("policy",)) -> DataFrame:
    """Mean of a value per task."""
    return records.groupBy("benchmark", *extra, "task_id").agg(F.avg(value).alias("value"))


def task_counts(records: DataFrame, costs: Sequence[str] = COSTS) -> DataFrame:
    """``benchmark, policy, task_id`` with records, errors, correct ones, and sums of the costs that there are over the records without error."""
    ok = F.col("error").isNull()
    sums = [F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))).alias(c) for c in present(records, costs)]
    right = F.count_if(F.col("correct") & ok).alias("n_correct")
    return records.groupBy("benchmark", "policy", "task_id").agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_errors"), right, *sums)


def summary(records: DataFrame, params_b: float | None = None, costs: Sequence[str] = COSTS, n_boot: int = 0) -> DataFrame:
    """Per (benchmark, policy): tasks, records, errors, accuracy (mean of the tasks' means; errors are wrong), mean costs over records without error.

    ``n_boot``: replicates of a bootstrap over tasks for ``acc_low`` and ``acc_high``, 95 % bounds of the accuracy; from the same counts per task.
    """
    return summary_of_tasks(task_counts(records, costs), params_b, costs, n_boot)


def summary_of_tasks(by_task: DataFrame, params_b: float | None = None, costs: Sequence[str] = COSTS, n_boot: int = 0) -> DataFrame:
    """``summary`` from ``task_counts``, which can be kept and added up."""
    costs = present(by_task, costs)
    ok = F.sum("n") - F.sum("n_errors")
    out = by_task.groupBy("benchmark", "policy").agg(
        F.count("*").alias("tasks"), F.sum("n").alias("records"), F.sum("n_errors").alias("errors"), F.avg(share(F.col("n_correct"), F.col("n"))).alias("accuracy"),
        *(share(F.sum(c), ok).alias(c) for c in costs),
    )
    out = out.withColumn("tflops", flops(params_b, F.col("prefill_tokens"), F.col("generated_tokens")) / 1e12) if params_b else out
    if not n_boot:
        return out
    values = by_task.select("benchmark", "policy", share(F.col("n_correct"), F.col("n")).alias("value"))
    bounds = histogram_intervals(values, ["benchmark", "policy"], n_boot=n_boot).select("benchmark", "policy", F.col("ci_low").alias("acc_low"), F.col("ci_high").alias("acc_high"))
    return out.join(bounds, ["benchmark", "policy"], "left")


def accuracy_by_level(records: DataFrame, level: str = "level") -> DataFrame:
    """Mean over the records that have a level."""
    known = records.where(F.col(level).isNotNull())
    right = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    return known.groupBy("benchmark", "policy", level).agg(share(right, F.count("*")).alias("accuracy"), F.count("*").alias("records"))


def level_table(by_level: DataFrame, levels: Sequence[int], level: str = "level") -> DataFrame:
    """Levels as columns, in order; null where a policy has none. ``levels`` are named, so no job looks for them."""
    wide = by_level.groupBy("benchmark", "policy").pivot(level, list(levels)).agg(F.first("accuracy"))
    return wide.select("benchmark", "policy", *(F.col(f"`{x}`").alias(f"level_{x}") for x in levels))


def base_rate(records: DataFrame) -> DataFrame:
    """Records, share of correct ones, sorted names of benchmarks."""
    right = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    return records.agg(F.count("*").alias("n"), share(right, F.count("*")).alias("base_rate"), F.array_sort(F.collect_set("benchmark")).alias("benchmarks"))


def progress(records: DataFrame, seconds: Column | None = None, workers: int = 1) -> DataFrame:
    """Finished, accuracy so far, errors; and ``jobs_per_s`` where the seconds of a job are given: finished jobs by the time that so many workers spent on them."""
    right = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    rate = [share(F.count("*") * F.lit(workers), F.sum(F.coalesce(seconds.cast("double"), F.lit(0.0)))).alias("jobs_per_s")] if seconds is not None else []
    return records.groupBy("benchmark", "policy").agg(F.count("*").alias("finished"), share(right, F.count("*")).alias("accuracy"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), *rate)
