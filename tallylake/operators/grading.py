"""Grading of outputs against tasks, and assembly of run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.functions.answers import compared, equivalent_of, extracted_answer, extracted_code, stripped, zero_division_of


def graded_math(outputs: DataFrame, tasks: DataFrame, long_numbers: bool = False) -> DataFrame:
    """``outputs`` (``benchmark, task_id, output``, more) with ``pred, correct, grade_detail, error`` by the tasks' references."""
    refs = tasks.where("kind = 'math'").select("benchmark", "task_id", "reference")
    with_pred = outputs.join(refs, ["benchmark", "task_id"]).withColumn("pred", extracted_answer(F.col("output")))
    # A generator stands between the comparison and what uses it, so that it is made once.
    both = with_pred.select("*", F.explode(F.array(compared(F.col("pred"), F.col("reference")))).alias("_both"))
    error = F.when(F.col("pred").isNotNull(), zero_division_of(F.col("_both")))
    return both.withColumns({"correct": equivalent_of(F.col("_both"), long_numbers), "grade_detail": F.lit(""), "error": error}).drop("_both")


def graded_code(outputs: DataFrame, results: DataFrame) -> DataFrame:
    """``outputs`` graded by logged execution results (``benchmark, task_id, policy, seed, exit_code, timed_out, stderr``)."""
    tail = stripped(F.right(F.coalesce("stderr", F.lit("")), F.lit(500)))
    last_line = F.coalesce(F.try_element_at(F.split(tail, r"\R"), F.lit(-1)), F.lit(""))
    joined = outputs.join(results, ["benchmark", "task_id", "policy", "seed"])
    timed_out = F.coalesce("timed_out", F.lit(False))
    graded = {
        "pred": F.left(extracted_code(F.col("output")), F.lit(2000)),
        "correct": F.coalesce((F.col("exit_code") == 0) & ~timed_out, F.lit(False)),
        "grade_detail": F.when(timed_out, "timeout").otherwise(last_line),
    }
    return joined.withColumns(graded).drop("exit_code", "timed_out", "stderr")


def run_records(graded: DataFrame, run: str, version: int = 1) -> DataFrame:
    """Graded attempts as log records: an error is never correct and has no cost or signals; code rows have no reference and no example test."""
    failed = F.col("error").isNotNull()
    unless_failed = lambda c: F.when(~failed, F.col(c))
    meta = F.map_filter("meta", lambda k, _: k != "example_test")
    return graded.select(
        F.lit(version).alias("v"), F.lit(run).alias("run"), "benchmark", "task_id", "policy", "seed", (F.col("correct") & ~failed).alias("correct"), unless_failed("pred").alias("pred"),
        F.when(F.col("kind") == "math", F.col("reference")).alias("reference"), unless_failed("grade_detail").alias("grade_detail"), "error", meta.alias("meta"), "wall_s",
        unless_failed("cost").alias("cost"), unless_failed("signals").alias("signals"), unless_failed("stopped_at").alias("stopped_at"), unless_failed("steps").alias("steps"),
    )
