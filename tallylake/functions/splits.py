"""Stable splits of tasks by the hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_position(task_id: Column) -> Column:
    """A number from 0 to 1: the first 32 bits of the SHA-256."""
    return F.conv(F.substring(F.sha2(task_id, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def in_train_split(task_id: Column, fraction: float) -> Column:
    return split_position(task_id) < fraction


def held_out(records: DataFrame, fraction: float | None) -> DataFrame:
    """Records of tasks outside the train split; 0 or None keeps all. A filter on the key alone: it moves below any later shuffle."""
    return records.where(~in_train_split(F.col("task_id"), fraction)) if fraction else records


def of_tasks(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Records whose task is in a list."""
    return records.join(tasks.select("task_id").distinct(), "task_id", "left_semi")
