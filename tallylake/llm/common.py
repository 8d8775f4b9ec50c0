"""Shared helpers of the corpus operators: checkpoints, hot keys and bounded per-worker caches."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold the most rows are treated one by one: at most so many, of those with so many rows. Any other key of a table has under 1 / MOST_HOT of its rows.
MOST_HOT, LEAST_HOT = 10_000, 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named by ``spark.checkpoint.dir``. One of our own only on a single machine (tests, notebooks)."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder. Spark deletes it with the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder, where it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(counts: DataFrame, n_col: str) -> DataFrame:
    """The keys with the most rows, ``MOST_HOT`` at most, so broadcast is safe. ``counts`` has one row per key with its number of rows in ``n_col``."""
    rest = [c for c in counts.columns if c != n_col]
    return counts.where(F.col(n_col) >= LEAST_HOT).orderBy(F.desc(n_col), *rest).limit(MOST_HOT)


def join_skewed(rows: DataFrame, table: DataFrame, keys: str | list[str]) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key), where a few keys may hold most of ``rows``.

    The table is checkpointed, so that both sides come to the join straight from their shuffles: then Spark's adaptive skew join splits the partitions that hot
    keys make large, whatever their number, which it doesn't where an aggregate stands in between.
    """
    return rows.join(checkpointed(table), keys)


def text_or_empty(name: str = "text") -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class BoundedCache(dict):
    """A dict that computes what is missing and starts afresh at ``limit`` entries, so that a worker's memory is bounded.

    Values are the same whether they come from the cache or not. Keys longer than ``longest`` are never kept.
    """

    def __init__(self, compute, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
