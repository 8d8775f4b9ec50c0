"""The run log as a stream: progress so far, and a table of the latest record per key.

The order of arrival comes from columns (``v``, a sequence number), never from the order of rows in a micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylake.operators.summary import progress
from tallylake.schemas import KEY, LOG
from tallylake.sources.runlog import latest, parsed


def log_stream(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Records of the JSON lines files that appear in a folder."""
    return parsed(spark.readStream.text(path).select("value"), schema)


def running_progress(records: DataFrame, name: str) -> StreamingQuery:
    """Finished, accuracy and errors so far, as a table in memory: as many rows as there are benchmarks and policies."""
    return progress(records).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


class LatestTable:
    """Latest record per key of a stream. Each micro-batch is reduced to its last record per key and appended under its batch number, so
    that a batch that is run again replaces itself; ``read`` takes the last over the batches, ``compact`` merges them."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str]):
        self.spark, self.path, self.order = spark, path, list(order)

    def upsert(self, batch: DataFrame, number: int) -> None:
        latest(batch, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        return records.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        return latest(self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch"), self.order)

    def compact(self, to: str) -> LatestTable:
        self.read().repartition("benchmark", F.pmod(F.xxhash64(*KEY), F.lit(16))).write.mode("overwrite").parquet(f"{to}/batch=0")
        return LatestTable(self.spark, to, self.order)
