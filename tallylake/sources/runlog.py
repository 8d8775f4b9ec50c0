"""The run log: reading JSON lines, latest record per key, completed keys, writing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.schemas import KEY, LOG

#: Paths in the order given, files of a path by name, lines in order.
ORDER = ("file_ord", "file_path", "block_start", "line_id")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by ``spark.checkpoint.dir``; one of our own only on a single machine (tests, notebooks)."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    return folder or tempfile.mkdtemp(prefix="spark-shared-")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of a session, for a while."""
    before = {c: spark.conf.get(c, None) for c in values}
    try:
        for c, v in values.items():
            spark.conf.set(c, v)
        yield
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def result_without(df: DataFrame, folder: str) -> DataFrame:
    """``df``, kept by a checkpoint, after which the folder that it was read from is deleted."""
    out = checkpointed(df)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return out


def parsed(lines: DataFrame, schema: str = LOG) -> DataFrame:
    """``lines`` (column ``value``) as records: blank and broken lines are dropped, ``seed`` becomes an int.

    Every line is parsed once: a generator stands between the parser and what uses its result, which the optimizer would else repeat.
    """
    record = F.from_json("value", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    rest = [c for c in lines.columns if c != "value"]
    # A record ends with a brace; most cut lines have none, and the parser throws an error for each.
    whole = lines.where(F.contains("value", F.lit("}"))).select(*rest, F.explode(F.array(record)).alias("r")).where(F.col("r.broken").isNull())
    return whole.select("r.*", *rest).drop("broken").withColumn("seed", F.try_to_number("seed", F.lit("S999999999")).cast("int"))


def read_run_log(spark: SparkSession, paths: Sequence[str], schema: str = LOG) -> DataFrame:
    """Records of all files, with ``file_ord`` (place of the path in ``paths``) and the place of the line in its file.

    Name only the fields that are needed in ``schema`` (with ``log_fields``): the others, long ``steps`` among them, are skipped and never built.
    """
    frames = []
    for i, path in enumerate(paths):
        lines = spark.read.text(path).select("value", F.lit(i).alias("file_ord"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))
        frames.append(lines.withColumn("line_id", F.monotonically_increasing_id()))
    lines = frames[0]
    for more in frames[1:]:
        lines = lines.unionByName(more)
    return parsed(lines, schema)


def has_key() -> Column:
    out = F.lit(True)
    for c in KEY:
        out = out & F.col(c).isNotNull()
    return out


def quarantined(records: DataFrame) -> DataFrame:
    """Parsed records that lack a part of the key: errors of whoever wrote them."""
    return records.where(~has_key())


def latest(records: DataFrame, order: Sequence[str | Column] = ORDER, columns: Sequence[str] | None = None, dealt: bool = False, salts: int = 0) -> DataFrame:
    """The last record of every key by ``order``, even where it is an error and an earlier one was not.

    One shuffle, on (benchmark, task): later groupings by key, by task and seed, or by task and policy reuse it. Few records of a key are
    retries, so combining before the shuffle would sort all rows for little. ``columns`` prunes what goes through it; carry no long texts. ``dealt``: the records come from a table that is stored by
    (benchmark, task), so nothing is shuffled. ``salts``: for logs in which a task may have very many records, they are dealt to so many parts of a key first, whose last ones then meet; one more shuffle.
    """
    keep = [c for c in (columns or records.columns) if c not in KEY]
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("r")
    whole = records.where(has_key())
    if salts:
        ordered = whole.select(*KEY, *keep, F.struct(*order).alias("_order"))
        parts = ordered.groupBy(*KEY, F.pmod(F.xxhash64("_order"), F.lit(salts)).alias("_salt")).agg(F.max_by(F.struct(*keep), "_order").alias("r"), F.max("_order").alias("_order"))
        return parts.groupBy(*KEY).agg(F.max_by("r", "_order").alias("r")).select(*KEY, "r.*")
    # A hash stands first in the order that brings a key together: names of benchmarks and tasks begin alike, and a sort goes by the first eight bytes.
    return (whole if dealt else whole.repartition("benchmark", "task_id")).groupBy(F.xxhash64(*KEY).alias("_hash"), *KEY).agg(last).select(*KEY, "r.*")


def completed_keys(records: DataFrame) -> DataFrame:
    """Keys with any record whose error is null or empty."""
    return records.where(F.coalesce("error", F.lit("")) == "").select(*KEY).distinct()


def write_run_log(records: DataFrame, path: str, fmt: str = "parquet", with_steps: bool = True) -> None:
    """Append records: Parquet partitioned by benchmark and policy, or JSON lines for interchange."""
    out = records if with_steps or "steps" not in records.columns else records.drop("steps")
    if fmt == "json":
        out.write.mode("append").json(path)
    else:
        out.write.mode("append").partitionBy("benchmark", "policy").format(fmt).save(path)


def compacted(records: DataFrame) -> DataFrame:
    """Records dealt for writing few files per benchmark and policy; large ones are split by task."""
    return records.repartition("benchmark", "policy", F.pmod(F.xxhash64("task_id"), F.lit(8)))


@dataclass
class StoredLog:
    """A run log as a table whose files are bucketed and sorted by (benchmark, task): latest records, the oracle, replays and summaries by task read it without a shuffle."""

    spark: SparkSession
    table: str
    buckets: int

    def append(self, records: DataFrame) -> None:
        """Add records, dealt first, so that each call writes a file a bucket."""
        dealt = records.where(has_key()).repartition(self.buckets, "benchmark", "task_id")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "benchmark", "task_id").sortBy("benchmark", "task_id").saveAsTable(self.table)

    def records(self) -> DataFrame:
        return self.spark.table(self.table)

    def latest(self, order: Sequence[str | Column], columns: Sequence[str] | None = None) -> DataFrame:
        """The last record of every key, still dealt by (benchmark, task)."""
        return latest(self.records(), order, columns, dealt=True)

    def compact(self, order: Sequence[str | Column], to: str) -> StoredLog:
        """The latest records alone, in a table of their own with a file a bucket."""
        out = StoredLog(self.spark, to, self.buckets)
        self.latest(order).write.mode("overwrite").format("parquet").bucketBy(self.buckets, "benchmark", "task_id").sortBy("benchmark", "task_id").saveAsTable(to)
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
