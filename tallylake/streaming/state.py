"""The run log as keyed state: the latest record of every key in a state store, and running counts that take back what a retry replaces.

A hash deals tasks to slots of some two thousand records, and an entry of the store is a slot: a call of Python, which costs a millisecond or more, serves all its tasks, policies and seeds. A record goes there and back once, without
names: numbers, times and strings as such with one number for their kinds, anything else as one text that Spark wrote and reads again; an entry is its records' columns, compressed. So what the shuffle and the store hold is near to what
the records hold. An entry is written again when any of its records changes; ``slots`` is fixed when a stream starts for the first time.
A batch returns its changes with a sign: a new record counts, and the one that it replaces is taken back. Their sums per policy and task lie under the batch's number, and add up to the same
counts per task that a summary of all records starts from: so progress and summaries after a new file cost what the file holds, and a report over them equals that of a full run. The stream's own log of files
read is the manifest. ``fold`` adds the batches up to one. The table of latest records is read from the state store of the last finished batch.

Cases: records without a whole key are left out; a record that is met again, or later than one that is newer by the order, changes nothing; of the order's values null is the least and NaN the greatest, as in a
sort; a null ``correct`` counts as wrong; an empty error is none. A stream started again on its folder goes on after its last batch, and a batch that is run again replaces its sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType, StructField, StructType

from tallylake.operators.summary import COSTS, present, share, summary_of_tasks
from tallylake.schemas import KEY
from tallylake.sources.runlog import has_key, settings

#: A store on disk; its changes are logged, not copied whole.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Records of a slot, about.
TOGETHER = 2000
#: How values that are no numbers, times or strings are kept as text.
TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: What columns of other kinds are kept as, and how many such columns at most: the kinds of their values share a bigint.
PLAINLY = {"double": "double", "float": "double", "string": "string"} | dict.fromkeys(("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp", "timestamp_ntz"), "bigint")
MOST = 39


def rank(values: Sequence[Any]) -> tuple:
    """What orders records: nulls first, NaN last."""
    return tuple((0,) if v is None else (2,) if v != v else (1, v) for v in values)


def plain(c: str, kind: DataType) -> tuple[Column, Column]:
    """What holds and orders a column, without nulls: its kind (0 null, 1 a value, 2 NaN), and its value as a number or text of the same order. pandas has one sign for null and NaN, and no nulls among integers."""
    x, name = F.col(c), kind.simpleString()
    place = F.when(x.isNull(), 0).otherwise(1)
    if name in ("double", "float"):
        return F.when(F.isnan(x), 2).otherwise(place), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    if name in ("tinyint", "smallint", "int", "bigint", "boolean"):
        value = x.cast("bigint")
    elif name == "date":
        value = F.unix_date(x).cast("bigint")
    elif name == "timestamp":
        value = F.unix_micros(x)
    elif name == "timestamp_ntz":  # reckoned by its fields: a time zone could fold hours
        value = F.unix_date(x.cast("date")).cast("bigint") * 86_400_000_000 + (F.hour(x) * 3600 + F.minute(x) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("bigint")
    elif name == "string":
        return place, F.coalesce(x, F.lit(""))
    else:
        raise ValueError(f"records cannot be ordered by {c}, which is {name}")
    return place, F.coalesce(value, F.lit(0))


def again(place: Column, value: Column, kind: DataType) -> Column:
    """The column that ``plain`` made two of."""
    name = kind.simpleString()
    if name in ("double", "float"):
        value = F.when(place == 2, float("nan")).otherwise(value)
    elif name == "date":
        value = F.date_from_unix_date(value.cast("int"))
    elif name == "timestamp":
        value = F.timestamp_micros(value)
    elif name == "timestamp_ntz":
        value = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(value.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    return F.when(place > 0, value.cast(kind))


def last_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The last row of every key, by the columns ``o0, o1, ...`` and their kinds; of rows alike in these, one that was kept."""
    kinds, codes = rows["_kinds"].to_numpy(), [rows["_kept"].to_numpy()]
    for c in sorted((c for c in rows.columns if c[0] == "o"), key=lambda c: -int(c[1:])):
        codes += [pd.factorize(rows[c], sort=True)[0] if rows[c].dtype.kind not in "iuf" else rows[c].to_numpy(), kinds // 3 ** int(c[1:]) % 3]
    return rows.iloc[np.lexsort(codes)].drop_duplicates([*KEY], keep="last")


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as an entry: their columns, compressed."""
    batch = pa.RecordBatch.from_arrays([pa.array(rows[c], None if rows[c].dtype.kind in "iuf" else pa.string()) for c in rows.columns], [*rows.columns])
    entry = pa.BufferOutputStream()
    with pa.ipc.new_stream(entry, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return entry.getvalue().to_pybytes()


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of entries, which are the first column of ``batches``."""
    for batch in batches:
        for entry in batch.column(0):
            yield from pa.ipc.open_stream(entry.as_buffer())


def keeping(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the latest record of every key of a slot; returns records that became the latest (sign 1) and those that ceased to be (-1)."""
    new = pd.concat(list(frames), ignore_index=True).drop(columns="_slot")
    old = pa.ipc.open_stream(pa.py_buffer(state.get[0])).read_pandas() if state.exists else new.iloc[:0]
    last = last_of(pd.concat([new.assign(_kept=0), old.assign(_kept=1)], ignore_index=True))
    came = last.loc[last["_kept"] == 0, new.columns]
    gone = old.merge(came[[*KEY]], on=[*KEY])[new.columns]
    if len(came):
        state.update((packed(last[new.columns].sort_values("task_id")),))
    yield pd.concat([came.assign(sign=1), gone.assign(sign=-1)], ignore_index=True).astype(object)  # Spark puts empty frames beside it, of which pandas would warn


class LiveLog:
    """A run log kept up to date by a stream in ``folder``, which the cluster shares: ``latest`` records, ``progress`` and ``summary``. ``slots``: about as many as there will be records, over ``TOGETHER``."""

    def __init__(self, spark: SparkSession, folder: str, order: Sequence[str], slots: int = 1024):
        self.spark, self.folder, self.order, self.slots = spark, folder, list(order), slots

    def form(self, schema: StructType | None = None) -> tuple[StructType, int, list[str]]:
        """The records' schema, the number of slots, and the columns that are kept plainly, those that order first; kept in the folder since the stream's first start."""
        path, order = f"{self.folder}/form", [*dict.fromkeys(self.order)]
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            if schema is None:
                raise ValueError(f"no stream has started in {self.folder}")
            if len(order) > MOST:
                raise ValueError(f"records are ordered by {MOST} columns at most")
            rest = [f.name for f in schema if f.name not in (*KEY, *order) and f.dataType.simpleString() in PLAINLY]
            self.spark.createDataFrame([(schema.json(), self.slots, [*order, *rest][:MOST])], "schema string, slots bigint, plainly array<string>").coalesce(1).write.parquet(path)
        kept = self.spark.read.parquet(path).first()
        known, plainly = StructType.fromJson(json.loads(kept["schema"])), kept["plainly"]
        if schema is not None and (schema.simpleString() != known.simpleString() or order != plainly[: len(order)]):
            raise ValueError(f"records of {schema.simpleString()} ordered by {order} do not go on with {known.simpleString()} and {plainly}")
        return known, kept["slots"], plainly

    def names(self, plainly: Sequence[str]) -> list[str]:
        """Of the columns that are kept plainly: ``o`` orders, ``p`` does not."""
        return [f"{'o' if c in self.order else 'p'}{i}" for i, c in enumerate(plainly)]

    def as_text(self, schema: StructType, plainly: Sequence[str]) -> StructType:
        """The other columns, by their places."""
        return StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema) if f.name not in (*KEY, *plainly)])

    def kept(self, schema: StructType, plainly: Sequence[str]) -> str:
        """The schema in which records are kept."""
        plain_ones = (f"{n} {PLAINLY[schema[c].dataType.simpleString()]}" for n, c in zip(self.names(plainly), plainly, strict=True))
        text = ["_record string"] if len(self.as_text(schema, plainly)) else []
        return ", ".join([*(f"{c} {schema[c].dataType.simpleString()}" for c in KEY), "_kinds bigint", *plain_ones, *text])

    def changes(self, records: DataFrame) -> DataFrame:
        """``records`` that become the latest of their key, and those that cease to be, by ``sign``."""
        rows = records.where(has_key()).select(*KEY, *(c for c in records.columns if c not in KEY))
        schema, slots, plainly = self.form(rows.schema)
        slot = F.pmod(F.xxhash64("benchmark", "task_id"), F.lit(slots)).alias("_slot")
        both = [plain(c, rows.schema[c].dataType) for c in plainly]
        kinds = reduce(Column.__add__, (place * F.lit(3**i).cast("bigint") for i, (place, _) in enumerate(both)), F.lit(0).cast("bigint"))
        fields = self.as_text(schema, plainly).names
        text = [F.to_json(F.struct(*(F.col(schema.names[int(c[1:])]).alias(c) for c in fields)), TEXT).alias("_record")] if fields else []
        texts = rows.select(slot, *KEY, kinds.alias("_kinds"), *(value.alias(n) for n, (_, value) in zip(self.names(plainly), both, strict=True)), *text)
        signed = texts.groupBy("_slot").applyInPandasWithState(keeping, self.kept(schema, plainly) + ", sign int", "entries binary", "update", GroupStateTimeout.NoTimeout)
        return self.read_again(signed, schema, plainly, "sign")

    def read_again(self, kept: DataFrame, schema: StructType, plainly: Sequence[str], *more: str) -> DataFrame:
        """Records from what was kept of them. A text is parsed once: a generator stands between the parser and what uses its result."""
        text = self.as_text(schema, plainly)
        rows = kept.select("*", F.explode(F.array(F.from_json("_record", text, TEXT))).alias("_r")) if len(text) else kept
        columns = {schema.names[int(c[1:])]: F.col("_r")[c] for c in text.names} | {c: F.col(c) for c in KEY}
        for i, (c, n) in enumerate(zip(plainly, self.names(plainly), strict=True)):
            place = F.expr(f"_kinds div {3**i} % 3")
            columns.setdefault(c, again(place, F.col(n), schema[c].dataType))
        return rows.select(*(columns[c].alias(c) for c in schema.names), *more)

    def put(self, batch: DataFrame, number: int) -> None:
        ok, sign = F.col("error").isNull(), F.col("sign")
        right = F.coalesce("correct", F.lit(False))
        sums = {"n": F.lit(1), "n_errors": (~ok).cast("int"), "n_correct": (right & ok).cast("int"), "n_right": right.cast("int"), "n_failed": (F.coalesce("error", F.lit("")) != "").cast("int")}
        sums |= {c: F.when(ok, F.coalesce(F.col(c), F.lit(0))) for c in present(batch, COSTS)}
        batch.groupBy("benchmark", "policy", "task_id").agg(*(F.sum(sign * v).alias(c) for c, v in sums.items())).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")

    def start(self, records: DataFrame) -> StreamingQuery:
        """Read what has come since the last time, and stop."""
        with settings(self.spark, STORE):
            stream = self.changes(records).writeStream.outputMode("update").foreachBatch(self.put)
            return stream.option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start()

    def latest(self) -> DataFrame:
        """The latest record of every key, from the state store."""
        schema, _, plainly = self.form()
        with settings(self.spark, STORE):
            state = self.spark.read.format("statestore").option("path", f"{self.folder}/stream").load()
        return self.read_again(state.select("value.groupState.entries").mapInArrow(unpacked, self.kept(schema, plainly)), schema, plainly)

    def numbers(self, folder: str) -> list[int]:
        """Of the folders ``name=number`` in a folder the numbers, ascending."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if "=" in x.getPath().getName()) if fs.exists(at) else []

    def task_sums(self) -> DataFrame:
        """``summary.task_counts`` of the latest records, from what was folded and the batches since."""
        folded = self.numbers("folded")
        since = [f"{self.folder}/sums/batch={n}" for n in self.numbers("sums") if not folded or n > folded[-1]]
        paths = [*since, *(f"{self.folder}/folded/upto={n}" for n in folded[-1:])]
        if not paths:
            raise ValueError(f"no batch of {self.folder} has been read")
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)  # without columns of the folders' names
        return rows.groupBy("benchmark", "policy", "task_id").agg(*(F.sum(c).alias(c) for c in rows.columns if c not in ("benchmark", "policy", "task_id"))).where("n > 0")

    def fold(self) -> None:
        """Add all batches up to one. What was added up stays in place; readers leave it out."""
        last = self.numbers("sums")[-1:]
        if last and last != self.numbers("folded")[-1:]:
            self.task_sums().write.mode("overwrite").parquet(f"{self.folder}/folded/upto={last[0]}")

    def summary(self, params_b: float | None = None, n_boot: int = 0) -> DataFrame:
        """``operators.summary.summary`` of the latest records."""
        return summary_of_tasks(self.task_sums().drop("n_right", "n_failed"), params_b, COSTS, n_boot)

    def progress(self) -> DataFrame:
        """``benchmark, policy, finished, accuracy, errors`` over the latest records."""
        sums = self.task_sums().groupBy("benchmark", "policy").agg(F.sum("n").alias("finished"), F.sum("n_right").alias("n_right"), F.sum("n_failed").alias("errors"))
        return sums.select("benchmark", "policy", "finished", share(F.col("n_right"), F.col("finished")).alias("accuracy"), "errors")
