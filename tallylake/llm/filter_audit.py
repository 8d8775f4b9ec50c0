"""What five document filters remove in every order of theirs, kept up to date by a stream that takes back what later files disprove.

The files of the table come as available-now micro-batches. The filters A to D follow from the text alone, so a document is a mask of failed filters, a bit each. E fails on a text that a document with
a smaller id holds, in any file: state keyed by the text holds the smallest id met so far and the documents that have it. When a smaller id arrives, the
documents held before turn out to be copies: their old masks are taken back from the counters of their parts, and counted again with E. Counters per part and mask are
all that is left of a micro-batch; they are written under its number, so a batch that is run again replaces itself, and a stream started again on the same folder reads new files only.

An entry of the state holds a few hundred texts, because each one costs a call of Python; their number follows the table when the stream begins, and the session's state store (RocksDB for
states beyond memory) holds them. Before the state each batch of rows of a task keeps, of equal texts, the smallest id: other rows are known to be copies, and come along as counts. So a text that a third of all rows hold
reaches its state as one row for each of their batches. At most 32 masks a part remain, from which the rows of all 120 orders follow without any further shuffle.

Cases: a null text is an empty one, equal to other empty ones; rows that repeat an id hold no smaller one, so they are no copies of each other; a null doc_id is no copy and makes none;
a null source is the part ``''``; a label counts if any of its rows for the id has it; null labels count for nothing; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import checkpointed, deleted, shared_folder, text_or_empty

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Micro-batches that a table is read in, about.
BATCHES = 4
COUNTERS = "part string, mask int, good boolean, toxic boolean, n bigint"
#: Texts, about, that share an entry of the state.
TOGETHER = 256


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the failed filters A to D."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 2 * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]")))
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text_key, doc_id, part, mask, good, toxic``. Texts end here: what follows carries a digest."""
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    words = F.filter(F.split(text_or_empty(), r"[ \t-\r]+"), lambda w: w != "").alias("words")
    texts = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"), words)
    rows = texts.select(F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(32)).alias("text_key"), "doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"))
    return rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of a task the smallest id, with the counts of the rows that hold it (``held``) and those of all others (``lost``), as JSON."""
    for batch in batches:
        least: dict[str, tuple[int | None, Counter, Counter]] = {}
        for key, doc_id, *entry in zip(*(batch[c].to_pylist() for c in ("text_key", "doc_id", "part", "mask", "good", "toxic")), strict=True):
            at, held, lost = least.get(key) or (None, Counter(), Counter())
            if doc_id is None:
                lost[tuple(entry)] += 1
            elif at is None or doc_id <= at:
                if at is not None and doc_id < at:
                    lost.update(copies(held))
                    held = Counter()
                at = doc_id
                held[tuple(entry)] += 1
            else:
                lost.update(copies({tuple(entry): 1}))
            least[key] = at, held, lost
        ids, held, lost = zip(*least.values(), strict=True) if least else ((), (), ())
        yield pa.RecordBatch.from_pydict({"text_key": pa.array([*least], pa.string()), "doc_id": pa.array(ids, pa.int64()), "held": pa.array(map(written, held), pa.string()), "lost": pa.array(map(written, lost), pa.string())})


def copies(counts: dict) -> dict:
    """The same documents, found to be copies."""
    return {(part, mask | COPY, good, toxic): n for (part, mask, good, toxic), n in counts.items()}


def written(counts: dict) -> str:
    return "" if not counts else json.dumps([[*k, n] for k, n in counts.items()])


def read(counts: str) -> Counter:
    return Counter({tuple(k): n for *k, n in json.loads(counts)}) if counts else Counter()


def retracting(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of the counters that new rows make. The state of a few hundred texts holds of each its smallest id and the counts of the documents that have it, as JSON."""
    texts, change = json.loads(state.get[0]) if state.exists else {}, Counter()
    for frame in frames:
        for text, doc_id, own, lost in zip(frame["text_key"], frame["doc_id"], frame["held"], frame["lost"], strict=True):
            change.update(read(lost))
            if pd.isna(doc_id):
                continue
            doc_id, own = int(doc_id), read(own)
            least, held = texts.get(text) or (None, "")
            if least is not None and doc_id > least:
                change.update(copies(own))
                continue
            change.update(own)
            if doc_id == least:
                own.update(read(held))
            elif least is not None:
                change.subtract(read(held))
                change.update(copies(read(held)))
            texts[text] = doc_id, written(own)
    state.update((json.dumps(texts),))
    rows = [(*k, n) for k, n in change.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


def stream_of(spark: SparkSession, path: str, files: int) -> DataStreamReader:
    """The files of a table, so many a micro-batch. A table may be a single file, which a stream reads as the one of that name in its folder."""
    reader = spark.readStream.format("parquet").option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("path", at.getParent().toString()).option("pathGlobFilter", at.getName())
    return reader.option("path", path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def counted(spark: SparkSession, path: str, labels: DataFrame, folder: str, batches: int = BATCHES, together: int = TOGETHER) -> DataFrame:
    """``part, mask, good, toxic, n`` after all files of ``path`` that the stream of ``folder`` has not read yet, and those that it has: one more run of the stream.

    ``folder`` is one that the cluster shares; it keeps the state, the counters and the number of the state's entries. A batch takes as many files as make about ``batches`` of the present ones.
    """
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    if not exists(spark, f"{folder}/entries"):
        spark.createDataFrame([(max(1, -(-table.count() // together)),)], "entries bigint").coalesce(1).write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries").first()[0]
    docs = stream_of(spark, path, max(1, -(-files // batches))).schema(table.schema).load()
    rows = judged(docs, labels).mapInArrow(combined, "text_key string, doc_id bigint, held string, lost string")
    dealt = rows.withColumn("entry", F.pmod(F.xxhash64("text_key"), F.lit(entries)))
    changes = dealt.groupBy("entry").applyInPandasWithState(retracting, COUNTERS, "texts string", "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, f"{folder}/counters"):
        return spark.createDataFrame([], COUNTERS)
    found = spark.read.schema(COUNTERS).option("basePath", f"{folder}/counters").parquet(f"{folder}/counters/batch=*")
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def orders_of(counts: DataFrame) -> DataFrame:
    """The 600 rows of each part (120 orders of five steps) from its counters, at most 128 of them.

    ``shapley`` needs no sum over orders: of the filters that a document fails each comes first in an equal share of the orders.
    """
    masks = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    every = [("".join(o), i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:i])) for o in itertools.permutations(FILTERS) for i, f in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "own", "earlier"), e, strict=True)) for e in every])), "array<struct<filter_order:string,step:int,own:int,earlier:int>>")
    rows = parts.select("part", "masks", F.explode(steps).alias("s"))

    def total(of: str, when) -> Column:
        return F.aggregate(F.filter("masks", lambda m: when(m["mask"])), F.lit(0).cast("bigint"), lambda a, m: a + m[of])

    own, earlier = F.col("s.own"), F.col("s.earlier")
    fails = lambda m: m.bitwiseAND(own) != 0
    new = lambda m: fails(m) & (m.bitwiseAND(earlier) == 0)
    share = F.aggregate(F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("bigint"), lambda a, m: a + m["n"] * F.floor(F.lit(120) / F.bit_count(m["mask"])))
    return rows.select(
        "part", "s.filter_order", "s.step", total("n", lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"), total("n", new).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(earlier) != 0)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"), total("good", new).alias("good_lost"), total("toxic", new).alias("toxic_lost"), share.alias("shapley"),
    )


def audited(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The audit of a whole table by a stream of its own, whose folder goes when the counters are there."""
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    counts = checkpointed(counted(spark, path, labels, folder, batches))
    deleted(spark, folder)
    return orders_of(counts)
