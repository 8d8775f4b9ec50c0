"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data is masked, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet and reads it again for the next stage.
Stages keep the columns of documents (``n_chars`` follows the text); the last one returns the pieces of packed sequences.

Cases: a null text is an empty document; rows with a null doc_id are judged as any other. Of a group of near duplicates the row with the smallest known doc_id stays (in a
group without any, and among rows of one doc_id, the one whose text hashes lowest); rows are told apart by all their columns, so other texts under a repeated
doc_id are judged by themselves, and of equal rows one stays; extra columns are carried to the last stage; no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.llm import packing, pii, simhash, toxicity
from tallylake.llm.common import shared_folder
from tallylake.llm.queries import WORD_VOCABULARY, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text").cast("string"), lexicon) < 0.7)


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart, in the order in which they are kept: known doc_ids first, then the doc_id, the text's hash, and a hash of all columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = F.xxhash64(*(F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes))
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.unhex(F.md5(text)).alias("hash"), every.alias("row"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each near-duplicate group, by ``row_key``."""
    key = "near_duplicate_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, row_key(docs))
    found = simhash.near_duplicates(keyed, doc_id=key)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    out = docs.withColumn("text", pii.redacted(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, and their places in sequences of 2,048 tokens."""
    return packing.packed_documents(docs, WORD_VOCABULARY)


STAGES = [("toxicity", without_toxic), ("near duplicates", without_near_duplicates), ("personal data", masked), ("packing", packed)]

#: SQL has no learned lexicon, CRF or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results between stages go to the folder that the cluster shares, each until the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            deleted(spark, f"{folder}/{i - 1}")
    return docs
