"""Run logs, calls, samples and outputs derived from the order tables, as the same SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.sources.runlog import latest

#: Policies in stage order.
POLICIES = ("B0", "B1", "B2-1k", "B2-4k", "B3")

RAW_SQL = """
SELECT p_type AS benchmark,
       concat('part-', CAST(l_partkey AS STRING)) AS task_id,
       CASE l_suppkey % 5 WHEN 0 THEN 'B0' WHEN 1 THEN 'B1' WHEN 2 THEN 'B2-1k' WHEN 3 THEN 'B2-4k' ELSE 'B3' END AS policy,
       CAST(l_linenumber % 3 AS INT) AS seed,
       l_orderkey * 8 + l_linenumber AS seq,
       l_shipdate, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
       CAST(1 + p_size % 5 AS INT) AS level,
       CASE WHEN l_tax >= 0.08 THEN 'TimeoutError: x' END AS error,
       (l_tax < 0.08 AND l_quantity > 30 - 5 * (l_suppkey % 5)) AS correct,
       CASE WHEN l_tax < 0.08 THEN CASE WHEN l_suppkey % 5 >= 2 THEN 2 ELSE 1 END END AS calls,
       CASE WHEN l_tax < 0.08 THEN (1 + (l_suppkey % 5) * (l_suppkey % 5)) * (10 + CAST(floor(l_extendedprice / 1000) AS BIGINT)) END AS generated_tokens,
       CASE WHEN l_tax < 0.08 THEN CASE WHEN l_suppkey % 5 >= 2 THEN (l_suppkey % 5) * (10 + CAST(floor(l_extendedprice / 1000) AS BIGINT)) ELSE 0 END END AS thinking_tokens,
       CASE WHEN l_tax < 0.08 THEN 100 + CAST(l_quantity AS BIGINT) END AS prefill_tokens,
       CASE WHEN l_tax < 0.08 THEN CASE WHEN l_suppkey % 5 >= 2 THEN 250 ELSE 100 END + CAST(l_quantity AS BIGINT) END AS prompt_tokens,
       CASE WHEN l_tax < 0.08 THEN l_extendedprice / 8192 END AS latency_s,
       CASE WHEN l_tax < 0.08 AND l_discount <> 0.05 THEN l_quantity / 50 - 1 - l_discount END AS mean_logprob,
       CASE WHEN l_tax < 0.08 THEN CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END END AS finished
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

#: What orders the records of a key, besides ``seq``: (order key, line) is not unique.
TIES = ("l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")

ATTEMPTS_SQL = f"""
SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY benchmark, task_id, policy, seed
   ORDER BY seq DESC, {", ".join(f"{c} DESC" for c in TIES)}) AS rn FROM attempts_raw r) x WHERE rn = 1
"""

CALLS_SQL = """
SELECT benchmark, task_id, policy, seed, 1 AS call_no, CASE WHEN calls = 2 THEN 'think' ELSE 'answer' END AS step,
  prefill_tokens AS prompt_tokens, CASE WHEN calls = 2 THEN thinking_tokens ELSE generated_tokens END AS completion_tokens,
  CASE WHEN l_discount >= 0.08 THEN 'length' ELSE 'stop' END AS finish_reason
 FROM attempts WHERE error IS NULL
UNION ALL
SELECT benchmark, task_id, policy, seed, 2, 'answer', prefill_tokens + thinking_tokens + (l_suppkey % 7) - 3, generated_tokens - thinking_tokens, 'stop'
 FROM attempts WHERE error IS NULL AND calls = 2
"""

SAMPLES_SQL = f"""
SELECT benchmark, task_id, policy, seed, mean_logprob, generated_tokens,
  CAST(row_number() OVER (PARTITION BY benchmark, task_id, policy, seed ORDER BY seq, {", ".join(TIES)}) - 1 AS INT) AS sample_no,
  CASE WHEN l_discount < 0.1 THEN CAST(CAST(l_quantity AS INT) % 4 AS STRING) END AS vote
FROM attempts_raw
"""

#: Columns of the attempts that outputs are made of.
OF_OUTPUTS = ("seq", "l_quantity", "l_discount")

OUTPUTS_SQL = """
SELECT benchmark, task_id, policy, seed, 'math' AS kind, CAST(seq % 6 AS INT) AS form,
 CASE CAST(seq % 6 AS INT)
  WHEN 0 THEN concat('so ', chr(92), 'boxed{', q, '}.')
  WHEN 1 THEN concat('<think>', chr(92), 'boxed{1}</think> final ', chr(92), 'boxed{', q, '}')
  WHEN 2 THEN concat('work', chr(10), '#### ', q)
  WHEN 3 THEN concat('The answer is ', q, '.')
  WHEN 4 THEN concat('first 3 then ', q)
  ELSE concat(chr(92), 'boxed{', chr(92), 'frac{', q, '}{2}}') END AS output,
 CASE CAST(seq % 6 AS INT) WHEN 5 THEN concat(chr(92), 'frac{', q, '}{2}') ELSE q END AS expected_pred,
 CASE WHEN l_discount >= 0.08 THEN concat(q, '1') WHEN seq % 6 = 5 THEN concat(q, '/2') ELSE q END AS reference,
 (l_discount < 0.08) AS expected_correct
FROM (SELECT a.*, CAST(CAST(l_quantity AS INT) AS STRING) AS q FROM attempts a) y
"""

#: What a live cascade (B0, then B2-1k below -0.3, then B3 below -0.5) would have logged, stage by stage; a run whose order number ends in 7 logged one token more.
LIVE_SQL = """
SELECT a.benchmark, a.task_id, a.seed, 'B0' AS stopped_at, a.correct, coalesce(a.generated_tokens, 0) + CASE WHEN a.seq % 10 = 7 THEN 1 ELSE 0 END AS generated_tokens
 FROM attempts a JOIN attempts b ON b.benchmark = a.benchmark AND b.task_id = a.task_id AND b.seed = a.seed AND b.policy = 'B2-1k' JOIN attempts c ON c.benchmark = a.benchmark AND c.task_id = a.task_id AND c.seed = a.seed AND c.policy = 'B3'
 WHERE a.policy = 'B0' AND a.mean_logprob >= -0.3
UNION ALL
SELECT a.benchmark, a.task_id, a.seed, 'B2-1k', b.correct, coalesce(a.generated_tokens, 0) + coalesce(b.generated_tokens, 0)
 FROM attempts a JOIN attempts b ON b.benchmark = a.benchmark AND b.task_id = a.task_id AND b.seed = a.seed AND b.policy = 'B2-1k' JOIN attempts c ON c.benchmark = a.benchmark AND c.task_id = a.task_id AND c.seed = a.seed AND c.policy = 'B3'
 WHERE a.policy = 'B0' AND NOT coalesce(a.mean_logprob >= -0.3, false) AND b.mean_logprob >= -0.5
UNION ALL
SELECT a.benchmark, a.task_id, a.seed, 'B3', c.correct, coalesce(a.generated_tokens, 0) + coalesce(b.generated_tokens, 0) + coalesce(c.generated_tokens, 0)
 FROM attempts a JOIN attempts b ON b.benchmark = a.benchmark AND b.task_id = a.task_id AND b.seed = a.seed AND b.policy = 'B2-1k' JOIN attempts c ON c.benchmark = a.benchmark AND c.task_id = a.task_id AND c.seed = a.seed AND c.policy = 'B3'
 WHERE a.policy = 'B0' AND NOT coalesce(a.mean_logprob >= -0.3, false) AND NOT coalesce(b.mean_logprob >= -0.5, false)
"""

#: The views in the order in which they build on each other.
VIEWS = {"attempts_raw": RAW_SQL, "attempts": ATTEMPTS_SQL, "calls": CALLS_SQL, "samples": SAMPLES_SQL, "outputs": OUTPUTS_SQL, "live": LIVE_SQL}


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL: the query after the views that it needs."""
    needed = {"attempts_raw": ("attempts_raw",), "attempts": ("attempts_raw", "attempts"), "samples": ("attempts_raw", "samples")}
    wanted = {v for n in names for v in (*needed.get(n, ("attempts_raw", "attempts")), n)}
    chain = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in wanted)
    query = query.strip()
    return f"WITH {chain}, {query[5:]}" if query.upper().startswith("WITH ") else f"WITH {chain} {query}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL over named frames, registered for this statement."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def attempts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, RAW_SQL, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def attempts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest record of every key, by the library's own operator; with its key and the ``columns`` named, else with all: what is not named does not go through the shuffle."""
    raw = attempts_raw(spark, sf_dir)
    return latest(raw, ["seq", *TIES], columns)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, CALLS_SQL, attempts=attempts(spark, sf_dir, "error", "calls", "prefill_tokens", "thinking_tokens", "generated_tokens", "l_discount", "l_suppkey"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on(spark, SAMPLES_SQL, attempts_raw=attempts_raw(spark, sf_dir))


def outputs(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """Outputs of the attempts, or of ``records`` that were made of them."""
    return on(spark, OUTPUTS_SQL, attempts=attempts(spark, sf_dir, *OF_OUTPUTS) if records is None else records)


def live(spark: SparkSession, records: DataFrame) -> DataFrame:
    """What live cascades logged, from attempts, of which each is read for several stages."""
    return on(spark, LIVE_SQL, attempts=records)


def points(records: DataFrame) -> DataFrame:
    """A summary as points: ``benchmark, policy, gen_tokens, accuracy``."""
    return records.select("benchmark", "policy", F.col("generated_tokens").alias("gen_tokens"), "accuracy")
