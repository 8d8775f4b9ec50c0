"""The registered queries of the run-log operators over the given tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallylake.functions import answers, prompts, signals, splits, usage
from tallylake.operators import bootstrap, calls, frontier, grading, jobs, replay, routing, summary
from tallylake.plans import fixtures, report
from tallylake.plans.fixtures import POLICIES, table, with_views
from tallylake.schemas import log_fields
from tallylake.sources import runlog, tasks
from tallylake.sources.runlog import result_without, shared_folder
from tallylake.streaming import log, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STAGES = ["B0", "B2-1k", "B3"]

#: What replays and summaries need of a record.
NARROW = ("benchmark", "task_id", "policy", "seed", "correct", "error", "calls", "prefill_tokens", "generated_tokens", "thinking_tokens", "latency_s", "mean_logprob")


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def to_digits(x: Column, digits: int = 9) -> Column:
    """A double to so many digits as SQL rounds it: the product with a power of ten to the next integer. Spark's ``round`` goes by the shortest decimal form, in which a sum next to a tie is on one side of it."""
    power = F.lit(10.0**digits)
    near = F.round(x * power) / power
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), x).otherwise(near)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to 9 digits: sums of doubles depend on the order of rows."""
    return df.select(*(to_digits(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def logprob_score():
    return routing.signal_score(F.col("mean_logprob"))


# ---- SQL building blocks -------------------------------------------------------------------------------------------

RIGHT = "(correct AND error IS NULL)"
SUMMARY_SQL = """
by_task AS (
  SELECT benchmark, policy, task_id, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS n_errors, count(*) FILTER (correct AND error IS NULL) AS n_right,
         sum(calls) FILTER (error IS NULL) AS calls, sum(prefill_tokens) FILTER (error IS NULL) AS prefill, sum(generated_tokens) FILTER (error IS NULL) AS gen,
         sum(thinking_tokens) FILTER (error IS NULL) AS think, sum(latency_s) FILTER (error IS NULL) AS latency
  FROM {source} GROUP BY ALL),
summarised AS (
  SELECT benchmark, policy, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n_errors) AS BIGINT) AS errors, avg(CAST(n_right AS DOUBLE) / n) AS accuracy,
         CAST(sum(calls) AS DOUBLE) / nullif(sum(n) - sum(n_errors), 0) AS calls, CAST(sum(prefill) AS DOUBLE) / nullif(sum(n) - sum(n_errors), 0) AS prefill_tokens,
         CAST(sum(gen) AS DOUBLE) / nullif(sum(n) - sum(n_errors), 0) AS generated_tokens, CAST(sum(think) AS DOUBLE) / nullif(sum(n) - sum(n_errors), 0) AS thinking_tokens,
         sum(latency) / nullif(sum(n) - sum(n_errors), 0) AS latency_s
  FROM by_task GROUP BY benchmark, policy)"""
POINTS_SQL = "WITH " + SUMMARY_SQL.format(source="attempts").strip() + ", points AS (SELECT benchmark, policy, generated_tokens AS gen_tokens, accuracy FROM summarised WHERE generated_tokens IS NOT NULL)"
FRONTIER_SQL = """, front AS (
  SELECT * EXCLUDE (top) FROM (SELECT *, max(accuracy) OVER (PARTITION BY benchmark ORDER BY gen_tokens, accuracy DESC, policy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM points) x
  WHERE top IS NULL OR accuracy > top)"""
ORACLE_SQL = """
oracle AS (
  SELECT benchmark, task_id, seed, 'oracle' AS policy, policy AS chosen, correct, error, calls, prompt_tokens, prefill_tokens, generated_tokens, thinking_tokens, latency_s, level
  FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, task_id, seed ORDER BY NOT (correct AND error IS NULL), coalesce(generated_tokens, 0), policy) AS place,
               count(*) OVER (PARTITION BY benchmark, task_id, seed) AS policies FROM attempts) x
  WHERE place = 1 AND policies = 5)"""


def staged_sql(policies: list[str]) -> str:
    """One row per task and seed that all stages ran, with each stage's columns numbered."""
    one = lambda i, p: ", ".join(f"max(CASE WHEN policy = '{p}' THEN {e} END) AS {n}{i}" for n, e in (("ok", "CAST(correct AS INT)"), ("err", "error"), ("tok", "coalesce(generated_tokens, 0)"), ("cl", "coalesce(calls, 0)"), ("pre", "coalesce(prefill_tokens, 0)"), ("th", "coalesce(thinking_tokens, 0)"), ("pt", "coalesce(prompt_tokens, 0)"), ("la", "coalesce(latency_s, 0)"), ("lv", "level"), ("fi", "finished"), ("sc", "mean_logprob")))
    every = ", ".join(one(i, p) for i, p in enumerate(policies))
    names = ", ".join(f"'{p}'" for p in policies)
    return f"wide AS (SELECT benchmark, task_id, seed, {every} FROM attempts WHERE policy IN ({names}) GROUP BY ALL HAVING count(*) = {len(policies)})"


def replay_columns(stop: str) -> str:
    total = lambda n: f"CAST({n}0 + CASE WHEN {stop} > 0 THEN {n}1 ELSE 0 END + CASE WHEN {stop} > 1 THEN {n}2 ELSE 0 END AS BIGINT)"
    at = lambda n: f"CASE {stop} WHEN 0 THEN {n}0 WHEN 1 THEN {n}1 ELSE {n}2 END"
    return f"({at('ok')}) = 1 AS correct, {at('err')} AS error, CASE {stop} WHEN 0 THEN 'B0' WHEN 1 THEN 'B2-1k' ELSE 'B3' END AS stopped_at, {at('lv')} AS level, {total('cl')} AS calls, {total('pt')} AS prompt_tokens, round(la0 + CASE WHEN {stop} > 0 THEN la1 ELSE 0 END + CASE WHEN {stop} > 1 THEN la2 ELSE 0 END, 9) AS latency_s, {total('pre')} AS prefill_tokens, {total('tok')} AS generated_tokens, {total('th')} AS thinking_tokens"


# ---- run log: latest, completed, summaries -------------------------------------------------------------------------


@query("WITH " + SUMMARY_SQL.format(source="attempts").strip() + " SELECT benchmark, policy, tasks, records, errors, round(accuracy, 9) AS accuracy, round(calls, 9) AS calls, round(prefill_tokens, 9) AS prefill_tokens, round(generated_tokens, 9) AS generated_tokens, round(thinking_tokens, 9) AS thinking_tokens, round(latency_s, 9) AS latency_s, round(2 * 8.2e9 * (prefill_tokens + generated_tokens) / 1e12, 9) AS tflops FROM summarised", "attempts")
def policy_summary(spark, sf_dir):
    return rounded(summary.summary(fixtures.attempts(spark, sf_dir, *NARROW), params_b=8.2))


@query("SELECT benchmark, task_id, policy, seed, seq, correct, error, generated_tokens FROM attempts", "attempts")
def latest_records(spark, sf_dir):
    return fixtures.attempts(spark, sf_dir, "seq", "correct", "error", "generated_tokens")


@query("SELECT DISTINCT benchmark, task_id, policy, seed FROM attempts_raw WHERE coalesce(error, '') = ''", "attempts_raw")
def completed_keys(spark, sf_dir):
    return runlog.completed_keys(fixtures.attempts_raw(spark, sf_dir))


@query("SELECT benchmark, task_id, policy, seed, correct, error, generated_tokens AS gen_tokens, CAST(level AS VARCHAR) AS level FROM attempts_raw", "attempts_raw")
def run_log_lines(spark, sf_dir):
    """Records written as JSON lines, between blank and broken ones, to the shared folder, and read back from its files."""
    raw = fixtures.attempts_raw(spark, sf_dir)
    record = F.struct("benchmark", "task_id", "policy", F.col("seed").cast("string").alias("seed"), "correct", "error", F.struct("calls", "prefill_tokens", "generated_tokens").alias("cost"), F.create_map(F.lit("level"), F.col("level").cast("string")).alias("meta"))
    lines = raw.select(F.to_json(record).alias("line")).select(F.explode(F.array("line", F.lit("  "), F.substring("line", 1, 40))).alias("value"))
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    lines.write.text(folder)
    records = runlog.read_run_log(spark, [folder], log_fields("benchmark", "task_id", "policy", "correct", "error", "meta", "cost"))
    out = records.select("benchmark", "task_id", "policy", "seed", "correct", "error", F.col("cost.generated_tokens").alias("gen_tokens"), F.col("meta")["level"].alias("level"))
    return result_without(out, folder)


@query("SELECT benchmark, policy, task_id, seed, correct, error, generated_tokens AS gen_tokens FROM attempts", "attempts")
def written_run_log(spark, sf_dir):
    """The latest records written as a compacted log, partitioned by benchmark and policy, and read back."""
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    runlog.write_run_log(runlog.compacted(fixtures.attempts(spark, sf_dir).select("benchmark", "policy", "task_id", "seed", "correct", "error", F.col("generated_tokens").alias("gen_tokens"))), folder)
    return result_without(spark.read.parquet(folder).select("benchmark", "policy", "task_id", "seed", "correct", "error", "gen_tokens"), folder)


def stored_log(spark, sf_dir, *columns: str) -> runlog.StoredLog:
    """The raw run log in two appends to a bucketed table, with a bucket for some 50,000 records; of each its key, what orders it and the ``columns`` named."""
    raw = fixtures.attempts_raw(spark, sf_dir).select("benchmark", "task_id", "policy", "seed", "seq", *fixtures.TIES, *columns)
    stored = runlog.StoredLog(spark, f"run_log_{uuid.uuid4().hex}", max(1, raw.count() // 50_000))
    for part in (0, 1):
        stored.append(raw.where(F.col("seq") % 2 == part))
    return stored


@query("SELECT benchmark, task_id, policy, seed, seq, correct, error, generated_tokens FROM attempts", "attempts")
def stored_latest(spark, sf_dir):
    """The latest records, read from a table that is stored by task."""
    stored = stored_log(spark, sf_dir, "correct", "error", "generated_tokens")
    out = runlog.checkpointed(stored.latest(["seq", *fixtures.TIES]).select("benchmark", "task_id", "policy", "seed", "seq", "correct", "error", "generated_tokens"))
    stored.drop()
    return out


@query("SELECT benchmark, policy, task_id, round(avg(CAST(correct AND error IS NULL AS INT)), 9) AS value FROM attempts GROUP BY ALL", "attempts")
def per_task_mean(spark, sf_dir):
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    return rounded(summary.per_task(fixtures.attempts(spark, sf_dir, "correct", "error"), right.cast("int")))


LEVEL_SQL = "SELECT benchmark, policy, level, round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 9) AS accuracy, count(*) AS records FROM attempts GROUP BY ALL"


@query(LEVEL_SQL, "attempts")
def accuracy_by_level(spark, sf_dir):
    return rounded(summary.accuracy_by_level(fixtures.attempts(spark, sf_dir)))


@query(f"SELECT benchmark, policy, {', '.join(f'max(accuracy) FILTER (level = {i}) AS level_{i}' for i in range(1, 6))} FROM ({LEVEL_SQL}) x GROUP BY ALL", "attempts")
def level_table(spark, sf_dir):
    return rounded(summary.level_table(summary.accuracy_by_level(fixtures.attempts(spark, sf_dir)), range(1, 6)))


@query("SELECT count(*) AS n, round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 9) AS base_rate, array_to_string(list_sort(list(DISTINCT benchmark)), '|') AS benchmarks FROM attempts", "attempts")
def base_rate(spark, sf_dir):
    return rounded(summary.base_rate(fixtures.attempts(spark, sf_dir)).withColumn("benchmarks", F.array_join("benchmarks", "|")))


@query("SELECT benchmark, policy, count(*) AS finished, round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 9) AS accuracy, count(*) FILTER (error IS NOT NULL) AS errors, round(count(*) * 32 / nullif(sum(coalesce(latency_s, 0)), 0), 9) AS jobs_per_s FROM attempts_raw GROUP BY ALL", "attempts_raw")
def log_progress(spark, sf_dir):
    return rounded(summary.progress(fixtures.attempts_raw(spark, sf_dir), F.col("latency_s"), workers=32))


# ---- splits and filters ----------------------------------------------------------------------------------------------

POSITION = "CAST(('0x' || substr(sha256(task_id), 1, 8)) AS BIGINT) / 4294967295.0"


@query(f"SELECT task_id, round({POSITION}, 9) AS position, {POSITION} < 0.5 AS train FROM (SELECT DISTINCT task_id FROM attempts_raw) x", "attempts_raw")
def stable_split(spark, sf_dir):
    ids = fixtures.attempts_raw(spark, sf_dir).select("task_id").distinct()
    return rounded(ids.select("task_id", splits.split_position(F.col("task_id")).alias("position"), splits.in_train_split(F.col("task_id"), 0.5).alias("train")))


@query(f"SELECT benchmark, policy, count(*) AS records, count(*) FILTER (correct) AS n_correct FROM attempts WHERE NOT ({POSITION} < 0.5) GROUP BY ALL", "attempts")
def held_out_counts(spark, sf_dir):
    kept = splits.held_out(fixtures.attempts(spark, sf_dir), 0.5)
    return kept.groupBy("benchmark", "policy").agg(F.count("*").alias("records"), F.count_if("correct").alias("n_correct"))


@query("SELECT benchmark, task_id, policy, seed FROM attempts WHERE task_id IN (SELECT concat('part-', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size < 10)", "attempts")
def task_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("task_id"))
    return splits.of_tasks(fixtures.attempts(spark, sf_dir), wanted).select("benchmark", "task_id", "policy", "seed")


# ---- replay and hindsight --------------------------------------------------------------------------------------------


@query("SELECT benchmark, task_id, seed FROM attempts GROUP BY ALL HAVING count(DISTINCT policy) = 5", "attempts")
def common_keys(spark, sf_dir):
    return replay.common_keys(fixtures.attempts(spark, sf_dir), POLICIES)


@query("WITH " + ORACLE_SQL.strip() + " SELECT * REPLACE (round(latency_s, 9) AS latency_s) FROM oracle", "attempts")
def hindsight_oracle(spark, sf_dir):
    return rounded(replay.oracle(fixtures.attempts(spark, sf_dir), POLICIES))


@query("WITH " + ORACLE_SQL.strip() + " SELECT * REPLACE (round(latency_s, 9) AS latency_s) FROM oracle", "attempts")
def stored_oracle(spark, sf_dir):
    """The hindsight oracle over the stored log: no shuffle from the table's files to the result."""
    stored = stored_log(spark, sf_dir, "correct", "error", "calls", "prompt_tokens", "prefill_tokens", "generated_tokens", "thinking_tokens", "latency_s", "level")
    out = runlog.checkpointed(rounded(replay.oracle(stored.latest(["seq", *fixtures.TIES]), POLICIES)))
    stored.drop()
    return out


REPLAY_SQL = "WITH " + staged_sql(STAGES) + ", stopped AS (SELECT *, CASE WHEN sc0 >= -0.3 THEN 0 WHEN sc1 >= -0.5 THEN 1 ELSE 2 END AS stop FROM wide)"


@query(REPLAY_SQL + f" SELECT benchmark, task_id, seed, 'sim:B0>B2-1k>B3@-0.3,-0.5' AS policy, {replay_columns('stop')} FROM stopped", "attempts")
def cascade_replay(spark, sf_dir):
    return rounded(replay.replayed(fixtures.attempts(spark, sf_dir), STAGES, [logprob_score()], [-0.3, -0.5]))


SWEEP_SQL = "WITH " + staged_sql(STAGES) + """, grid AS (SELECT i / 20.0 - 1 AS t FROM range(21) r(i)),
stopped AS (SELECT *, CASE WHEN sc0 >= t THEN 0 WHEN sc1 >= t THEN 1 ELSE 2 END AS stop FROM wide, grid),
run AS (SELECT benchmark, task_id, t, CASE stop WHEN 0 THEN ok0 WHEN 1 THEN ok1 ELSE ok2 END AS ok, tok0 + CASE WHEN stop > 0 THEN tok1 ELSE 0 END + CASE WHEN stop > 1 THEN tok2 ELSE 0 END AS tok, CAST(stop > 0 AS INT) AS esc FROM stopped),
by_task AS (SELECT benchmark, t, task_id, count(*) AS n, sum(ok) AS ok, sum(tok) AS tok, sum(esc) AS esc FROM run GROUP BY ALL),
sweep AS (SELECT benchmark, CAST(t AS DOUBLE) AS threshold, avg(CAST(ok AS DOUBLE) / n) AS accuracy, CAST(sum(tok) AS DOUBLE) / sum(n) AS gen_tokens, CAST(sum(esc) AS DOUBLE) / sum(n) AS escalation_rate FROM by_task GROUP BY ALL)"""


@query(SWEEP_SQL + " SELECT benchmark, round(threshold, 9) AS threshold, round(accuracy, 9) AS accuracy, round(gen_tokens, 9) AS gen_tokens, round(escalation_rate, 9) AS escalation_rate FROM sweep", "attempts")
def cascade_sweep(spark, sf_dir):
    return rounded(sweep(fixtures.attempts(spark, sf_dir, *NARROW)))


@query("WITH " + staged_sql(STAGES) + """, best AS (SELECT *, greatest(sc0, sc1) AS top FROM wide),
breaks AS (SELECT DISTINCT benchmark, t FROM (SELECT benchmark, sc0 AS t FROM best UNION ALL SELECT benchmark, sc1 FROM best WHERE sc0 IS NULL OR sc1 > sc0) x WHERE t IS NOT NULL),
stopped AS (SELECT w.*, t, CASE WHEN sc0 >= t THEN 0 WHEN sc1 >= t THEN 1 ELSE 2 END AS stop FROM wide w JOIN breaks b ON b.benchmark = w.benchmark),
by_task AS (SELECT benchmark, t, task_id, count(*) AS n, sum(CASE stop WHEN 0 THEN ok0 WHEN 1 THEN ok1 ELSE ok2 END) AS ok, sum(tok0 + CASE WHEN stop > 0 THEN tok1 ELSE 0 END + CASE WHEN stop > 1 THEN tok2 ELSE 0 END) AS tok, sum(CAST(stop > 0 AS INT)) AS esc FROM stopped GROUP BY ALL)
SELECT benchmark, round(t, 9) AS threshold, round(avg(CAST(coalesce(ok, 0) AS DOUBLE) / n), 9) AS accuracy, round(CAST(sum(tok) AS DOUBLE) / sum(n), 9) AS gen_tokens, round(CAST(sum(esc) AS DOUBLE) / sum(n), 9) AS escalation_rate FROM by_task GROUP BY benchmark, t""", "attempts")
def cascade_curve(spark, sf_dir):
    """The sweep at every threshold at which the outcome of some record changes."""
    return rounded(replay.curve(fixtures.attempts(spark, sf_dir, *NARROW), STAGES, [logprob_score()]))


def sweep(records: DataFrame) -> DataFrame:
    return replay.swept(records, STAGES, [logprob_score()], [i / 20.0 - 1 for i in range(21)])


@query(f"WITH q AS (SELECT quantile_cont(mean_logprob, {replay.even_grid()!r}) AS q FROM attempts WHERE policy = 'B0') SELECT CAST(i AS INT) AS place, round(q[i + 1], 9) AS threshold FROM q, range(21) r(i)", "attempts")
def quantile_grid(spark, sf_dir):
    """The 21 thresholds of a sweep without a router, one row each."""
    return rounded(replay.quantiles(fixtures.attempts(spark, sf_dir), "B0", "mean_logprob"))


PAIRED_SQL = """WITH sided AS (
  SELECT benchmark, task_id, count(*) FILTER (policy = 'B3') AS na, count(*) FILTER (policy = 'B0') AS nb, count(*) FILTER (policy = 'B3' AND correct AND error IS NULL) AS ra,
         count(*) FILTER (policy = 'B0' AND correct AND error IS NULL) AS rb, coalesce(sum(generated_tokens) FILTER (policy = 'B3'), 0) AS ta, coalesce(sum(generated_tokens) FILTER (policy = 'B0'), 0) AS tb
  FROM attempts GROUP BY ALL),
paired AS (SELECT benchmark, task_id, CAST(ra AS DOUBLE) / na - CAST(rb AS DOUBLE) / nb AS value, CAST(ta AS DOUBLE) / na AS tok_a, CAST(tb AS DOUBLE) / nb AS tok_b FROM sided WHERE na > 0 AND nb > 0)"""


@query(PAIRED_SQL + " SELECT benchmark, count(*) AS tasks, round(avg(value), 9) AS accuracy_diff, round(avg(tok_a) / greatest(avg(tok_b), 1e-9), 9) AS token_ratio, round(avg(tok_a) - avg(tok_b), 9) AS token_diff FROM paired GROUP BY ALL", "attempts")
def paired_difference(spark, sf_dir):
    return rounded(replay.paired_difference(fixtures.attempts(spark, sf_dir, *NARROW), "B3", "B0"))


@query(REPLAY_SQL + f""" SELECT benchmark, task_id, seed, 'live' AS policy, {replay_columns('stop')}, CAST(stop + 1 AS DOUBLE) AS stages_run,
  CASE WHEN sc0 IS NOT NULL THEN round(sc0, 9) ELSE '-Infinity'::DOUBLE END AS score_b0, CASE WHEN stop >= 1 THEN CASE WHEN sc1 IS NOT NULL THEN round(sc1, 9) ELSE '-Infinity'::DOUBLE END END AS score_b2,
  concat_ws('>', nullif(array_to_string(['B0' FOR x IN range(cl0)], '>'), ''), CASE WHEN stop > 0 THEN nullif(array_to_string(['B2-1k' FOR x IN range(cl1)], '>'), '') END, CASE WHEN stop > 1 THEN nullif(array_to_string(['B3' FOR x IN range(cl2)], '>'), '') END) AS steps FROM stopped""", "attempts")
def live_cascade_records(spark, sf_dir):
    step = F.struct(F.col("policy").alias("name"), F.col("generated_tokens").alias("completion_tokens"))
    records = fixtures.attempts(spark, sf_dir).withColumn("steps", F.when(F.col("error").isNull(), F.array_repeat(step, F.col("calls"))))
    live = replay.live_records(records, STAGES, [logprob_score()], [-0.3, -0.5], "live").withColumn("steps", F.concat_ws(">", F.transform("steps", lambda s: s["name"])))
    met = lambda name: F.try_element_at("signals", F.lit(name))
    return rounded(live.withColumns({"stages_run": met("stages_run"), "score_b0": met("score_B0"), "score_b2": met("score_B2-1k")}).drop("signals"))


@query(REPLAY_SQL + f""", sim AS (SELECT benchmark, task_id, seed, {replay_columns('stop')} FROM stopped)
SELECT s.benchmark, count(*) AS checked, count(*) FILTER (l.correct IS DISTINCT FROM s.correct OR l.generated_tokens IS DISTINCT FROM s.generated_tokens OR l.stopped_at IS DISTINCT FROM s.stopped_at) AS differing
FROM sim s JOIN live l ON l.benchmark = s.benchmark AND l.task_id = s.task_id AND l.seed = s.seed GROUP BY ALL""", "live")
def replay_vs_live(spark, sf_dir):
    """Per benchmark: runs of a live cascade's log (made stage by stage) that are also replayed, and those on which the two differ."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, "seq", "correct", "error", "generated_tokens", "mean_logprob"))
    simulated = runlog.checkpointed(replay.replayed(records, STAGES, [logprob_score()], [-0.3, -0.5]))
    live = runlog.checkpointed(fixtures.live(spark, records).withColumn("error", F.lit(None).cast("string")))
    wrong = replay.disagreements(simulated, live).groupBy("benchmark").agg(F.count("*").alias("differing"))
    met = simulated.join(live.select("benchmark", "task_id", "seed"), ["benchmark", "task_id", "seed"]).groupBy("benchmark").agg(F.count("*").alias("checked"))
    return met.join(wrong, "benchmark", "left").select("benchmark", "checked", F.coalesce("differing", F.lit(0)).alias("differing"))


# ---- bootstrap -------------------------------------------------------------------------------------------------------

CUM = [round(b, 17) for b in bootstrap.poisson_bounds()]


@query(PAIRED_SQL + f""", drawn AS (SELECT benchmark, value, i AS replicate, CAST(('0x' || substr(md5(task_id || '|' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM paired, range(40) r(i)),
weighted AS (SELECT benchmark, replicate, value, {" + ".join(f"CAST(u >= {b!r} AS INT)" for b in CUM)} AS w FROM drawn)
SELECT benchmark, CAST(replicate AS INT) AS replicate, round(sum(w * value) / nullif(sum(w), 0), 9) AS mean FROM weighted GROUP BY ALL""", "attempts")
def poisson_bootstrap(spark, sf_dir):
    pairs = replay.paired_tasks(fixtures.attempts(spark, sf_dir, *NARROW), "B3", "B0")
    return rounded(bootstrap.poisson_replicates(pairs, ["benchmark"], replicates=40))


@query()
def histogram_bootstrap(spark, sf_dir):
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    values = summary.per_task(fixtures.attempts(spark, sf_dir, "correct", "error"), right.cast("int"))
    return bootstrap.histogram_intervals(values, ["benchmark", "policy"])


@query("SELECT policy, round(avg(latency_s), 9) AS mean, true AS inside FROM attempts WHERE latency_s IS NOT NULL GROUP BY policy", "attempts")
def latency_intervals(spark, sf_dir):
    """The bootstrap of latencies, of which there are as many values as records: their histogram is a tree. The bounds are random; that they hold the mean is not."""
    values = fixtures.attempts(spark, sf_dir, "latency_s").select("policy", F.col("latency_s").alias("value"))
    bounds = bootstrap.histogram_intervals(values, ["policy"])
    return rounded(bounds.select("policy", "mean", F.col("mean").between(F.col("ci_low"), F.col("ci_high")).alias("inside")))


@query("SELECT benchmark, policy, round(value, 9) AS value, count(*) AS n FROM (SELECT benchmark, policy, task_id, avg(CAST(correct AND error IS NULL AS INT)) AS value FROM attempts GROUP BY ALL) x GROUP BY ALL", "attempts")
def accuracy_histogram(spark, sf_dir):
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    values = rounded(summary.per_task(fixtures.attempts(spark, sf_dir, "correct", "error"), right.cast("int")))
    return bootstrap.histogram(values, ["benchmark", "policy"])


# ---- frontier --------------------------------------------------------------------------------------------------------


def policy_points(spark, sf_dir) -> DataFrame:
    return fixtures.points(summary.summary(fixtures.attempts(spark, sf_dir, *NARROW)))


@query(POINTS_SQL + FRONTIER_SQL + " SELECT benchmark, policy, round(gen_tokens, 9) AS gen_tokens, round(accuracy, 9) AS accuracy FROM front", "attempts")
def pareto_frontier(spark, sf_dir):
    return rounded(frontier.pareto_frontier(policy_points(spark, sf_dir)))


@query("""WITH points AS (SELECT benchmark, seq * 8 + seed AS id, CAST(generated_tokens AS DOUBLE) AS x, mean_logprob AS y FROM attempts WHERE generated_tokens IS NOT NULL AND mean_logprob IS NOT NULL)
SELECT benchmark, x, round(max(y), 9) AS y FROM (SELECT *, max(y) OVER (PARTITION BY benchmark ORDER BY x, y DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM points) p WHERE top IS NULL OR y > top GROUP BY benchmark, x""", "attempts")
def attempt_frontier(spark, sf_dir):
    """The frontier over single attempts: many points a benchmark, so their order is cut into ranges."""
    points = fixtures.attempts(spark, sf_dir).select("benchmark", (F.col("seq") * 8 + F.col("seed")).alias("id"), F.col("generated_tokens").cast("double").alias("x"), F.col("mean_logprob").alias("y"))
    return rounded(frontier.pareto_frontier(points, "x", "y", "id", many=True).select("benchmark", "x", "y"))


@query(POINTS_SQL + FRONTIER_SQL + """, seg AS (SELECT benchmark, gen_tokens AS x0, accuracy AS y0, lead(gen_tokens) OVER w AS x1, lead(accuracy) OVER w AS y1 FROM front WINDOW w AS (PARTITION BY benchmark ORDER BY gen_tokens)),
budgets AS (SELECT DISTINCT benchmark, CAST(b AS DOUBLE) AS budget FROM attempts, (VALUES (20), (100), (300), (900)) v(b))
SELECT b.benchmark, b.budget, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (budget - x0) / (x1 - x0) * (y1 - y0) END, 9) AS value
FROM budgets b LEFT JOIN seg s ON s.benchmark = b.benchmark AND budget >= x0 AND (x1 IS NULL OR budget < x1)""", "attempts")
def accuracy_at_budget(spark, sf_dir):
    points = policy_points(spark, sf_dir)
    budgets = points.select("benchmark").distinct().select("benchmark", F.explode(F.array(*map(F.lit, (20.0, 100.0, 300.0, 900.0)))).alias("budget"))
    return rounded(frontier.accuracy_at_budget(frontier.pareto_frontier(points), budgets))


TO_TARGET = """, seg AS (SELECT benchmark, gen_tokens AS x1, accuracy AS y1, lag(gen_tokens) OVER w AS x0, lag(accuracy) OVER w AS y0 FROM front WINDOW w AS (PARTITION BY benchmark ORDER BY gen_tokens))"""


@query(POINTS_SQL + FRONTIER_SQL + TO_TARGET + """, targets AS (SELECT DISTINCT benchmark, CAST(t AS DOUBLE) AS target FROM attempts, (VALUES (0.3), (0.5), (0.7), (0.95)) v(t))
SELECT t.benchmark, t.target, round(CASE WHEN y0 IS NULL THEN x1 ELSE x0 + (target - y0) / (y1 - y0) * (x1 - x0) END, 9) AS tokens
FROM targets t LEFT JOIN seg s ON s.benchmark = t.benchmark AND y1 >= target AND (y0 IS NULL OR y0 < target)""", "attempts")
def compute_to_target(spark, sf_dir):
    points = policy_points(spark, sf_dir)
    targets = points.select("benchmark").distinct().select("benchmark", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.95)))).alias("target"))
    return rounded(frontier.compute_to_target(frontier.pareto_frontier(points), targets))


ATTEMPT_FRONT_SQL = """WITH points AS (SELECT benchmark, seq * 8 + seed AS id, CAST(generated_tokens AS DOUBLE) AS x, mean_logprob AS y FROM attempts WHERE generated_tokens IS NOT NULL AND mean_logprob IS NOT NULL),
front AS (SELECT benchmark, x, max(y) AS y FROM (SELECT *, max(y) OVER (PARTITION BY benchmark ORDER BY x, y DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM points) p WHERE top IS NULL OR y > top GROUP BY benchmark, x),
seg AS (SELECT benchmark, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM front WINDOW w AS (PARTITION BY benchmark ORDER BY x))"""


def attempt_points(records: DataFrame) -> DataFrame:
    points = records.select("benchmark", (F.col("seq") * 8 + F.col("seed")).alias("id"), F.col("generated_tokens").cast("double").alias("x"), F.col("mean_logprob").alias("y"))
    return runlog.checkpointed(frontier.pareto_frontier(points, "x", "y", "id", many=True))


@query(ATTEMPT_FRONT_SQL + """ SELECT a.benchmark, a.task_id, a.policy, a.seed, CAST(a.prompt_tokens AS DOUBLE) AS budget, round(CASE WHEN x1 IS NULL THEN y ELSE y + (a.prompt_tokens - x) / (x1 - x) * (y1 - y) END, 9) AS value
FROM attempts a ASOF LEFT JOIN seg s ON s.benchmark = a.benchmark AND a.prompt_tokens >= s.x""", "attempts")
def quality_at_every_budget(spark, sf_dir):
    """The frontier over single attempts, read off at the prompt tokens of every attempt: as many budgets as records."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, "seq", "prompt_tokens", "generated_tokens", "mean_logprob"))
    budgets = records.select("benchmark", "task_id", "policy", "seed", F.col("prompt_tokens").cast("double").alias("budget"))
    return rounded(frontier.accuracy_at_budget(attempt_points(records), budgets, "x", "y", many=True))


@query(ATTEMPT_FRONT_SQL + """ SELECT a.benchmark, a.task_id, a.policy, a.seed, a.mean_logprob AS target, round(CASE WHEN y0 IS NULL THEN x ELSE x0 + (a.mean_logprob - y0) / (y - y0) * (x - x0) END, 9) AS tokens
FROM attempts a ASOF LEFT JOIN seg s ON s.benchmark = a.benchmark AND a.mean_logprob <= s.y""", "attempts")
def tokens_to_every_target(spark, sf_dir):
    """The tokens with which the frontier over single attempts reaches the log probability of every attempt."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, "seq", "prompt_tokens", "generated_tokens", "mean_logprob"))
    targets = records.select("benchmark", "task_id", "policy", "seed", F.col("mean_logprob").alias("target"))
    return frontier.compute_to_target(attempt_points(records), targets, "x", "y", many=True).withColumn("tokens", to_digits(F.col("tokens")))


@query(POINTS_SQL + """ SELECT p.benchmark, p.policy, round(p.gen_tokens, 9) AS gen_tokens, round(p.accuracy, 9) AS accuracy,
  round(CASE WHEN p.gen_tokens > r.gen_tokens THEN (p.accuracy - r.accuracy) / (p.gen_tokens - r.gen_tokens) END, 9) AS marginal_efficiency
FROM points p LEFT JOIN points r ON r.benchmark = p.benchmark AND r.policy = 'B0'""", "attempts")
def marginal_efficiency(spark, sf_dir):
    return rounded(frontier.marginal_efficiency(policy_points(spark, sf_dir).where("gen_tokens IS NOT NULL"), "B0"))


@query("WITH " + ORACLE_SQL.strip() + ", everyone AS (SELECT benchmark, task_id, policy, correct, error, calls, prefill_tokens, generated_tokens, thinking_tokens, latency_s FROM attempts UNION ALL SELECT benchmark, task_id, policy, correct, error, calls, prefill_tokens, generated_tokens, thinking_tokens, latency_s FROM oracle)," + SUMMARY_SQL.format(source="everyone") + ", points AS (SELECT *, generated_tokens AS gen_tokens FROM summarised)" + FRONTIER_SQL + """
SELECT p.benchmark, p.policy, p.tasks, p.records, p.errors, round(p.accuracy, 9) AS accuracy, round(p.gen_tokens, 9) AS gen_tokens, round(p.latency_s, 9) AS latency_s, f.policy IS NOT NULL AS on_frontier
FROM points p LEFT JOIN front f ON f.benchmark = p.benchmark AND f.policy = p.policy""", "attempts")
def policy_table(spark, sf_dir):
    out = report.policy_table(report.dealt_once(fixtures.attempts(spark, sf_dir, *NARROW)), POLICIES)
    return rounded(out.select("benchmark", "policy", "tasks", "records", "errors", "accuracy", "gen_tokens", "latency_s", "on_frontier"))


TARGET_SQL = "WITH " + SUMMARY_SQL.format(source="attempts").strip() + ", points AS (SELECT benchmark, policy, generated_tokens AS gen_tokens, accuracy FROM summarised WHERE generated_tokens IS NOT NULL)" + FRONTIER_SQL + TO_TARGET + SWEEP_SQL.replace("WITH ", ", ", 1).replace("by_task", "by_sweep") + """,
curve AS (SELECT * FROM (SELECT *, max(accuracy) OVER (PARTITION BY benchmark ORDER BY gen_tokens, accuracy DESC, threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sweep) x WHERE top IS NULL OR accuracy > top),
cut AS (SELECT benchmark, gen_tokens AS x1, accuracy AS y1, lag(gen_tokens) OVER w AS x0, lag(accuracy) OVER w AS y0 FROM curve WINDOW w AS (PARTITION BY benchmark ORDER BY gen_tokens)),
base AS (SELECT benchmark, accuracy - 0.01 AS target, gen_tokens AS reference_tokens FROM points WHERE policy = 'B3'),
checked AS (SELECT b.*, CASE WHEN s.y0 IS NULL THEN s.x1 ELSE s.x0 + (target - s.y0) / (s.y1 - s.y0) * (s.x1 - s.x0) END AS fixed_tokens,
  CASE WHEN c.y0 IS NULL THEN c.x1 ELSE c.x0 + (target - c.y0) / (c.y1 - c.y0) * (c.x1 - c.x0) END AS cascade_tokens
  FROM base b LEFT JOIN seg s ON s.benchmark = b.benchmark AND s.y1 >= target AND (s.y0 IS NULL OR s.y0 < target)
  LEFT JOIN cut c ON c.benchmark = b.benchmark AND c.y1 >= target AND (c.y0 IS NULL OR c.y0 < target))"""


def checked_targets(spark, sf_dir) -> DataFrame:
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, *NARROW))
    return report.target_check(fixtures.points(summary.summary(records)), sweep(records), "B3")


CHECKED_SQL = TARGET_SQL + """ SELECT benchmark, round(target, 9) AS target, round(reference_tokens, 9) AS reference_tokens, round(fixed_tokens, 9) AS fixed_tokens, round(cascade_tokens, 9) AS cascade_tokens,
  round(fixed_tokens / reference_tokens, 9) AS fixed_ratio, round(cascade_tokens / reference_tokens, 9) AS cascade_ratio, coalesce(cascade_tokens / reference_tokens <= 0.6, false) AS meets FROM checked"""


@query(CHECKED_SQL, "attempts")
def target_check(spark, sf_dir):
    return rounded(checked_targets(spark, sf_dir))


@query(CHECKED_SQL, "attempts")
def report_targets(spark, sf_dir):
    """The target check of a whole report that has the hindsight oracle among its policies: the fixed policies' tokens are those of the report without it."""
    made = report.report(fixtures.attempts(spark, sf_dir), POLICIES, STAGES, [logprob_score()], [i / 20.0 - 1 for i in range(21)], "B3", n_boot=0)
    return rounded(made.target)


AGAINST_SQL = TARGET_SQL + """, chosen AS (SELECT s.benchmark, s.threshold, s.gen_tokens AS budget, row_number() OVER (PARTITION BY s.benchmark ORDER BY s.gen_tokens, s.threshold) AS place FROM sweep s JOIN base b ON b.benchmark = s.benchmark AND s.accuracy >= b.target),
best AS (SELECT c.benchmark, c.threshold, p.policy AS fixed, row_number() OVER (PARTITION BY c.benchmark ORDER BY p.accuracy DESC, p.gen_tokens, p.policy DESC) AS rank FROM chosen c JOIN points p ON p.benchmark = c.benchmark AND p.gen_tokens <= c.budget WHERE c.place = 1),
casc AS (SELECT r.benchmark, r.task_id, b.threshold, b.fixed, avg(ok) AS acc_a, avg(tok) AS tok_a FROM run r JOIN best b ON b.benchmark = r.benchmark AND b.threshold = CAST(r.t AS DOUBLE) AND b.rank = 1 GROUP BY ALL),
flat AS (SELECT benchmark, task_id, policy AS fixed, avg(CAST(correct AND error IS NULL AS INT)) AS acc_b, avg(coalesce(generated_tokens, 0)) AS tok_b FROM attempts GROUP BY ALL)"""


@query(AGAINST_SQL + """
SELECT c.benchmark, round(c.threshold, 9) AS threshold, c.fixed, count(*) AS tasks, round(avg(acc_a - acc_b), 9) AS accuracy_diff, round(avg(tok_a) / avg(tok_b), 9) AS token_ratio
FROM casc c JOIN flat f ON f.benchmark = c.benchmark AND f.task_id = c.task_id AND f.fixed = c.fixed GROUP BY ALL""", "attempts")
def cascade_against_fixed(spark, sf_dir):
    """Per benchmark the cascade at its chosen threshold against the best fixed policy at its budget, over the tasks of both."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, *NARROW))
    points, curve = runlog.checkpointed(fixtures.points(summary.summary(records))), runlog.checkpointed(sweep(records))
    chosen = report.chosen_thresholds(curve, report.target_check(points, curve, "B3"))
    pairs = replay.against_fixed(records, points, curve, chosen, STAGES, [logprob_score()])
    return rounded(pairs.groupBy("benchmark", "threshold", "fixed").agg(F.count("*").alias("tasks"), F.avg("value").alias("accuracy_diff"), (F.avg("tok_a") / F.avg("tok_b")).alias("token_ratio")))


@query()
def success_bar(spark, sf_dir):
    """Benchmarks on which the cascade needs few enough tokens and differs from the best fixed policy at its budget, by 2,000 replicates of their paired tasks."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, *NARROW))
    points, curve = runlog.checkpointed(fixtures.points(summary.summary(records))), runlog.checkpointed(sweep(records))
    check = report.target_check(points, curve, "B3")
    return report.success_bar(check, report.cascade_intervals(records, points, curve, check, STAGES, [logprob_score()]))


@query(AGAINST_SQL + f""", pairs AS (SELECT c.benchmark, c.task_id, acc_a - acc_b AS value FROM casc c JOIN flat f ON f.benchmark = c.benchmark AND f.task_id = c.task_id AND f.fixed = c.fixed),
drawn AS (SELECT benchmark, value, i AS replicate, CAST(('0x' || substr(md5(task_id || '|' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM pairs, range(100) r(i)),
means AS (SELECT benchmark, replicate, sum(w * value) / nullif(sum(w), 0) AS mean FROM (SELECT benchmark, replicate, value, {" + ".join(f"CAST(u >= {b!r} AS INT)" for b in CUM)} AS w FROM drawn) x GROUP BY ALL),
bounds AS (SELECT benchmark, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY ALL),
met AS (SELECT c.benchmark, coalesce(cascade_tokens / reference_tokens <= 0.6, false) AS meets, coalesce(low > 0 OR high < 0, false) AS clear FROM checked c LEFT JOIN bounds b ON b.benchmark = c.benchmark)
SELECT count(*) AS benchmarks, count(*) FILTER (meets) AS target_met, count(*) FILTER (meets AND clear) AS bar_met, count(*) FILTER (meets AND clear) >= 2 AS success FROM met""", "attempts")
def success_bar_by_hashes(spark, sf_dir):
    """The success bar with replicates whose weights are hashes of their tasks, so that SQL has the same."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, *NARROW))
    points, curve = runlog.checkpointed(fixtures.points(summary.summary(records))), runlog.checkpointed(sweep(records))
    check = report.target_check(points, curve, "B3")
    pairs = replay.against_fixed(records, points, curve, report.chosen_thresholds(curve, check), STAGES, [logprob_score()])
    return report.success_bar(check, bootstrap.poisson_intervals(pairs, ["benchmark"], replicates=100))


@query()
def policy_intervals(spark, sf_dir):
    """The summary with 95 % bounds of the accuracy by 2,000 replicates."""
    return rounded(summary.summary(fixtures.attempts(spark, sf_dir, *NARROW), n_boot=2000).select("benchmark", "policy", "tasks", "accuracy", "acc_low", "acc_high", "latency_s"))


@query(PAIRED_SQL + f""", drawn AS (SELECT benchmark, value, i AS replicate, CAST(('0x' || substr(md5(task_id || '|' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM paired, range(200) r(i)),
means AS (SELECT benchmark, replicate, sum(w * value) / nullif(sum(w), 0) AS mean FROM (SELECT benchmark, replicate, value, {" + ".join(f"CAST(u >= {b!r} AS INT)" for b in CUM)} AS w FROM drawn) x GROUP BY ALL)
SELECT benchmark, round(quantile_cont(mean, 0.025), 9) AS ci_low, round(quantile_cont(mean, 0.975), 9) AS ci_high FROM means GROUP BY ALL""", "attempts")
def poisson_intervals(spark, sf_dir):
    pairs = replay.paired_tasks(fixtures.attempts(spark, sf_dir, *NARROW), "B3", "B0")
    return rounded(bootstrap.poisson_intervals(pairs, ["benchmark"], replicates=200))


# ---- routing ---------------------------------------------------------------------------------------------------------

AUC_SQL = """ ranked AS (SELECT {g} s, y, rank() OVER (PARTITION BY {p} ORDER BY s) + (count(*) OVER (PARTITION BY {p}, s) - 1) / 2.0 AS r FROM scored),
totals AS (SELECT {g} count(*) AS n, sum(y) AS pos, count(*) - sum(y) AS neg, sum(CASE WHEN y = 1 THEN r END) AS pos_ranks FROM ranked GROUP BY ALL)
SELECT {g} n, round((pos_ranks - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0), 9) AS auc FROM totals"""


@query("WITH scored AS (SELECT benchmark, mean_logprob AS s, CAST(correct AS INT) AS y FROM attempts WHERE error IS NULL AND mean_logprob IS NOT NULL)," + AUC_SQL.format(g="benchmark,", p="benchmark"), "attempts")
def signal_auc(spark, sf_dir):
    scored = fixtures.attempts(spark, sf_dir).where("error IS NULL").select("benchmark", F.col("mean_logprob").alias("score"), F.col("correct").cast("int").alias("y"))
    return rounded(routing.auc(scored, groups=["benchmark"]))


FIXED_ROUTER = routing.Logistic(["mean_logprob", "finished"], [1.5, 0.4], -0.2, [-0.5, 0.6], [0.3, 0.5])


@query("SELECT benchmark, task_id, seed, round(1 / (1 + exp(-(-0.2 + 1.5 * (coalesce(mean_logprob, -0.5) + 0.5) / 0.3 + 0.4 * (coalesce(finished, 0.6) - 0.6) / 0.5))), 9) AS score FROM attempts WHERE policy = 'B0'", "attempts")
def logistic_score(spark, sf_dir):
    return rounded(fixtures.attempts(spark, sf_dir).where("policy = 'B0'").select("benchmark", "task_id", "seed", FIXED_ROUTER.score().alias("score")))


@query("SELECT count(*) AS n, count(mean_logprob) AS mean_logprob, count(finished) AS finished FROM attempts WHERE policy = 'B0' AND error IS NULL", "attempts")
def training_rows(spark, sf_dir):
    rows = routing.training_rows(fixtures.attempts(spark, sf_dir), "B0", signals=None)
    return rows.agg(F.count("*").alias("n"), F.count("mean_logprob").alias("mean_logprob"), F.count("finished").alias("finished"))


def router_table(spark, sf_dir) -> DataFrame:
    rows = routing.training_rows(fixtures.attempts(spark, sf_dir), "B0", signals=None)
    return rows.select("task_id", "mean_logprob", F.col("finished").cast("double").alias("finished"), F.log1p(F.col("generated_tokens").cast("double")).alias("completion_tokens_log"), F.col("correct").cast("int").alias("y"))


@query()
def router_fit(spark, sf_dir):
    """Weights of a router trained on the train half of one policy's records."""
    rows = router_table(spark, sf_dir).where(splits.in_train_split(F.col("task_id"), 0.5))
    features = routing.present_features(rows, ["mean_logprob", "finished", "completion_tokens_log"], signals=None)
    r = routing.fitted(rows, features)
    return rounded(spark.createDataFrame([(f, w, m, s) for f, w, m, s in zip([*r.features, "bias"], [*r.weights, r.bias], [*r.mean, 0.0], [*r.std, 1.0], strict=True)], "feature string, weight double, mean double, std double"), 6)


@query()
def router_evaluation(spark, sf_dir):
    """AUC and base rate of a trained router on either half."""
    rows = router_table(spark, sf_dir)
    train = splits.in_train_split(F.col("task_id"), 0.5)
    router = routing.fitted(rows.where(train), ["mean_logprob", "finished", "completion_tokens_log"])
    return rounded(routing.evaluated(rows, router, F.when(train, "train").otherwise("test")), 6)


@query("SELECT policy, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS base_rate, round(avg(CAST(correct AS INT)), 6) AS mean_score FROM attempts WHERE error IS NULL GROUP BY policy", "attempts")
def routers_by_policy(spark, sf_dir):
    """A router for every policy, all from one fit. At a fit's optimum the mean score is the base rate, since the bias is not penalised."""
    records = fixtures.attempts(spark, sf_dir, "error", "correct", "mean_logprob", "finished", "generated_tokens").where("error IS NULL")
    rows = runlog.checkpointed(records.select("policy", "mean_logprob", "finished", F.log1p("generated_tokens").alias("tokens_log"), F.col("correct").cast("int").alias("y")))
    routers = routing.fitted_by(rows, ["policy"], ["mean_logprob", "finished", "tokens_log"])
    scored = rows.select("policy", "y", routing.score_by(routers, ["policy"]).alias("score"))
    return rounded(scored.groupBy("policy").agg(F.count("*").alias("n"), F.avg("y").alias("base_rate"), F.avg("score").alias("mean_score")), 6)


@query(f"""WITH own AS (SELECT * FROM attempts WHERE policy = 'B0' AND error IS NULL AND (mean_logprob IS NOT NULL OR finished IS NOT NULL) AND {POSITION} < 0.5)
SELECT array_to_string(list_sort(list(DISTINCT benchmark)), ',') AS benchmarks, 'B0' AS policy, '0.5' AS split_frac, count(*) AS n_train, round(avg(CAST(correct AS INT)), 9) AS base_rate, true AS rated FROM own""", "attempts")
def router_metadata(spark, sf_dir):
    """What a trained router knows of its training."""
    signals = F.map_filter(F.create_map(F.lit("mean_logprob"), F.col("mean_logprob"), F.lit("finished"), F.col("finished").cast("double")), lambda _, v: v.isNotNull())
    meta = routing.trained(fixtures.attempts(spark, sf_dir).withColumn("signals", signals), "B0", split=0.5, features=["mean_logprob", "finished"]).meta
    rated = all(0 < float(meta[f"{side}_auc"]) < 1 for side in ("train", "test"))
    return rounded(spark.createDataFrame([(meta["benchmarks"], meta["policy"], meta["split_frac"], int(meta["n_train"]), float(meta["base_rate"]), rated)], "benchmarks string, policy string, split_frac string, n_train long, base_rate double, rated boolean"))


ROUTED = "(1 / (1 + exp(-(-0.2 + 1.5 * (coalesce({sc}, -0.5) + 0.5) / 0.3 + 0.4 * (coalesce({fi}, 0.6) - 0.6) / 0.5))))"


@query(f"WITH scored AS (SELECT CASE WHEN {POSITION} < 0.5 THEN 'train' ELSE 'test' END AS split, round({ROUTED.format(sc='mean_logprob', fi='finished')}, 9) AS s, CAST(correct AS INT) AS y FROM attempts WHERE policy = 'B0' AND error IS NULL)," + AUC_SQL.format(g="split,", p="split").replace("AS auc FROM totals", "AS auc, round(CAST(pos AS DOUBLE) / n, 9) AS base_rate FROM totals"), "attempts")
def fixed_router_evaluation(spark, sf_dir):
    """AUC and base rate of a given router on either half."""
    rows = routing.training_rows(fixtures.attempts(spark, sf_dir), "B0", signals=None)
    split = F.when(splits.in_train_split(F.col("task_id"), 0.5), "train").otherwise("test")
    scored = rows.select(to_digits(FIXED_ROUTER.score()).alias("score"), F.col("correct").cast("int").alias("y"), split.alias("split"))
    return rounded(routing.rated(scored, ["split"]))


@query("SELECT CAST(place AS INT) AS place, feature, n FROM (SELECT 0 AS place, 'mean_logprob' AS feature, count(mean_logprob) AS n FROM attempts WHERE policy = 'B0' AND error IS NULL UNION ALL SELECT 1, 'finished', count(finished) FROM attempts WHERE policy = 'B0' AND error IS NULL) x WHERE n > 0", "attempts")
def router_features(spark, sf_dir):
    """The features that a policy's training rows have, in their order, and how many rows have each."""
    known = signals.as_map({"mean_logprob": F.col("mean_logprob"), "finished": F.col("finished")})
    rows = routing.training_rows(fixtures.attempts(spark, sf_dir).withColumn("signals", known), "B0")
    return routing.feature_counts(rows).where("n > 0").select(F.row_number().over(W.orderBy("candidate")).cast("int").alias("row"), "feature", "n").select((F.col("row") - 1).alias("place"), "feature", "n")


@query("WITH " + staged_sql(STAGES) + f", stopped AS (SELECT *, CASE WHEN round({ROUTED.format(sc='sc0', fi='fi0')}, 9) >= 0.6 THEN 0 WHEN sc1 >= -0.4 THEN 1 ELSE 2 END AS stop FROM wide) SELECT benchmark, task_id, seed, 'routed' AS policy, {replay_columns('stop')} FROM stopped", "attempts")
def routed_replay(spark, sf_dir):
    """A cascade with a scorer of its own at each boundary: a router after the first stage, which sees its mean features where a record failed, and a signal after the second."""
    scores = routing.stage_scores([to_digits(FIXED_ROUTER.score()), logprob_score()], STAGES)
    return rounded(replay.replayed(fixtures.attempts(spark, sf_dir), STAGES, scores, [0.6, -0.4], "routed"))


@query(f"SELECT benchmark, task_id, seed, round({ROUTED.format(sc='mean_logprob', fi='finished')}, 9) AS score FROM attempts WHERE policy = 'B1'", "attempts")
def saved_router_score(spark, sf_dir):
    """Scores of a router that was saved and loaded again."""
    path = f"{shared_folder(spark)}/router-{uuid.uuid4().hex}"
    FIXED_ROUTER.save(spark, path)
    return result_without(rounded(fixtures.attempts(spark, sf_dir).where("policy = 'B1'").select("benchmark", "task_id", "seed", routing.Logistic.load(spark, path).score().alias("score"))), path)


@query()
def document_quality_router(spark, sf_dir):
    """The same training on documents: quality labels from length and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("chars_log"), *((F.col("lang") == x).cast("double").alias(f"lang_{x}") for x in ("en", "de", "fr", "es")))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    router = routing.fitted(rows, ["chars_log", "lang_en", "lang_de", "lang_fr", "lang_es"])
    return rounded(rows.select("doc_id", "y", router.score().alias("score")), 6)


# ---- answers and grading ---------------------------------------------------------------------------------------------


@query("SELECT benchmark, task_id, policy, seed, form, expected_pred AS pred FROM outputs", "outputs")
def answer_extraction(spark, sf_dir):
    return fixtures.outputs(spark, sf_dir).select("benchmark", "task_id", "policy", "seed", "form", answers.extracted_answer(F.col("output")).alias("pred"))


@query("SELECT benchmark, task_id, policy, seed, expected_pred AS pred, expected_correct AS correct FROM outputs", "outputs")
def answer_grading(spark, sf_dir):
    out = fixtures.outputs(spark, sf_dir)
    return out.select("benchmark", "task_id", "policy", "seed", answers.extracted_answer(F.col("output")).alias("pred"), "reference").select("benchmark", "task_id", "policy", "seed", "pred", answers.equivalent(F.col("pred"), F.col("reference")).alias("correct"))


@query("""WITH refs AS (SELECT DISTINCT benchmark, task_id, CAST(level * 10 AS VARCHAR) AS reference FROM attempts)
SELECT o.benchmark, o.task_id, policy, seed, expected_pred AS pred, CASE WHEN form = 5 THEN CAST(q AS DOUBLE) / 2 ELSE CAST(q AS DOUBLE) END = CAST(r.reference AS DOUBLE) AS correct, '' AS grade_detail, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, regexp_extract(expected_pred, '[0-9]+') AS q FROM outputs) o JOIN refs r ON r.benchmark = o.benchmark AND r.task_id = o.task_id""", "outputs")
def graded_outputs(spark, sf_dir):
    """Outputs graded against a table of tasks with one reference each."""
    records = report.dealt_once(fixtures.attempts(spark, sf_dir, *fixtures.OF_OUTPUTS, "level"))
    known = records.select("benchmark", "task_id", F.lit("math").alias("kind"), (F.col("level") * 10).cast("string").alias("reference")).distinct()
    graded = grading.graded_math(fixtures.outputs(spark, sf_dir, records).drop("reference", "kind"), known)
    return graded.select("benchmark", "task_id", "policy", "seed", "pred", "correct", "grade_detail", "error")


LAST_NUMBER_SQL = r"""WITH tail AS (SELECT doc_id, regexp_replace(text, '(?s)^.*</think>', '') AS t FROM documents),
box AS (SELECT *, regexp_extract(t, '(?s)^.*(\\(?:boxed|fbox).*)$', 1) AS b FROM tail),
cut AS (SELECT *, CASE WHEN contains(b, '{') THEN CASE WHEN regexp_matches(b, '^[^{]*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}') THEN trim(regexp_extract(b, '^[^{]*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1)) END
    WHEN regexp_matches(b, '^\\boxed\s+[^\s$]') THEN regexp_extract(b, '^\\boxed\s+([^\s$]+)', 1) END AS boxed,
  CASE WHEN regexp_matches(t, '####\s*[^\n]') THEN trim(regexp_extract(t, '####\s*([^\n]+)', 1)) END AS marked,
  CASE WHEN regexp_matches(t, '(?i)answer is[:\s]*\$?[^\n$]') THEN regexp_replace(trim(regexp_extract(t, '(?i)answer is[:\s]*\$?([^\n$]+)', 1)), '\.+$', '') END AS stated FROM box)
SELECT doc_id, coalesce(boxed, marked, stated, regexp_extract_all(t, '-?[0-9][0-9,]*(?:\.[0-9]+)?')[-1]) AS pred FROM cut"""


@query(LAST_NUMBER_SQL)
def last_number_of_documents(spark, sf_dir):
    """The final answer of every document: of prose, mostly the last number, else none."""
    return table(spark, sf_dir, "documents").select("doc_id", answers.extracted_answer(F.col("text")).alias("pred"))


@query("SELECT benchmark, task_id, policy, seed, concat('x = ', q, chr(10), 'y') AS code, (l_tax < 0.04) AS correct, CASE WHEN l_tax >= 0.06 THEN 'timeout' WHEN l_tax >= 0.04 THEN 'AssertionError' ELSE '' END AS grade_detail FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM attempts) x WHERE error IS NULL", "attempts")
def code_grading(spark, sf_dir):
    rows = fixtures.attempts(spark, sf_dir).where("error IS NULL")
    code = F.concat(F.lit("x = "), F.col("l_quantity").cast("int").cast("string"), F.lit("\ny"))
    outputs = rows.select("benchmark", "task_id", "policy", "seed", F.concat(F.lit("first ```python\nz\n``` then\n```py\n"), code, F.lit("\n```\n")).alias("output"))
    stderr = F.when(F.col("l_tax") >= 0.04, "Traceback\n  line 1\nAssertionError\n").otherwise("")
    results = rows.select("benchmark", "task_id", "policy", "seed", F.when(F.col("l_tax") < 0.04, 0).otherwise(1).alias("exit_code"), (F.col("l_tax") >= 0.06).alias("timed_out"), stderr.alias("stderr"))
    return grading.graded_code(outputs, results).select("benchmark", "task_id", "policy", "seed", F.col("pred").alias("code"), "correct", "grade_detail")


# ---- calls, signals, votes -------------------------------------------------------------------------------------------


@query("""SELECT benchmark, task_id, policy, seed, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  max(prompt_tokens) FILTER (call_no = 1) + greatest(0, coalesce(max(prompt_tokens) FILTER (call_no = 2) - max(prompt_tokens) FILTER (call_no = 1) - max(completion_tokens) FILTER (call_no = 1), 0)) AS prefill_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS generated_tokens, coalesce(max(completion_tokens) FILTER (step = 'think'), 0) AS thinking_tokens FROM calls GROUP BY ALL""", "calls")
def attempt_costs(spark, sf_dir):
    return calls.attempt_costs(fixtures.calls(spark, sf_dir))


@query("SELECT benchmark, policy, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(prefill_tokens) AS BIGINT) AS prefill_tokens, CAST(sum(generated_tokens) AS BIGINT) AS generated_tokens, CAST(coalesce(sum(thinking_tokens), 0) AS BIGINT) AS thinking_tokens FROM attempts_raw WHERE error IS NULL GROUP BY ALL", "attempts_raw")
def added_costs(spark, sf_dir):
    raw = fixtures.attempts_raw(spark, sf_dir).where("error IS NULL")
    cost = F.struct("calls", F.lit(0).cast("bigint").alias("prompt_tokens"), "prefill_tokens", "generated_tokens", "thinking_tokens", F.lit(0.0).alias("latency_s"))
    return calls.added_costs(raw.withColumn("cost", cost), ["benchmark", "policy"]).select("benchmark", "policy", "calls", "prefill_tokens", "generated_tokens", "thinking_tokens")


@query("SELECT policy, CAST(2 * 8.2 * 1e9 * (sum(prefill_tokens) + sum(generated_tokens)) AS DOUBLE) AS flops, round(sum(generated_tokens) * 0.002 / 3600.0 * 2 / 32 * 1.5, 9) AS usd FROM attempts GROUP BY ALL", "attempts")
def compute_and_dollars(spark, sf_dir):
    sums = fixtures.attempts(spark, sf_dir).groupBy("policy").agg(F.sum("prefill_tokens").alias("p"), F.sum("generated_tokens").alias("g"))
    return rounded(sums.select("policy", usage.flops(8.2, F.col("p"), F.col("g")).alias("flops"), usage.dollars(F.col("g") * F.lit(0.002), 1.5, 2, 32).alias("usd")))


LOGPROBS = "[-abs(CAST(x AS DOUBLE)) * 4 FOR x IN embedding]"


@query(f"""WITH lp AS (SELECT vec_id, {LOGPROBS} AS v FROM embeddings)
SELECT vec_id, round(list_avg(v), 9) AS mean_logprob, round(list_min(v), 9) AS min_logprob, round(list_avg(v[greatest(len(v) - 15, 1):]), 9) AS tail_mean_logprob,
  round(CAST(len([x FOR x IN v IF x < ln(0.5)]) AS DOUBLE) / len(v), 9) AS frac_low_conf, round(ln(1 + CAST(len(v) AS DOUBLE)), 9) AS completion_tokens_log FROM lp""")
def generation_signals(spark, sf_dir):
    v = F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 4)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    parts = signals.logprob_signals(F.col("v")) | {"completion_tokens_log": signals.length_signals(F.size("v"), F.lit("stop"))["completion_tokens_log"]}
    return rounded(rows.select("vec_id", *(c.alias(n) for n, c in parts.items())))


@query("""WITH part AS (SELECT vec_id, j, [exp(CAST(x AS DOUBLE)) FOR x IN embedding[j * 8 + 1 : j * 8 + 8]] AS e FROM embeddings, range(8) r(j)),
each AS (SELECT vec_id, list_sum([-(x / list_sum(e)) * ln(x / list_sum(e) + 1e-12) FOR x IN e]) AS h FROM part)
SELECT vec_id, round(avg(h), 9) AS mean_topk_entropy FROM each GROUP BY ALL""")
def topk_entropy(spark, sf_dir):
    keys = F.array(*(F.lit(f"t{i}") for i in range(8)))
    top = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.map_from_arrays(keys, F.transform(F.slice("embedding", j * 8 + 1, 8), lambda x: x.cast("double"))))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", signals.topk_entropy(top).alias("mean_topk_entropy")))


@query("SELECT conv_id, turn, round(ln(1 + CAST(length(text) AS DOUBLE)), 9) AS question_chars_log, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS think_hit_budget, round(ln(1 + CAST(turn AS DOUBLE)), 9) AS think_tokens_log FROM conversations")
def task_and_thinking_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    parts = signals.task_signals(F.col("text")) | signals.thinking_signals(F.when(F.col("turn") % 2 == 0, "length").otherwise("stop"), F.col("turn"))
    return rounded(rows.select("conv_id", "turn", *(c.alias(n) for n, c in parts.items())))


@query("""SELECT benchmark, task_id, policy, seed, round(ln(1 + CAST(length(output) AS DOUBLE)), 9) AS completion_tokens_log, CASE WHEN form % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS finished,
  CASE WHEN form IN (0, 1, 5) THEN 1.0 ELSE 0.0 END::DOUBLE AS has_answer, CASE WHEN form < 5 THEN round(-0.25 * form - 0.25, 9) END::DOUBLE AS mean_logprob, CASE WHEN form < 5 THEN -0.5 * form - 0.5 END::DOUBLE AS min_logprob,
  CASE WHEN form < 5 THEN CASE WHEN -0.5 * form - 0.5 < ln(0.5) THEN 0.5 ELSE 0.0 END END::DOUBLE AS frac_low_conf FROM outputs""", "outputs")
def call_signals(spark, sf_dir):
    """All signals of one generation as a map without those that cannot be told, and some of them read off it."""
    low = F.col("form") * -0.5 - 0.5
    rows = fixtures.outputs(spark, sf_dir).withColumns({"logprobs": F.when(F.col("form") < 5, F.array(low, F.lit(0.0))), "top": F.lit(None).cast("array<map<string,double>>")})
    every = signals.call_signals(F.col("kind"), F.col("output"), F.length("output"), F.when(F.col("form") % 2 == 0, "stop").otherwise("length"), F.col("logprobs"), F.col("top"))
    known = rows.select("benchmark", "task_id", "policy", "seed", signals.as_map(every).alias("signals"))
    names = ("completion_tokens_log", "finished", "has_answer", "mean_logprob", "min_logprob", "frac_low_conf")
    return rounded(known.select("benchmark", "task_id", "policy", "seed", *(F.try_element_at("signals", F.lit(n)).alias(n) for n in names)))


@query("""WITH by_vote AS (SELECT benchmark, task_id, policy, seed, vote, count(*) AS n, min(sample_no) AS first FROM samples GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY benchmark, task_id, policy, seed ORDER BY vote IS NULL, n DESC, first) AS place FROM by_vote),
whole AS (SELECT benchmark, task_id, policy, seed, count(*) AS samples, count(DISTINCT vote) AS distinct_answers, avg(mean_logprob) AS mean_logprob, CAST(sum(generated_tokens) AS BIGINT) AS total_generated_tokens FROM samples GROUP BY ALL)
SELECT benchmark, task_id, policy, seed, b.vote AS winner, CAST(CASE WHEN b.vote IS NULL THEN 0 ELSE b.first END AS INT) AS chosen_sample, CASE WHEN b.vote IS NULL THEN 0 ELSE b.n END AS votes,
  round(CASE WHEN b.vote IS NULL THEN 0 ELSE CAST(b.n AS DOUBLE) / samples END, 9) AS agreement, distinct_answers, round(mean_logprob, 9) AS mean_logprob, total_generated_tokens
FROM whole JOIN best b USING (benchmark, task_id, policy, seed) WHERE place = 1""", "samples")
def majority_vote(spark, sf_dir):
    return rounded(calls.majority_vote(fixtures.samples(spark, sf_dir), means=["mean_logprob"], sums=["generated_tokens"]))


@query("SELECT DISTINCT task_id, seed, seed * 1000 + CAST(j AS INT) AS sample_seed FROM attempts_raw, range(5) r(j)", "attempts_raw")
def sample_seeds(spark, sf_dir):
    keys = fixtures.attempts_raw(spark, sf_dir).select("task_id", "seed").distinct()
    return keys.select("task_id", "seed", F.explode(usage.sample_seeds(F.col("seed"), 5)).alias("sample_seed"))


@query("SELECT doc_id, right(text, 200) AS prompt_tail, left(text, 20000) AS step_text FROM documents")
def trimmed_steps(spark, sf_dir):
    step = usage.trimmed_step(F.lit("think"), F.col("text"), F.col("text"), F.lit("stop"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", step.alias("s")).select("doc_id", "s.prompt_tail", F.col("s.text").alias("step_text"))


@query("SELECT vec_id, len([x FOR x IN embedding IF x >= 0]) AS kept, CASE WHEN label % 2 = 0 THEN CAST(label AS BIGINT) ELSE 0 END AS completion_tokens, CASE WHEN label % 3 = 0 THEN 'stop' ELSE 'unknown' END AS finish_reason FROM embeddings")
def cleaned_calls(spark, sf_dir):
    response = F.struct(
        F.lit("t").alias("text"), F.lit(None).cast("bigint").alias("prompt_tokens"), F.when(F.col("label") % 2 == 0, F.col("label").cast("bigint")).alias("completion_tokens"), F.when(F.col("label") % 3 == 0, "stop").alias("finish_reason"),
        F.transform("embedding", lambda x: F.when(x >= 0, x.cast("double"))).alias("token_logprobs"), F.array(F.create_map().cast("map<string,double>")).alias("top_logprobs"),
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", response.alias("response")).select("vec_id", usage.cleaned_call().alias("c"))
    return rows.select("vec_id", F.coalesce(F.size("c.token_logprobs"), F.lit(0)).cast("bigint").alias("kept"), "c.completion_tokens", "c.finish_reason")


# ---- tasks, prompts, jobs --------------------------------------------------------------------------------------------


def part_tasks(spark, sf_dir) -> DataFrame:
    """Parts as school-math rows: a name as question, and a worked answer."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("question"), F.concat(F.lit("so #### 9 and then ####  "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" ")).alias("answer"), F.col("p_partkey").alias("src_index"))
    return tasks.school_math_tasks(rows, "gsm8k")


PART_TASKS_SQL = "SELECT concat('gsm8k-', CAST(p_partkey AS VARCHAR)) AS task_id, 'gsm8k' AS benchmark, 'math' AS kind, p_name AS question, CAST(p_size * 1000 AS VARCHAR) AS reference, p_partkey AS src_index FROM part"


@query(PART_TASKS_SQL)
def school_math_tasks(spark, sf_dir):
    return part_tasks(spark, sf_dir).drop("code_reference", "meta")


@query("""SELECT concat('gsm8k-', CAST(p_partkey AS VARCHAR)) AS task_id, 'math' AS kind, p_name AS question, CAST(p_size * 1000 AS VARCHAR) AS reference, NULL AS test FROM part
UNION ALL SELECT concat('mbppplus-', CAST(p_partkey AS VARCHAR)), 'code', p_name, NULL, concat('assert f() == ', CAST(p_size AS VARCHAR)) FROM part""")
def written_tasks(spark, sf_dir):
    """Tasks of both kinds written as JSON lines and read back."""
    folder = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), F.concat(F.lit("assert f() == "), "p_size").alias("test"), F.col("p_partkey").alias("src_index"))
    tasks.write_tasks(part_tasks(spark, sf_dir).unionByName(tasks.code_tasks(rows)), folder)
    return result_without(tasks.read_tasks(spark, folder).select("task_id", "kind", "question", "reference", F.col("code_reference.test").alias("test")), folder)


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('u', CAST(p_partkey AS VARCHAR)) ELSE concat('math500-', CAST(p_partkey AS VARCHAR)) END AS task_id, p_name AS question, p_brand AS reference, CAST(p_size AS VARCHAR) AS level, p_type AS subject FROM part")
def competition_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("problem"), F.col("p_brand").alias("answer"), F.concat(F.lit("Level "), "p_size").alias("level"), F.col("p_type").alias("subject"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("u"), "p_partkey")).alias("unique_id"), F.col("p_partkey").alias("src_index"))
    return tasks.competition_tasks(rows).select("task_id", "question", "reference", F.col("meta")["level"].alias("level"), F.col("meta")["subject"].alias("subject"))


@query("""SELECT concat('train-', c, '-', CAST(p_partkey AS VARCHAR)) AS task_id, p_name AS question, concat('{', CAST(p_size AS VARCHAR), '}') AS reference, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END AS level
FROM part, (VALUES ('algebra'), ('geometry')) v(c) WHERE (p_partkey % 2 = 0) = (c = 'algebra') AND p_partkey % 5 <> 0""")
def solution_tasks(spark, sf_dir):
    boxed = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("as \\boxed{1}, so \\boxed{{"), "p_size", F.lit("}}."))).otherwise("no box")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("Problem"), boxed.alias("solution"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Level "), "p_size")).alias("level"), F.col("p_partkey").alias("src_index"))
    both = tasks.answer_tasks({"algebra": rows.where("src_index % 2 = 0"), "geometry": rows.where("src_index % 2 <> 0")}, "train", from_solution=True)
    return both.select("task_id", "question", "reference", F.try_element_at("meta", F.lit("level")).alias("level"))


@query("SELECT concat('aime2025-', CASE WHEN p_partkey % 2 = 0 THEN 'AIME2025-I' ELSE 'AIME2025-II' END, '-', CAST(p_partkey AS VARCHAR)) AS task_id, p_name AS question, CAST(p_size AS VARCHAR) AS reference FROM part")
def exam_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("question"), F.col("p_size").alias("answer"), F.col("p_partkey").alias("src_index"))
    return tasks.exam_tasks(rows.where("src_index % 2 = 0"), rows.where("src_index % 2 <> 0")).select("task_id", "question", "reference")


@query("SELECT concat('mbppplus-', CAST(p_partkey AS VARCHAR)) AS task_id, p_name AS question, concat('assert f() == ', CAST(p_size AS VARCHAR)) AS test, concat('import math', chr(10), 'import re') AS setup, CASE WHEN p_size % 2 = 0 THEN concat('assert ', p_brand) ELSE '' END AS example_test FROM part")
def code_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), F.concat(F.lit("assert f() == "), "p_size").alias("test"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("assert "), "p_brand"))).otherwise(F.array().cast("array<string>")).alias("test_list"), F.array(F.lit("import math"), F.lit("import re")).alias("test_imports"), F.col("p_partkey").alias("src_index"))
    return tasks.code_tasks(rows).select("task_id", "question", "code_reference.test", "code_reference.setup", F.col("meta")["example_test"].alias("example_test"))


@query("SELECT p_partkey, coalesce(TRY_CAST(regexp_replace(concat(p_type, p_brand, CAST(p_size AS VARCHAR)), '[^0-9]', '', 'g') AS INT), 0) AS level FROM part")
def parsed_levels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tasks.level(F.concat("p_type", "p_brand", "p_size")).alias("level"))


@query(f"SELECT task_id, src_index FROM ({PART_TASKS_SQL}) x ORDER BY src_index, task_id LIMIT 50")
def first_tasks(spark, sf_dir):
    return tasks.chosen(part_tasks(spark, sf_dir), limit=50).select("task_id", "src_index")


@query(f"SELECT task_id, src_index FROM ({PART_TASKS_SQL}) x ORDER BY md5(concat('7|', task_id)), task_id LIMIT 50")
def shuffled_tasks(spark, sf_dir):
    return tasks.chosen(part_tasks(spark, sf_dir), limit=50, shuffle_seed=7).select("task_id", "src_index")


@query(f"""SELECT task_id, concat('<|im_start|>user', chr(10), question, chr(10), chr(10), 'Give only the final answer within ', chr(92), 'boxed{{}}, with no explanation.', '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), '<think>', chr(10), chr(10), '</think>', chr(10), chr(10)) AS direct,
  concat('<|im_start|>user', chr(10), question, chr(10), chr(10), 'Please reason step by step, and put your final answer within ', chr(92), 'boxed{{}}.', '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), '<think>', chr(10)) AS thinking,
  concat(question, chr(10), '</think>', chr(10), chr(10)) AS closed FROM ({PART_TASKS_SQL}) x""")
def chat_prompts(spark, sf_dir):
    rows = part_tasks(spark, sf_dir)
    thoughts = prompts.cut_thoughts(F.concat("question", F.lit("\n\n</think> more </think>")))
    return rows.select("task_id", prompts.prompt(prompts.user_message("direct"), "not thinking").alias("direct"), prompts.prompt(prompts.user_message("think"), "thinking").alias("thinking"), prompts.prompt(thoughts, "closed thoughts").alias("closed"))


@query("""WITH shown AS (SELECT concat('mbppplus-', CAST(p_partkey AS VARCHAR)) AS task_id, concat(p_name, CASE WHEN p_size % 2 = 0 THEN concat(chr(10), chr(10), 'Your code should pass this test:', chr(10), 'assert ', p_brand) ELSE '' END, chr(10), chr(10)) AS head FROM part)
SELECT task_id, concat(head, 'Return only the complete code in one ```python block.') AS direct,
  concat('<|im_start|>user', chr(10), head, 'Briefly plan the solution, then give the complete code in one ```python block.', '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS planned FROM shown""")
def code_prompts(spark, sf_dir):
    """Prompts of code tasks, with the test that they show where they have one."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("prompt"), F.lit("assert f()").alias("test"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("assert "), "p_brand"))).otherwise(F.array().cast("array<string>")).alias("test_list"), F.col("p_partkey").alias("src_index"))
    return tasks.code_tasks(rows).select("task_id", prompts.user_message("direct").alias("direct"), prompts.prompt(prompts.user_message("cot"), "plain").alias("planned"))


@query("""SELECT t.benchmark, t.task_id, p.policy, CAST(s.seed AS INT) AS seed FROM (SELECT DISTINCT benchmark, task_id FROM attempts_raw) t, (VALUES ('B0'), ('B1'), ('B3')) p(policy), (VALUES (0), (1), (2)) s(seed)
WHERE NOT EXISTS (SELECT 1 FROM attempts_raw a WHERE a.benchmark = t.benchmark AND a.task_id = t.task_id AND a.policy = p.policy AND a.seed = s.seed AND a.error IS NULL)""", "attempts_raw")
def pending_jobs(spark, sf_dir):
    raw = fixtures.attempts_raw(spark, sf_dir)
    known = raw.select("benchmark", "task_id").distinct().withColumn("kind", F.lit("math"))
    grid = jobs.pending_jobs(known, [("B0", False), ("B1", True), ("B3", False)], [0, 1, 2], runlog.completed_keys(raw))
    return grid.select("benchmark", "task_id", "policy", "seed")


@query("""SELECT benchmark, task_id, src_index FROM (SELECT p_type AS benchmark, concat('part-', CAST(p_partkey AS VARCHAR)) AS task_id, p_partkey AS src_index, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part) x WHERE rn <= 3""")
def selected_run(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("benchmark"), F.concat(F.lit("part-"), "p_partkey").alias("task_id"), F.col("p_partkey").alias("src_index"))
    return jobs.selected_run(rows, limit=3)


@query("""SELECT t.benchmark, t.task_id, p.policy FROM (SELECT p_type AS benchmark, concat('part-', CAST(p_partkey AS VARCHAR)) AS task_id, CASE WHEN p_size % 2 = 0 THEN 'math' ELSE 'code' END AS kind FROM part) t,
(VALUES ('B0', false), ('B4', true), ('B5', true), ('B6', false)) p(policy, math) WHERE kind = 'math' OR NOT math""")
def supported_tasks(spark, sf_dir):
    """Task and policy pairs that are supported: B4 votes, B5 is a cascade with B4 in it, B6 one without."""
    policies = spark.createDataFrame([("B0", False, []), ("B4", True, []), ("B5", False, ["B0", "B4"]), ("B6", False, ["B0"])], "policy string, needs_math boolean, stages array<string>")
    kinds = jobs.supported(policies).select("policy", F.explode("kinds").alias("kind"))
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("benchmark"), F.concat(F.lit("part-"), "p_partkey").alias("task_id"), F.when(F.col("p_size") % 2 == 0, "math").otherwise("code").alias("kind"))
    return rows.join(kinds, "kind").select("benchmark", "task_id", "policy")


@query("""SELECT benchmark, task_id, policy, seed, correct AND error IS NULL AS correct, CASE WHEN error IS NULL THEN CAST(l_quantity AS BIGINT) END AS pred, CASE WHEN l_suppkey % 2 = 0 THEN 'r' END AS reference, error,
  CAST(level AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS example_test, CASE WHEN error IS NULL THEN prefill_tokens END AS prompt_tokens, CASE WHEN error IS NULL THEN prefill_tokens END AS prefill_tokens FROM attempts""", "attempts")
def run_records(spark, sf_dir):
    """Graded attempts as log records, with the cost of a single call."""
    rows = fixtures.attempts(spark, sf_dir)
    cost = usage.single_call_cost(F.col("prefill_tokens"), F.col("generated_tokens"), F.lit(0.1))
    meta = F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("example_test"), F.lit("assert f()"))
    more = {"kind": F.when(F.col("l_suppkey") % 2 == 0, "math").otherwise("code"), "pred": F.col("l_quantity").cast("bigint"), "reference": F.lit("r"), "grade_detail": F.lit(""), "meta": meta, "wall_s": F.lit(0.1), "cost": cost, "signals": F.col("mean_logprob"), "stopped_at": F.lit(None), "steps": F.lit(None)}
    made = grading.run_records(rows.withColumns(more), "replayed")
    return made.select("benchmark", "task_id", "policy", "seed", "correct", "pred", "reference", "error", F.col("meta")["level"].alias("level"), F.try_element_at("meta", F.lit("example_test")).alias("example_test"), "cost.prompt_tokens", "cost.prefill_tokens")


# ---- streaming -------------------------------------------------------------------------------------------------------


@query("SELECT 'events' AS benchmark, event_type AS policy, count(*) AS finished, round(CAST(count(*) FILTER (value > 10) AS DOUBLE) / count(*), 9) AS accuracy, CAST(0 AS BIGINT) AS errors FROM events GROUP BY ALL")
def stream_progress(spark, sf_dir):
    """Running progress over the events as a file stream, after all of it has come."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    records = stream.select(F.lit("events").alias("benchmark"), F.col("event_type").alias("policy"), (F.col("value") > 10).alias("correct"), F.lit(None).cast("string").alias("error"))
    name = f"progress_{uuid.uuid4().hex}"
    log.running_progress(records, name).awaitTermination()
    return rounded(spark.table(name))


@query("SELECT benchmark, task_id, policy, seed, seq, correct, error, generated_tokens FROM attempts", "attempts")
def stream_latest(spark, sf_dir):
    """The latest record per key of the run log as a file stream, kept batch by batch in a table of the shared folder."""
    lines = table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    records = fixtures.on(spark, fixtures.RAW_SQL, lineitem=stream, part=table(spark, sf_dir, "part"))
    folder = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    kept = log.LatestTable(spark, f"{folder}/table", ["seq", *fixtures.TIES])
    kept.start(records, f"{folder}/progress").awaitTermination()
    return result_without(kept.read().select("benchmark", "task_id", "policy", "seed", "seq", "correct", "error", "generated_tokens"), folder)


def live_log(spark, sf_dir, *columns: str) -> state.LiveLog:
    """The run log as a file stream, with its latest records in a state store of the shared folder: key, what orders them, result and the ``columns`` named."""
    lines = table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    records = fixtures.on(spark, fixtures.RAW_SQL, lineitem=stream, part=table(spark, sf_dir, "part"))
    live = state.LiveLog(spark, f"{shared_folder(spark)}/live-{uuid.uuid4().hex}", ["seq", *fixtures.TIES], max(1, lines.count() // state.TOGETHER))
    live.start(records.select("benchmark", "task_id", "policy", "seed", "seq", "correct", "error", *columns, *fixtures.TIES)).awaitTermination()
    return live


@query("SELECT benchmark, task_id, policy, seed, seq, correct, error, generated_tokens FROM attempts", "attempts")
def live_latest(spark, sf_dir):
    """The latest record per key, read from the state that a stream keeps."""
    live = live_log(spark, sf_dir, "generated_tokens")
    return result_without(live.latest().select("benchmark", "task_id", "policy", "seed", "seq", "correct", "error", "generated_tokens"), live.folder)


@query("SELECT benchmark, policy, count(*) AS finished, round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 9) AS accuracy, count(*) FILTER (error IS NOT NULL) AS errors FROM attempts GROUP BY ALL", "attempts")
def live_progress(spark, sf_dir):
    """Running counts over the latest records: what a retry replaces is taken back."""
    live = live_log(spark, sf_dir)
    return result_without(rounded(live.progress()), live.folder)


@query("WITH " + SUMMARY_SQL.format(source="attempts").strip() + " SELECT benchmark, policy, tasks, records, errors, round(accuracy, 9) AS accuracy, round(calls, 9) AS calls, round(prefill_tokens, 9) AS prefill_tokens, round(generated_tokens, 9) AS generated_tokens, round(thinking_tokens, 9) AS thinking_tokens, round(latency_s, 9) AS latency_s FROM summarised", "attempts")
def live_summary(spark, sf_dir):
    """The summary from the counts per task that a stream keeps, after they were folded."""
    live = live_log(spark, sf_dir, *summary.COSTS)
    live.fold()
    return result_without(rounded(live.summary()), live.folder)
