"""Run log, costs, signals, votes, replay, frontiers, routers and streaming on literal cases and generated logs."""

import json
import math
import os
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylake import queries
from tallylake.functions import signals, splits, usage
from tallylake.operators import bootstrap, calls, frontier, jobs, ranges, replay, routing, summary
from tallylake.plans import fixtures, report
from tallylake.sources import runlog, tasks
from tallylake.streaming import log, state


def line(task, policy="p", seed=0, **more):
    return json.dumps({"benchmark": "b", "task_id": task, "policy": policy, "seed": seed, **more})


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_log_reading(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [line("1", correct=False, error="E"), "", "   ", line("1", correct=True, seed="0", signals={"x": 1.5}), '{"benchmark": "b", "task_', line("2", correct=True, meta={"level": 3}, cost={"calls": 2})])
    b = write(tmp_path / "b.jsonl", [line("1", correct=False, error="later"), json.dumps({"benchmark": "b", "seed": 1})])
    both = runlog.read_run_log(spark, [a, b])
    assert both.count() == 5 and runlog.quarantined(both).count() == 1
    got = {r["task_id"]: r for r in runlog.latest(both).collect()}
    assert got["1"]["error"] == "later" and got["2"]["meta"] == {"level": "3"} and got["2"]["cost"]["calls"] == 2
    other = {r["task_id"]: r for r in runlog.latest(runlog.read_run_log(spark, [b, a])).collect()}
    assert other["1"]["correct"] is True and other["1"]["signals"] == {"x": 1.5}
    done = {r["task_id"] for r in runlog.completed_keys(both).collect() if r["task_id"]}
    assert done == {"1", "2"}


def test_latest_of_a_task_with_very_many_records(spark):
    rows = [("b", "1", "p", 0, i % 997, i, None if i % 5 else "E") for i in range(3000)] + [("b", "2", "p", 0, 5, 1, None), ("b", None, "p", 0, 5, 1, None)]
    df = spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, v int, w int, error string")
    plain = runlog.latest(df, ["v", "w"])
    salted = runlog.latest(df, ["v", "w"], salts=7)
    assert salted.columns == plain.columns and sorted(map(str, salted.collect())) == sorted(map(str, plain.collect())) and salted.count() == 2


def test_latest_in_a_split_file(spark, tmp_path):
    path = write(tmp_path / "long.jsonl", [line(str(i % 50), correct=i >= 1950, pred=str(i)) for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = runlog.read_run_log(spark, [path])
        assert rows.rdd.getNumPartitions() > 3
        assert {int(r["pred"]) for r in runlog.latest(rows).collect()} == set(range(1950, 2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_writing(spark, tmp_path):
    rows = runlog.read_run_log(spark, [write(tmp_path / "x.jsonl", [line("1", correct=True), line("2", correct=False)])]).drop("file_path", "file_ord", "block_start", "line_id")
    runlog.write_run_log(rows, f"{tmp_path}/log", with_steps=False)
    runlog.write_run_log(rows, f"{tmp_path}/log", with_steps=False)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    runlog.write_run_log(runlog.compacted(rows), f"{tmp_path}/json", "json")
    assert runlog.read_run_log(spark, [f"{tmp_path}/json"]).count() == 2


def test_tasks(spark, tmp_path):
    math_rows = spark.createDataFrame([("q", "so #### 1 #### 1,234 ", 0)], "question string, answer string, src_index int")
    t = tasks.school_math_tasks(math_rows)
    assert t.first()["reference"] == "1234" and t.first()["task_id"] == "gsm8k-0"
    code = tasks.code_tasks(spark.createDataFrame([(7, "do", "assert g()", ["assert f()"], ["import os", "import re"], 0)], "task_id int, prompt string, test string, test_list array<string>, test_imports array<string>, src_index int"))
    assert code.first()["code_reference"]["setup"] == "import os\nimport re" and code.first()["meta"] == {"example_test": "assert f()"}
    tasks.write_tasks(t.unionByName(code), f"{tmp_path}/t")
    back = {r["task_id"]: r for r in tasks.read_tasks(spark, f"{tmp_path}/t").collect()}
    assert back["gsm8k-0"]["reference"] == "1234" and back["mbppplus-7"]["code_reference"]["test"] == "assert g()" and back["mbppplus-7"]["reference"] is None
    with pytest.raises(KeyError):
        tasks.picked(t, None, ["nope"])
    solved = tasks.answer_tasks({"": spark.createDataFrame([("q", r"\boxed{1}", "Level 3", 0), ("q", "no", None, 1), ("q", r"\boxed{2}", None, 2)], "problem string, solution string, level string, src_index int")}, "m", from_solution=True)
    assert [(r["task_id"], r["reference"], r["meta"]) for r in solved.orderBy("src_index").collect()] == [("m-default-0", "1", {"level": "3"}), ("m-default-2", "2", {})]
    many = spark.range(100).select(F.col("id").cast("string").alias("task_id"), F.col("id").alias("src_index"), F.lit("b").alias("benchmark"))
    a, b = ([r["task_id"] for r in tasks.chosen(many, 10, 3).collect()] for _ in range(2))
    assert a == b and len(a) == 10 and [r["task_id"] for r in tasks.chosen(many, 3).collect()] == ["0", "1", "2"]


def test_jobs(spark):
    known = spark.createDataFrame([("b", "1", "math", 0), ("b", "2", "code", 1)], "benchmark string, task_id string, kind string, src_index int")
    done = spark.createDataFrame([("b", "1", "p", 0)], "benchmark string, task_id string, policy string, seed int")
    grid = {(r["task_id"], r["policy"], r["seed"]) for r in jobs.pending_jobs(known, [("p", False), ("vote", True)], [0, 1], done).collect()}
    assert grid == {("1", "p", 1), ("1", "vote", 0), ("1", "vote", 1), ("2", "p", 0), ("2", "p", 1)}
    policies = spark.createDataFrame([("p", False, []), ("vote", True, []), ("casc", False, ["p", "vote"])], "policy string, needs_math boolean, stages array<string>")
    assert {r["policy"]: r["kinds"] for r in jobs.supported(policies).collect()} == {"p": ["math", "code"], "vote": ["math"], "casc": ["math"]}
    assert jobs.selected_run(known, ["b"], 1).first()["task_id"] == "1"


def test_costs(spark):
    df = spark.createDataFrame([("b", "1", "p", 0, 1, "think", 10, 3), ("b", "1", "p", 0, 2, "answer", 15, 4), ("b", "2", "p", 0, 1, "answer", 5, 2)], "benchmark string, task_id string, policy string, seed int, call_no int, step string, prompt_tokens long, completion_tokens long")
    got = {r["task_id"]: (r["calls"], r["prompt_tokens"], r["prefill_tokens"], r["generated_tokens"], r["thinking_tokens"]) for r in calls.attempt_costs(df).collect()}
    assert got == {"1": (2, 25, 12, 7, 3), "2": (1, 5, 5, 2, 0)}
    one = spark.range(1).select(usage.flops(1.0, F.lit(2), F.lit(3)).alias("f"), usage.dollars(F.lit(7200.0), 1.5, 2, 0).alias("d"), usage.sample_seeds(F.lit(3), 2).alias("s"), usage.continued_prefill(F.lit(10), F.lit(12), F.lit(5)).alias("p")).first()
    assert (one["f"], one["d"], one["s"], one["p"]) == (1e10, 6.0, [3000, 3001], 10)


def test_signals(spark):
    df = spark.createDataFrame([([-0.1] * 20 + [-2.0], [{"a": -1.0, "b": -1.0}]), (None, None), ([], [])], "lp array<double>, top array<map<string,double>>")
    got = [r.asDict() for r in df.select(*(c.alias(n) for n, c in signals.logprob_signals(F.col("lp")).items()), signals.topk_entropy(F.col("top")).alias("h"), signals.topk_entropy_vectorised(F.col("top")).alias("hv")).collect()]
    assert got[0]["min_logprob"] == -2.0 and got[0]["tail_mean_logprob"] == pytest.approx((-0.1 * 15 - 2) / 16) and got[0]["frac_low_conf"] == pytest.approx(1 / 21)
    assert got[0]["h"] == pytest.approx(math.log(2), abs=1e-9) == got[0]["hv"]
    assert all(v is None for r in got[1:] for v in r.values())
    texts = spark.createDataFrame([("math", r"\boxed{1}"), ("math", "it is 3"), ("code", "```python\nx\n```"), ("code", "x")], "kind string, t string")
    assert [r[0] for r in texts.select(signals.has_answer(F.col("kind"), F.col("t"))).collect()] == [1.0, 0.0, 1.0, 0.0]
    assert spark.range(1).select(signals.as_map({"a": F.lit(1.0), "b": F.lit(None)})).first()[0] == {"a": 1.0}


def test_votes(spark):
    rows = [(1, 0, None, 1.0), (1, 1, "b", None), (1, 2, "a", 3.0), (1, 3, "a", 5.0), (2, 0, "y", 1.0), (2, 1, "x", 1.0), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "g int, sample_no int, vote string, m double")
    got = {r["g"]: (r["winner"], r["chosen_sample"], r["agreement"], r["distinct_answers"], r["m"]) for r in calls.majority_vote(df, key=["g"], means=["m"]).collect()}
    assert got == {1: ("a", 2, 0.5, 2, 3.0), 2: ("y", 0, 0.5, 2, 1.0), 3: (None, 0, 0.0, 0, None)}


def generated(spark, n=60, policies=("A", "B", "C"), seeds=(0, 1)):
    rng = random.Random(1)
    rows = []
    for t in range(n):
        for s in seeds:
            for i, p in enumerate(policies):
                error = "E" if rng.random() < 0.05 else None
                right = error is None and rng.random() < 0.4 + 0.2 * i
                score = None if error or rng.random() < 0.1 else rng.random() - (0 if right else 0.4)
                rows.append(("b", f"t{t}", p, s, right, error, score, None if error else i + 1, None if error else 50, None if error else 10 * (i + 1) + rng.randint(0, 5), None if error else i, 1 + t % 5))
    return spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, correct boolean, error string, score double, calls long, prefill_tokens long, generated_tokens long, thinking_tokens long, level int").cache()


def test_replay_against_a_loop(spark):
    df = generated(spark)
    rows = {}
    for r in df.collect():
        rows.setdefault((r["task_id"], r["seed"]), {})[r["policy"]] = r
    score = [routing.signal_score(F.col("score"))]
    for thresholds in ([0.3, 0.5], [-1e9, -1e9], [1e9, 1e9]):
        got = {(r["task_id"], r["seed"]): (r["correct"], r["stopped_at"], r["generated_tokens"], r["calls"]) for r in replay.replayed(df, ["A", "B", "C"], score, thresholds).collect()}
        expected = {}
        for key, stage in rows.items():
            tokens = n_calls = 0
            for p, t in zip("ABC", [*thresholds, None], strict=True):
                r = stage[p]
                tokens, n_calls = tokens + (r["generated_tokens"] or 0), n_calls + (r["calls"] or 0)
                if t is None or (-math.inf if r["score"] is None else r["score"]) >= t:
                    break
            expected[key] = (r["correct"], p, tokens, n_calls)
        assert got == expected
        live = replay.live_records(df, ["A", "B", "C"], score, thresholds, "live")
        assert replay.disagreements(replay.replayed(df, ["A", "B", "C"], score, thresholds), live).count() == 0
    nan = df.withColumn("score", F.lit(float("nan")))
    assert {r["stopped_at"] for r in replay.replayed(nan, ["A", "B"], [F.col("score")], [0.0]).collect()} == {"B"}
    assert replay.replayed(df, ["A", "Z"], score, [0.0]).count() == 0


def test_sweep_is_repeated_replay(spark):
    df, score = generated(spark), [routing.signal_score(F.col("score"))]
    points = {r["threshold"]: r for r in replay.swept(df, ["A", "B", "C"], score, [0.0, 0.4]).collect()}
    for t, p in points.items():
        rows = replay.replayed(df, ["A", "B", "C"], score, [t, t])
        acc = rows.groupBy("task_id").agg(F.avg(F.col("correct").cast("int")).alias("a")).agg(F.avg("a")).first()[0]
        assert p["accuracy"] == pytest.approx(acc) and p["gen_tokens"] == pytest.approx(rows.agg(F.avg("generated_tokens")).first()[0])
        assert p["escalation_rate"] == pytest.approx(rows.agg(F.avg((F.col("stopped_at") != "A").cast("int"))).first()[0])
    assert replay.quantile_grid(df, "A", "score", 3) == pytest.approx(np.quantile([r["score"] for r in df.where("policy = 'A' AND score IS NOT NULL").collect()], [0, 0.5, 1]))


def test_oracle_and_pairs(spark):
    df = generated(spark)
    best = replay.oracle(df, ["A", "B", "C"])
    table = {r["policy"]: r for r in summary.summary(df.unionByName(best, allowMissingColumns=True)).collect()}
    assert all(table["oracle"]["accuracy"] >= table[p]["accuracy"] for p in "ABC")
    assert replay.oracle(df, []).count() == 0 and replay.common_keys(df, ["A", "Z"]).count() == 0
    d = replay.paired_difference(df, "C", "A").first()
    assert d["accuracy_diff"] == pytest.approx(table["C"]["accuracy"] - table["A"]["accuracy"]) and d["tasks"] == 60
    ci = bootstrap.poisson_intervals(replay.paired_tasks(df, "C", "A"), ["benchmark"], replicates=200).first()
    assert ci["ci_low"] < d["accuracy_diff"] < ci["ci_high"]


def test_bootstrap_against_the_normal_interval(spark):
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    values = summary.per_task(generated(spark, 200), right.cast("int"))
    for r in bootstrap.histogram_intervals(values, ["benchmark", "policy"]).collect():
        v = np.array([x["value"] for x in values.where(F.col("policy") == r["policy"]).collect()])
        half = 1.96 * v.std() / math.sqrt(len(v))
        assert r["mean"] == pytest.approx(v.mean()) and r["ci_low"] == pytest.approx(v.mean() - half, abs=0.015) and r["ci_high"] == pytest.approx(v.mean() + half, abs=0.015)
    assert bootstrap.histogram_intervals(values.where("false"), ["benchmark", "policy"]).count() == 0


def test_summary(spark):
    rows = [("b", "1", "p", 0, True, None, 10), ("b", "1", "p", 1, False, "E", None), ("b", "2", "p", 0, True, None, 20), ("b", "1", "bad", 0, True, "E", None)]
    df = spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, correct boolean, error string, generated_tokens long").withColumns({c: F.lit(1).cast("long") for c in ("calls", "prefill_tokens", "thinking_tokens")}).withColumn("level", F.lit(1))
    got = {r["policy"]: r for r in summary.summary(df, params_b=1.0).collect()}
    assert (got["p"]["tasks"], got["p"]["records"], got["p"]["errors"], got["p"]["accuracy"], got["p"]["generated_tokens"]) == (2, 3, 1, 0.75, 15.0)
    assert got["bad"]["accuracy"] == 0 and got["bad"]["generated_tokens"] is None
    levels = summary.level_table(summary.accuracy_by_level(df), [1, 2]).where("policy = 'p'").first()
    assert levels["level_1"] == pytest.approx(2 / 3) and levels["level_2"] is None
    assert summary.base_rate(df).first()["benchmarks"] == ["b"]


def test_frontier(spark):
    points = spark.createDataFrame([("x", "a", 10.0, 0.5), ("x", "b", 100.0, 0.9), ("x", "c", 200.0, 0.8), ("x", "b2", 100.0, 0.9), ("x", "n", 5.0, float("nan")), ("x", "u", None, 0.99)], "benchmark string, policy string, gen_tokens double, accuracy double")
    front = frontier.pareto_frontier(points)
    assert [r["policy"] for r in front.orderBy("gen_tokens").collect()] == ["a", "b"]
    assert frontier.pareto_frontier(points, many=True, per_range=1).count() == 2
    budgets = spark.createDataFrame([("x", 55.0), ("x", 5.0), ("x", 1e9)], "benchmark string, budget double")
    assert {r["budget"]: r["value"] for r in frontier.accuracy_at_budget(front, budgets).collect()} == {55.0: pytest.approx(0.7), 5.0: None, 1e9: 0.9}
    targets = spark.createDataFrame([("x", 0.7), ("x", 0.95), ("x", 0.1)], "benchmark string, target double")
    assert {r["target"]: r["tokens"] for r in frontier.compute_to_target(front, targets).collect()} == {0.7: pytest.approx(55.0), 0.95: None, 0.1: 10.0}
    gain = {r["policy"]: r["marginal_efficiency"] for r in frontier.marginal_efficiency(points, "a").collect()}
    assert gain["b"] == pytest.approx(0.4 / 90) and gain["a"] is None


def router_rows(spark, n=400):
    r = np.random.default_rng(0)
    y = r.integers(0, 2, n)
    good = y + r.normal(0, 0.5, n)
    noise = r.normal(size=n)
    data = [(float(g) if i % 10 else None, float(z), 1.0, None, int(t)) for i, (g, z, t) in enumerate(zip(good, noise, y, strict=True))]
    return spark.createDataFrame(data, "good double, noise double, flat double, absent double, y int")


def test_router_against_numpy(spark, tmp_path):
    df = router_rows(spark)
    features = ["good", "noise", "flat", "absent"]
    router = routing.fitted(df, features)
    rows = df.collect()
    x = np.array([[r[f] if r[f] is not None else np.nan for f in features] for r in rows], float)
    mean = np.array([np.nanmean(c) if not np.isnan(c).all() else 0 for c in x.T])
    x = np.where(np.isnan(x), mean, x)
    std = x.std(0)
    x = (x - mean) / np.where(std < 1e-8, 1, std)
    y, z = np.array([r["y"] for r in rows]), np.column_stack((np.ones(len(x)), x))
    w = np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        penalty = np.diag([0, 1, 1, 1, 1.0])
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty + 1e-9 * np.eye(5), z.T @ (p - y) + penalty @ w)
    assert np.allclose([router.bias, *router.weights], w, atol=1e-6) and router.weights[0] > 5 * abs(router.weights[1])
    router.save(spark, f"{tmp_path}/r")
    again = routing.Logistic.load(spark, f"{tmp_path}/r")
    assert again.weights == router.weights and again.features == router.features
    halves = routing.evaluated(df, router, (F.col("noise") > 0)).collect()
    assert len(halves) == 2 and all(h["auc"] > 0.85 for h in halves)
    with pytest.raises(ValueError):
        routing.fitted(df.limit(19), features)


def test_auc(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.4, 1), (None, 1)]
    df = spark.createDataFrame(rows, "score double, y int")
    known = [r for r in rows if r[0] is not None]
    pairs = [(p > n) + 0.5 * (p == n) for p, a in known if a for n, b in known if not b]
    for per_range in (1, 2, 1000):
        assert routing.auc(df, per_range=per_range).first()["auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert routing.auc(df.where("y = 1")).first()["auc"] is None


def test_splits(spark):
    import hashlib

    ids = [f"task-{i}" for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "t string").select(splits.in_train_split(F.col("t"), 0.5)).collect()]
    assert got == [int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.5 for i in ids]


def test_report(spark, tmp_path):
    df = generated(spark).withColumn("latency_s", F.col("generated_tokens") / 500)
    made = report.report(df, ["A", "B", "C"], ["A", "B", "C"], [routing.signal_score(F.col("score"))], [0.0, 0.5], "C", params_b=1.0, n_boot=50)
    text = made.markdown()
    assert text.startswith("## b\n") and "| oracle |" in text and "acc_low" in text and "latency_s" in text and "### Cascade sweep" in text and " errors |" in text and "the bar" in text and "### Accuracy by level" in text
    made.write(f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/report/policies").count() == 4
    table = {r["policy"]: r for r in made.policies.collect()}
    assert all(r["acc_low"] <= r["accuracy"] <= r["acc_high"] for r in table.values())
    bar = report.success_bar(made.target, made.differences, least=1).first()
    assert bar["benchmarks"] == 1
    # The differences by hand: the cheapest replay that reaches the target, against the best fixed policy within its tokens.
    target = table["C"]["accuracy"] - 0.01
    sweep = {r["threshold"]: r for r in made.sweep.collect() if r["accuracy"] >= target}
    assert (made.differences.count() == 1) == bool(sweep)
    if sweep:
        chosen = min(sweep.values(), key=lambda r: (r["gen_tokens"], r["threshold"]))
        fixed = max((r for p, r in table.items() if p != "oracle" and r["gen_tokens"] <= chosen["gen_tokens"]), key=lambda r: (r["accuracy"], -r["gen_tokens"]))
        assert made.differences.first()["mean"] == pytest.approx(chosen["accuracy"] - fixed["accuracy"])


def test_report_keeps_the_oracle_out_of_fixed_policies(spark):
    """A cheap policy that is right on half of the tasks, a dear one on the other half: only hindsight reaches the reference cheaply."""
    rows = [("b", str(i), p, 0, i % 2 == k, None, tokens, 0.5) for i in range(20) for k, (p, tokens) in enumerate((("A", 10), ("B", 40)))] + [("b", str(i), "C", 0, True, None, 500, 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, correct boolean, error string, generated_tokens long, score double")
    scores = [routing.signal_score(F.col("score"))]
    without, with_oracle = (report.report(df, of, ["A", "C"], scores, None, "C", n_boot=50) for of in ((), ["A", "B", "C"]))
    assert with_oracle.policies.where("hindsight").select("policy", "accuracy", "gen_tokens").first() == ("oracle", 1.0, 25.0)
    for made in (without, with_oracle):
        found = made.target.first()
        assert found["fixed_tokens"] == pytest.approx(10 + 490 * 0.98) and found["fixed_ratio"] == pytest.approx((10 + 490 * 0.98) / 500)
        assert made.sweep.count() == 21 and {round(r["threshold"], 9) for r in made.sweep.collect()} == {i / 20 for i in range(21)}
    assert [r["mean"] for r in without.differences.collect()] == [r["mean"] for r in with_oracle.differences.collect()]
    assert "known in hindsight" in with_oracle.markdown() and without.markdown().find("hindsight") < 0
    assert "a share of 0.5 of all tasks" in report.report(df, split=0.5, n_boot=0).markdown()
    named = spark.createDataFrame([("b", "B5-x", 1.0, 1.0, False), ("b", "oracle", 2.0, 1.0, True), ("b", "A", 3.0, 1.0, False)], "benchmark string, policy string, gen_tokens double, accuracy double, hindsight boolean")
    assert [r["policy"] for r in report.fixed_points(named).collect()] == ["A"]


def test_a_report_deals_its_records_once(spark):
    kept = report.dealt_once(generated(spark).withColumn("steps", F.array(F.lit("long"))))
    assert "steps" not in kept.columns
    for build in (summary.task_counts, lambda x: replay.oracle(x, ["A", "B", "C"]), lambda x: replay.staged(x, ["A", "B"], [routing.signal_score(F.col("score"))])):
        assert "Exchange" not in build(kept)._jdf.queryExecution().executedPlan().toString()


def test_sweep_and_curve_equal_replays(spark):
    rng = random.Random(8)
    some = lambda: rng.choice([None, float("nan"), 0.1, 0.4, 0.4, 0.7, -1.0])
    rows = [(b, str(t), p, s, rng.choice([True, False, None]), rng.choice([None, None, "E"]), rng.choice([None, 5, 9]), some()) for b in "xy" for t in range(12) for s in range(1 + t % 3) for p in "ABCD" if (t, p) != (3, "D")]
    df = spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, correct boolean, error string, generated_tokens long, score double")
    stages, scores = list("ABCD"), [routing.signal_score(F.col("score"))]

    def replays(t):
        """The point of each benchmark at a threshold, from a replay."""
        out = replay.replayed(df, stages, scores, [t] * 3).groupBy("benchmark", "task_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("ok"), F.sum("generated_tokens").alias("tok"), F.count_if(F.col("stopped_at") != "A").alias("esc"))
        out = out.groupBy("benchmark").agg(F.avg(F.col("ok") / F.col("n")).alias("acc"), (F.sum("tok") / F.sum("n")).alias("tok"), (F.sum("esc") / F.sum("n")).alias("esc"))
        return {r["benchmark"]: pytest.approx((r["acc"], r["tok"], r["esc"])) for r in out.collect()}

    point = lambda r: (r["accuracy"], r["gen_tokens"], r["escalation_rate"])
    grid = [0.4, -2.0, 0.05, 0.1, 0.41, 0.9, 0.4]
    got = replay.swept(df, stages, scores, grid).collect()
    assert len(got) == 2 * 6
    for per_range in (1, 1_000_000):
        got += replay.curve(df, stages, scores, per_range=per_range).collect()
    assert {r["threshold"] for r in got} == {*grid, 0.7, -1.0}
    want = {t: replays(t) for t in {r["threshold"] for r in got}}
    for r in got:
        assert point(r) == want[r["threshold"]][r["benchmark"]], r
    assert replay.swept(df.where("false"), stages, scores, grid).count() == 0 and replay.curve(df.where("false"), stages, scores).count() == 0
    alone = replay.swept(df, ["A"], scores, [0.1]).collect()  # one stage stops always
    assert {r["escalation_rate"] for r in alone} == {0.0}
    plan = replay.swept(df, stages, scores, [i / 1000 for i in range(1000)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") <= 3


def test_quantiles_and_ranges(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 1), 1) for _ in range(500)]
    df = spark.createDataFrame([("A", v, i) for i, v in enumerate(values)] + [("A", None, 0), ("A", float("nan"), 0), ("B", 99.0, 0)], "policy string, v double, i int")
    for per_range in (3, 1_000_000):
        got = [r["threshold"] for r in replay.quantiles(df, "A", "v", 7, per_range).orderBy("place").collect()]
        assert got == pytest.approx(np.quantile(values, np.linspace(0, 1, 7)))
    assert replay.quantile_grid(df, "Z", "v") == []
    points = spark.createDataFrame([("g", str(i), float(rng.randint(0, 40)), rng.random()) for i in range(300)] + [("g", "1000", 5.0, 2.0), ("g", "1001", 5.0, 2.0)], "benchmark string, policy string, gen_tokens double, accuracy double")
    want, top = [], None
    for r in sorted(points.collect(), key=lambda r: (r["gen_tokens"], -r["accuracy"], r["policy"])):
        if top is None or r["accuracy"] > top:
            want, top = [*want, r["policy"]], r["accuracy"]
    for many in (True, False):
        assert sorted(r["policy"] for r in frontier.pareto_frontier(points, many=many, per_range=2).collect()) == sorted(want)
    cuts = [1.0, 2.0, 2.5, 9.0]
    at = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 2.2, 3.0, 9.0, 10.0)], "x double").select("x", ranges.range_of(F.col("x"), cuts).alias("r")).collect()
    assert all(r["r"] == sum(c < r["x"] for c in cuts) for r in at)


def test_replay_keeps_levels_latency_and_steps(spark):
    step = lambda n: [{"name": n, "prompt_tail": "", "text": "t", "finish_reason": "stop", "completion_tokens": 1}]
    rows = [("b", "1", "A", 0, False, None, 0.1, 1, 10, 7, 0.5, 3, {"subject": "x"}, step("a")), ("b", "1", "B", 0, True, None, None, 2, 20, 9, 1.5, 3, {"subject": "x"}, step("b") * 2), ("b", "2", "A", 0, True, None, 0.9, 1, 10, 7, 0.25, 4, {}, step("a")), ("b", "2", "B", 0, False, "E", None, None, None, None, None, 4, None, None)]
    df = spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, correct boolean, error string, score double, calls long, generated_tokens long, prompt_tokens long, latency_s double, level int, meta map<string,string>, steps array<struct<name:string,prompt_tail:string,text:string,finish_reason:string,completion_tokens:bigint>>")
    score = [routing.signal_score(F.col("score"))]
    got = {r["task_id"]: r for r in replay.live_records(df, ["A", "B"], score, [0.5], "live").collect()}
    assert [s["name"] for s in got["1"]["steps"]] == ["a", "b", "b"] and [s["name"] for s in got["2"]["steps"]] == ["a"]
    assert (got["1"]["latency_s"], got["1"]["prompt_tokens"], got["1"]["level"], got["1"]["meta"]) == (2.0, 16, 3, {"subject": "x"})
    best = {r["task_id"]: r for r in replay.oracle(df, ["A", "B"]).collect()}
    assert best["1"]["chosen"] == "B" and best["1"]["level"] == 3 and best["2"]["latency_s"] == 0.25 and best["2"]["meta"] == {}
    assert summary.accuracy_by_level(replay.replayed(df, ["A", "B"], score, [0.5])).count() == 2
    rate = {r["policy"]: r["jobs_per_s"] for r in summary.progress(df, F.col("latency_s"), workers=3).collect()}
    assert rate == {"A": pytest.approx(2 * 3 / 0.75), "B": pytest.approx(2 * 3 / 1.5)}


def test_streams(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    schema = "v int, benchmark string, task_id string, policy string, seed string, correct boolean, error string"
    write(source / "1.jsonl", [line("1", v=1, correct=False, error="E"), line("2", v=1, correct=True)])
    table = log.LatestTable(spark, f"{tmp_path}/latest", ["v"])
    table.start(log.log_stream(spark, str(source), schema), f"{tmp_path}/cp").awaitTermination()
    write(source / "2.jsonl", [line("1", v=2, correct=True), "broken", line("3", v=2, correct=False)])
    table.start(log.log_stream(spark, str(source), schema), f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["task_id"], r["correct"]) for r in table.read().collect()) == [("1", True), ("2", True), ("3", False)]
    assert table.compact(f"{tmp_path}/merged").read().count() == 3
    log.running_progress(log.log_stream(spark, str(source), schema), "seen").awaitTermination()
    assert spark.table("seen").first()["finished"] == 4


def test_live_log_keeps_the_latest_records_in_its_state(spark, tmp_path):
    """Batches out of order, records met again, retries in the same file and in later ones, and a restart."""
    rng = random.Random(12)
    source = tmp_path / "log"
    source.mkdir()
    schema = "v int, benchmark string, task_id string, policy string, seed string, correct boolean, error string"
    made = [{"v": v, "task": str(rng.randrange(6)), "policy": rng.choice("AB"), "seed": rng.randrange(2), "correct": rng.choice([True, False, None]), "error": rng.choice([None, "", "E"])} for v in rng.sample(range(1000), 90)]
    lines = [line(**m) for m in made] + [line(**made[0]), line("9", v=None, policy="A"), line("9", v=3, policy="A", correct=True), json.dumps({"v": 1, "benchmark": "b"}), "broken"]
    files = [lines[i::3] for i in range(3)]
    live = state.LiveLog(spark, str(tmp_path / "live"), ["v"])

    def right():
        records = spark.read.text(str(source)).select("value")
        last = runlog.latest(runlog.parsed(records, schema), ["v"]).collect()
        as_rows = lambda rows: sorted((r["task_id"], r["policy"], r["seed"], r["v"], str(r["correct"]), str(r["error"])) for r in rows)
        assert as_rows(live.latest().collect()) == as_rows(last)
        want = {}
        for r in last:
            n = want.setdefault((r["benchmark"], r["policy"]), [0, 0, 0])
            want[r["benchmark"], r["policy"]] = [n[0] + 1, n[1] + bool(r["correct"]), n[2] + bool(r["error"])]
        got = {(r["benchmark"], r["policy"]): (r["finished"], r["accuracy"], r["errors"]) for r in live.progress().collect()}
        assert got == {k: (n, pytest.approx(ok / n), bad) for k, (n, ok, bad) in want.items()}

    def same_summary():
        last = runlog.latest(runlog.parsed(spark.read.text(str(source)).select("value"), schema), ["v"])
        rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("benchmark", "policy", "tasks", "records", "errors", "accuracy").collect())
        assert rows(live.summary()) == rows(summary.summary(last))

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for i, some in enumerate(files):  # each file comes to a stream that was started again
        write(source / f"{i}.jsonl", some)
        live.start(log.log_stream(spark, str(source), schema)).awaitTermination()
        right()
        same_summary()
        if i == 1:
            live.fold()
            same_summary()
    assert len(list((tmp_path / "live/sums").glob("batch=*"))) == 3 and live.numbers("folded") == [1]
    state.LiveLog(spark, str(tmp_path / "live"), ["v"]).start(log.log_stream(spark, str(source), schema)).awaitTermination()  # nothing new
    right()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert state.rank([None, 1]) < state.rank([0, 0]) < state.rank([1e300, 0]) < state.rank([float("nan"), 0])


def test_budgets_and_targets_are_merged_with_the_frontier(spark):
    rng = random.Random(4)
    raw = [("g", float(rng.randint(0, 60)), rng.random()) for _ in range(80)] + [("h", 3.0, 0.5)]
    points = spark.createDataFrame([(g, str(i), x, y) for i, (g, x, y) in enumerate(raw)], "benchmark string, policy string, gen_tokens double, accuracy double")
    front = frontier.pareto_frontier(points)
    own = {g: sorted((r["gen_tokens"], r["accuracy"]) for r in front.collect() if r["benchmark"] == g) for g in "gh"}
    asked = [(g, x, i) for i, (g, x) in enumerate([(g, rng.choice([rng.uniform(-1, 70), float(rng.randint(0, 60)), rng.random()])) for g in "ghn" for _ in range(60)] + [("g", None), ("g", own["g"][1][0]), ("g", own["g"][1][1]), ("g", own["g"][-1][1])])]

    def value(ps, b):
        low, high = [p for p in ps if p[0] <= b], [p for p in ps if p[0] > b]
        return None if not low else low[-1][1] if not high else low[-1][1] + (b - low[-1][0]) / (high[0][0] - low[-1][0]) * (high[0][1] - low[-1][1])

    def tokens(ps, t):
        low, high = [p for p in ps if p[1] < t], [p for p in ps if p[1] >= t]
        return None if not high else high[0][0] if not low else low[-1][0] + (t - low[-1][1]) / (high[0][1] - low[-1][1]) * (high[0][0] - low[-1][0])

    for f, name, out, by_hand in ((frontier.accuracy_at_budget, "budget", "value", value), (frontier.compute_to_target, "target", "tokens", tokens)):
        rows = spark.createDataFrame(asked, f"benchmark string, {name} double, id int")
        for options in ({}, {"many": True, "per_range": 3}, {"many": True}):
            got = f(front, rows, **options)
            assert got.columns == ["benchmark", name, "id", out]
            assert {r["id"]: r[out] for r in got.collect()} == {i: None if x is None or g not in own else pytest.approx(by_hand(own[g], x)) for g, x, i in asked}
    nan = spark.createDataFrame([("h", float("nan"))], "benchmark string, budget double")
    assert frontier.accuracy_at_budget(front, nan).first()["value"] == 0.5
    # Points and budgets are never joined with each other: without ranges there is no join at all.
    plan = frontier.accuracy_at_budget(points, spark.createDataFrame(asked, "benchmark string, budget double, id int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_grid_by_bitmaps(spark):
    """More cells than a word has, seeds and policies in any order, keys that are no cell, and tasks without any."""
    rng = random.Random(2)
    policies, seeds = [(f"p{i}", i % 3 == 0) for i in range(9)], [7, 1, 100, 0, 3, 9, 12, 13]
    known = [("b", str(i), "math" if i % 2 else "code") for i in range(12)] + [("c", "1", None), (None, "2", "math")]
    done = {(b, t, p, s) for b, t, _ in known for p, _ in policies for s in seeds if b and rng.random() < 0.5}
    rows = [*done, *rng.choices([*done], k=20), ("b", "1", "other", 1), ("b", "2", "p1", 555), ("x", "9", "p1", 1)]
    frames = spark.createDataFrame(known, "benchmark string, task_id string, kind string"), spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int")
    got = jobs.pending_jobs(frames[0], policies, seeds, frames[1])
    want = [(b, t, k, p, s) for b, t, k in known for p, m in policies for s in seeds if (not m or k == "math") and (b, t, p, s) not in done]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: min(i for i, x in enumerate(plan) if word in x)
    assert depth("Generate explode") < depth("Join LeftOuter")  # tasks meet their bitmaps first, and are exploded after that
    assert jobs.pending_jobs(frames[0], [], [], frames[1]).count() == 0 and jobs.completed_cells(frames[1], ["p0"], [1]).columns == ["benchmark", "task_id", "cells"]


def test_bootstrap_down_a_tree(spark):
    """Many values, so the histogram is split: mean and spread of the replicates are those of a multinomial, and a small fan goes down several levels."""
    rng = np.random.default_rng(5)
    data = {"a": rng.gamma(2.0, 3.0, 900), "b": rng.integers(0, 40, 500).astype(float), None: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "benchmark string, value double")
    hist = bootstrap.histogram(df, ["benchmark"])
    for levels, fan in ((1, 30), (3, 6)):
        got = {r["benchmark"]: r for r in bootstrap.tree_intervals(hist, ["benchmark"], levels, 3000, 0.05, 0, fan).collect()}
        assert set(got) == set(data)
        for g, vs in data.items():
            half = 1.959964 * vs.std() / math.sqrt(len(vs))
            assert got[g]["mean"] == pytest.approx(vs.mean())
            if g:
                assert (got[g]["ci_high"] - got[g]["ci_low"]) / 2 == pytest.approx(half, rel=0.08) and (got[g]["ci_high"] + got[g]["ci_low"]) / 2 == pytest.approx(vs.mean(), abs=half / 4)
        assert got[None]["ci_low"] == 1.0 and got[None]["ci_high"] == 2.0
        again = {r["benchmark"]: r for r in bootstrap.tree_intervals(hist.repartition(3), ["benchmark"], levels, 3000, 0.05, 0, fan).collect()}
        assert all(again[g] == pytest.approx(got[g]) if g else True for g in data) and all(again[g]["ci_low"] == pytest.approx(got[g]["ci_low"]) for g in data)
    flat = {r["benchmark"]: r for r in bootstrap.histogram_intervals(df, ["benchmark"], n_boot=3000).collect()}
    deep = {r["benchmark"]: r for r in bootstrap.histogram_intervals(df, ["benchmark"], n_boot=3000, fan=10).collect()}
    for g in "ab":
        assert flat[g]["ci_high"] - flat[g]["ci_low"] == pytest.approx(deep[g]["ci_high"] - deep[g]["ci_low"], rel=0.1)


def test_stored_log_is_read_without_a_shuffle(spark):
    rows = generated(spark).withColumns({"v": F.lit(1), "seq": F.monotonically_increasing_id()})
    stored = runlog.StoredLog(spark, "stored_log_of_a_test", 4)
    try:
        stored.append(rows)
        stored.append(rows.where("seed = 0").withColumns({"v": F.lit(2), "correct": F.lit(True)}))
        stored.append(rows.limit(2).withColumn("task_id", F.lit(None).cast("string")))  # no whole key
        order = ["v", "seq"]
        plain = runlog.latest(rows.unionByName(rows.where("seed = 0").withColumns({"v": F.lit(2), "correct": F.lit(True)})), order)
        stages, scores = ["A", "B", "C"], [routing.signal_score(F.col("score"))]
        kept = stored.compact(order, "stored_log_of_a_test_latest")
        for frame in (stored.latest(order), kept.records()):
            for build in (lambda x: x, lambda x: replay.oracle(x, stages), lambda x: replay.replayed(x, stages, scores, [0.3, 0.5]), lambda x: summary.task_counts(x)):
                got, want = build(frame), build(plain)
                assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
                key = lambda r: str(r)
                assert sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=key) == sorted(map(tuple, want.select(sorted(want.columns)).collect()), key=key)
    finally:
        stored.drop()
        spark.sql("DROP TABLE IF EXISTS stored_log_of_a_test_latest")


def test_many_routers_in_one_fit(spark):
    """Weights as those of single fits, for groups of different sizes and spreads; groups without enough rows have none."""
    rng = np.random.default_rng(7)
    rows = []
    for policy, split, n, a in (("p", 0, 300, 2.0), ("p", 1, 40, -1.0), ("q", 0, 120, 0.3), ("q", None, 60, 5.0), ("small", 0, 19, 1.0)):
        x = rng.normal(a, 1 + abs(a), n)
        for i, v in enumerate(x):
            y = int(rng.random() < 1 / (1 + math.exp(-a * (v - a))))
            rows.append((policy, split, None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(v), float(i % 3), 4.0, y if i % 17 else (y if i else None)))
    df = spark.createDataFrame(rows, "policy string, split int, a double, b double, constant double, y int")
    features = ["a", "b", "constant"]
    many = routing.fitted_by(df, ["policy", "split"], features)
    assert set(many) == {("p", 0), ("p", 1), ("q", 0), ("q", None)}
    for (policy, split), router in many.items():
        own = df.where((F.col("policy") == policy) & F.col("split").eqNullSafe(F.lit(split)))
        one = routing.fitted(own, features)
        assert np.allclose([router.bias, *router.weights, *router.mean, *router.std], [one.bias, *one.weights, *one.mean, *one.std], atol=1e-7)
    scores = df.select("policy", "split", routing.score_by(many, ["policy", "split"]).alias("s"), many["q", None].score().alias("t")).collect()
    assert all((r["s"] is None) == (r["policy"] == "small") and (r["policy"] != "q" or r["split"] is not None or r["s"] == pytest.approx(r["t"])) for r in scores)
    assert routing.fitted_by(df.where("policy = 'small'"), ["policy"], features) == {}
    # One job a round for all of them: as many as the slowest takes, and three before.
    tracker, group = spark.sparkContext.statusTracker(), "routers"
    spark.sparkContext.setJobGroup(group, group)
    routing.fitted_by(df, ["policy", "split"], features)
    together = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("singles", "singles")
    for policy, split in many:
        routing.fitted(df.where((F.col("policy") == policy) & F.col("split").eqNullSafe(F.lit(split))), features)
    singles = len(tracker.getJobIdsForGroup("singles"))
    spark.sparkContext.setJobGroup("others", "others")
    assert together < singles


def test_trained_router_knows_its_training(spark):
    rng = random.Random(3)
    rows = [("b" if t % 2 else "c", f"t{t}", "p", s, rng.random() < (0.8 if t % 3 else 0.3), None if t % 10 else "E", {"mean_logprob": float(t % 3) + rng.random()}) for t in range(120) for s in range(2)]
    df = spark.createDataFrame(rows, "benchmark string, task_id string, policy string, seed int, correct boolean, error string, signals map<string,double>")
    router = routing.trained(df, "p", split=0.6)
    fine = [r for r in rows if r[5] is None]
    at = {r["task_id"]: r["p"] for r in df.select("task_id", splits.split_position(F.col("task_id")).alias("p")).distinct().collect()}
    train = [r for r in fine if at[r[1]] < 0.6]
    assert router.features == ["mean_logprob"] and router.meta["policy"] == "p" and router.meta["benchmarks"] == "b,c" and router.meta["split_frac"] == "0.6"
    assert int(router.meta["n_train"]) == len(train) and float(router.meta["base_rate"]) == pytest.approx(sum(r[4] for r in train) / len(train))
    assert 0.5 < float(router.meta["train_auc"]) < 1 and 0 < float(router.meta["test_auc"]) < 1
    alone = routing.trained(df, "p", ["b"])
    assert alone.meta["benchmarks"] == "b" and "test_auc" not in alone.meta and alone.meta["split_frac"] == "None"


def test_sums_next_to_a_tie_are_rounded_as_sql_does(spark):
    """Latencies are cents over 8192: one sum of three in 64 is a tie at nine digits, and lies next to it as a double."""
    values = [19.321367187499998, 19.3213671875, -19.321367187499998, 0.49999999999999994, 1e300, float("inf"), float("-inf"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", queries.to_digits(F.col("x")).alias("x")).orderBy("i")
    assert [r["x"] for r in got.collect()] == [v for (v,) in duckdb.execute("SELECT round(x, 9) FROM (SELECT unnest(?::DOUBLE[]) AS x) t", [values]).fetchall()]


def test_a_live_log_calls_python_by_slots(spark, tmp_path):
    """Hundreds of tasks are a few entries of the state; orders by doubles, times and texts with nulls and NaN, and values that text could lose, are those of the batch operator."""
    rng = random.Random(4)
    times = [None, datetime(2021, 3, 28, 1, 30, 0, 5), datetime(2021, 3, 28, 2, 30, 0, 4), datetime(1960, 1, 1)]
    rows = [("b", f"t{rng.randrange(300)}", rng.choice("AB"), rng.randrange(2), rng.choice([None, float("nan"), -0.5, 0.1, float("inf")]), rng.choice(times), rng.choice([None, "", "é", "z"]), i, {"a": None, "q\"\n": 0.1 + i}, rng.choice([True, None]), rng.choice([None, "E"])) for i in range(3000)]
    schema = "benchmark string, task_id string, policy string, seed int, x double, at timestamp_ntz, s string, i bigint, m map<string,double>, correct boolean, error string"
    live = state.LiveLog(spark, str(tmp_path / "live"), ["x", "at", "s", "i"], slots=4)
    for part in (rows[:2000], rows[2000:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        live.start(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))).awaitTermination()
    want = runlog.latest(spark.read.schema(schema).parquet(str(tmp_path / "log")), ["x", "at", "s", "i"])
    as_rows = lambda df: sorted(str(tuple(r)) for r in df.select(want.columns).collect())
    assert as_rows(live.latest()) == as_rows(want) and live.latest().schema == want.schema
    with runlog.settings(spark, state.STORE):
        assert spark.read.format("statestore").load(str(tmp_path / "live/stream")).count() <= 4
    with pytest.raises(ValueError, match="do not go on"):
        live.changes(spark.readStream.schema(schema + ", more int").parquet(str(tmp_path / "log")))


def test_a_live_log_keeps_little_more_than_its_records_hold(spark, tmp_path):
    """The store's bytes a record, of which what orders it is a part; values of every kind are those of the batch operator, kept plainly or as text."""
    rng = random.Random(7)
    at = lambda: datetime(1992, 1, 1) + timedelta(days=rng.randrange(2500))
    none = lambda x: None if rng.random() < 0.1 else x
    rows = [("LARGE", f"part-{rng.randrange(2000)}", f"B{rng.randrange(5)}", rng.randrange(3), i, at(), rng.randrange(1000), rng.randrange(900_00, 105_000_00) / 100, rng.choice("ANR"), none(rng.random() < 0.5), none(rng.randrange(100)), none("TimeoutError: x")) for i in range(12_000)]
    schema = "benchmark string, task_id string, policy string, seed int, seq bigint, shipped timestamp_ntz, supplier bigint, price double, flag string, correct boolean, calls bigint, error string"
    small = {"t": "CAST(calls AS TINYINT)", "f": "CAST(IF(calls = 3, 'NaN', price) AS FLOAT)", "d": "CAST(shipped AS DATE)", "z": "CAST(shipped AS TIMESTAMP)", "n": "CAST(price AS DECIMAL(12,2))", "a": "array(flag, NULL)"}
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    order, read = ["seq", "shipped", "supplier", "price", "flag"], spark.read.schema(schema).parquet(str(tmp_path / "log"))
    for folder, more in (("live", {}), ("kinds", {c: F.expr(x) for c, x in small.items()})):
        live = state.LiveLog(spark, str(tmp_path / folder), order, slots=6)
        live.start(spark.readStream.schema(schema).parquet(str(tmp_path / "log")).withColumns(more)).awaitTermination()
        want = runlog.latest(read.withColumns(more), order)
        as_rows = lambda df: sorted(str(tuple(r)) for r in df.select(want.columns).collect())
        assert as_rows(live.latest()) == as_rows(want) and dict(live.latest().dtypes) == dict(want.dtypes)
    kept = sum(f.stat().st_size for f in (tmp_path / "live/stream/state").rglob("*.changelog"))
    assert 0 < kept < 60 * state.LiveLog(spark, str(tmp_path / "live"), order).latest().count()
    with pytest.raises(ValueError, match="do not go on"):
        state.LiveLog(spark, str(tmp_path / "live"), order[1:]).changes(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))


def test_attempts_carry_the_columns_named(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    some = fixtures.attempts(spark, "/root/testdata/sf0.001", "latency_s")
    assert some.columns == ["benchmark", "task_id", "policy", "seed", "latency_s"]
    assert "TimeoutError" not in some._jdf.queryExecution().executedPlan().toString()  # the error's text is not made
