"""Hindsight and replay over logged stages: common keys, oracle, cascades and their sweeps, paired differences.

All policies of a task and seed come together in one aggregate; no join of policies with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallylake.operators.ranges import PER_RANGE, cuts, range_of, with_before, with_sums_before
from tallylake.operators.summary import present, share
from tallylake.schemas import COST_FIELDS, TASK_SEED
from tallylake.sources.runlog import checkpointed

#: What a record carries besides its result and cost, where the records have it.
CARRIED = ("level", "meta")


def of_policies(records: DataFrame, policies: Sequence[str]) -> DataFrame:
    return records.where(F.col("policy").isin(*policies)) if policies else records.where(F.lit(False))


def common_keys(records: DataFrame, policies: Sequence[str]) -> DataFrame:
    """Task and seed of which every named policy has a record."""
    keys = of_policies(records, policies).groupBy(*TASK_SEED).agg(F.count_distinct("policy").alias("n"))
    return keys.where(F.col("n") == len({*policies})).drop("n")


def oracle(records: DataFrame, policies: Sequence[str], name: str = "oracle") -> DataFrame:
    """Per task and seed the cheapest correct record, else the cheapest; ties go by the order of ``policies``; errors count with no tokens.

    Columns: key with ``policy = name``, ``chosen``, ``correct, error``, and of the costs, ``level`` and ``meta`` those that the records have. No policies: no rows.
    """
    order = F.coalesce(*(F.when(F.col("policy") == p, i) for i, p in enumerate(policies))) if policies else F.lit(0)
    tokens = F.coalesce("generated_tokens", F.lit(0))
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    keep = F.struct(F.col("policy").alias("chosen"), "correct", "error", *present(records, COST_FIELDS), *present(records, CARRIED))
    picked = F.min_by(keep, F.struct((~right).alias("wrong"), tokens.alias("tokens"), order.alias("order")))
    out = of_policies(records, policies).groupBy(*TASK_SEED).agg(picked.alias("r"), F.count_distinct("policy").alias("n"))
    return out.where(F.col("n") == len({*policies})).select(*TASK_SEED, F.lit(name).alias("policy"), "r.*")


def cascade_name(stages: Sequence[str], thresholds: Sequence[float]) -> str:
    # Fixed value: the form of a replay's name.
    return "sim:" + ">".join(stages) + "@" + ",".join(f"{t:g}" for t in thresholds)


def staged(records: DataFrame, stages: Sequence[str], scores: Sequence[Column]) -> DataFrame:
    """One row per task and seed that all stages ran: ``stages``, an array in stage order of ``score, correct, error``, and of the costs, ``level``, ``meta`` and ``steps`` those that the records have.

    ``scores``: one expression over a record for each boundary (or one for all). NaN and null scores never stop.
    """
    scores = list(scores) * (len(stages) - 1) if len(scores) == 1 else list(scores)
    per_stage = F.coalesce(*(F.when(F.col("policy") == s, e.cast("double")) for s, e in zip(stages, scores, strict=False)), F.lit(None).cast("double")) if len(stages) > 1 else F.lit(None).cast("double")
    score = F.when(~F.isnan(per_stage), per_stage)
    costs = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in present(records, COST_FIELDS)]
    entry = F.struct(score.alias("score"), F.coalesce("correct", F.lit(False)).alias("correct"), "error", *costs, *present(records, (*CARRIED, "steps")))
    wide = of_policies(records, stages).groupBy(*TASK_SEED).agg(*(F.first(F.when(F.col("policy") == s, entry), ignorenulls=True).alias(f"s{i}") for i, s in enumerate(stages)))
    complete = wide.where(" AND ".join(f"s{i} IS NOT NULL" for i in range(len(stages))))
    return complete.select(*TASK_SEED, F.array(*(f"s{i}" for i in range(len(stages)))).alias("stages"))


def stopping_stage(n: int, threshold: Callable[[int], Column]) -> Column:
    """Place of the stage that a replay stops at: the first whose score reaches its threshold, else the last."""
    out = F.lit(n - 1)
    for i in range(n - 2, -1, -1):
        out = F.when(F.col("stages")[i]["score"] >= threshold(i), F.lit(i)).otherwise(out)
    return out


def run_cost(cost: str, stop: Column) -> Column:
    """The sum of a cost over the stages that ran."""
    kind = "double" if cost == "latency_s" else "bigint"
    return F.aggregate(F.slice("stages", F.lit(1), stop + 1), F.lit(0).cast(kind), lambda a, s: a + s[cost].cast(kind))


def stopped(records: DataFrame, stages: Sequence[str], scores: Sequence[Column], thresholds: Sequence[float]) -> DataFrame:
    """``staged`` with ``stop``, the place of the stage that the cascade stops at."""
    return staged(records, stages, scores).withColumn("stop", stopping_stage(len(stages), lambda i: F.lit(float(thresholds[i]))))


def outcome(records: DataFrame, stages: Sequence[str]) -> list[Column]:
    """Of ``stopped`` rows: result, ``level`` and ``meta`` of the stage that stopped, its name, and the costs of all that ran."""
    at = F.col("stages")[F.col("stop")]
    own = [at[c].alias(c) for c in ("correct", "error", *present(records, CARRIED))]
    return [*own, F.array(*map(F.lit, stages))[F.col("stop")].alias("stopped_at"), *(run_cost(c, F.col("stop")).alias(c) for c in present(records, COST_FIELDS))]


def replayed(records: DataFrame, stages: Sequence[str], scores: Sequence[Column], thresholds: Sequence[float], name: str | None = None, tasks: Column | None = None) -> DataFrame:
    """A cascade over logged stages: every stage run adds its cost; the stage that stops gives the result."""
    some = records.where(tasks) if tasks is not None else records
    return stopped(some, stages, scores, thresholds).select(*TASK_SEED, F.lit(name or cascade_name(stages, thresholds)).alias("policy"), *outcome(records, stages))


#: What a sweep adds up: right records by their task's number of records, tokens, records beyond the first stage; and records and tasks.
SUMS = ("right", "tokens", "escalated", "n", "tasks")


def changes(records: DataFrame, stages: Sequence[str], scores: Sequence[Column], tasks: Column | None = None) -> DataFrame:
    """``benchmark, at`` and ``SUMS``, rows to be added up: how the sums over all replays change where the threshold, shared by all boundaries, passes ``at``; what holds from the start is at minus infinity.

    A replay stops at the first stage whose score reaches the threshold, so its outcome changes where the threshold passes a score that is higher than all before it: at most once
    a boundary. The rows that leave a task are these changes, however many thresholds are asked for.
    """
    some = records.where(tasks) if tasks is not None else records
    rows = staged(some.drop("steps", *CARRIED), stages, scores)
    last = len(stages) - 1
    tokens, paths, top = F.lit(0).cast("bigint"), [], F.lit(None).cast("double")
    for i in range(len(stages)):
        stage = F.col("stages")[i]
        tokens = tokens + stage["generated_tokens"].cast("bigint")
        until = stage["score"] if i < last else F.lit(float("inf"))
        here = F.struct(until.alias("until"), stage["correct"].cast("int").alias("right"), tokens.alias("tokens"), F.lit(int(i > 0)).alias("escalated"))
        paths.append(F.when(until.isNotNull() & (top.isNull() | (until > top)) | F.lit(i == last), here))
        top = F.greatest(top, until)
    # The seeds of a task are few; together they tell their number.
    seeds = rows.groupBy("benchmark", "task_id").agg(F.collect_list(F.array_compact(F.array(*paths))).alias("seeds"))
    path = seeds.select("benchmark", (F.lit(1.0) / F.size("seeds")).alias("weight"), F.explode("seeds").alias("path"))

    def change(now: Column, before: Column | None, at: Column) -> Column:
        less = lambda c: now[c] - before[c] if before is not None else now[c]
        once = F.lit(1 if before is None else 0)
        return F.struct(at.alias("at"), (less("right") * F.col("weight")).alias("right"), less("tokens").alias("tokens"), less("escalated").alias("escalated"), once.alias("n"), (once * F.col("weight")).alias("tasks"))

    first = F.array(change(F.col("path")[0], None, F.lit(float("-inf"))))
    later = F.transform(F.slice("path", F.lit(2), F.size("path") - 1), lambda now, i: change(now, F.col("path")[i], F.col("path")[i]["until"]))
    return path.select("benchmark", F.explode(F.concat(first, later)).alias("c")).select("benchmark", "c.*")


def curve_point() -> list[Column]:
    """A sweep's columns from its sums."""
    return [(F.col("right") / F.round("tasks")).alias("accuracy"), (F.col("tokens") / F.col("n")).alias("gen_tokens"), (F.col("escalated") / F.col("n")).alias("escalation_rate")]


def swept(records: DataFrame, stages: Sequence[str], scores: Sequence[Column], grid: Sequence[float], tasks: Column | None = None) -> DataFrame:
    """``benchmark, threshold, accuracy, gen_tokens, escalation_rate`` for each threshold, shared by all boundaries.

    Each change of a replay counts from the first threshold beyond it, so a benchmark has at most one row of changes a threshold, and running sums over these.
    """
    at = sorted({float(t) for t in grid})
    dealt = changes(records, stages, scores, tasks).groupBy("benchmark", range_of(F.col("at"), at, inclusive=True).alias("place")).agg(*(F.sum(c).alias(c) for c in SUMS))
    order = W.partitionBy("benchmark").orderBy("place")
    up_to = order.rowsBetween(W.unboundedPreceding, 0)
    # A row holds for the thresholds up to the next one's; the first row of a benchmark is at its lowest threshold.
    until = F.lead("place", 1, len(at)).over(order)
    sums = dealt.where(F.col("place") < len(at)).select("benchmark", "place", until.alias("until"), *(F.sum(c).over(up_to).alias(c) for c in SUMS))
    each = sums.withColumn("place", F.explode(F.sequence("place", F.col("until") - 1)))
    return each.select("benchmark", F.element_at(F.lit(at).cast("array<double>"), F.col("place") + 1).alias("threshold"), *curve_point())


def curve(records: DataFrame, stages: Sequence[str], scores: Sequence[Column], tasks: Column | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """As ``swept``, at every threshold at which an outcome changes just beyond: the whole curve, exactly. Ranges of thresholds carry the running sums, so no task holds a benchmark."""
    rows = checkpointed(changes(records, stages, scores, tasks).groupBy("benchmark", "at").agg(*(F.sum(c).alias(c) for c in SUMS)))
    at = cuts(rows.where(F.col("at") > float("-inf")), "at", per_range)
    return with_sums_before(rows, ["benchmark"], "at", SUMS, at).where(F.col("at") > float("-inf")).select("benchmark", F.col("at").alias("threshold"), *curve_point())


def quantiles(records: DataFrame, first_stage: str, signal: str, points: int = 21, per_range: int = PER_RANGE) -> DataFrame:
    """``place, threshold``: even quantiles (interpolated) of a signal over the first stage's records of all benchmarks. Nulls and NaN are left out.

    Rows collapse to distinct values with counts, and ranks come from running counts over ranges of values, so no task holds all of them.
    """
    x = F.col(signal).cast("double")
    counts = records.where((F.col("policy") == first_stage) & x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    places = [(i, s * (total - 1)) for i, s in enumerate(even_grid(points))] if total else []
    asked = F.lit([]).cast("array<struct<place:int,rank:bigint,part:double>>") if not places else F.array(*(F.struct(F.lit(i).alias("place"), F.lit(int(at) + up).cast("bigint").alias("rank"), F.lit(float(at - int(at) if up else 1 - (at - int(at)))).alias("part")) for i, at in places for up in (0, 1)))
    ranked = with_before(counts, [], "v", F.sum, "n", "_before", cuts(counts, "v", per_range))
    first = F.coalesce("_before", F.lit(0))
    hit = ranked.select("v", F.explode(F.filter(asked, lambda a: (a["part"] > 0) & (a["rank"] >= first) & (a["rank"] < first + F.col("n")))).alias("a"))
    return hit.groupBy(F.col("a.place").alias("place")).agg(F.sum(F.col("v") * F.col("a.part")).alias("threshold"))


def quantile_grid(records: DataFrame, first_stage: str, signal: str, points: int = 21) -> list[float]:
    """The thresholds of a sweep without a router: ``quantiles`` as a list of ``points`` numbers, empty without any value."""
    return [r["threshold"] for r in quantiles(records, first_stage, signal, points).orderBy("place").collect()]


def even_grid(points: int = 21) -> list[float]:
    return [i / (points - 1) for i in range(points)]


def paired_tasks(records: DataFrame, a: str, b: str) -> DataFrame:
    """Per task that both policies ran: mean accuracy and tokens of each over its own seeds; errors are wrong and cost nothing."""
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    tokens = F.coalesce("generated_tokens", F.lit(0))
    sides = [(p, F.col("policy") == name) for p, name in (("a", a), ("b", b))]
    aggs = [x for p, m in sides for x in (F.count_if(m).alias(f"n_{p}"), F.count_if(m & right).alias(f"right_{p}"), F.sum(F.when(m, tokens)).alias(f"tokens_{p}"))]
    wide = of_policies(records, [a, b]).groupBy("benchmark", "task_id").agg(*aggs).where("n_a > 0 AND n_b > 0")
    means = [x for p in "ab" for x in (share(F.col(f"right_{p}"), F.col(f"n_{p}")).alias(f"acc_{p}"), share(F.col(f"tokens_{p}"), F.col(f"n_{p}")).alias(f"tok_{p}"))]
    return wide.select("benchmark", "task_id", *means).withColumn("value", F.col("acc_a") - F.col("acc_b"))


def paired_difference(records: DataFrame, a: str, b: str) -> DataFrame:
    """``benchmark, tasks, accuracy_diff, token_ratio, token_diff`` of policy a against policy b. Intervals come from the bootstrap of ``paired_tasks``."""
    pairs = paired_tasks(records, a, b)
    ratio = F.avg("tok_a") / F.greatest(F.avg("tok_b"), F.lit(1e-9))
    return pairs.groupBy("benchmark").agg(F.count("*").alias("tasks"), F.avg("value").alias("accuracy_diff"), ratio.alias("token_ratio"), (F.avg("tok_a") - F.avg("tok_b")).alias("token_diff"))


def live_records(records: DataFrame, stages: Sequence[str], scores: Sequence[Column], thresholds: Sequence[float], name: str) -> DataFrame:
    """As ``replayed``, in the form that a live cascade logs: with ``signals`` of the scores met and ``stages_run``, and the steps of all stages that ran, one after the other."""
    stop = stopped(records, stages, scores, thresholds)
    scored = [F.when((F.col("stop") >= i) & F.col("stages")[i]["score"].isNotNull(), F.create_map(F.lit(f"score_{s}"), F.col("stages")[i]["score"])).otherwise(F.create_map().cast("map<string,double>")) for i, s in enumerate(stages[:-1])]
    ran = F.create_map(F.lit("stages_run"), (F.col("stop") + 1).cast("double"))
    steps = [F.flatten(F.filter(F.transform(F.slice("stages", F.lit(1), F.col("stop") + 1), lambda s: s["steps"]), lambda x: x.isNotNull())).alias("steps")] if "steps" in records.columns else []
    return stop.select(*TASK_SEED, F.lit(name).alias("policy"), *outcome(records, stages), F.map_concat(ran, *scored).alias("signals"), *steps)


def disagreements(replay: DataFrame, live: DataFrame) -> DataFrame:
    """Task and seed on which a replay and the live cascade differ in result, tokens or stopping stage. A live run with an error is left out."""
    say = ("correct", "generated_tokens", "stopped_at")
    both = replay.select(*TASK_SEED, *say).join(live.where("error IS NULL").select(*TASK_SEED, *(F.col(c).alias(f"live_{c}") for c in say)), [*TASK_SEED])
    same = F.lit(True)
    for c in say:
        same = same & F.col(c).eqNullSafe(F.col(f"live_{c}"))
    return both.where(~same)


def against_fixed(records: DataFrame, points: DataFrame, sweep: DataFrame, chosen: DataFrame, stages: Sequence[str], scores: Sequence[Column]) -> DataFrame:
    """``benchmark, task_id, threshold, fixed, acc_a, tok_a, acc_b, tok_b, value``: per task the cascade at its chosen threshold (a) against the best fixed policy at its budget (b).

    ``chosen``: ``benchmark, threshold``; ``sweep``: its points, whose mean tokens are the budget; ``points``: the fixed policies' tokens and accuracy. The best fixed policy is the most accurate one
    within the budget (of equals the cheapest, then by name); a benchmark without one has no rows. The replays of the few thresholds come from one staging.
    """
    budget = sweep.join(chosen, ["benchmark", "threshold"]).select("benchmark", "threshold", F.col("gen_tokens").alias("budget"))
    within = points.join(budget, "benchmark").where(F.col("gen_tokens") <= F.col("budget"))
    best = F.max_by(F.col("policy"), F.struct(F.col("accuracy"), (-F.col("gen_tokens")).alias("tokens"), "policy")).alias("fixed")
    within = within.groupBy("benchmark", "threshold").agg(best)
    at = staged(records.drop("steps", *CARRIED), stages, scores).join(within, "benchmark").withColumn("stop", stopping_stage(len(stages), lambda _: F.col("threshold")))
    one = lambda c: F.col("stages")[F.col("stop")][c]
    run = at.groupBy("benchmark", "task_id", "threshold", "fixed").agg(F.avg((one("correct") & one("error").isNull()).cast("int")).alias("acc_a"), F.avg(run_cost("generated_tokens", F.col("stop"))).alias("tok_a"))
    right = F.coalesce("correct", F.lit(False)) & F.col("error").isNull()
    fixed = records.groupBy("benchmark", "task_id", F.col("policy").alias("fixed")).agg(F.avg(right.cast("int")).alias("acc_b"), F.avg(F.coalesce("generated_tokens", F.lit(0))).alias("tok_b"))
    return run.join(fixed, ["benchmark", "task_id", "fixed"]).withColumn("value", F.col("acc_a") - F.col("acc_b"))
