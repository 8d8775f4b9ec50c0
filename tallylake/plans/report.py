"""The report over a run log: policy table, sweep, target check, levels; and the success bar across benchmarks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.functions.splits import held_out
from tallylake.operators.bootstrap import histogram_intervals
from tallylake.operators.frontier import compute_to_target, pareto_frontier, with_frontier_flag
from tallylake.operators.replay import against_fixed, even_grid, oracle, swept
from tallylake.operators.summary import accuracy_by_level, summary
from tallylake.sources.runlog import checkpointed, settings

SLACK, BAR = 0.01, 0.60


def policy_table(records: DataFrame, oracle_of: Sequence[str] = (), params_b: float | None = None, n_boot: int = 0) -> DataFrame:
    """Summary of all policies and of the hindsight oracle, with the frontier marked, and with bounds of the accuracy by ``n_boot`` replicates; ``hindsight`` marks the oracle. Sort by (benchmark, gen_tokens, policy)."""
    rows = summary(records, params_b, n_boot=n_boot).withColumn("hindsight", F.lit(False))
    if oracle_of:
        rows = rows.unionByName(summary(oracle(records, oracle_of), params_b, n_boot=n_boot).withColumn("hindsight", F.lit(True)))
    return with_frontier_flag(rows.withColumnRenamed("generated_tokens", "gen_tokens"))


def fixed_points(points: DataFrame, learned: str = "B5") -> DataFrame:
    """The points of policies that decide nothing by what they saw: without those whose name begins as ``learned``, and without those that know the answers (``hindsight``, where the points have it)."""
    own = points.where(~F.startswith("policy", F.lit(learned)))
    return own.where(~F.col("hindsight")).drop("hindsight") if "hindsight" in points.columns else own


def target_check(points: DataFrame, sweep: DataFrame | None, reference: str, slack: float = SLACK, bar: float = BAR, learned: str = "B5") -> DataFrame:
    """Per benchmark: tokens with which the fixed policies and the cascade reach the reference's accuracy less the slack.

    ``points``: ``benchmark, policy, gen_tokens, accuracy``, and ``hindsight`` if an oracle is among them; ``sweep``: the same with ``threshold`` for policy. ``meets`` tells whether the cascade needs at most ``bar`` times the reference's tokens.
    """
    base = points.where(F.col("policy") == reference).select("benchmark", (F.col("accuracy") - slack).alias("target"), F.col("gen_tokens").alias("reference_tokens"))
    fixed = pareto_frontier(fixed_points(points, learned))
    out = compute_to_target(fixed, base).withColumnRenamed("tokens", "fixed_tokens")
    if sweep is not None:
        curve = pareto_frontier(sweep, point_id="threshold")
        out = compute_to_target(curve, out).withColumnRenamed("tokens", "cascade_tokens")
    else:
        out = out.withColumn("cascade_tokens", F.lit(None).cast("double"))
    ratio = lambda c: F.col(c) / F.nullif(F.col("reference_tokens"), F.lit(0.0))
    return out.withColumns({"fixed_ratio": ratio("fixed_tokens"), "cascade_ratio": ratio("cascade_tokens")}).withColumn("meets", F.coalesce(F.col("cascade_ratio") <= bar, F.lit(False)))


def success_bar(check: DataFrame, differences: DataFrame, least: int = 2) -> DataFrame:
    """One row: benchmarks that meet the target and whose paired interval against the best fixed policy leaves out zero, and whether they are enough.

    ``differences``: ``benchmark, ci_low, ci_high``.
    """
    both = check.join(differences, "benchmark", "left")
    clear = F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))
    return both.agg(F.count("*").alias("benchmarks"), F.count_if("meets").alias("target_met"), F.count_if(F.col("meets") & clear).alias("bar_met")).withColumn("success", F.col("bar_met") >= least)


def chosen_thresholds(sweep: DataFrame, check: DataFrame) -> DataFrame:
    """``benchmark, threshold``: of the sweep's points that reach the target the one with the fewest tokens, of equals the lowest. Benchmarks without one have no row."""
    reached = sweep.join(check.select("benchmark", "target"), "benchmark").where(F.col("accuracy") >= F.col("target"))
    return reached.groupBy("benchmark").agg(F.min_by("threshold", F.struct("gen_tokens", "threshold")).alias("threshold"))


def cascade_intervals(records: DataFrame, points: DataFrame, sweep: DataFrame, check: DataFrame, stages: Sequence[str], scores: Sequence[Column], n_boot: int = 2000) -> DataFrame:
    """``benchmark, mean, ci_low, ci_high`` of the paired difference per task between the cascade at its chosen threshold and the best fixed policy at its budget.

    The bootstrap draws from the histogram of differences, so 2,000 replicates cost the same for any number of tasks.
    """
    pairs = against_fixed(records, points, sweep, chosen_thresholds(sweep, check), stages, scores)
    return histogram_intervals(pairs.withColumn("value", F.round("value", 9)), ["benchmark"], n_boot=n_boot)


@dataclass
class Report:
    """Result tables of a report, each a DataFrame over few rows, and what is to be said of all of them."""

    policies: DataFrame
    levels: DataFrame | None
    sweep: DataFrame | None
    target: DataFrame | None
    differences: DataFrame | None
    notes: tuple[str, ...] = ()

    def tables(self) -> dict[str, DataFrame]:
        return {name: df for name, df in vars(self).items() if name != "notes" and df is not None}

    def write(self, path: str) -> None:
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def markdown(self) -> str:
        """A section for each benchmark, from a collect of a few rows a benchmark: policies, sweep, target, levels. The notes come last."""
        parts = {name: df.collect() for name, df in self.tables().items()}
        blocks = []
        for benchmark in sorted({r["benchmark"] for r in parts["policies"]}):
            own = {name: [r.asDict() for r in rows if r["benchmark"] == benchmark] for name, rows in parts.items()}
            blocks += [f"## {benchmark}", *section(own)]
        return "\n\n".join([*blocks, *self.notes])


def shown(value, digits: int = 3) -> str:
    return "-" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def lined(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    return "\n".join("| " + " | ".join(cells) + " |" for cells in (head, ["---"] * len(head), *rows))


def section(own: dict[str, list[dict]]) -> list[str]:
    """The text blocks of one benchmark."""
    columns = [("accuracy", 3), ("acc_low", 3), ("acc_high", 3), ("gen_tokens", 0), ("thinking_tokens", 0), ("latency_s", 2), ("calls", 1), ("tflops", 2)]
    columns = [(c, d) for c, d in columns if c in own["policies"][0]]
    policies = sorted(own["policies"], key=lambda r: (r["gen_tokens"] is None, r["gen_tokens"], r["policy"]))
    mark = lambda r: f"{r['errors']} errors" if r["errors"] else ""
    out = [lined(["policy", *(c for c, _ in columns), "frontier", "errors"], [[r["policy"], *(shown(r[c], d) for c, d in columns), "yes" if r["on_frontier"] else "", mark(r)] for r in policies])]
    if own.get("sweep"):
        rows = [[shown(r["threshold"]), shown(r["accuracy"]), shown(r["gen_tokens"], 0), shown(r["escalation_rate"], 2)] for r in sorted(own["sweep"], key=lambda r: r["threshold"])]
        out += ["### Cascade sweep", lined(["threshold", "accuracy", "gen_tokens", "escalated"], rows)]
    for r in own.get("target", ()):
        verdict = "meets the bar" if r["meets"] else "does not meet the bar"
        out.append(f"### Tokens to reach an accuracy of {shown(r['target'])}\n\n- fixed policies: {shown(r['fixed_tokens'], 0)} ({shown(r['fixed_ratio'], 2)} of the reference's)\n- cascade: {shown(r['cascade_tokens'], 0)} ({shown(r['cascade_ratio'], 2)} of the reference's), {verdict}")
    for r in own.get("differences", ()):
        out.append(f"Cascade against the best fixed policy at its budget: {shown(r['mean'])} ({shown(r['ci_low'])} to {shown(r['ci_high'])})")
    if own.get("levels"):
        levels = sorted({r["level"] for r in own["levels"]})
        at = {(r["policy"], r["level"]): r["accuracy"] for r in own["levels"]}
        out += ["### Accuracy by level", lined(["policy", *map(str, levels)], [[p, *(shown(at.get((p, x)), 2) for x in levels)] for p in sorted({p for p, _ in at})])]
    return out


def dealt_once(records: DataFrame) -> DataFrame:
    """``records`` as several tables of a report read them: computed once, dealt by (benchmark, task), without the long steps.

    Adaptive execution would hide how the checkpoint's rows are dealt, so it is off for this step.
    """
    with settings(records.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        return checkpointed(records.drop("steps").repartition("benchmark", "task_id"))


def report(records: DataFrame, oracle_of: Sequence[str] = (), stages: Sequence[str] = (), scores: Sequence[Column] = (), grid: Sequence[float] | None = None, reference: str | None = None, split: float | None = None, params_b: float | None = None, n_boot: int = 2000) -> Report:
    """All tables of a run log that holds the latest record per key.

    Records are dealt by (benchmark, task) once and kept in the shared folder without their steps; grouping by key, by task and seed, and by task reuses that without a shuffle. Without a ``grid`` the sweep has 21 points from 0 to 1, which router scores lie in.
    The hindsight oracle is a row of the policies, and no fixed policy: neither the target check nor the differences compare the cascade with it.
    """
    some = dealt_once(held_out(records, split))
    policies = policy_table(some, oracle_of, params_b, n_boot)
    sweep = swept(some, stages, scores, even_grid() if grid is None else grid) if stages else None
    points = policies.select("benchmark", "policy", "gen_tokens", "accuracy", "hindsight")
    target = target_check(points, sweep, reference) if reference else None
    differences = cascade_intervals(some, fixed_points(points), sweep, target, stages, scores, n_boot) if stages and reference else None
    notes = [f"Only tasks outside of the training split count (a share of {split:g} of all tasks)."] if split else []
    notes += [f"`oracle` is the cheapest right record among {', '.join(oracle_of)}, known in hindsight; no fixed policy is compared with it."] if oracle_of else []
    return Report(policies, accuracy_by_level(some) if "level" in records.columns else None, sweep, target, differences, tuple(notes))
