"""The grid of pending jobs, and the choice of what to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def supported(policies: DataFrame) -> DataFrame:
    """``policy, stages, needs_math`` -> ``policy, kinds``: a voting policy takes math alone, a cascade what all its stages take."""
    own = policies.select("policy", "needs_math", F.explode_outer("stages").alias("stage"))
    stage = policies.select(F.col("policy").alias("stage"), F.col("needs_math").alias("stage_math"))
    needs = own.join(stage, "stage", "left").groupBy("policy").agg(F.max(F.col("needs_math") | F.coalesce("stage_math", F.lit(False))).alias("math"))
    return needs.select("policy", F.when(F.col("math"), F.array(F.lit("math"))).otherwise(F.array(F.lit("math"), F.lit("code"))).alias("kinds"))


#: Cells of the grid that share a word of a bitmap.
WORD = 62


def completed_cells(done: DataFrame, policies: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """``benchmark, task_id, cells``: a bitmap for each task with a completed key, in words of ``WORD`` cells; cell ``p * len(seeds) + s`` is of the p-th policy and the s-th seed. Other keys have no cell."""
    place = lambda names, kind: F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else F.lit(None).cast(f"map<{kind},int>")
    cell = F.try_element_at(place(policies, "string"), "policy") * len(seeds) + F.try_element_at(place(seeds, "int"), F.col("seed").cast("int"))
    known = done.select("benchmark", "task_id", cell.alias("cell")).where("cell IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cell") % WORD)
    words = [F.bit_or(F.when(F.floor(F.col("cell") / WORD) == w, bit).otherwise(0)) for w in range(max(1, -(-len(policies) * len(seeds) // WORD)))]
    return known.groupBy("benchmark", "task_id").agg(F.array(*words).alias("cells"))


def pending_jobs(tasks: DataFrame, policies: Sequence[tuple[str, bool]], seeds: Sequence[int], done: DataFrame) -> DataFrame:
    """Tasks x policies x seeds, without unsupported pairs and completed keys.

    The completed keys of a task come together as one bitmap, combined before the shuffle, and one row a task meets it; only then are the bits that are not set exploded. So what is shuffled are tasks and
    completed keys, not the grid.
    """
    names, numbers = [*dict.fromkeys(p for p, _ in policies)], [*dict.fromkeys(seeds)]
    cells = [(p, m, s, names.index(p) * len(numbers) + numbers.index(s)) for p, m in policies for s in seeds]
    entry = "array<struct<policy:string,needs_math:boolean,seed:int,word:int,bit:int>>"
    grid = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(m).alias("needs_math"), F.lit(s).alias("seed"), F.lit(c // WORD).alias("word"), F.lit(c % WORD).alias("bit")) for p, m, s, c in cells)).cast(entry)
    met = tasks.join(completed_cells(done, names, numbers), ["benchmark", "task_id"], "left")
    open_cell = lambda g: F.coalesce(F.getbit(F.get("cells", g["word"]), g["bit"]), F.lit(0)) == 0
    jobs = met.withColumn("g", F.explode(F.filter(grid, lambda g: open_cell(g) & (~g["needs_math"] | (F.col("kind") == "math")))))
    return jobs.select(*tasks.columns, "g.policy", "g.seed")


def selected_run(tasks: DataFrame, benchmarks: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Only some benchmarks, and the first ``limit`` tasks of each."""
    out = tasks.where(F.col("benchmark").isin(*benchmarks)) if benchmarks else tasks
    if limit:
        rank = F.row_number().over(W.partitionBy("benchmark").orderBy("src_index", "task_id"))
        out = out.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    return out
