"""Benchmark tables normalised to tasks; reading, writing and choosing tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.functions.answers import last_boxed, stripped

JSON_TASKS = "id string, benchmark string, kind string, question string, reference string, meta map<string,string>"
NO_CODE = "struct<test:string,setup:string>"


def picked(df: DataFrame, preferred: str | None, candidates: Sequence[str]) -> Column:
    """The first of the named columns that ``df`` has, even if it holds nulls."""
    for name in ([preferred] if preferred else []) + [*candidates]:
        if name in df.columns:
            return F.col(name)
    raise KeyError(f"none of {[preferred, *candidates]} found; columns are {sorted(df.columns)}")


def level(value: Column) -> Column:
    """All digits of a value as one number, else 0: ``Level 3`` -> 3."""
    return F.coalesce(F.regexp_replace(value.cast("string"), "[^0-9]", "").try_cast("int"), F.lit(0))


def shaped(df: DataFrame, name: str, kind: str, task_id: Column, question: Column, reference: Column, meta: Column, code: Column | None = None, index: str = "src_index") -> DataFrame:
    return df.select(
        task_id.alias("task_id"), F.lit(name).alias("benchmark"), F.lit(kind).alias("kind"), question.cast("string").alias("question"), reference.cast("string").alias("reference"),
        (code if code is not None else F.lit(None).cast(NO_CODE)).alias("code_reference"), meta.alias("meta"), F.col(index).cast("bigint").alias("src_index"),
    )


def no_meta() -> Column:
    return F.create_map().cast("map<string,string>")


def school_math_tasks(df: DataFrame, name: str = "gsm8k") -> DataFrame:
    """``question, answer, src_index``: the reference is what follows the last ``####``, without commas."""
    reference = F.replace(stripped(F.substring_index("answer", "####", -1)), F.lit(","), F.lit(""))
    return shaped(df, name, "math", F.concat_ws("-", F.lit(name), "src_index"), F.col("question"), reference, no_meta())


def competition_tasks(df: DataFrame, name: str = "math500") -> DataFrame:
    """``problem, answer, level, subject, unique_id, src_index``."""
    task_id = F.concat_ws("-", F.lit(name), "src_index")
    if "unique_id" in df.columns:
        task_id = F.coalesce("unique_id", task_id)
    meta = F.create_map(F.lit("level"), level(F.col("level")).cast("string"), F.lit("subject"), F.coalesce(F.col("subject"), F.lit("")) if "subject" in df.columns else F.lit(""))
    return shaped(df, name, "math", task_id, F.col("problem"), F.col("answer"), meta)


def answer_tasks(configs: dict[str, DataFrame], name: str, question: str | None = None, answer: str | None = None, from_solution: bool = False) -> DataFrame:
    """Question/answer tables of several configurations, united. ``from_solution``: the answer is the last boxed expression of a
    worked solution, and rows without one are dropped after they were numbered."""
    out = None
    for config, df in configs.items():
        q, a = picked(df, question, ("problem", "question", "Problem", "Question")), picked(df, answer, ("answer", "Answer", "solution"))
        a = last_boxed(a.cast("string")) if from_solution else a
        has_level = F.col("level").isNotNull() if "level" in df.columns else F.lit(False)
        meta = F.when(has_level, F.create_map(F.lit("level"), level(F.col("level")).cast("string"))).otherwise(no_meta()) if "level" in df.columns else no_meta()
        rows = shaped(df, name, "math", F.concat_ws("-", F.lit(name), F.lit(config or "default"), "src_index"), q, a, meta)
        rows = rows.where(F.col("reference").isNotNull()) if from_solution else rows
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no configuration given")
    return out


def exam_tasks(first: DataFrame, second: DataFrame, name: str = "aime2025") -> DataFrame:
    """Two exams of one year as one benchmark."""
    return answer_tasks({"AIME2025-I": first, "AIME2025-II": second}, name)


def code_tasks(df: DataFrame, name: str = "mbppplus") -> DataFrame:
    """``task_id, prompt, test, test_list, test_imports, src_index``; imports are a list or one text."""
    kinds = dict(df.dtypes)
    setup = F.array_join("test_imports", "\n") if kinds.get("test_imports", "").startswith("array") else F.col("test_imports") if "test_imports" in kinds else F.lit("")
    example = F.coalesce(F.try_element_at("test_list", F.lit(1)), F.lit("")) if "test_list" in kinds else F.lit("")
    code = F.struct(F.col("test").alias("test"), F.coalesce(setup, F.lit("")).alias("setup"))
    return shaped(df, name, "code", F.concat_ws("-", F.lit(name), F.col("task_id")), F.col("prompt"), F.lit(None), F.create_map(F.lit("example_test"), example), code)


def chosen(tasks: DataFrame, limit: int = 0, shuffle_seed: int | None = None) -> DataFrame:
    """A deterministic shuffle where a seed is given, then the first ``limit`` tasks (0: all)."""
    order = [F.md5(F.concat_ws("|", F.lit(str(shuffle_seed)), "task_id")), F.col("task_id")] if shuffle_seed is not None else [F.col("src_index"), F.col("task_id")]
    return tasks.orderBy(*order).limit(limit) if limit > 0 else tasks.orderBy(*order)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from JSON lines; blank lines are skipped. An object as reference is a code task's."""
    rows = spark.read.schema(JSON_TASKS).json(path).where("id IS NOT NULL")
    code = F.when(F.col("kind") == "code", F.from_json("reference", NO_CODE))
    return rows.select(F.col("id").alias("task_id"), "benchmark", "kind", "question", F.when(F.col("kind") != "code", F.col("reference")).alias("reference"), code.alias("code_reference"), "meta", F.monotonically_increasing_id().alias("src_index"))


def write_tasks(tasks: DataFrame, path: str) -> None:
    reference = F.when(F.col("kind") == "code", F.to_json("code_reference")).otherwise(F.col("reference"))
    tasks.select(F.col("task_id").alias("id"), "benchmark", "kind", "question", reference.alias("reference"), "meta").write.mode("overwrite").json(path)
