"""Answers, prompts, code blocks and grading on literal cases."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallylake.functions import answers, prompts
from tallylake.operators import grading

BOXED = [
    (r"so \boxed{42}.", "42"), (r"\boxed{1} then \boxed{2}", "2"), (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"), ("none", None), (r"\boxed 5", "5"), (r"\boxed{1", None), (r"\fbox{x{y}z}", "x{y}z"), (r"\boxed 7 and {8}", "8"),
    (r"\boxed", None), ("", None), (r"\boxed{}", ""), (r"a \boxed{{}{}} b}", "{}{}"),
]
EXTRACTED = [
    ("work\n#### 1,234", "1,234"), ("The answer is 17.", "17"), ("first 3 then 99", "99"), (r"<think>\boxed{1}</think> final \boxed{2}", "2"), ("nothing", None), ("x</think>y 3</think>4", "4"), ("ANSWER IS: $5$ ok", "5"),
    ("3, and -4.5 or 6,", "6,"), ("#### a\n#### b", "a"), (r"\boxed{ 8 }", "8"),
]
EQUAL = [("1,000", "1000"), (r"\dfrac{1}{2}", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), ("1/2", r"\frac12"), ("x = 5", "5"), (r"10\text{ cm}", "10"), (r"90^\circ", "90"), (".5", "0.5"), (r"\left(1,2\right)", "(1,2)"), ("2.50", "5/2"), ("-1/2", r"-\frac{1}{2}"), ("5.", "5"), (r"\$5", r"\$5"), ("7 dollars", "7")]
UNEQUAL = [("3", "4"), ("1/3", "0.33"), (None, "1"), ("1,2", "12"), (r"\frac{1}{0}", "1"), ("", "0"), ("abc", "1")]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_boxed(spark):
    assert column(spark, [t for t, _ in BOXED], answers.last_boxed) == [e for _, e in BOXED]


def test_extracted(spark):
    assert column(spark, [t for t, _ in EXTRACTED] + [None], answers.extracted_answer) == [e for _, e in EXTRACTED] + [None]


def test_normalised(spark):
    cases = {"1,2": "1,2", "  7  ": "7", r"\text{ abc}": "abc", "1,234,567.5": "1234567.5", "x=3": "3", r"\frac34": r"\frac{3}{4}", r"\tfrac{a}2": r"\frac{a}{2}", "5x": "5", "2e3": "2", r"a\neq b": r"a\neb", r"\$5": "\\5"}
    assert column(spark, list(cases), answers.normalised) == list(cases.values())


def test_equivalent(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(EQUAL + UNEQUAL)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in df.select(answers.equivalent(F.col("a"), F.col("b"))).collect()]
    assert got == [True] * len(EQUAL) + [False] * len(UNEQUAL)
    zero = [r[0] for r in df.select(answers.zero_division(F.col("a"), F.col("b"))).collect()]
    assert [i for i, z in enumerate(zero) if z] == [len(EQUAL) + 4]


def test_long_numbers(spark):
    df = spark.createDataFrame([("1" * 30, "1" * 30 + ".0"), ("1e3", "1000"), ("1" * 30, "2" * 30)], "a string, b string")
    assert [r[0] for r in df.select(answers.equivalent(F.col("a"), F.col("b"), long_numbers=True)).collect()] == [True, False, False]


def test_any_exact_numbers(spark):
    equal = [("10000000000.0", "10000000000"), ("12345678901/1", "12345678901"), ("123456789012345678", "123456789012345678.0"), ("0.0000000000012", "1.2e-12"), ("1e+3", "1000"), ("1" * 40, "1" * 40 + ".00"), ("1" * 40 + "/2", "2" * 40 + "/4"), ("1e+999999999", "10e+999999998"), ("5e-1", "1/2"), ("-0.0", "0e+7")]
    unequal = [("10000000000.1", "10000000000"), ("1" * 30, "1" * 29 + "2"), ("1e+999999999", "1/3"), ("1e+3", "100"), ("1__0e+1", "100"), ("9" * 20 + "/0", "1"), (None, "1" * 30), ("x^2", "y^2")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(equal + unequal)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(answers.equivalent(F.col("a"), F.col("b"))).collect()] == [True] * len(equal) + [False] * len(unequal)


def test_code(spark):
    cases = {"a ```python\nx\n``` b ```\ny = 1\n```": "y = 1", "```python\nz = 2": "z = 2", " plain ": "plain", "t</think>```py\nq\n```": "q", "```one": "one"}
    assert column(spark, list(cases), answers.extracted_code) == list(cases.values())


def test_grading(spark):
    tasks = spark.createDataFrame([("t", "1", "math", "1/2"), ("t", "2", "math", "3")], "benchmark string, task_id string, kind string, reference string")
    outputs = spark.createDataFrame([("t", "1", r"\boxed{0.5}"), ("t", "2", r"\boxed{\frac{1}{0}}")], "benchmark string, task_id string, output string")
    out = {r["task_id"]: r for r in grading.graded_math(outputs, tasks).collect()}
    assert (out["1"]["correct"], out["1"]["error"]) == (True, None) and (out["2"]["correct"], out["2"]["error"]) == (False, "ZeroDivisionError")
    key = "benchmark string, task_id string, policy string, seed int"
    code = spark.createDataFrame([("c", str(i), "p", 0, "```python\nf()\n```") for i in range(3)], f"{key}, output string")
    results = spark.createDataFrame([("c", "0", "p", 0, 0, False, ""), ("c", "1", "p", 0, 1, False, "Trace\nAssertionError\n"), ("c", "2", "p", 0, 0, True, "x")], f"{key}, exit_code int, timed_out boolean, stderr string")
    graded = sorted((r["task_id"], r["correct"], r["grade_detail"], r["pred"]) for r in grading.graded_code(code, results).collect())
    assert graded == [("0", True, "", "f()"), ("1", False, "AssertionError", "f()"), ("2", False, "timeout", "f()")]


def test_records(spark):
    df = spark.createDataFrame([("t", "1", "p", 0, "math", True, None, "r", {"level": "1", "example_test": "x"}), ("t", "2", "p", 0, "code", True, "E", "r", {})], "benchmark string, task_id string, policy string, seed int, kind string, correct boolean, error string, reference string, meta map<string,string>")
    full = df.withColumns({"pred": F.lit("p"), "grade_detail": F.lit(""), "wall_s": F.lit(1.0), "cost": F.lit(1), "signals": F.lit(1), "stopped_at": F.lit("s"), "steps": F.lit(1)})
    a, b = grading.run_records(full, "run").orderBy("task_id").collect()
    assert (a["correct"], a["reference"], a["meta"], a["cost"]) == (True, "r", {"level": "1"}, 1)
    assert (b["correct"], b["reference"], b["cost"], b["signals"], b["pred"]) == (False, None, None, None, None)


def test_prompts(spark):
    df = spark.createDataFrame([("math", "1+1?", {}), ("code", " add ", {"example_test": "assert f()"}), ("code", "sub", None)], "kind string, question string, meta map<string,string>")
    direct = [r[0] for r in df.select(prompts.user_message("direct")).collect()]
    assert direct[0] == "1+1?\n\n" + prompts.DIRECT and direct[1] == f"add\n\n{prompts.SHOWN_TEST}assert f()\n\n{prompts.ONLY_CODE}" and direct[2] == f"sub\n\n{prompts.ONLY_CODE}"
    assert df.select(prompts.user_message("cot")).collect()[1][0].endswith(prompts.PLAN_CODE)
    thought = F.concat(prompts.prompt("question", "thinking"), F.lit("hm\n\n"))
    texts = df.limit(1).select(*(prompts.prompt("question", k) for k in ("plain", "thinking", "not thinking")), prompts.prompt(thought, "closed thoughts")).first()
    assert texts[0] == "<|im_start|>user\n1+1?<|im_end|>\n<|im_start|>assistant\n"
    assert texts[1].endswith("assistant\n<think>\n") and texts[2].endswith("<think>\n\n</think>\n\n") and texts[3].endswith("hm\n</think>\n\n")
    assert spark.range(1).select(prompts.cut_thoughts(F.lit("a</think>b</think>c"))).first()[0] == "a"
    with pytest.raises(Exception):
        df.withColumn("kind", F.lit("art")).select(prompts.user_message("cot")).collect()


def test_answers_are_normalised_once_and_open_pairs_are_looked_at_once(spark, monkeypatch):
    rows = [("1", "1"), ("1/2", "0.5"), ("x", "y"), (None, "1"), ("1" * 30, "1" * 30 + ".0"), ("1" * 30, "1" * 30 + ".0"), ("1e-3", "0.001"), ("1e-3", "0.002"), ("$7$", "7")]
    df = spark.createDataFrame(rows, "a string, b string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = df.select(answers.equivalent(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    once = df.select(answers.normalised(F.col("a")).alias("n"))._jdf.queryExecution().executedPlan().toString().count("regexp_replace")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_replace") == 2 * once
    assert [r[0] for r in df.select(answers.equivalent(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True, True, True, False, True]
    asked = []
    monkeypatch.setattr(answers, "same_fraction", lambda p, q: asked.append((p, q)) or True)
    found = pa.StructArray.from_arrays([pa.array([True, None, None, False, False]), pa.array([None, "1", None, "1", "2"]), pa.array([None, "2", None, "2", "3"])], ["same", "a", "b"])
    assert answers.settled(found).to_pylist() == [True, True, False, True, True] and sorted(asked) == [("1", "2"), ("2", "3")]
