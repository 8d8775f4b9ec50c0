"""Prompt columns: user messages, chat templates, continuation of cut thoughts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import stripped

# Instructions.
STEP_BY_STEP = "Please reason step by step, and put your final answer within \\boxed{}."
DIRECT = "Give only the final answer within \\boxed{}, with no explanation."
SHOWN_TEST = "Your code should pass this test:\n"
PLAN_CODE = "Briefly plan the solution, then give the complete code in one ```python block."
ONLY_CODE = "Return only the complete code in one ```python block."

# What one model family has before and after a message, by kind of prompt.
TEMPLATES = {
    "plain": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "thinking": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n"),
    "not thinking": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"),
    "closed thoughts": ("", "\n</think>\n\n"),
}


def prompt(text: Column | str, kind: str, templates: dict[str, tuple[str, str]] = TEMPLATES) -> Column:
    """A text as a prompt of some kind. Thoughts that are closed lose their trailing newlines."""
    text = F.col(text) if isinstance(text, str) else text
    before, after = map(F.lit, templates[kind])
    return F.concat(before, F.regexp_replace(text, r"\n+\z", "") if kind == "closed thoughts" else text, after)


def cut_thoughts(text: Column) -> Column:
    """Thoughts up to their first closing tag."""
    return F.substring_index(text, "</think>", 1)


def user_message(style: Column | str, kind: str = "kind", question: str = "question", meta: str = "meta") -> Column:
    """The user's turn for a task. ``style``: direct, cot or think. An unknown kind is an error."""
    style = F.lit(style) if isinstance(style, str) else style
    math = F.concat(question, F.lit("\n\n"), F.when(style == "direct", DIRECT).otherwise(STEP_BY_STEP))
    example = F.coalesce(F.try_element_at(F.col(meta), F.lit("example_test")), F.lit(""))
    shown = F.when(example != "", F.concat(F.lit(SHOWN_TEST), example))
    code = F.concat_ws("\n\n", stripped(F.col(question)), shown, F.when(style == "cot", PLAN_CODE).otherwise(ONLY_CODE))
    unknown = F.raise_error(F.concat(F.lit("unknown task kind: "), F.coalesce(kind, F.lit("null")))).cast("string")
    return F.when(F.col(kind) == "math", math).when(F.col(kind) == "code", code).otherwise(unknown)
