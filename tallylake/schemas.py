"""Explicit schemas of the four tables: tasks, calls, attempts (the run log) and routers."""

from __future__ import annotations

#: Counters of an attempt's cost; a missing one counts as 0.
COST_FIELDS = ("calls", "prompt_tokens", "prefill_tokens", "generated_tokens", "thinking_tokens", "latency_s")
COST = "struct<calls:bigint,prompt_tokens:bigint,prefill_tokens:bigint,generated_tokens:bigint,thinking_tokens:bigint,latency_s:double>"
STEPS = "array<struct<name:string,prompt_tail:string,text:string,finish_reason:string,completion_tokens:bigint>>"

TASKS = "task_id string, benchmark string, kind string, question string, reference string, code_reference struct<test:string,setup:string>, meta map<string,string>, src_index bigint"
CALLS = "benchmark string, task_id string, policy string, seed int, sample_no int, call_no int, step string, text string, finish_reason string, prompt_tokens bigint, completion_tokens bigint, latency_s double, token_logprobs array<double>, top_logprobs array<map<string,double>>"
#: Fields of the run log. ``seed`` is read as text, because both numbers and quoted numbers occur.
LOG_FIELDS = {
    "v": "int", "run": "string", "benchmark": "string", "task_id": "string", "policy": "string", "seed": "string", "correct": "boolean", "pred": "string", "reference": "string",
    "grade_detail": "string", "error": "string", "meta": "map<string,string>", "wall_s": "double", "cost": COST, "signals": "map<string,double>", "stopped_at": "string", "steps": STEPS,
}


def log_fields(*names: str) -> str:
    """A schema of the run log with some of its fields only; none named: with all."""
    return ", ".join(f"{n} {kind}" for n, kind in LOG_FIELDS.items() if not names or n in (*names, "seed"))


LOG = log_fields()
ROUTERS = "features array<string>, weights array<double>, bias double, mean array<double>, std array<double>, meta map<string,string>"

#: A record's key, and what it shares with the other policies' records of the same task and seed.
KEY = ("benchmark", "task_id", "policy", "seed")
TASK_SEED = ("benchmark", "task_id", "seed")

