"""Answers of model outputs as column expressions: extraction, normalisation, exact equivalence, code blocks."""

from __future__ import annotations

import re
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks an answer, and what a number looks like.
BOX, BARE_BOX, MARKED, STATED = r"(?s)^.*(\\(?:boxed|fbox).*)$", r"^\\boxed\s+([^\s$]+)", r"(?d)####\s*(.+)", r"(?di)answer is[:\s]*\$?([^\n$]+)"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
# Tokens removed when answers are normalised, in this order.
REMOVED = ("\\left", "\\right", "\\!", "\\,", "\\;", "\\:", "\\displaystyle", "$", "^\\circ", "^{\\circ}", "\\%", "%", "\\$")
RENAMED = (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge"))
# Patterns and what takes their place, in this order: text wrappers; then, after the tokens, units, spaces, a variable and full stops; last, short fractions and decimals.
WRAPPERS = ((r"\\text\{\s*([^}]*)\}", "$1"), (r"\\(?:mathrm|textbf|mbox)\{([^}]*)\}", "$1"))
AROUND = ((r"^(-?[0-9.,/]+)\s*(?:[a-zA-Z]+\^?[0-9]*)$", "$1"), (" ", ""), (r"^[a-zA-Z]=", ""), (r"\.+\z", ""))
THOUSANDS = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\z"
SHORT = ((r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}"), (r"\\frac\{([^{}]*)\}([0-9])", r"\\frac{$1}{$2}"), (r"(^|[^0-9])\.([0-9])", "$10.$2"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs in it."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", "")


def without_thinking(text: Column) -> Column:
    """What follows the last closing tag of thoughts."""
    return F.substring_index(text, "</think>", -1)


def first_match(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def last_boxed(text: Column) -> Column:
    """Content of the last ``\\boxed{...}`` or ``\\fbox{...}`` with balanced braces; ``\\boxed x`` without any brace after it; else null.

    Only what follows the last box is looked at, brace by brace: the depth after the n-th brace is a running sum over the braces alone.
    """
    tail = F.regexp_extract(text, BOX, 1)
    at = F.instr(tail, "{")
    body = F.substring(tail, at + 1, F.length(tail))
    # Pieces between braces: where the depth first falls below zero, the content ends.
    pieces = F.regexp_extract_all(body, F.lit(r"([^{}]*[{}])"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(-1).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        size = state["size"] + F.length(piece)
        depth = state["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)
        end = F.when((state["end"] < 0) & (depth < 0), size - 1).otherwise(state["end"])
        return F.struct(depth.alias("depth"), size.alias("size"), end.alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    braced = F.when(end >= 0, F.substring(body, F.lit(1), end))
    bare = first_match(tail, BARE_BOX, 1)
    return F.when(tail == "", F.lit(None)).when(at > 0, braced).otherwise(bare)


def extracted_answer(text: Column) -> Column:
    """The final answer: last box, else first ``#### x``, else ``answer is x``, else the last number, else null."""
    t = without_thinking(text)
    marked = stripped(first_match(t, MARKED, 1))
    stated = F.regexp_replace(stripped(first_match(t, STATED, 1)), r"\.+\z", "")
    last_number = F.try_element_at(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), F.lit(-1))
    return F.coalesce(stripped(last_boxed(t)), marked, stated, last_number)


def rewritten(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def normalised(answer: Column) -> Column:
    """A chain of rewrites under which answers that differ in formatting alone become equal."""
    s = rewritten(stripped(answer), WRAPPERS)
    for old, new in (*((token, "") for token in REMOVED), *RENAMED):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = rewritten(s, AROUND)
    s = bound(s, lambda x: F.when(x.rlike(THOUSANDS), F.replace(x, F.lit(","), F.lit(""))).otherwise(x))
    return rewritten(s, SHORT)


def rational(text: Column) -> Column:
    """``struct<num, den: decimal(38,0), zero: boolean>`` of a normalised answer, null where it is no number of at most 18 digits a part (a decimal: in all).

    ``zero`` marks a fraction with denominator zero.
    """
    return bound(F.replace(text, F.lit("\\frac"), F.lit("")), of_number)


def of_number(s: Column) -> Column:
    big = "decimal(38,0)"

    def of(num: Column, den: Column) -> Column:
        return F.struct(num.cast(big).alias("num"), den.cast(big).alias("den"), (den.cast(big) == 0).alias("zero"))

    frac, slash, plain = r"^(-?)\{(-?[0-9]{1,18})\}\{([0-9]{1,18})\}\z", r"^(-?[0-9]{1,18})/([0-9]{1,18})\z", r"^([+-]?)(?=[0-9.]{1,19}\z)([0-9]{0,18})(?:\.([0-9]{0,18}))?\z"
    group = lambda p, n: F.regexp_extract(s, p, n)
    sign = lambda x: F.when(x == "-", F.lit(-1)).otherwise(F.lit(1))
    digits = F.concat(group(plain, 2), group(plain, 3))
    decimal = of(sign(group(plain, 1)) * F.nullif(digits, F.lit("")).try_cast("bigint"), F.rpad(F.lit("1"), F.length(group(plain, 3)) + 1, F.lit("0")).try_cast("bigint"))
    return (
        F.when(s.rlike(frac), of(sign(group(frac, 1)) * group(frac, 2).try_cast("bigint"), group(frac, 3).try_cast("bigint")))
        .when(s.rlike(slash), of(group(slash, 1).try_cast("bigint"), group(slash, 2).try_cast("bigint")))
        .when(s.rlike(plain) & (digits != ""), decimal)
    )


DECIMAL = re.compile(r"\s*([-+]?(?=\d|\.\d)(?:\d+(?:_\d+)*)?(?:\.(?:\d+(?:_\d+)*)?)?)(?:[eE]([-+]?\d+(?:_\d+)*))?\s*")


def decimal_of(s: str) -> tuple[int, int] | None:
    """``n, e`` of a decimal number ``n * 10 ** e``, n without zeros at its end. Large exponents are never expanded."""
    m = DECIMAL.fullmatch(s)
    if m is None:
        return None
    whole, _, part = m[1].replace("_", "").partition(".")
    digits = (whole + part).rstrip("0")
    n = int(digits) if digits.strip("+-") else 0
    return (n, int(m[2] or 0) - len(part) + len(whole + part) - len(digits)) if n else (0, 0)


def fraction_of(s: str) -> Fraction | None:
    try:
        if s.startswith(("{", "-{")) and s.endswith("}"):
            sign, (num, den) = (-1 if s[0] == "-" else 1), s.lstrip("-")[1:-1].split("}{")
            return sign * Fraction(int(num), int(den))
        return Fraction(s)
    except (ValueError, ZeroDivisionError):
        return None


def same_fraction(p: str | None, q: str | None) -> bool:
    """Whether two normalised answers are the same number, of any length."""
    p, q = (p or "").replace("\\frac", ""), (q or "").replace("\\frac", "")
    try:
        x, y = decimal_of(p), decimal_of(q)
    except ValueError:  # more digits than Python reads
        return False
    if x and y:
        return x == y
    if any(v and abs(v[1]) > 4 * (len(p) + len(q)) for v in (x, y)):
        return False  # no fraction of so few digits has this value
    return (v := fraction_of(p)) is not None and v == fraction_of(q)


def settled(found: pa.Array) -> pa.Array:
    """``same``, or, of pairs that are open (``a, b`` are not null), whether they are the same number; each pair of a batch is looked at once."""
    same, a, b = found.flatten()
    out = same.fill_null(False).to_numpy(zero_copy_only=False).copy()
    pairs = pa.table([a, b], names=["a", "b"]).filter(pc.is_valid(a))
    if len(pairs):
        held = [*zip(*(c.to_pylist() for c in pairs.columns), strict=True)]
        answers = {pair: same_fraction(*pair) for pair in {*held}}
        out[pc.is_valid(a).to_numpy(zero_copy_only=False)] = [answers[pair] for pair in held]
    return pa.array(out)


def equivalent(pred: Column, reference: Column, long_numbers: bool = False) -> Column:
    """Whether two answers are equal: normalised texts, else exact rationals. A null prediction is wrong.

    Both are normalised once, in one struct that goes through one vectorised function. That looks only at texts with digits that are no number of at most 18 digits a part
    (longer ones, or with exponents), each pair once; ``long_numbers``: at all others that differ, too.
    """
    return equivalent_of(compared(pred, reference), long_numbers)


def equivalent_of(both: Column, long_numbers: bool = False) -> Column:
    """``equivalent``, from what ``compared`` gives."""
    def found(p: Column) -> Column:
        x, y = p["x"], p["y"]
        ok = x.isNotNull() & y.isNotNull() & ~F.coalesce(x["zero"], F.lit(False)) & ~F.coalesce(y["zero"], F.lit(False))
        same = (p["a"] == p["b"]) | (ok & (x["num"] * y["den"] == y["num"] * x["den"]))
        digit = r"\p{Nd}"
        is_open = F.lit(True) if long_numbers else p["a"].rlike(digit) & p["b"].rlike(digit) & (x.isNull() | y.isNull())
        is_open = is_open & (p["a"] != p["b"]) & ~F.coalesce(same, F.lit(False))
        return F.struct(same.alias("same"), F.when(is_open, p["a"]).alias("a"), F.when(is_open, p["b"]).alias("b"))

    return F.arrow_udf(settled, "boolean")(bound(both, found)).alias("equivalent")  # Spark cannot make up a name over the function's structs


def compared(pred: Column, reference: Column) -> Column:
    """Both answers, normalised (``a, b``) and as rationals (``x, y``)."""
    both = F.struct(normalised(pred).alias("a"), normalised(reference).alias("b"))
    return bound(both, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), rational(p["a"]).alias("x"), rational(p["b"]).alias("y")))


def zero_division(pred: Column, reference: Column) -> Column:
    """``ZeroDivisionError`` where different answers hold a fraction with denominator zero, else null."""
    return F.when(pred.isNotNull(), zero_division_of(compared(pred, reference)))


def zero_division_of(both: Column) -> Column:
    """``zero_division``, from what ``compared`` gives."""
    def divides(p: Column) -> Column:
        return (p["a"] != p["b"]) & (F.coalesce(p["x"]["zero"], F.lit(False)) | F.coalesce(p["y"]["zero"], F.lit(False)))

    return F.when(bound(both, divides), F.lit("ZeroDivisionError"))


def extracted_code(text: Column) -> Column:
    """The last fenced block; else what follows the first line of an unterminated fence; else the whole text."""
    t = without_thinking(text)
    block = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?s)```(?:python|py)?\s*\n(.*?)```"), F.lit(1)), F.lit(-1))
    after = F.substring(t, F.instr(t, "```") + 3, F.length(t))
    rest = F.when(F.instr(after, "\n") > 0, F.substring(after, F.instr(after, "\n") + 1, F.length(after))).otherwise(after)
    return stripped(F.when(block.isNotNull(), block).when(F.instr(t, "```") > 0, rest).otherwise(t))
