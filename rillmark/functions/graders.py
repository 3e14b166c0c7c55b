"""Graders of text answers: Columns where patterns suffice, Arrow functions where braces
must be matched.  No grader evaluates or runs what it reads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .equality import competition_score, same_value

# Replacements, in order, and what is removed from a final answer.
REPLACED = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Replacements in a LaTeX answer, in order, before and after units are cut.
MATH_REPLACED = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]
MATH_POINTS = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""


def _tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def number_answer(text: Column, flexible: bool = False) -> Column:
    """The last number after '####' in the last 300 characters, without commas; flexible: the
    last number of any kind that isn't a lone point (the first if all are)."""
    end = _tail(text, 300)
    if not flexible:
        return F.replace(F.replace(_last(F.regexp_extract_all(end, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))), F.lit(",")), F.lit("$"))
    found = F.regexp_extract_all(end, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    real = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(_last(real), F.when(F.size(found) > 0, F.get(found, F.lit(0))))


def number_score(text: Column, truth: Column, flexible: bool = False, score: float = 1.0, wrong: float = 0.0) -> Column:
    answer = number_answer(text, flexible)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(wrong)


def final_answer(text: Column) -> Column:
    """A free-form final answer in a canonical form: what follows the last '=', without units,
    wrappers and markup, fractions and roots braced, digits without commas."""
    out = F.element_at(F.split(text, "="), -1)
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    for word in REMOVED:
        out = F.replace(out, F.lit(word), F.lit(""))
    out = F.regexp_replace(out, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for wrapper in ("text", "textbf", "overline"):
        out = F.regexp_replace(out, rf"\\{wrapper}\{{(.*?)\}}", "$1")
    out = F.regexp_replace(out, r"\\boxed\{(.*)\}", "$1")
    out = F.regexp_replace(out, r"frac([^{])(.)", "frac{$1}{$2}")
    out = F.replace(F.regexp_replace(out, r"sqrt([^{])", "sqrt{$1}"), F.lit("$"))
    bare = F.replace(out, F.lit(","))
    return F.trim(F.when(bare.rlike("^[0-9]+$"), bare).otherwise(out))


def stated_answer(text: Column) -> Column:
    """What the last 'Answer:' of the last 300 characters states, or [INVALID]."""
    found = F.regexp_extract_all(_tail(text, 300), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(_last(found), F.lit("[INVALID]"))


def stated_score(text: Column, truth: Column) -> Column:
    """struct<score (1 or -1), acc, pred> of the stated answer."""
    pred = final_answer(stated_answer(text))
    right = pred == final_answer(truth)
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def plain_text(text: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), f"[{PUNCTUATION}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(^|\b)(a|an|the)\b", " "), r"\s+", " "))


def tagged_answer(text: Column, least: int = 1) -> Column:
    """The text of the last <answer> element, if there are enough of them."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) >= least, F.trim(F.element_at(found, -1)))


def exact_match(text: Column, golden: Column, score: float = 1.0, wrong: float = 0.0, contained: bool = False) -> Column:
    """Whether the tagged answer equals (or contains) one of the golden answers, as plain
    text; a quarter of the score if answer tags pile up."""
    answer = plain_text(tagged_answer(text))
    hit = F.exists(golden, lambda g: answer.contains(plain_text(g)) if contained else answer == plain_text(g))
    if contained:
        full = F.lit(score)
    else:
        tags = F.greatest(F.regexp_count(text, F.lit("<answer>")), F.regexp_count(text, F.lit("</answer>")))
        full = F.when(tags > 10, score / 4).otherwise(score)
    return F.when(tagged_answer(text).isNull(), 0.0).when(hit, full).otherwise(wrong)


def think_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two lists over their union, counting repeats; 1 for equal lists, 0 if only
    one is empty."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float = 1.0) -> Column:
    """Negative in the buffer before the longest allowed length, else 0."""
    return F.least(-(length - (longest - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def area_score(area: Column, corners: tuple[float, float, float, float] = (0.05, 0.25, 0.75, 0.95)) -> Column:
    """A trapezoid of the crop's share of the image."""
    a, b, c, d = corners
    return F.when((area <= a) | (area >= d), 0.0).when(area < b, (area - a) / (b - a)).when(area <= c, 1.0).otherwise((d - area) / (d - c))


def proxy_reward(relevance: Column, saliency: Column, composition: Column, integrity: Column, area: Column, valid: Column) -> Column:
    """Weighted components, capped by a low relevance; -1 where invalid."""
    total = 0.45 * relevance + 0.20 * saliency + 0.15 * composition + 0.10 * integrity + 0.10 * area
    return F.when(~valid, -1.0).when(relevance < 0.5, F.least(total, relevance)).otherwise(total)


def relative_relevance(candidate: Column, original: Column, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-scale * (candidate - original)))


def braced_after(text: str, at: int) -> str | None:
    """What the first matched braces from a place on hold."""
    start = text.find("{", at)
    depth = 0
    for k in range(start, len(text)) if start >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return text[start + 1 : k]
    return None


def boxed_in(text: str | None) -> str | None:
    """What the last \\boxed holds.  One with a space behind it goes before all others and holds
    what follows up to a dollar sign; a box of another kind doesn't count."""
    if text is None:
        return None
    _, spaced, tail = text.rpartition("\\boxed ")
    if spaced:
        return tail.split("$")[0]
    at = text.rfind("\\boxed")
    return braced_after(text, at) if at >= 0 and text.startswith("\\boxed{", at) else None


def strict_box(text: str | None) -> str | None:
    """What the last \\boxed{ of the last 100 characters holds."""
    end = (text or "")[-100:]
    at = end.rfind("\\boxed{")
    return braced_after(end, at) if at >= 0 else None


def _braced(text: str, command: str, arguments: int) -> str:
    """Brace the single-character arguments of a command."""
    head, *rest = text.split(command)
    for tail in rest:
        head += command
        for _ in range(arguments):
            if not tail or tail[0] == "{":
                break
            head, tail = head + "{" + tail[0] + "}", tail[1:]
        head += tail
    return head


def math_form(text: str) -> str:
    """A LaTeX answer in a canonical form, for comparison as text."""
    for old, new in MATH_REPLACED:
        text = text.replace(old, new)
    text = text.split("\\text{ ")[0] if text.count("\\text{ ") == 1 else text
    for old, new in MATH_POINTS:
        text = text.replace(old, new)
    if text.startswith("."):
        text = "0" + text
    sides = text.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        text = sides[1]
    text = _braced(_braced(text, "\\sqrt", 1).replace(" ", ""), "\\frac", 2)
    if text == "0.5":
        return "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?[1-9][0-9]*|0)/(-?[1-9][0-9]*|0)", text):
        return f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return text


def same_math(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    return math_form(a) == math_form(b)


def boxed_match(text: str | None, truth: str | None) -> float:
    answer = boxed_in(text)
    return float(answer is not None and same_math(answer, truth))


def _column(f: Callable, kind: str):
    def make(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([f(*v) for v in zip(*series, strict=True)])

        return run(*columns)

    return make


boxed_answer = _column(boxed_in, "string")
math_normal = _column(lambda s: None if s is None else math_form(s), "string")
boxed_score = _column(lambda s, t: boxed_match(s, t), "double")
strict_box_score = _column(lambda s, t: 1.0 if t is not None and strict_box(s) == t else -1.0, "double")
numeric_score = _column(lambda s, t: float(s is not None and t is not None and same_value(s, t)), "double")


def geometry_score(text: Column, truth: Column, form: float = 0.1) -> Column:
    return (1 - form) * boxed_score(text, truth) + form * think_format(text)


# Names of data sources, by the grader that their answers go to.
GRADERS: dict[str, list[str]] = {
    "number": ["openai/gsm8k"],
    "boxed": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "stated": ["math_dapo", "math", "math_dapo_reasoning"],
    "competition": ["numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"],
    "code": ["codecontests", "apps", "codeforces", "taco"],
    "geometry": ["hiyouga/geometry3k"],
    "exact": ["searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"],
}


def grader_of(source: Column) -> Column:
    """The name of a source's grader; null if it has none."""
    out = F.when(source.startswith("aime"), "stated")
    for kind, names in GRADERS.items():
        out = out.when(source.isin(*names), kind)
    return out


_by_braces = _column(lambda kind, s, t: None if kind is None else float({"boxed": boxed_match, "geometry": boxed_match, "competition": lambda a, b: competition_score(a, b)[0]}[kind](s, t)), "double")


def dispatch(source: Column, text: Column, truth: Column, passed: Column | None = None) -> Column:
    """The score by the source's grader; an unknown source is an error when a row has it.
    Answers that are programs aren't run here: ``passed`` says which of their tests were
    passed elsewhere.  Braces are matched for the rows of the graders that need it only."""
    kind = grader_of(source)
    braces = _by_braces(F.when(kind.isin("boxed", "geometry", "competition"), kind), text, truth)
    code = pass_fraction(passed) if passed is not None else F.raise_error(F.lit("programs are run elsewhere: tell what they passed"))
    return (
        F.when(kind == "number", number_score(text, truth)).when(kind.isin("boxed", "competition"), braces).when(kind == "stated", stated_score(text, truth)["score"])
        .when(kind == "geometry", 0.9 * braces + 0.1 * think_format(text)).when(kind == "exact", exact_match(text, F.array(truth))).when(kind == "code", code.cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("no grader for "), source)).cast("double"))
    )


def pass_fraction(passed: Column) -> Column:
    """The share of tests passed, of the first ten; 0 without any."""
    some = F.slice(passed, 1, 10)
    return F.coalesce(F.try_divide(F.size(F.filter(some, lambda x: x)).cast("double"), F.size(some).cast("double")), F.lit(0.0))


def call_format_reward(text: Column, truth: Column, most: float = 1.0, least: float = 0.0) -> Column:
    """Whether an answer has the parts in the order that its truth has: thoughts, then tool
    calls, a response, both or neither, each once."""
    calls, says = truth.contains("<tool_call>"), truth.contains("<response>")
    once = lambda tag: (F.regexp_count(text, F.lit(f"<{tag}>")) == 1) & (F.regexp_count(text, F.lit(f"</{tag}>")) == 1)
    thought, call, response = r"(?s)^<think>.*?</think>", r"\n<tool_call>\n.*?\n</tool_call>", r"\n<response>.*?</response>"
    end = r"\n?$(?![\s\S])"
    ok = (
        F.when(calls & says, text.rlike(thought + call + response + end) & once("tool_call") & once("response"))
        .when(calls, text.rlike(thought + call + end) & once("tool_call")).when(says, text.rlike(thought + response + end) & once("response")).otherwise(text.rlike(thought + end))
    )
    return F.when(ok, most).otherwise(least)


def call_match(wanted: list[dict], given: list[dict], low: float = -3.0, high: float = 3.0) -> float:
    """How well given tool calls match wanted ones, between ``low`` and ``high``: overlap of
    their names, and for each wanted call the best unused one of its name, by overlap of
    parameter names and equal values."""
    if wanted == given:
        return high

    def overlap(a: list, b: list) -> float:
        if a == b:
            return 1.0
        common = sum(min(a.count(x), b.count(x)) for x in set(a))
        return common / (len(a) + len(b) - common) if a and b else 0.0

    points, most = overlap([c["name"] for c in wanted], [c["name"] for c in given]), 1.0
    free = list(range(len(given)))
    for call in wanted:
        need = call["parameters"]
        most += 1 + len(need)
        value = {
            i: overlap(list(need), list(given[i]["parameters"])) + sum(k in given[i]["parameters"] and given[i]["parameters"][k] == v for k, v in need.items())
            for i in free if given[i]["name"] == call["name"]
        }
        best = max(value, key=value.get, default=None)
        if best is not None and value[best] > 0:
            free.remove(best)
            points += value[best]
    return low + (high - low) * points / most


def _calls(text: str) -> list[dict]:
    body = text.split("<tool_call>")[1].split("</tool_call>")[0].strip()
    calls = [json.loads(line) for line in body.split("\n")]
    if any(not isinstance(c["parameters"], dict) for c in calls):
        raise ValueError("parameters")
    return [c | {"name": c["name"]} for c in calls]


def _call_score(text: str | None, truth: str | None) -> float | None:
    """Null where the truth is null or has no readable calls; a null text has no calls."""
    if truth is None:
        return None
    if "<tool_call>" not in truth:
        return 0.0
    try:
        wanted = _calls(truth)
    except (ValueError, KeyError, TypeError, IndexError):
        return None
    try:
        if "</tool_call>" not in text:
            return -3.0
        return call_match(wanted, _calls(text))
    except (ValueError, KeyError, TypeError, IndexError):
        return -3.0


tool_call_score = _column(_call_score, "double")
