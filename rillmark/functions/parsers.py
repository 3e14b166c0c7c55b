"""Structured text: tool calls, actions, media tags, prompts.

Dialects of tool calls are patterns that give (name, arguments) pairs in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def hermes_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of <tool_call> JSON bodies; bad JSON is skipped."""
    bodies = _lit_all(text, r"(?s)<tool_call>(.*?)</tool_call>")
    calls = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def hermes_content(text: Column) -> Column:
    return F.when(text.contains("<tool_call>") & text.contains("</tool_call>"), F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")).otherwise(text)


def channel_calls(text: Column) -> Column:
    """Calls addressed to=functions.NAME whose JSON-constrained message a call mark ends; what
    was thought aloud (analysis channels, also one that the prompt began) isn't searched."""
    bare = F.regexp_replace(text, r"(?s)(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    pattern = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    return F.transform(F.arrays_zip(_lit_all(bare, pattern, 1).alias("n"), _lit_all(bare, pattern, 2).alias("a")), lambda x: F.struct(x["n"].alias("name"), x["a"].alias("arguments")))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_value(text: Column) -> Column:
    """The text if it is JSON, else the JSON string of it."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.when(is_json(text), text).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def _last_of_each(entries: Column) -> Column:
    """A map of array<struct<k, v>>: a name given again keeps its place and takes the last value."""
    named = F.filter(entries, lambda e: e["k"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(named, lambda e: e["k"] == k), -1)["v"]))


def _pairs(body: Column, key: str, value: str) -> Column:
    both = F.arrays_zip(_lit_all(body, key).alias("k"), _lit_all(body, value).alias("v"))
    return _last_of_each(F.transform(both, lambda x: F.struct(x["k"].alias("k"), F.regexp_replace(x["v"], r"^\s+|\s+$", "").alias("v"))))


def _element_calls(block: str, name: str, key: str, value: str):
    def of(text: Column) -> Column:
        bodies = _lit_all(text, block)
        return F.transform(bodies, lambda b: F.struct(F.trim(F.regexp_extract(b, name, 1)).alias("name"), _pairs(b, key, value).alias("arguments")))

    return of


#: Dialects with a name and keyed values in elements.
function_calls = _element_calls(r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<function=([^>]+)>", r"(?s)<parameter=([^>]+)>", r"(?s)<parameter=[^>]+>(.*?)(?:</parameter>|$)")
keyed_calls = _element_calls(r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)^([^<]*)", r"(?s)<arg_key>(.*?)</arg_key>", r"(?s)<arg_value>(.*?)</arg_value>")
seed_calls = _element_calls(r"(?s)<seed:tool_call>(.*?)</seed:tool_call>", r"(?s)<function=([^>]+)>", r"(?s)<parameter=([^>]+)>", r"(?s)<parameter=[^>]+>(.*?)</parameter>")
invoke_calls = _element_calls(r"(?s)(<invoke name=\"[^\"]+\">.*?</invoke>)", r"<invoke name=\"([^\"]+)\">", r"(?s)<parameter name=\"([^\"]+)\"[^>]*>", r"(?s)<parameter name=\"[^\"]+\"[^>]*>(.*?)</parameter>")


def marked_calls(text: Column) -> Column:
    """Calls between begin, argument and end marks; arguments that aren't JSON become {}."""
    pattern = r"(?s)<\|tool_call_begin\|>\s*(.*?)\s*<\|tool_call_argument_begin\|>\s*(.*?)\s*<\|tool_call_end\|>"
    both = F.arrays_zip(_lit_all(text, pattern, 1).alias("n"), _lit_all(text, pattern, 2).alias("a"))
    name = lambda n: F.regexp_replace(F.regexp_replace(n, r"^functions\.", ""), r":[0-9]+$", "")
    return F.transform(both, lambda x: F.struct(name(x["n"]).alias("name"), F.when(F.get_json_object(x["a"], "$").isNotNull(), x["a"]).otherwise("{}").alias("arguments")))


def brace_calls(text: Column) -> Column:
    """Calls of the form call:NAME{key:value, ...} between their marks; a quoted value is a
    string, a bare one is typed: true, false, null, a number, else a string.  Values are JSON."""
    pattern = r"(?s)<\|tool_call>call:(\w+)\{(.*?)\}<tool_call\|>"
    pair = r'(?s)(\w+):(?:<\|"\|>(.*?)<\|"\|>|([^,}]*))'
    both = F.arrays_zip(_lit_all(text, pattern, 1).alias("n"), _lit_all(text, pattern, 2).alias("a"))

    def value(quoted: Column, bare: Column, whole: Column) -> Column:
        word, plain = F.lower(F.trim(bare)), F.trim(bare)
        digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")  # of any length
        number = F.when(plain.rlike(r"^[+-]?\d+$"), digits).when(plain.try_cast("double").isNotNull(), plain.try_cast("double").cast("string"))
        typed = F.when(word.isin("true", "false", "null"), word).otherwise(F.coalesce(number, _string(plain)))
        return F.when(whole.rlike(r'(?s)^\w+:<\|"\|>'), _string(quoted)).otherwise(typed)

    def arguments(body: Column) -> Column:
        parts = F.arrays_zip(*(_lit_all(body, pair, k).alias(n) for k, n in ((1, "k"), (2, "q"), (3, "b"), (0, "w"))))
        return _last_of_each(F.transform(parts, lambda p: F.struct(p["k"].alias("k"), value(p["q"], p["b"], p["w"]).alias("v"))))

    return F.transform(both, lambda x: F.struct(x["n"].alias("name"), arguments(x["a"]).alias("arguments")))


def _string(text: Column) -> Column:
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def typed(calls: Column) -> Column:
    """Calls of a dialect with keyed values, each value as JSON (text that isn't becomes a string)."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.transform_values(c["arguments"], lambda _, v: json_value(v)).alias("arguments")))


#: The full-width marks of one dialect.
_MARK = "\uff5cDSML\uff5c"


def marked_invocations(text: Column) -> Column:
    """Calls in marked invoke elements inside their block; parameters say whether they are
    strings, others are JSON (kept as strings where they aren't).  Values are JSON."""
    inner = F.array_join(_lit_all(text, rf"(?s)<{_MARK}tool_calls>(.*?)</{_MARK}tool_calls>"), "\n")
    invoke, parameter = rf'(?s)<{_MARK}invoke name="(.*?)">(.*?)</{_MARK}invoke>', rf'(?s)<{_MARK}parameter name="(.*?)" string="(true|false)">(.*?)</{_MARK}parameter>'
    both = F.arrays_zip(_lit_all(inner, invoke, 1).alias("n"), _lit_all(inner, invoke, 2).alias("b"))

    def arguments(body: Column) -> Column:
        parts = F.arrays_zip(*(_lit_all(body, parameter, k).alias(n) for k, n in ((1, "k"), (2, "s"), (3, "v"))))
        return _last_of_each(F.transform(parts, lambda p: F.struct(p["k"].alias("k"), F.when(p["s"] == "true", _string(p["v"])).otherwise(json_value(p["v"])).alias("v"))))

    return F.transform(both, lambda x: F.struct(x["n"].alias("name"), arguments(x["b"]).alias("arguments")))


def after_thought(text: Column) -> Column:
    """What stands behind the last </think>."""
    return F.substring_index(text, "</think>", -1)


def named_tool(raw: Column, keys: Column, tools: dict[str, list[str]]) -> Column:
    """Which tool a call means: its exact name, else the only one whose name is part of it, else
    the only one whose required parameters it has all of, else the name as it is."""
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, need)).cast("array<string>").alias("need")) for n, need in tools.items()))
    only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))["name"])
    compact = F.replace(F.lower(raw), F.lit("-"), F.lit("_"))
    exact = F.when(raw.isin(*tools), raw)
    within = only(F.filter(table, lambda t: compact.contains(F.lower(t["name"]))))
    fits = only(F.filter(table, lambda t: (F.size(t["need"]) > 0) & (F.size(F.array_except(t["need"], keys)) == 0)))
    return F.coalesce(exact, within, fits, raw)


def crop_action(text: Column) -> Column:
    """struct<cx, cy, area, strict> of a <crop> action with exactly these whole numbers in
    0..1000 (area from 1), or null; a missing end tag is forgiven but not strict."""
    body = F.regexp_extract(text, r"(?s)<crop>\s*(\{.*?\})", 1)
    keys = F.array_sort(F.json_object_keys(F.when(body != "", body)))
    number = lambda k: F.when(F.get_json_object(body, f"$.{k}").rlike("^-?[0-9]+$"), F.get_json_object(body, f"$.{k}").try_cast("int"))
    cx, cy, area = (number(k) for k in ("cx", "cy", "area"))
    ok = (keys == F.array(*map(F.lit, ("area", "cx", "cy")))) & cx.between(0, 1000) & cy.between(0, 1000) & area.between(1, 1000)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(cx.alias("cx"), cy.alias("cy"), area.alias("area"), text.rlike(r"(?s)<crop>\s*\{.*?\}\s*</crop>").alias("strict")))


def media_parts(content: Column) -> Column:
    """array<struct<type, text>>: content cut at <image>, <video> and <audio>, tags kept as
    parts, empty parts dropped."""
    parts = F.split(content, r"(?=<(?:image|video|audio)>)|(?<=<image>)|(?<=<video>)|(?<=<audio>)")
    kind = lambda p: F.when(p.isin("<image>", "<video>", "<audio>"), F.regexp_replace(p, "[<>]", "")).otherwise("text")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def _fenced(text: Column) -> Column:
    """(the JSON object that a text is, whether it is one by itself): one in a code block of JSON
    is recovered."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    block = F.regexp_extract(text, r"(?is)^\s*```json\s*(\{.*\})\s*```\s*$", 1)
    return F.struct(F.when(is_json(bare) & bare.startswith("{"), bare).when(is_json(block), block).alias("json"), (is_json(bare) & bare.startswith("{")).alias("strict"))


def _object(json: Column, keys: list[str], ordered: bool = False) -> Column:
    """Whether an object has exactly these keys."""
    found = F.json_object_keys(json)
    return F.coalesce(found == F.array(*map(F.lit, keys)) if ordered else F.array_sort(found) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def _int(json: Column, key: str) -> Column:
    """A whole number that is written as one."""
    raw = F.get_json_object(json, f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))
    return F.when((kind == "BIGINT") & raw.rlike("^-?[0-9]+$"), raw.try_cast("bigint"))


def percent_action(text: Column) -> Column:
    """struct<cx, cy, area, strict> of an object of whole percentages, in thousandths, or null."""
    read = _fenced(text)
    json = read["json"]
    cx, cy, area = (_int(json, k) for k in ("cx_pct", "cy_pct", "area_pct"))
    ok = _object(json, ["cx_pct", "cy_pct", "area_pct"]) & cx.between(0, 100) & cy.between(0, 100) & area.between(1, 100)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct((cx * 10).alias("cx"), (cy * 10).alias("cy"), (area * 10).alias("area"), read["strict"].alias("strict")))


def layout_action(text: Column) -> Column:
    """struct<operation, x1, y1, x2, y2, strict> of a layout in whole percentages, or null; only
    padding needs the whole image."""
    read = _fenced(text)
    json = read["json"]
    operation = F.get_json_object(json, "$.operation")
    box = {k: _int(json, f"{k}_pct") for k in ("x1", "y1", "x2", "y2")}
    whole = (box["x1"] == 0) & (box["y1"] == 0) & (box["x2"] == 100) & (box["y2"] == 100)
    ok = _object(json, ["operation", "x1_pct", "y1_pct", "x2_pct", "y2_pct"]) & operation.isin("crop", "crop_pad", "pad") & (box["x1"] < box["x2"]) & (box["y1"] < box["y2"]) & ((operation != "pad") | whole)
    for x in box.values():
        ok = ok & x.between(0, 100)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(operation.alias("operation"), *(x.alias(k) for k, x in box.items()), read["strict"].alias("strict")))


def mode_decision(text: Column) -> Column:
    """'crop' or 'pad' of an object that says only that, or null."""
    mode = F.get_json_object(F.when(is_json(text), text), "$.mode")
    return F.when(_object(F.when(is_json(text), text), ["mode"]) & mode.isin("crop", "pad"), mode)


def crop_fill(text: Column, described: bool = False) -> Column:
    """struct<ratio, is_cropped, is_filled, crop_box, fill_color> of an object with these fields in
    this order (and a description, if it is to have one), or null.  A box is there if and only
    if the image is cropped, a colour if and only if it is filled."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    json = F.when(is_json(bare), bare)
    fields = ["target_ratio", "is_cropped", "is_filled", "crop_box", "fill_color", *(["description"] if described else [])]
    parsed = F.try_parse_json(json)
    kind = lambda key: F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
    is_number = lambda k: k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    ratio = F.when(is_number(kind("target_ratio")), F.get_json_object(json, "$.target_ratio").try_cast("double"))
    flag = lambda key: F.when(kind(key) == "BOOLEAN", F.get_json_object(json, f"$.{key}") == "true")
    cropped, filled = flag("is_cropped"), flag("is_filled")
    of = lambda key, n: F.array(*(F.get_json_object(json, f"$.{key}[{k}]") for k in range(n)))
    exact = lambda key, n: F.get_json_object(json, f"$.{key}[{n - 1}]").isNotNull() & F.get_json_object(json, f"$.{key}[{n}]").isNull()
    numbers = kind("crop_box").rlike("^ARRAY<(BIGINT|DECIMAL.*|DOUBLE|FLOAT)>$") & exact("crop_box", 4)
    box = F.transform(of("crop_box", 4), lambda v: v.try_cast("double"))
    b = [F.get(box, F.lit(k)) for k in range(4)]
    box_ok = F.when(cropped, numbers & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= 1) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= 1)).otherwise(kind("crop_box") == "VOID")
    colour = F.transform(of("fill_color", 3), lambda v: v.try_cast("bigint"))
    colour_ok = F.when(filled, (kind("fill_color") == "ARRAY<BIGINT>") & exact("fill_color", 3) & F.forall(colour, lambda v: v.between(0, 255))).otherwise(kind("fill_color") == "VOID")
    ok = _object(json, fields, ordered=True) & (ratio > 0) & cropped.isNotNull() & filled.isNotNull() & box_ok & colour_ok
    if described:
        ok = ok & (kind("description") == "STRING") & (F.trim(F.get_json_object(json, "$.description")) != "")
    out = F.struct(ratio.alias("ratio"), cropped.alias("is_cropped"), filled.alias("is_filled"), F.when(cropped, box).alias("crop_box"), F.when(filled, colour).alias("fill_color"))
    return F.when(F.coalesce(ok, F.lit(False)), out)


def operation_of(cropped: Column, filled: Column) -> Column:
    return F.when(cropped & filled, "crop_fill").when(cropped, "crop").when(filled, "fill").otherwise("keep")
