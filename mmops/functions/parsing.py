"""Structured values out of model output: JSON, boxes, code blocks, tool calls.

Text that holds nothing to parse gives null or an empty array; nothing is ever evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import once
from .text import strip

GRID_BOX = "array<struct<label:string,grid:array<int>>>"
ACTIONS = {
    # Actions of the phone tool and the arguments that each needs.
    "key": ("text",), "click": ("coordinate",), "long_press": ("coordinate", "time"), "swipe": ("coordinate", "coordinate2"), "type": ("text",),
    "system_button": ("button",), "open": ("text",), "wait": ("time",), "terminate": ("status",),
}


def between(text: Column, first: str, last: str) -> Column:
    """From the first ``first`` to the last ``last``; null if they aren't there in that order."""
    a, b = F.call_function("instr", text, F.lit(first)), F.length(text) - F.call_function("instr", F.reverse(text), F.lit(last)) + 1
    ok = (a > 0) & F.contains(text, F.lit(last)) & (b > a)
    return F.when(ok, F.substring(text, a, b - a + 1))


def valid_json(text: Column) -> Column:
    """The text if it parses as JSON, else null."""
    return once(text, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def json_object_text(text: Column) -> Column:
    """G-01: the JSON of a best-effort reading: after the chain of thought, without fence lines, else from { to }."""
    body = strip(F.coalesce(text, F.lit("")))
    for mark in ("</think>", "</reasoning>"):
        body = strip(F.element_at(F.split(body, mark, -1), -1))
    lines = F.filter(F.split(body, r"\r?\n", -1), lambda x: ~F.startswith(strip(x), F.lit("```")))
    body = F.when(F.startswith(body, F.lit("```")), strip(F.array_join(lines, "\n"))).otherwise(body)
    return F.coalesce(valid_json(body), valid_json(between(body, "{", "}")))


def fenced_json(text: Column) -> Column:
    """G-02: struct<json, raw_text, parse_error> of the first fenced block, or of the whole text."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = strip(F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), inside).otherwise(text))
    json = valid_json(body)
    return F.struct(json.alias("json"), F.when(json.isNull(), body).alias("raw_text"), json.isNull().alias("parse_error"))


def boxes_3d(text: Column) -> Column:
    """G-03: array<struct<label, bbox_3d>> from a json fence or from the outer brackets; one object counts as a list."""
    inside = lambda t: strip(F.regexp_extract(t, r"(?s)```json(.*?)(?:```|$)", 1))
    body = once(text, lambda t: F.when(F.contains(t, F.lit("```json")), inside(t)).otherwise(between(t, "[", "]")))
    body = once(body, lambda b: F.when(F.startswith(b, F.lit("{")), F.concat(F.lit("["), b, F.lit("]"))).otherwise(b))
    return F.coalesce(F.from_json(valid_json(body), "array<struct<label:string,bbox_3d:array<double>>>"), F.array().cast("array<struct<label:string,bbox_3d:array<double>>>"))


def points_2d(text: Column) -> Column:
    """G-04: array<struct<point, label>>; a point without a label is point_k by its place among the points."""
    body = once(text, lambda t: F.when(F.contains(t, F.lit("```json")), F.regexp_extract(t, r"(?s)```json(.*?)(?:```|$)", 1)).otherwise(t))
    items = F.from_json(valid_json(strip(body)), "array<struct<point_2d:array<double>,label:string>>")
    points = F.filter(items, lambda p: F.size(p.point_2d) == 2)
    named = F.transform(points, lambda p, i: F.struct(p.point_2d.alias("point"), F.coalesce(p.label, F.concat(F.lit("point_"), (i + 1).cast("string"))).alias("label")))
    return F.coalesce(named, F.array().cast("array<struct<point:array<double>,label:string>>"))


def grid_boxes(text: Column) -> Column:
    """G-06: array<struct<label, grid>> from reference and box marks; none and groups of under four numbers are left out."""
    # The marks.
    marked = F.regexp_extract_all(text, F.lit(r"(?s)<\|object_ref_start\|>.*?<\|object_ref_end\|>\s*<\|box_start\|>.*?<\|box_end\|>"), F.lit(0))

    def of_mark(m):
        label = strip(F.regexp_extract(m, r"(?s)<\|object_ref_start\|>(.*?)<\|object_ref_end\|>", 1))
        inner = strip(F.regexp_extract(m, r"(?s)<\|box_start\|>(.*?)<\|box_end\|>", 1))
        groups = F.transform(F.split(inner, ","), lambda g: F.slice(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)).cast("array<int>"), F.lit(1), F.lit(4)))
        boxes = F.transform(F.filter(groups, lambda g: F.size(g) == 4), lambda g: F.struct(label.alias("label"), g.alias("grid")))
        return F.when((label != "") & (F.lower(inner) != "none"), boxes).otherwise(F.array().cast(GRID_BOX))

    return F.flatten(F.transform(marked, of_mark))


def last_code_block(text: Column, languages: str = "python") -> Column:
    """G-07: the last fenced block of one of the languages (a regex alternation); null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```(?:{languages})\n(.*?)```"), F.lit(1)), F.lit(-1))


def first_code(text: Column) -> Column:
    """G-09: the first fenced or code-tagged text; the whole text if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```[A-Za-z0-9]*\n(.*?)```", 1)
    tagged = F.regexp_extract(text, r"(?s)<code>(.*?)</code>", 1)
    return F.when(fenced != "", fenced).when(tagged != "", tagged).otherwise(text)


def tool_call(text: Column) -> Column:
    """G-08: struct<name, arguments> of the JSON between the tool-call marks; arguments as JSON text."""
    body = F.regexp_extract(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1)
    name, args = F.get_json_object(body, "$.name"), F.get_json_object(body, "$.arguments")
    return F.when(valid_json(body).isNotNull(), F.struct(name.alias("name"), args.alias("arguments")))


def to_list(text: Column) -> Column:
    """G-10 and P-04: a bracketed list as strings, anything else as a list of itself; single quotes are accepted."""
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.startswith(strip(text), F.lit("[")) & parsed.isNotNull(), parsed).otherwise(F.array(text))


def action_problem(arguments: Column) -> Column:
    """P-34: null for a valid action (JSON text with its arguments), else what is wrong with it."""
    action = F.get_json_object(arguments, "$.action")
    out = F.when(action.isNull(), F.lit("no action"))
    for name, needed in ACTIONS.items():
        for arg in needed:
            out = out.when((action == name) & F.get_json_object(arguments, f"$.{arg}").isNull(), F.lit(f"{name} needs {arg}"))
    return out.when(~action.isin(*ACTIONS), F.concat(F.lit("unknown action "), action))


def media_kind(uri: Column) -> Column:
    """O-IN-25: how an image reference is to be read."""
    u = F.lower(uri)
    return F.when(u.rlike("^https?://"), "http").when(F.startswith(u, F.lit("file://")), "file").when(F.startswith(u, F.lit("data:image")), "data").otherwise("path")


def data_url_bytes(uri: Column) -> Column:
    """O-IN-25: the bytes of a base64 data URL."""
    return F.try_to_binary(F.regexp_extract(uri, "(?s)base64,(.*)$", 1), F.lit("base64"))
