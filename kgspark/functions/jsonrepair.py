"""Reading a JSON object out of model output, repaired where need be."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.DOTALL)
_OBJECT = re.compile(r"\{.*", re.DOTALL)
_CLOSERS = {"{": "}", "[": "]"}


def _walk(s: str) -> str:
    """One pass: a quote inside a string that no delimiter follows is escaped; missing and crossed closers are put right; "}{" gets a comma."""
    out: list[str] = []
    open_: list[str] = []
    inside = False
    i = 0
    while i < len(s):
        c = s[i]
        if inside:
            if c == "\\" and i + 1 < len(s):
                out.append(s[i : i + 2])
                i += 2
                continue
            if c == '"':
                after = s[i + 1 :].lstrip()
                if not after or after[0] in ",}]:":
                    inside = False
                    out.append(c)
                else:
                    out.append('\\"')
            else:
                out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c))
        elif c == '"':
            inside = True
            out.append(c)
        elif c in _CLOSERS:
            if c == "{" and out and "".join(out[-40:]).rstrip().endswith("}"):
                out.append(", ")
            open_.append(c)
            out.append(c)
        elif c in "}]":
            while open_ and _CLOSERS[open_[-1]] != c:
                out.append(_CLOSERS[open_.pop()])
            if open_:
                open_.pop()
                out.append(c)
            if not open_:
                break
        else:
            out.append(c)
        i += 1
    if inside:
        out.append('"')
    text = re.sub(r"[,:]\s*$", "", "".join(out))
    return text + "".join(_CLOSERS[c] for c in reversed(open_))


def repair(content: str | None) -> str | None:
    """The first JSON object in ``content`` as compact JSON; null where there is none or no repair helps."""
    if not content:
        return None
    fenced = _FENCE.search(content)
    found = fenced[1] if fenced else (m[0] if (m := _OBJECT.search(content)) else None)
    if found is None:
        return None
    for candidate in (found, found[: found.rfind("}") + 1], _walk(found), re.sub(r",\s*([}\]])", r"\1", _walk(found))):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())  # a type object: workers import this module, and have no session to parse a name
def repair_json(content: pd.Series) -> pd.Series:
    return content.map(repair)


REPORT = "title string, summary string, findings array<struct<summary:string,explanation:string>>"


def report(content):
    """The community report in model output: a struct of title, summary and findings. A bare title is taken where nothing parses."""
    fixed = F.from_json(repair_json(content), REPORT)
    title = F.nullif(F.regexp_extract(content, '"title"\\s*:\\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(fixed, F.when(title.isNotNull(), F.struct(title.alias("title"), F.lit("").alias("summary"), F.from_json(F.lit("[]"), "array<struct<summary:string,explanation:string>>").alias("findings"))))
