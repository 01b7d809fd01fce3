"""State templates over line-oriented text: rules by state, values that fill down, are required or collect lists.

A template is data: one struct of values and rules, read from the usual text form by template_of(). `records` runs it as one
fold over a text's lines, on Arrow batches: built-in functions work the fold's lambdas out node by node, and copy the records
so far at each line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VALUE = "struct<name:string,filldown:boolean,required:boolean,list:boolean>"
RULE = "struct<state:string,pattern:string,slots:array<int>,groups:array<int>,record:string,next:string,goes_on:boolean,error:boolean>"
#: The type of a template column.
TEMPLATE = f"struct<values:array<{VALUE}>,rules:array<{RULE}>,record_at_end:boolean>"
# Words of the template format.
OPTIONS = ["Filldown", "Required", "List", "Key"]
LINE_ACTIONS = ["Next", "Continue", "Error"]
RECORD_ACTIONS = ["NoRecord", "Record", "Clear", "Clearall"]
START, LAST, AT_END = "Start", "End", "EOF"


def _action(text: str) -> tuple[str, str, str | None]:
    """Line action, record action and next state of what stands behind an arrow."""
    word, _, state = text.strip().partition(" ")
    line, record = "Next", "NoRecord"
    parts = word.split(".")
    if all(p in LINE_ACTIONS + RECORD_ACTIONS for p in parts) and len(parts) <= 2:
        for p in parts:
            line, record = (p, record) if p in LINE_ACTIONS else (line, p)
    else:
        state = text.strip()
    if line == "Continue" and state:
        raise ValueError(f"a rule that goes on can't change the state: {text!r}")
    return line, record, state.strip() or None


def template_of(text: str) -> dict:
    """A template in its text form as a value of TEMPLATE: `Value [options] NAME (pattern)` lines, then states and their rules.

    Fillup is not supported and is refused, as is what has no state Start.
    """
    values, patterns, rules, states, state = [], {}, [], set(), None
    for raw in text.splitlines():
        line = raw.rstrip()
        if re.match(r"\s*#", line) or not line:
            continue
        if state is None and line.startswith("Value "):
            m = re.fullmatch(r"Value (?:([A-Z]\w*(?:,\w+)*) )?(\w+) (\(.*\))", line)
            options = (m[1] or "").split(",") if m else []
            if not m or any(o and o not in OPTIONS for o in options):
                raise ValueError(f"no value line: {line!r}")
            values.append({"name": m[2].lower(), "filldown": "Filldown" in options, "required": "Required" in options, "list": "List" in options})
            patterns[m[2]] = m[3]
        elif re.fullmatch(r"\w+", line):
            state = line
            states.add(state)
        elif re.match(r"\s+\^", line) and state is not None:
            body, arrow, action = line.strip().partition(" -> ")
            line_action, record, after = _action(action) if arrow else ("Next", "NoRecord", None)
            names = list(patterns)
            body = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: f"(?P<{m[1] or m[2]}>{patterns[m[1] or m[2]][1:-1]})", body).replace("$$", "$")
            places = re.compile(body).groupindex
            rules.append({
                "state": state, "pattern": re.sub(r"\(\?P<\w+>", "(", body), "slots": [names.index(n) for n in places], "groups": list(places.values()),
                "record": record, "next": None if line_action == "Error" else after, "goes_on": line_action == "Continue", "error": line_action == "Error",
            })
        else:
            raise ValueError(f"neither value, state nor rule: {line!r}")
    missing = {r["next"] for r in rules} - states - {None, LAST, AT_END}
    if START not in states or missing:
        raise ValueError(f"states that are not there: {sorted(missing) or [START]}")
    return {"values": values, "rules": rules, "record_at_end": AT_END not in states}


# How to_json() writes quotes, backslashes and control characters.
_ESCAPES = {chr(i): f"\\u{i:04X}" for i in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
_escaped = re.compile(r'["\\\x00-\x09\x0b-\x1f]')  # no line end, as none is in a value
# The line end before the end of a text, or before one more line end there.
_last_end = re.compile("\n(?=[\n\x85\u2028\u2029]?\\Z)")

# What a pattern means by an end, a dot and a word's edge in the engine's dialect; escapes and classes are left as they are.
_dialect = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[.$]", re.DOTALL)
_MEANING = {"$": r"(?=[\x85\u2028\u2029]?\Z)", r"\Z": r"(?=[\x85\u2028\u2029]?\Z)", ".": r"[^\n\r\x85\u2028\u2029]", r"\b": r"(?u:\b)", r"\B": r"(?u:\B)"}


def _matcher(rule: str) -> Callable[[str], re.Match | None]:
    """Finds a rule's pattern as the engine reads it: classes such as \\d are ASCII, and a line may end in one of three more line ends."""
    own = re.search(r"\(\?[a-zA-Z]*[ms]", rule)  # the pattern says itself what ends and dots are
    pattern = re.compile(rule if own else _dialect.sub(lambda m: _MEANING.get(m[0], m[0]), rule), re.ASCII)
    bare, inner = _dialect.sub("", rule), None
    while bare != inner:
        inner, bare = bare, re.sub(r"\([^()]*\)", "", bare)
    # search() tries every place of a line, which a pattern that holds only at the start of one does not need.
    return pattern.match if bare.startswith("^") and "|" not in bare else pattern.search


def _quoted(x: str) -> str:
    return f'"{_escaped.sub(lambda m: _ESCAPES[m[0]], x)}"'


@lru_cache(maxsize=256)
def _prepared(template: str) -> tuple[list[tuple], list[int], list[int], dict[str, list[tuple]], bool]:
    """Values (key, list), required and filldown ones, rules by state and record_at_end of a template as JSON."""
    t = json.loads(template)
    values = [(f'"{v["name"]}":', v.get("list")) for v in t["values"]]
    required, kept = ([i for i, v in enumerate(t["values"]) if v.get(option)] for option in ("required", "filldown"))
    rules: dict[str, list[tuple]] = {}
    for r in t["rules"]:
        sets = [(i, g, values[i][1]) for i, g in zip(r["slots"], r["groups"], strict=True)]
        taken = r.get("record")
        does = (taken == "Record", taken in ("Record", "Clear", "Clearall"), taken == "Clearall")
        rules.setdefault(r["state"], []).append((_matcher(r["pattern"]), sets, *does, r.get("next"), r.get("goes_on"), r.get("error")))
    return values, required, kept, rules, t["record_at_end"]


def _read(text: str, template: str) -> list[str] | None:
    """The records of one text as JSON objects; None if an error rule fails it."""
    values, required, kept, rules, at_end = _prepared(template)
    nothing: list = [None] * len(values)
    cur, rows, state = nothing.copy(), [], START
    quoted = _quoted if _escaped.search(text) else '"{}"'.format

    def record() -> None:
        for i in required:
            if not cur[i] or not any(cur[i]):
                return
        if cur != nothing:
            fields = [key + (f"[{','.join(map(quoted, c or ()))}]" if listed else quoted(c or "")) for (key, listed), c in zip(values, cur, strict=True)]
            rows.append(f"{{{','.join(fields)}}}")

    own = rules.get(state, ())
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    for line in (body[:-2] + _last_end.sub("", body[-2:])).split("\n"):
        for match, sets, takes, clears, clears_all, after, goes_on, error in own:
            m = match(line)
            if m is None:
                continue
            if error:
                return None
            for i, g, listed in sets:
                if not listed:
                    cur[i] = m[g] or ""
                elif cur[i] is None:
                    cur[i] = [m[g] or ""]
                else:
                    cur[i].append(m[g] or "")
            if takes:
                record()
            if clears:
                last, cur = cur, nothing.copy()
                for i in () if clears_all else kept:
                    cur[i] = last[i]
            if goes_on:
                continue
            if after:
                state, own = after, rules.get(after, ())
            break
        if state in (LAST, AT_END):
            break
    if at_end and state != LAST:
        record()
    return rows


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _read_all(texts: pa.Array, templates: pa.Array) -> pa.Array:
    known = templates.flatten().dictionary_encode()  # the same few for all texts
    names, at, out = known.dictionary.to_pylist(), iter(known.indices.to_pylist()), []
    for text, n in zip(texts, pc.list_value_length(templates).to_pylist(), strict=True):
        own = [next(at) for _ in range(n or 0)]
        body = text.as_py()
        out.append(None if body is None else [None if i is None else _read(body, names[i]) for i in own])
    return pa.array(out, pa.list_(pa.list_(pa.string())))


def records_of_each(text: Column, templates: Column) -> Column:
    """array<array<string>>: what records() finds with each of an array of templates as JSON; null for one that fails the text.

    A batch of texts is read by one fold in Python, which reads patterns as the engine does.
    """
    return _read_all(F.make_valid_utf8(text), templates)


def records(text: Column, template: Column) -> Column:
    """struct<failed boolean, records array<string>>: the records of the text as JSON objects, keys in lower case.

    A line is given to the rules of the state in order. The first that matches sets its values; one that goes on leaves the
    line to the next rule. A record is taken if its required values are there and any value is; then all but filldown values
    are cleared. The values left at the end of the text make a last record unless the template has a state EOF or the state
    is End. An error rule fails the text: no records. Values without a match are '', lists without one [].
    """
    return F.when(text.isNotNull(), told(F.get(records_of_each(text, F.array(F.to_json(template))), F.lit(0))))


def told(found: Column) -> Column:
    """The struct of records() from what records_of_each() has for one template."""
    return F.struct(found.isNull().alias("failed"), F.coalesce(found, F.array().cast("array<string>")).alias("records"))
