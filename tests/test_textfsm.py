"""State templates: filldown, required, lists, actions, states; rows worked out by hand."""

import json
import time

import pytest
from compare import same
from pyspark.sql import functions as F

from snapfold.operators import text, textfsm
from snapfold.plans import text_queries
from snapfold.plans.queries import ORACLES

PORTS = r"""
Value Filldown ROUTER (\S+)
Value PORT (\S+)
Value Required STATUS (up|down)
Value List MEMBERS (\d+)
# a comment
Start
  ^Router ${ROUTER}$$ -> Ports
  ^% -> Error

Ports
  ^Port -> Continue.Record
  ^Port $PORT
  ^  status ${STATUS}
  ^  member ${MEMBERS}
  ^Summary -> Record Summary
  ^reset -> Clearall

Summary
  ^ checked ${STATUS} -> Record
  ^ stop -> End
"""


def run(spark, template, body):
    df = spark.createDataFrame([(body, textfsm.template_of(template))], f"t string, fsm {textfsm.TEMPLATE}")
    r = df.select(textfsm.records(F.col("t"), F.col("fsm")).alias("r")).first().r
    return r.failed, [json.loads(x) for x in r.records]


@pytest.mark.parametrize(
    ("body", "failed", "rows"),
    [
        ("Router r1\nPort a\n  status up\n  member 1\n  member 2\nPort b\n  member 3\nPort c\n  status down\nSummary\n checked up\nRouter r2\n stop\n checked down", False,
         [("r1", "a", "up", ["1", "2"]), ("r1", "c", "down", []), ("r1", "", "up", [])]),
        ("noise\nRouter r1\nPort a\n  status up", False, [("r1", "a", "up", [])]),
        ("Router r1\nPort a\n  status up\nreset\nPort b\n  status down", False, [("", "b", "down", [])]),
        ("Router r1\r\nPort \"q\\\r\n  status up\r\n", False, [("r1", '"q\\', "up", [])]),
        ("% refused\nRouter r1\nPort a\n  status up", True, []),
        ("", False, []), ("Router r1", False, []),
    ],
)
def test_states(spark, body, failed, rows):
    assert run(spark, PORTS, body) == (failed, [dict(zip(("router", "port", "status", "members"), r, strict=True)) for r in rows])


def test_end_of_file_and_clear(spark):
    plain = "Value A (\\w+)\nValue B (\\d+)\n\nStart\n  ^a ${A}\n  ^b ${B} -> Record\n  ^c -> Clear\n"
    assert run(spark, plain, "a x\nb 1\na y\nc\nb 2\na z") == (False, [{"a": "x", "b": "1"}, {"a": "", "b": "2"}, {"a": "z", "b": ""}])
    assert run(spark, plain + "\nEOF\n", "a x\nb 1\na z") == (False, [{"a": "x", "b": "1"}])


@pytest.mark.parametrize("bad", ["Value Fillup A (x)\n\nStart\n  ^${A}\n", "Value A (x)\n\nBegin\n  ^${A}\n", "Value A (x)\n\nStart\n  ^${A} -> Nowhere\n", "Value A (x)\n\nStart\n  ^${A} -> Continue Start\n", "what\nis this\n"])
def test_refused_templates(bad):
    with pytest.raises(ValueError, match=r"\w"):
        textfsm.template_of(bad)


def test_parse_outputs_with_states(spark):
    raw = spark.createDataFrame([("d1", "p", "Router r1\nPort a\n  status up"), ("d2", "p", "% no"), ("d3", "p", "port z"), ("d4", "q", "x"), ("d5", "p", None)], "device_name string, platform string, raw_output string").withColumns({"command": F.lit("show ports"), "snapshot_id": F.lit("s")})
    templates = spark.createDataFrame([("p", "show ports", 0, None, None, textfsm.template_of(PORTS)), ("p", "show ports", 1, "^port (\\S+)$", ["port"], None)], f"platform string, command string, tier int, pattern string, fields array<string>, fsm {textfsm.TEMPLATE}")
    got = {r.device_name: (r.reason, r.records) for r in text.parse_outputs(raw, templates).collect()}
    assert got == {"d1": ("ok", '[{"router":"r1","port":"a","status":"up","members":[]}]'), "d2": ("parser_error", None), "d3": ("ok", '[{"port":"z"}]'), "d4": ("no_template", None), "d5": ("no_rows", None)}


def test_long_text_does_not_copy_the_records_so_far(spark):
    n = 4000
    body = F.concat(F.lit("Router r1\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Port "), i.cast("string"), F.lit("\n  status up\n  member 1"))), "\n"))
    df = spark.createDataFrame([(textfsm.template_of(PORTS),)], f"fsm {textfsm.TEMPLATE}").select(textfsm.records(body, F.col("fsm")).alias("r"))
    start = time.time()
    got = df.first().r.records
    assert time.time() - start < 30
    assert [json.loads(x) for x in got] == [{"router": "r1", "port": str(i), "status": "up", "members": ["1"]} for i in range(1, n + 1)]


@pytest.mark.parametrize(("line", "a"), [("x5.", "5"), ("x\u0663.", None), ("x5\u2028", "5"), ("x5\u00e9", None), ("x5\x1f\"\\", "5")])
def test_patterns_keep_the_dialect_of_the_engine(spark, line, a):
    plain = "Value A (\\d)\nValue B (.*)\n\nStart\n  ^x${A}\\b${B}$$\n"
    rest = line[2:].rstrip("\u2028")
    assert run(spark, plain, line) == (False, [] if a is None else [{"a": a, "b": rest}])
    assert spark.range(1).select(F.regexp_extract(F.lit(line), r"^x(\d)\b(.*)$", 2)).first()[0] == ("" if a is None else rest)


@pytest.mark.parametrize(("rule", "line", "a"), [("^a|x${A}", "bbx7", "7"), ("^(a|b)${A}", "b7", "7"), ("^(a|b)${A}", "xb7", None), ("^\\(|${A}", "b7", "7"), ("^[|(]${A}", "|7", "7"), ("^[|(]${A}", "b|7", None)])
def test_rules_with_an_alternative_inside_a_line(spark, rule, line, a):
    assert run(spark, f"Value Required A (\\d)\n\nStart\n  {rule} -> Record\n", line) == (False, [] if a is None else [{"a": a}])


def test_query_against_duckdb(spark):
    same(spark, text_queries.state_templates, ORACLES["state_templates"])
