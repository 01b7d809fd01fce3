"""Diffs by patience: whole texts come back from their rows, easy ones equal difflib's; versioned tables."""

import difflib
import random
from collections import defaultdict

import pytest

from snapfold.operators import diff, stored


def texts():
    rnd = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["!", "!", "", "x"]
    out = [(None, None), ("", "a"), ("a", ""), ("a\nb\n", "a\nb"), ("a", "b"), ("a\r\nb", "a\nb\nc")]
    for _ in range(40):
        a = [rnd.choice(lines) for _ in range(rnd.randint(0, 40))]
        b = [x for x in a if rnd.random() < 0.85]
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.choice([*lines, "new"]))
        out.append(("\n".join(a), "\n".join(b)))
    return [*out, ("a\nb", "a\nc"), ("a\nb", "a\nc")]


def cut(t):
    t = (t or "").replace("\r\n", "\n")
    t = t.removesuffix("\n")
    return t.split("\n") if t else []


def test_rows_give_both_texts(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate(texts())]
    df = spark.createDataFrame(pairs, "k int, old string, new string").repartition(3)
    got = defaultdict(list)
    for r in diff.diff_rows(df, "old", "new", context_lines=1000).orderBy("place").collect():
        got[r.k].append(r)
    for k, a, b in pairs:
        rows, x, y = got[k], cut(a), cut(b)
        assert (rows == []) == (x == y)
        if rows:
            assert [r.line for r in rows if r.sign != "+"] == x and [r.line for r in rows if r.sign != "-"] == y
            assert [r.old_no for r in rows if r.old_no] == list(range(1, len(x) + 1)) and [r.new_no for r in rows if r.new_no] == list(range(1, len(y) + 1))
            assert {r.hunk for r in rows} == {1} and [r.place for r in rows] == list(range(1, len(rows) + 1))


def test_unified_text_of_distinct_lines(spark):
    """Where every line occurs once and none has moved, the shortest diff is the only sensible one."""
    rnd, pairs = random.Random(8), []
    for k in range(25):
        a = [f"line {i}" for i in range(rnd.randint(0, 60))]
        b = [x for x in a if rnd.random() < 0.9]
        for j in range(rnd.randint(0, 3)):
            b.insert(rnd.randint(0, len(b)), f"new {j}")
        pairs.append((k, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(pairs, "k int, old string, new string")
    got = {r.k: r for r in diff.unified_diffs(df, "old", "new").collect()}
    for k, a, b in pairs:
        want = list(difflib.unified_diff(cut(a), cut(b), lineterm=""))
        added, removed = sum(x.startswith("+") for x in want[2:]), sum(x.startswith("-") for x in want[2:])
        assert (got[k].diff, got[k].full_line_count, got[k].added, got[k].removed) == ("\n".join(want), len(want), added, removed)
        assert got[k].summary == f"{added + removed} lines changed ({added - removed:+d})"
    short = {r.k: r for r in diff.unified_diffs(df, "old", "new", compact=5).collect()}
    assert all(len(r["diff"].split("\n")) <= 6 and r.full_line_count == got[k].full_line_count for k, r in short.items())


def test_refresh_is_switched_last(spark, tmp_path):
    home = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        stored.read_current(spark, home)
    stored.replace_table(spark.range(3), home)
    before = stored.read_current(spark, home)

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        stored.replace_table(spark.range(9), home, before_switch=killed)
    assert stored.read_current(spark, home).count() == 3
    bad = spark.range(5).selectExpr("id", "if(id = 4, raise_error('no'), 1) as x")
    with pytest.raises(Exception, match="no"):
        stored.replace_table(bad, home)
    assert stored.read_current(spark, home).columns == ["id"] and stored.read_current(spark, home).count() == 3
    stored.replace_table(spark.range(7), home)
    assert stored.read_current(spark, home).count() == 7 and before.count() == 3
    stored.replace_table(spark.range(8), home)
    assert len(list((tmp_path / "t").glob("v-*"))) == 2
