"""Differences between snapshots and between configurations."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch

# Lines that change with every save.
METADATA = ["current configuration", "last configuration change at", "building configuration", "bytes"]


def diff_snapshots(df: DataFrame, keys: Sequence[str], s1: str | Column, s2: str | Column, device: str | None = None, include_changed: bool = False, values: Sequence[str] = ()) -> DataFrame:
    """keys and change (added, removed, changed) between two snapshots of a table, in one full-outer join."""
    base = df if device is None else df.filter(F.col("device_name") == device)
    digest = F.xxhash64(*values) if values else F.lit(0).cast("long")
    side = lambda s, name: base.filter(F.col("snapshot_id") == s).select(*keys, digest.alias(name)).distinct()
    both = side(s1, "_old").groupBy(*keys).agg(F.max("_old").alias("_old")).join(side(s2, "_new").groupBy(*keys).agg(F.max("_new").alias("_new")), list(keys), "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    kinds = ["added", "removed", *(["changed"] if include_changed else [])]
    return both.withColumn("change", change).filter(F.col("change").isin(kinds)).select(*keys, "change")


def diff_tables(tables: dict[str, tuple[DataFrame, Sequence[str]]], s1: str, s2: str, device: str | None = None, samples: int = 50) -> tuple[DataFrame, DataFrame]:
    """Totals (table_name, change, n) and samples (table_name, change, row_text) of the rows added and removed between two snapshots.

    tables: name -> (table, its key columns). The samples are the first `samples` of each table and change, by their text.
    """
    each = []
    for name, (df, keys) in tables.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
        each.append(diff_snapshots(df, keys, s1, s2, device).select(F.lit(name).alias("table_name"), "change", text.alias("row_text")))
    rows = reduce(DataFrame.unionByName, each)
    place = F.row_number().over(Window.partitionBy("table_name", "change").orderBy("row_text"))
    return rows.groupBy("table_name", "change").agg(F.count(F.lit(1)).alias("n")), rows.withColumn("_n", place).filter(F.col("_n") <= samples).drop("_n")


def config_line_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], text: str = "raw_output") -> DataFrame:
    """Per pair of texts the lines added and removed, as bags of lines: order does not count, metadata lines are left out."""
    skip = F.lit(False)
    for m in METADATA:
        skip = skip | F.lower("line").contains(m)
    lines = lambda df, n: df.select(*keys, F.explode(F.split(text, "\n")).alias("line")).filter(~skip).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias(n))
    both = lines(old, "a").join(lines(new, "b"), [*keys, "line"], "full_outer")
    more = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return both.groupBy(*keys).agg(F.sum(F.greatest(more, F.lit(0))).alias("added"), F.sum(F.greatest(-more, F.lit(0))).alias("removed"))


#: Rounds of alignment at most; what is then left of a gap is given as removed and added lines.
ROUNDS = 16


def _increasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the places (a ascending, b) of the lines that a gap's two sides share, a longest run in which b ascends too."""
    for batch in batches:
        pairs, left, right = [], [], []
        for pair, places in zip(batch.column("_p").to_pylist(), batch.column("places").to_pylist(), strict=True):
            tops, at, before = [], [], []
            for i, x in enumerate(places):
                k = bisect_left(tops, x["b"])
                tops[k:k + 1], at[k:k + 1] = [x["b"]], [i]
                before.append(at[k - 1] if k else None)
            i = at[-1] if at else None
            while i is not None:
                pairs.append(pair)
                left.append(places[i]["a"])
                right.append(places[i]["b"])
                i = before[i]
        yield pa.record_batch({"_p": pa.array(pairs, pa.int64()), "a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32())})


def _gaps(lines: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    """_p, gap (matched lines before), place, line, and m, whether the line is matched."""
    known = matched.select("_p", F.col(side).alias("place"), F.lit(True).alias("m"))
    each = lines.join(known, ["_p", "place"], "left").withColumn("m", F.coalesce("m", F.lit(False)))
    before = Window.partitionBy("_p").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one text
    return each.withColumn("gap", F.coalesce(F.sum(F.col("m").cast("int")).over(before), F.lit(0)))


def _aligned(a: DataFrame, b: DataFrame, stored: Scratch) -> DataFrame:
    """_p, a, b: the places of lines that are matched, by patience: lines that are the same from a gap's ends on, then those
    that occur once on either side of a gap, as far as their order agrees; matched lines part gaps, and so on."""
    spark = a.sparkSession
    found, rounds = [stored.put(spark.createDataFrame([], "_p long, a int, b int"), "matched")], 0
    while rounds < ROUNDS:
        rounds += 1
        matched = stored.union(*found)
        sides = []
        for lines, side in ((a, "a"), (b, "b")):
            rest = _gaps(lines, matched, side).filter("not m").drop("m")
            n = Window.partitionBy("_p", "gap")
            ends = rest.withColumns({"head": F.row_number().over(n.orderBy("place")), "tail": F.row_number().over(n.orderBy(F.desc("place")))})
            sides.append(stored.put(ends.withColumnRenamed("place", side), f"gaps-{side}"))
        x, y = sides
        # Equal from the start, or from the end, of a gap on: the first difference ends the run.
        same = []
        for end in ("head", "tail"):
            both = x.select("_p", "gap", end, "a", F.col("line").alias("_l"), F.col("head").alias("_h")).join(y.select("_p", "gap", end, "b", "line"), ["_p", "gap", end])
            stop = F.min(F.when(F.col("_l") != F.col("line"), F.col(end))).over(Window.partitionBy("_p", "gap"))
            same.append(both.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col(end) < F.col("stop"))).select("_p", "a", "b", "gap"))
        head, tail = same
        # A line that both runs take, of a gap that is shorter on one side, belongs to the first.
        tail = tail.join(head.select("_p", "a"), ["_p", "a"], "left_anti").join(head.select("_p", "b"), ["_p", "b"], "left_anti")
        ends = stored.put(head.select("_p", "a", "b").unionByName(tail.select("_p", "a", "b")), "matched")
        once = []
        for df, side in ((x, "a"), (y, "b")):
            rest = df.join(ends.select("_p", side), ["_p", side], "left_anti")
            once.append(rest.groupBy("_p", "gap", "line").agg(F.count(F.lit(1)).alias("n"), F.min(side).alias(side)).filter("n = 1").drop("n"))
        places = once[0].join(once[1], ["_p", "gap", "line"]).groupBy("_p", "gap").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("places"))
        anchors = stored.put(places.select("_p", "places").mapInArrow(_increasing, "_p long, a int, b int"), "matched")
        stored.drop(x, y)
        found += [ends, anchors]
        if ends.isEmpty() and anchors.isEmpty():
            break
    return stored.put(stored.union(*found), "alignment")


def diff_rows(pairs: DataFrame, old: str, new: str, context_lines: int = 3) -> DataFrame:
    """The unified diff of each pair of texts, line by line: the other columns of pairs, hunk, place, sign, old_no, new_no, line.

    hunk and place count from 1 in each pair; sign is ' ', '-' or '+'; old_no and new_no are the line's numbers, null on
    the side that has not got it. Texts are aligned by patience, in joins of their lines: the diff is always right, though
    not always the shortest. Null texts are empty; equal texts give no rows. A pair is a row: rows that repeat are diffed
    each for itself. A carriage return before a line's end belongs to the end.
    """
    stored = Scratch(pairs.sparkSession)
    kept = [c for c in pairs.columns if c not in (old, new)]
    numbered = pairs.withColumn("_p", F.monotonically_increasing_id())
    texts = stored.put(numbered.select("_p", *[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r?\n$", "").alias(n) for n, c in (("a", old), ("b", new))], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)]), "pairs")
    changed = texts.filter("a <> b")
    lines = lambda c: stored.put(changed.filter(F.col(c) != "").select("_p", F.posexplode(F.split(c, r"\r?\n")).alias("place", "line")), f"lines-{c}")
    a, b = lines("a"), lines("b")
    matched = _aligned(a, b, stored)
    left, right = _gaps(a, matched, "a"), _gaps(b, matched, "b")
    none = F.lit(None).cast("int")
    rows = left.filter("not m").select("_p", "gap", F.lit(0).alias("kind"), "place", F.lit("-").alias("sign"), (F.col("place") + 1).alias("old_no"), none.alias("new_no"), "line")
    rows = rows.unionByName(right.filter("not m").select("_p", "gap", F.lit(1).alias("kind"), "place", F.lit("+").alias("sign"), none.alias("old_no"), (F.col("place") + 1).alias("new_no"), "line"))
    same = left.filter("m").join(matched.withColumnRenamed("a", "place"), ["_p", "place"])
    rows = rows.unionByName(same.select("_p", "gap", F.lit(2).alias("kind"), "place", F.lit(" ").alias("sign"), (F.col("place") + 1).alias("old_no"), (F.col("b") + 1).alias("new_no"), "line"))
    order = Window.partitionBy("_p").orderBy("gap", "kind", "place")  # the lines of one pair
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("_edit", F.when(F.col("sign") != " ", F.col("at")))
    near = (F.col("at") - F.max("_edit").over(upto) <= context_lines) | (F.min("_edit").over(after) - F.col("at") <= context_lines)
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False)))
    begins = F.col("_near") & ~F.coalesce(F.lag("_near").over(order), F.lit(False))
    rows = rows.withColumn("hunk", F.sum(begins.cast("int")).over(upto)).filter("_near")
    out = rows.join(texts.select("_p", *[f"_k{i}" for i in range(len(kept))]), "_p")
    out = stored.put(out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "hunk", F.col("at").alias("place"), "sign", "old_no", "new_no", "line"), "diff-rows")
    stored.drop(*[t for t, _ in list(stored.paths.values()) if t is not out])
    return out


def unified_diffs(pairs: DataFrame, old: str, new: str, context_lines: int = 3, compact: int | None = None) -> DataFrame:
    """pairs with `diff`, full_line_count, its added and removed lines and a summary, put together from diff_rows().

    The whole diff is given; with `compact`, one of more lines keeps its head and a note of how many it has. Lines of
    metadata are shown but not counted as added or removed.
    """
    kept = [c for c in pairs.columns if c not in (old, new)]
    ids = pairs.withColumn("_id", F.monotonically_increasing_id())
    stored = Scratch(pairs.sparkSession)
    ids = stored.put(ids, "numbered-pairs")
    rows = diff_rows(ids.select("_id", old, new), old, new, context_lines)
    # Old and new lines before a hunk follow from the least number on each side, or from the other side's lines before it.
    hunks = rows.groupBy("_id", "hunk").agg(*[F.min(c).alias(f"{c}_first") for c in ("old_no", "new_no")], *[F.count(c).alias(f"{c}_n") for c in ("old_no", "new_no")], F.array_sort(F.collect_list(F.struct("place", F.concat("sign", "line").alias("t")))).alias("body"))
    order = Window.partitionBy("_id").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)

    def span(c: str) -> Column:
        first, n = F.col(f"{c}_first"), F.col(f"{c}_n")
        before = F.coalesce(first - 1, F.max(F.col(f"{c}_first") + n - 1).over(order), F.lit(0))
        return F.when(n == 1, (before + 1).cast("string")).otherwise(F.concat_ws(",", F.when(n == 0, before).otherwise(before + 1), n))

    text = F.concat_ws("\n", F.concat(F.lit("@@ -"), span("old_no"), F.lit(" +"), span("new_no"), F.lit(" @@")), F.array_join("body.t", "\n"))
    hunks = hunks.select("_id", "hunk", text.alias("text"), (F.size("body") + 1).alias("n"))
    diffs = hunks.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("hunk", "text"))).alias("h"), (F.sum("n") + 2).alias("full_line_count"))
    skip = reduce(lambda c, m: c | F.lower("line").contains(m), METADATA, F.lit(False))
    counts = rows.filter(~skip).groupBy("_id").agg(F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"))
    out = ids.drop(old, new).join(diffs, "_id", "left").join(counts, "_id", "left")
    whole = F.coalesce(F.concat(F.lit("--- \n+++ \n"), F.array_join("h.text", "\n")), F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    lines, added, removed = number("full_line_count"), number("added"), number("removed")
    if compact is not None:
        note = F.concat(F.lit("... ("), lines, F.lit(" lines in all)"))
        whole = F.when(lines <= compact, whole).otherwise(F.array_join(F.concat(F.slice(F.split(whole, "\n"), 1, compact), F.array(note)), "\n"))
    summary = F.concat((added + removed).cast("string"), F.lit(" lines changed ("), F.when(added >= removed, "+").otherwise(""), added - removed, F.lit(")"))
    return out.select(*kept, whole.alias("diff"), lines.alias("full_line_count"), added.alias("added"), removed.alias("removed"), summary.alias("summary"))


def extract_sections(text: Column, sections: Sequence[str]) -> Column:
    """Lines of the named top-level sections. An unindented line opens or ends one, a line '!' ends it."""
    names = [s.lower() for s in sections]
    start = F.struct(F.lit(False).alias("inside"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        top = (F.trim(line) != "") & ~line.rlike(r"^[ \t]")
        named = F.lit(False)
        for n in names:
            named = named | F.lower(line).startswith(n)
        inside = F.when(top, named).otherwise(a["inside"])
        return F.struct((inside & (F.trim(line) != "!")).alias("inside"), F.when(inside, F.concat(a["kept"], F.array(line))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: F.array_join(a["kept"], "\n"))
