"""Route policies: extraction from configuration text, first-match evaluation, best paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import ipv4_number
from .stored import Scratch
from .text import let


def config_lines(raw: DataFrame, text: str = "raw_output", keys: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """keys, line_no, line of each line of the texts."""
    return raw.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _groups(raw: DataFrame, text: str, keys: tuple[str, ...], pattern: str, n: int) -> DataFrame:
    """keys, line_no, g of each line that the pattern matches whole: an array of its n groups, '' where one has no part.

    A line is read once for all groups: the array comes out of a generator, so what is made of it doesn't match again.
    """
    lines = config_lines(raw, text, keys).filter(F.col("line").rlike(pattern))
    cells = F.split(F.regexp_replace("line", pattern, "\x01".join(f"${i + 1}" for i in range(n))), "\x01")
    return lines.select(*keys, "line_no", F.explode(F.array(cells)).alias("g"))


def route_maps(raw: DataFrame, text: str = "raw_output", keys: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """keys, policy, action, seq, place, matches, sets: one row per stanza with its match and set lines in text order.

    A stanza runs from its head to the next line that is blank or not indented; place is the head's line number, so that
    stanzas of equal policy, action and number stay apart. One text is one row all along: nothing is shuffled.
    """
    head = r"^route-map (\S+) (permit|deny) (\d+)"

    def stanzas(lines: Column) -> Column:
        tops = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(r"^\s+\S"), i)), lambda i: i.isNotNull())
        return let(tops, lambda tops: F.array_compact(F.transform(tops, lambda top, j: stanza(lines, tops, top, j))))

    def stanza(lines: Column, tops: Column, top: Column, j: Column) -> Column:
        line = F.get(lines, top)
        end = F.coalesce(F.get(tops, j + 1), F.size(lines))
        return F.when(line.rlike(head), F.struct(top.alias("place"), line.alias("line"), F.slice(lines, top + 2, F.greatest(end - top - 1, F.lit(0))).alias("body")))

    # The lines and their tops are worked out once a text, not once a line.
    each = raw.select(*keys, F.explode(let(F.split(text, "\n"), stanzas)).alias("s"))
    part = lambda i: F.regexp_extract("s.line", head, i)
    of = lambda kind: F.transform(F.filter("s.body", lambda x: x.rlike(rf"^\s+{kind}\b")), lambda x: F.trim(x))
    return each.select(*keys, part(1).alias("policy"), part(2).alias("action"), part(3).try_cast("int").alias("seq"), F.col("s.place").alias("place"), of("match").alias("matches"), of("set").alias("sets"))


def bindings(raw: DataFrame, text: str = "raw_output", keys: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """keys, neighbor, direction, policy; the last line for a neighbour and direction counts."""
    pattern = r"^\s*neighbor (\S+) route-map (\S+) (in|out)"
    lines = config_lines(raw, text, keys).filter(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.groupBy(*keys, part(1).alias("neighbor"), part(3).alias("direction")).agg(F.max_by(part(2), "line_no").alias("policy"))


def policies_of_neighbors(asked: DataFrame, raw: DataFrame, text: str = "raw_output", keys: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """asked (keys, neighbor, direction) with policy, action, seq, place, matches, sets: a row for each clause of the bound policy.

    A neighbour without a policy in that direction has one row of nulls (nothing is filtered); so has a policy that no stanza defines.
    """
    bound = asked.join(bindings(raw, text, keys), [*keys, "neighbor", "direction"], "left")
    return bound.join(route_maps(raw, text, keys), [*keys, "policy"], "left")


def prefix_lists(raw: DataFrame, text: str = "raw_output", keys: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """keys, list, seq, place, action, network (a number), length, low, high: the entries of IPv4 prefix lists.

    An entry takes prefixes under its network whose length lies between low and high: its own length alone, from ge on, or
    up to le. Entries without a number come by their place in the text, behind none.
    """
    pattern = r"^\s*ip prefix-list (\S+)(?: seq (\d+))? (permit|deny) (\d+\.\d+\.\d+\.\d+)/(\d+)(?: ge (\d+))?(?: le (\d+))?\s*$"
    lines = _groups(raw, text, keys, pattern, 7)
    part = lambda i: F.get("g", F.lit(i - 1))
    number = lambda i: part(i).try_cast("int")
    length, ge, le = number(5), number(6), number(7)
    address = F.explode(F.array(ipv4_number(part(4)))).alias("address")  # worked out once
    rows = lines.select(*keys, part(1).alias("list"), F.coalesce(number(2), F.col("line_no")).alias("seq"), F.col("line_no").alias("place"), part(3).alias("action"), address, length.alias("length"), F.coalesce(ge, length).alias("low"), F.coalesce(le, F.when(ge.isNotNull(), 32), length).alias("high"))
    sound = rows.filter("address is not null and length between 0 and 32")
    return sound.select(*keys, "list", "seq", "place", "action", _masked(F.col("address"), F.col("length")).alias("network"), "length", "low", "high")


def as_path_lists(raw: DataFrame, text: str = "raw_output", keys: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """keys, list, place, action, pattern: the entries of AS path lists; `_` in one stands for any end or separator."""
    pattern = r"^\s*ip as-path access-list (\S+) (permit|deny) (.+?)\s*$"
    lines = _groups(raw, text, keys, pattern, 3)
    part = lambda i: F.get("g", F.lit(i - 1))
    return lines.select(*keys, part(1).alias("list"), F.col("line_no").alias("place"), part(2).alias("action"), F.regexp_replace(part(3), "_", "(?:^|[ ,{}()]|\\$)").alias("pattern"))


def _masked(address: Column, length: Column) -> Column:
    """The address with all bits behind the length off."""
    return F.when(length > 0, F.call_function("shiftleft", F.call_function("shiftright", address.cast("long"), 32 - length), 32 - length)).otherwise(F.lit(0).cast("long"))


def resolve_matches(requests: DataFrame, clauses: DataFrame, prefixes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """request, condition, holds: the truth that policy_walk() asks for, computed for match lines over prefix and AS path lists.

    requests: request, device, policy, prefix and, for AS path lists, as_path ('65001 65002'); clauses as for policy_walk();
    prefixes and paths: the lists of `device`. A line names one list or more and holds if one of them permits; in a list the
    first entry that takes the route decides, and where none does, or the list is not there, it does not permit. Prefixes
    meet entries by equality of their leading bits, for the lengths that their list has (33 at most), so no request is
    compared with a whole list. What is asked, the prefix lists and the truth are written once, as all are read again.
    """
    stored = Scratch(requests.sparkSession)
    said = clauses.select("device", "policy", F.explode(F.array_distinct("matches")).alias("condition"))
    route = ["request", "device", "prefix", *(["as_path"] if paths is not None else [])]
    kinds = {"prefix": r"^match ip address prefix-list (.+)$", "path": r"^match as-path (.+)$"}
    kinds = kinds if paths is not None else {"prefix": kinds["prefix"]}
    names = F.coalesce(*[F.when(F.col("condition").rlike(line), F.struct(F.lit(kind).alias("kind"), F.split(F.trim(F.regexp_extract("condition", line, 1)), r"\s+").alias("lists"))) for kind, line in kinds.items()])
    told = said.withColumn("names", names).filter("names is not null").select("device", "policy", "condition", "names.kind", F.explode("names.lists").alias("list"))
    asked = stored.put(requests.select(*route, "policy").join(told, ["device", "policy"]).drop("policy"), "asked")
    decided = lambda df, first: df.groupBy("request", "condition", "list").agg(F.min(F.struct(*first, "action"))["action"].alias("action"))

    entries = stored.put(prefixes, "prefix-lists")
    lengths = entries.groupBy("device", "list").agg(F.collect_set("length").alias("lengths"))  # 33 at most
    mine = asked.filter("kind = 'prefix'").withColumns({"address": ipv4_number(F.split_part("prefix", F.lit("/"), F.lit(1))).cast("long"), "bits": F.split_part("prefix", F.lit("/"), F.lit(2)).try_cast("int")})
    mine = mine.filter("address is not null and bits between 0 and 32").join(lengths, ["device", "list"])
    mine = mine.withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.col("bits"))))
    met = mine.withColumn("network", _masked(F.col("address"), F.col("length"))).join(entries, ["device", "list", "length", "network"]).filter("bits between low and high")
    permits = [decided(met, ["seq", "place"])]
    if paths is not None:
        met = asked.filter("kind = 'path'").join(paths, ["device", "list"]).filter(F.rlike(F.coalesce("as_path", F.lit("")), F.col("pattern")))
        permits.append(decided(met, ["place"]))
    held = [p.select("request", "condition", (F.col("action") == "permit").alias("holds")) for p in permits]
    every = reduce(DataFrame.unionByName, held, asked.select("request", "condition", F.lit(False).alias("holds")))
    truth = stored.put(every.groupBy("request", "condition").agg(F.max("holds").alias("holds")), "truth")
    stored.drop(asked, entries)
    return truth


def policy_walk(clauses: DataFrame, requests: DataFrame, truth: DataFrame) -> DataFrame:
    """request and outcome of the first clause whose match lines all hold: permit, deny, implicit_deny, or missing policy.

    clauses: device, policy, seq, action, matches; requests: request, device, policy; truth: request, condition, holds.
    A condition without a row is false; a request without any row of truth takes all as true; no match lines always match.
    """
    told = truth.groupBy("request").agg(F.count(F.lit(1)).alias("told"))
    place = F.col("place") if "place" in clauses.columns else F.lit(0)
    lines = requests.join(clauses.withColumn("place", place), ["device", "policy"]).select("request", "seq", "place", "action", F.explode_outer("matches").alias("condition"))
    judged = lines.join(truth, ["request", "condition"], "left").join(told, "request", "left")
    holds = F.col("condition").isNull() | F.col("told").isNull() | F.coalesce("holds", F.lit(False))
    first = judged.groupBy("request", "seq", "place", "action").agg(F.bool_and(holds).alias("all")).groupBy("request").agg(F.min(F.when(F.col("all"), F.struct("seq", "place", "action"))).alias("won"))
    out = requests.select("request", "policy").join(first.withColumn("known", F.lit(True)), "request", "left")
    outcome = F.when(F.col("policy").isNull(), "unbound").when(F.col("known").isNull(), "missing").otherwise(F.coalesce("won.action", F.lit("implicit_deny")))
    return out.select("request", F.col("won.seq").alias("seq"), outcome.alias("outcome"))


def policy_trace(clauses: DataFrame, requests: DataFrame, truth: DataFrame) -> DataFrame:
    """request, seq, place, action, reason, won, sets: the clauses that policy_walk() looks at, up to the one that decides.

    reason: no match lines, all match lines hold, or the first line by name that does not. sets are those of a permitting winner.
    """
    place = F.col("place") if "place" in clauses.columns else F.lit(0)
    told = truth.groupBy("request").agg(F.count(F.lit(1)).alias("told"))
    kept = F.col("sets") if "sets" in clauses.columns else F.array().cast("array<string>")
    lines = requests.join(clauses.withColumns({"place": place, "sets": kept}), ["device", "policy"]).select("request", "seq", "place", "action", F.array_join("sets", "\n").alias("sets"), F.explode_outer("matches").alias("condition"))
    judged = lines.join(truth, ["request", "condition"], "left").join(told, "request", "left")
    fails = F.col("condition").isNotNull() & F.col("told").isNotNull() & ~F.coalesce("holds", F.lit(False))
    each = judged.groupBy("request", "seq", "place", "action", "sets").agg(F.min(F.when(fails, F.col("condition"))).alias("failed"), F.max("condition").alias("any"))
    won = F.min(F.when(F.col("failed").isNull(), F.struct("seq", "place"))).over(Window.partitionBy("request"))
    looked = each.withColumn("_won", won).filter(F.col("_won").isNull() | (F.struct("seq", "place") <= F.col("_won")))
    reason = F.when(F.col("any").isNull(), "no match lines").when(F.col("failed").isNull(), "all match lines hold").otherwise(F.concat(F.lit("fails: "), "failed"))
    sets = F.when(F.col("failed").isNull() & (F.col("action") == "permit") & (F.col("sets") != ""), F.split("sets", "\n")).otherwise(F.array().cast("array<string>"))
    return looked.select("request", "seq", "place", "action", reason.alias("reason"), F.col("failed").isNull().alias("won"), sets.alias("sets"))


def best_path(paths: DataFrame, by: tuple[str, ...] = ("device", "prefix")) -> DataFrame:
    """The winning path per device and prefix: weight, local preference, local origin, AS path length, origin, MED within one AS, then type, metric, router id.

    Paths that are equal in all of these go by neighbour AS and then their other columns, so that one input has one answer.
    """
    least_med = F.min("med").over(Window.partitionBy(*by, "neighbor_as"))
    order = [F.desc("weight"), F.desc("local_pref"), F.desc("is_local"), F.asc("as_path_len"), F.asc("origin"), F.asc("is_internal"), F.asc("igp_metric"), F.asc("router_id")]
    named = {*by, "weight", "local_pref", "is_local", "as_path_len", "origin", "is_internal", "igp_metric", "router_id", "neighbor_as"}
    order += [F.asc("neighbor_as"), *[F.asc(c) for c in paths.columns if c not in named]]
    ranked = paths.filter("valid").withColumn("_med", least_med).filter("med = _med").drop("_med")
    return ranked.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_p = 1").drop("_p")
