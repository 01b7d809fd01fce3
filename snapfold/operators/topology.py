"""Devices, links, facts and graph questions over a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.network import canonical_interface, canonical_platform, first_present, link_id, platform_of_product, role_of_host, usable_interface, vendor_of
from .stored import Scratch
from .tables import few, number_rows

def resolve_hostnames(names: DataFrame, devices: DataFrame) -> DataFrame:
    """raw, hostname for each distinct name: exact, then any case, first label, a device name and a separator, one edit, unchanged.

    Tiers one to three are equality joins. The rest meet on equality too: a name's prefixes that end before a separator, and
    for one edit the spellings with one character left out. Ties go to the smallest hostname.
    """
    raw = names.select("raw").filter("raw is not null").distinct().withColumn("low", F.lower("raw"))
    known = devices.select("hostname").distinct().withColumn("key", F.lower("hostname"))
    label = F.split_part("low", F.lit("."), F.lit(1))
    n = F.length("low")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & ~F.substring("low", i + 1, F.lit(1)).rlike("[a-z0-9]"))
    prefixes = F.transform(ends, lambda i: F.left("low", i))
    gaps = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.left(c, i - 1), F.substring(c, i + 1, F.length(c))))
    keys = raw.select("raw", "low", F.explode(F.array_distinct(F.concat(
        F.array(F.struct(F.lit(2).alias("tier"), F.col("low").alias("key")), F.struct(F.lit(3).alias("tier"), label.alias("key"))),
        F.transform(prefixes, lambda p: F.struct(F.lit(4).alias("tier"), p.alias("key"))),
    ))).alias("k")).select("raw", "k.tier", "k.key")
    direct = keys.join(known, "key").select("raw", F.when(F.col("raw") == F.col("hostname"), 1).otherwise(F.col("tier")).alias("tier"), "hostname")
    spell = lambda df, c: df.withColumn("form", F.explode(F.array_distinct(F.concat(F.array(c), gaps(F.col(c))))))
    edits = spell(raw.filter(n >= 3), "low").join(spell(known, "key"), "form").filter(F.levenshtein("low", "key") <= 1).select("raw", F.lit(5).alias("tier"), "hostname")
    best = direct.unionByName(edits).groupBy("raw").agg(F.min(F.struct("tier", "hostname")).alias("b"))
    return raw.join(best, "raw", "left").select("raw", F.coalesce("b.hostname", "raw").alias("hostname"), F.coalesce("b.tier", F.lit(6)).alias("tier"))


def build_devices(facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per device: inventory first, then what the outputs said. facts: device_name, snapshot_id, platform, model, os_version, pid, ip_address."""
    order = F.struct("snapshot_id")
    seen = facts.groupBy("device_name").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("snapshot_id"))).alias(f"f_{c}") for c in ("platform", "model", "os_version", "pid", "ip_address")], F.max(order).alias("_"))
    both = inventory.join(seen.withColumnRenamed("device_name", "hostname"), "hostname", "full_outer")
    platform = F.coalesce(canonical_platform(first_present(F.col("platform"), F.col("f_platform"))), platform_of_product(F.col("f_pid")))
    own_role, derived = first_present(F.col("role")), role_of_host(F.col("hostname"))
    return both.select(
        "hostname", first_present(F.col("ip_address"), F.col("f_ip_address")).alias("ip_address"), platform.alias("platform"), "site", F.coalesce(own_role, derived).alias("role"),
        F.when(own_role.isNotNull(), "inventory").when(derived.isNotNull(), "hostname").alias("role_source"), vendor_of(platform).alias("vendor"),
        first_present(F.col("f_model"), F.col("f_pid")).alias("model"), F.col("f_os_version").alias("os_version"),
        F.to_json(F.struct(F.col("f_platform").alias("seen_platform"), F.col("f_pid").alias("pid"), F.col("f_ip_address").alias("seen_ip"))).alias("metadata"),
    )


def extract_links(neighbors: DataFrame, devices: DataFrame) -> DataFrame:
    """Links from neighbour rows (device, local_if, peer, peer_if, protocol, snapshot_id): resolved, canonical, checked, one per pair of ends."""
    names = resolve_hostnames(neighbors.select(F.col("peer").alias("raw")), devices).select(F.col("raw").alias("peer"), "hostname")
    rows = neighbors.filter(usable_interface(F.col("local_if")) & usable_interface(F.col("peer_if"))).join(names, "peer").filter("device <> hostname")
    rows = rows.withColumns({"local_if": canonical_interface(F.col("local_if")), "peer_if": canonical_interface(F.col("peer_if"))})
    rows = rows.withColumn("link_id", link_id(F.col("device"), F.col("local_if"), F.col("hostname"), F.col("peer_if")))
    last = F.max(F.struct("snapshot_id", "device", "local_if", "hostname", "peer_if", "protocol")).alias("l")
    names = {"device": "source_device", "local_if": "source_interface", "hostname": "destination_device", "peer_if": "destination_interface", "protocol": "discovery_protocol"}
    return rows.groupBy("link_id").agg(last, F.min("snapshot_id").alias("first_snapshot")).select("link_id", *[F.col(f"l.{a}").alias(b) for a, b in names.items()], "first_snapshot", F.col("l.snapshot_id").alias("snapshot_id"))


def linked(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, src, dst of each pair of nodes once, the lesser one first; no loops."""
    return edges.filter("src <> dst").select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, src, dst of linked() pairs in both directions."""
    return pairs.select(*keys, F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def mirrored(edges: DataFrame) -> DataFrame:
    """src, dst in both directions, each pair once."""
    return both_ways(linked(edges))


def adjacency_edges(source: DataFrame, devices: DataFrame, *, roles: Sequence[str] = (), sites: Sequence[str] = (), name_like: str | None = None, snapshot_id: str | None = None) -> DataFrame:
    """Edges with either end in scope. source: src, dst and more."""
    out = source if snapshot_id is None else source.filter(F.col("snapshot_id") == snapshot_id)
    scope = devices
    if roles:
        scope = scope.filter(F.col("role").isin(list(roles)))
    if sites:
        scope = scope.filter(F.col("site").isin(list(sites)))
    if name_like:
        scope = scope.filter(F.col("hostname").like(name_like))
    hosts = scope.select("hostname").distinct().withColumn("_in", F.lit(True))
    a, b = hosts.withColumnsRenamed({"hostname": "src", "_in": "_a"}), hosts.withColumnsRenamed({"hostname": "dst", "_in": "_b"})
    return out.join(a, "src", "left").join(b, "dst", "left").filter("_a or _b").drop("_a", "_b")


def nhop_subgraph(edges: DataFrame, center: str, hops: int) -> DataFrame:
    """Edges with both ends within `hops` of the centre; none for 0 hops or an unknown centre.

    Each hop is a job of its own that joins the last one's nodes and leaves out those of all before, which it reads as one
    written table; it ends early where a hop finds nothing new. So no plan, the result's included, grows with the hops.
    """
    stored = Scratch(edges.sparkSession)
    both = stored.put(mirrored(edges), "mirrored")
    front = stored.put(both.filter(F.col("src") == center).select(F.col("src").alias("node")).distinct(), "reached")
    found = [front]
    for _ in range(hops):
        step = both.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = stored.put(step.join(stored.union(*found), "node", "left_anti"), "reached")
        if front.isEmpty():
            break
        found.append(front)
    stored.drop(both)
    ends = lambda c: stored.union(*found).withColumnRenamed("node", c)
    return edges.filter(F.lit(hops > 0)).join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select(*edges.columns)


def connected(spark: SparkSession, nodes: DataFrame, edges: DataFrame, keys: Sequence[str], first: DataFrame | None = None) -> DataFrame:
    """keys, node, root: the least node of each node's component, separately for each value of the keys.

    A round hooks each node to its least neighbour, follows the hooks to their ends, and goes on with the links between the
    ends alone. So links are read whole once and then shrink, long chains fold in one round, and hooks are followed in tables
    of nodes. Rounds are written to the shared folder, each deletes the one before; links to unknown nodes do not count.
    first: links of edges whose components are found before, so that the rounds over all edges begin with links between those.
    """
    stored, keys = Scratch(spark), list(keys)
    labels = stored.put(nodes.select(*keys, "node", F.col("node").alias("root")).distinct(), "labels")
    renamed = lambda df, **names: df.select(*keys, *[F.col(a).alias(b) for a, b in names.items()])

    def between(links: DataFrame, roots: DataFrame) -> DataFrame:
        at = links.join(renamed(roots, node="src", root="from"), [*keys, "src"]).join(renamed(roots, node="dst", root="to"), [*keys, "dst"])
        return linked(at.select(*keys, F.col("from").alias("src"), F.col("to").alias("dst")), keys)

    for links in (edges,) if first is None else (first, edges):
        pairs = stored.put(between(links, labels), "pairs")
        while not pairs.isEmpty():
            near = both_ways(pairs, keys).groupBy(*keys, F.col("src").alias("node")).agg(F.min("dst").alias("near"))
            hooks, moving = stored.put(near.select(*keys, "node", F.least("node", "near").alias("root")), "hooks"), True
            while moving:
                ahead = hooks.join(renamed(hooks, node="root", root="further"), [*keys, "root"])
                further = stored.put(ahead.select(*keys, "node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "hooks")
                stored.drop(hooks)
                hooks, moving = further, not further.filter("moved").isEmpty()
            now = labels.join(renamed(hooks, node="root", root="end"), [*keys, "root"], "left").select(*keys, "node", F.coalesce("end", "root").alias("root"))
            now, left = stored.put(now, "labels"), stored.put(between(pairs, hooks), "pairs")
            stored.drop(labels, pairs, hooks)
            labels, pairs = now, left
        stored.drop(pairs)
    return labels


#: Links a node from which on components are found by a part of the links first.
MANY_LINKS = 16


def first_links(pairs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """A part of the links to find components by before all of them are looked at; None where there are few for each node.

    A link is taken by a hash of its ends, with a share of sqrt(nodes / links). Whatever the graph, and whatever a scenario
    removes of it, no more than nodes / share links are expected between what the part leaves asunder (Karger, Klein, Tarjan):
    both are the root of nodes * links. The part says where to begin only; all links are looked at after it.
    """
    n, m = nodes.count(), pairs.count()
    if m <= MANY_LINKS * n:
        return None
    return pairs.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 30)) < int((n / m) ** 0.5 * (1 << 30)))


def blast_radius(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """For each scenario that removes devices and links: components, largest one and isolated devices of what is left, and before.

    scenarios: scenario, device; links: scenario, src, dst. The graph is labelled once. A scenario takes up again only the
    components that it touches; all others count as they are. Of a touched component with many links a part is taken up
    again (first_links); of the others, those at nodes outside of the largest piece which that part leaves, as no others can
    join pieces. So work is what scenarios touch and part, not scenarios x graph, and no task holds a component's links.
    """
    spark = nodes.sparkSession
    stored = Scratch(spark)
    keyed = lambda df: df.withColumn("k", F.lit(0))
    known = stored.put(nodes.select("node").distinct(), "known")
    pairs = stored.put(linked(edges), "pairs")
    part = first_links(pairs, known)
    first = pairs if part is None else stored.put(part, "first")
    labels = connected(spark, keyed(known), keyed(pairs), ["k"], None if part is None else keyed(first)).select("node", F.col("root").alias("comp"))
    sizes = stored.put(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    gone = stored.put(scenarios.select("scenario", F.col("device").alias("node")).distinct(), "gone")
    hit, uncut = gone, lambda df: df
    if links is not None:
        cut = stored.put(links.select("scenario", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "cut")
        hit, uncut = gone.union(cut.select("scenario", "src")), lambda df: df.join(cut, ["scenario", "src", "dst"], "left_anti")
    touched = stored.put(hit.join(labels, "node").select("scenario", "comp").distinct(), "touched")
    left_nodes = stored.put(few(touched).join(labels, "comp").select("scenario", "node").join(gone, ["scenario", "node"], "left_anti"), "left")
    left = uncut(first.join(left_nodes.withColumnRenamed("node", "src"), "src").select("scenario", "src", "dst"))
    pieces = connected(spark, left_nodes, left, ["scenario"])
    parts = pieces.groupBy("scenario", "root").agg(F.count(F.lit(1)).alias("size"))
    if part is not None:
        parts = stored.put(parts.join(labels.withColumnRenamed("node", "root"), "root"), "pieces")
        main = stored.put(parts.groupBy("scenario", "comp").agg(F.max(F.struct("size", "root")).getField("root").alias("root")), "main")
        minor = stored.put(pieces.join(main, ["scenario", "root"], "left_anti"), "minor")
        at = lambda end, other: pairs.join(minor.withColumnRenamed("node", end), end).select("scenario", "root", "src", "dst", F.col(other).alias("node"))
        met = uncut(at("src", "dst").union(at("dst", "src"))).join(pieces.withColumnRenamed("root", "to"), ["scenario", "node"])
        whole = connected(spark, parts.select("scenario", F.col("root").alias("node")), met.select("scenario", F.col("root").alias("src"), F.col("to").alias("dst")), ["scenario"])
        whole = whole.select("scenario", F.col("node").alias("root"), F.col("root").alias("whole"))
        parts = parts.join(whole, ["scenario", "root"]).groupBy("scenario", "whole").agg(F.sum("size").alias("size"))
        stored.drop(first, main, minor)
    stored.drop(known, pairs, left_nodes)
    new = parts.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("top"), F.count_if(F.col("size") == 1).alias("alone"))

    # Components by size: the largest untouched one is the first rank that the scenario doesn't touch.
    # No scenario touches more components than `most`, so the most + 1 largest hold one that it doesn't, if there is any.
    most = touched.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    top = stored.put(sizes.orderBy(F.desc("size"), "comp").limit(most + 1), "largest")
    ranks = top.select("comp", F.row_number().over(Window.orderBy(F.desc("size"), "comp")).alias("rank"))  # most + 1 rows
    ranked = touched.join(sizes, "comp").join(ranks, "comp", "left")
    old = ranked.groupBy("scenario").agg(F.count(F.lit(1)).alias("t_n"), F.count_if(F.col("size") == 1).alias("t_alone"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    whole = sizes.agg(F.count(F.lit(1)).alias("components_before"), F.max("size").alias("largest_before"), F.count_if(F.col("size") == 1).alias("alone_before"))
    every = scenarios.select("scenario") if links is None else scenarios.select("scenario").union(links.select("scenario"))
    out = every.distinct().join(new, "scenario", "left").join(old, "scenario", "left").crossJoin(F.broadcast(whole))  # one row
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("ranks"), F.lit(0)) + 1), F.coalesce("ranks", F.array().cast("array<int>"))))
    out = out.withColumn("rank", free).join(top.join(ranks, "comp").select("rank", F.col("size").alias("untouched")), "rank", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "scenario", (F.col("components_before") - zero("t_n") + zero("n")).alias("components"), F.greatest(zero("top"), zero("untouched")).alias("largest"),
        (F.col("alone_before") - zero("t_alone") + zero("alone")).alias("isolated"), "components_before", "largest_before",
    )


def bfs_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root, depth, slot from the node of highest degree (then least name) of each component, however deep.

    slot: a node's place in its level from 0, by its first parent's place and then by name, as a queue meets them. Levels are
    put in order by ranges over all components, so a wide level is the work of many tasks. Each level is a written table,
    and all but the last two are read by the result alone.
    """
    spark = nodes.sparkSession
    stored = Scratch(spark)
    keyed = lambda df: df.withColumn("k", F.lit(0))
    pairs = stored.put(linked(edges), "pairs")
    both = both_ways(pairs)
    labels = connected(spark, keyed(nodes.select("node").distinct()), keyed(pairs), ["k"]).select("node", F.col("root").alias("comp"))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    roots = labels.join(degree, "node", "left").groupBy("comp").agg(F.min(F.struct(-F.coalesce("degree", F.lit(0)), F.col("node"))).getField("node").alias("node"))
    level = lambda df, depth: df.select("node", "root", F.lit(depth).alias("depth"), "slot")
    front = stored.put(level(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("slot")), 0), "level")
    levels = [front]
    while not front.isEmpty():
        step = both.join(front.select(F.col("node").alias("src"), "root", "slot"), "src").groupBy("root", F.col("dst").alias("node")).agg(F.min("slot").alias("parent"))
        near = stored.union(*levels[-2:]).select("node")  # a node's neighbours are at most one level away
        slots = number_rows(step.join(near, "node", "left_anti"), stored, ["root"], ["parent", "node"])
        front = stored.put(level(slots.withColumnRenamed("place", "slot"), len(levels)), "level")
        levels.append(front)
    stored.drop(pairs)
    return stored.union(*levels)


# Words in a role that make a device a router, for the last step of device_facts().
ROUTER_ROLES = ["border", "core", "router", "edge", "spine", "leaf"]


def device_facts(devices: DataFrame, sessions: DataFrame, text_ids: DataFrame | None = None) -> DataFrame:
    """hostname, platform, loopback, local_as, role with each fact from its first source.

    The sources: inventory, own sessions, what the device's texts say (text_ids: device_name, router_id, local_as), what peers
    call a device's AS, and last, where all sessions have exactly one peer that is nobody's loopback, that peer for router
    roles that still lack a fact. sessions: device, loopback, local_as, peer_ip, remote_as. Each step sees the state before it.
    """
    own = sessions.groupBy(F.col("device").alias("hostname")).agg(F.min("loopback").alias("s_loopback"), F.min("local_as").alias("s_as"))
    base = devices.join(own, "hostname", "left")
    if text_ids is not None:
        base = base.join(text_ids.select(F.col("device_name").alias("hostname"), F.col("router_id").alias("t_loopback"), F.col("local_as").alias("t_as")), "hostname", "left")
    else:
        base = base.withColumns({"t_loopback": F.lit(None).cast("string"), "t_as": F.lit(None).cast("string")})
    base = base.withColumns({"loopback": F.coalesce("loopback", "s_loopback", "t_loopback"), "own_as": F.coalesce(F.col("s_as").cast("string"), "t_as")})
    told = sessions.groupBy(F.col("peer_ip").alias("loopback")).agg(F.min("remote_as").alias("told_as"))
    known = base.join(told, "loopback", "left").select("hostname", "platform", "loopback", F.coalesce("own_as", F.col("told_as").cast("string")).alias("local_as"), "role")
    speakers = known.filter("local_as is not null").select(F.col("hostname").alias("device"))
    strangers = sessions.filter("peer_ip is not null").join(known.select(F.col("loopback").alias("peer_ip")), "peer_ip", "left_anti").join(speakers, "device", "left_semi")
    one = strangers.agg(F.count(F.lit(1)).alias("_n"), F.min("peer_ip").alias("_ip"), F.min("remote_as").cast("string").alias("_as"))  # one row
    router = F.exists(F.lit(ROUTER_ROLES), lambda r: F.contains(F.lower(F.coalesce("role", F.lit(""))), r))
    last = lambda c, guess: F.coalesce(c, F.when(router & (F.col("_n") == 1), F.col(guess))).alias(c)
    return known.crossJoin(F.broadcast(one)).select("hostname", "platform", last("loopback", "_ip"), last("local_as", "_as").cast(sessions.schema["local_as"].dataType).alias("local_as"), "role")


def overlay(edges: DataFrame, facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges with the state of the session that runs over them: the session's peer address is the neighbour's loopback."""
    peers = facts.select(F.col("hostname").alias("dst"), F.col("loopback").alias("peer_ip")).filter("peer_ip is not null")
    state = sessions.join(peers, "peer_ip").groupBy(F.col("device").alias("src"), "dst").agg(F.max("state").alias("bgp_state"))
    return edges.join(state, ["src", "dst"], "left")


def devices_without_links(devices: DataFrame, links: DataFrame) -> DataFrame:
    """hostname of the devices at neither end of any link."""
    ends = links.select(F.col("source_device").alias("hostname")).union(links.select("destination_device"))
    return devices.select("hostname").join(ends, "hostname", "left_anti")


def latest_sessions(ospf: DataFrame, interfaces: DataFrame) -> DataFrame:
    """OSPF neighbours with the area of their interface, where one is known."""
    area = interfaces.select("device_name", "snapshot_id", "interface", "area").dropDuplicates(["device_name", "snapshot_id", "interface"])
    return ospf.join(area, ["device_name", "snapshot_id", "interface"], "left")


def session_flaps(events: DataFrame, by: Sequence[str], time: str, state: str) -> DataFrame:
    """State changes per peer: rows whose state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(time, state))
    return events.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col(state))).groupBy(*by).agg(F.count(F.lit(1)).alias("flaps"))
