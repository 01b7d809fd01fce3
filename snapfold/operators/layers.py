"""Layers of a snapshot (OSPF, BGP, VLAN, physical links) read from parsed rows, and the questions asked of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import bgp_state, canonical_interface, interface_list, ospf_sound, ospf_state
from .topology import adjacency_edges, mirrored, nhop_subgraph

# The keys under which parsed rows of the various vendors hold a value; the first that has one counts.
KEYS = {
    "neighbor_id": ["neighbor_id", "router_id"],
    "ospf_neighbor_ip": ["neighbor_ip", "ip_address", "address"],
    "interface": ["interface"],
    "ospf_state": ["state"],
    "bgp_neighbor_ip": ["neighbor_ip", "neighbor", "bgp_neighbor", "peer"],
    "bgp_neighbor_as": ["neighbor_as", "as", "peer_as"],
    "bgp_state": ["state", "state_pfxrcd", "state_or_prefixes_received"],
    "vlan_id": ["vlan_id", "tag"],
    "vlan_name": ["name", "vlan_name"],
    "vlan_interfaces": ["interfaces", "ports"],
}
# States that a typed row may have, by layer.
BGP_STATES = ["Established", "Active", "Idle", "Connect", "OpenSent", "OpenConfirm", "Down"]
OSPF_STATES = ["Full", "FULL/DR", "FULL/BDR", "FULL/DROTHER", "2-Way", "2WAY/DROTHER", "Init", "ExStart", "Exchange", "Loading", "Down"]
L2_PROTOCOLS = ["CDP", "LLDP"]
# What stands in the address column of an interface without an address.
UNASSIGNED = ["unassigned", "none", ""]


def parsed_rows(parsed: DataFrame, *carry: str) -> DataFrame:
    """device_name, command, snapshot_id, carry and fields (a map) for each object of the JSON lists in parsed_data.

    Null, empty, broken and non-list JSON gives no rows. Lists and objects inside a row stay as JSON text.
    """
    rows = F.from_json("parsed_data", "array<map<string,string>>")
    return parsed.select("device_name", "command", "snapshot_id", *carry, F.explode(rows).alias("fields"))


def pick(fields: Column, names: Sequence[str], first: bool = False) -> Column:
    """The value of the first of these keys, in any case, that has one; null, blank and [] are none. With `first`, a list gives its first."""

    def one(name: str) -> Column:
        held = F.filter(F.map_entries(fields), lambda e: (F.lower(e["key"]) == name) & ~F.trim(F.coalesce(e["value"], F.lit(""))).isin("", "[]"))
        value = F.get(held, F.lit(0))["value"]
        return F.when(value.startswith("["), F.get(F.from_json(value, "array<string>"), F.lit(0))).otherwise(value) if first else value

    return F.coalesce(*[one(n) for n in names])


def of_snapshot(rows: DataFrame, snapshot: str | None = None) -> DataFrame:
    """The rows of this snapshot, or of the newest that `rows` has (a join with one row)."""
    if snapshot is not None:
        return rows.filter(F.col("snapshot_id") == snapshot)
    newest = rows.agg(F.max("snapshot_id").alias("snapshot_id"))
    return rows.join(F.broadcast(newest), "snapshot_id", "left_semi")


def topology_snapshot(links: DataFrame, sessions: DataFrame) -> DataFrame:
    """snapshot_id, one row: the newest that has links, else the newest that has sessions, else null."""
    one = lambda df, name: df.agg(F.max("snapshot_id").alias(name))
    return one(links, "l").crossJoin(F.broadcast(one(sessions, "s"))).select(F.coalesce("l", "s").alias("snapshot_id"))


def _layer(parsed: DataFrame, like: str, snapshot: str | None, scope: Sequence[str]) -> DataFrame:
    rows = of_snapshot(parsed.filter(F.col("command").ilike(like)), snapshot).filter("parsed_data is not null")
    return parsed_rows(rows.filter(F.col("device_name").isin(list(scope))) if scope else rows)


def ospf_layer(parsed: DataFrame, snapshot: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """device, neighbor_id, neighbor_ip, interface, state of one snapshot's OSPF neighbours; rows without a neighbour id go."""
    f = F.col("fields")
    out = _layer(parsed, "%ospf neighbor%", snapshot, scope).select(
        F.col("device_name").alias("device"), pick(f, KEYS["neighbor_id"]).alias("neighbor_id"), pick(f, KEYS["ospf_neighbor_ip"]).alias("neighbor_ip"),
        pick(f, KEYS["interface"]).alias("interface"), F.coalesce(pick(f, KEYS["ospf_state"]), F.lit("")).alias("state"), "snapshot_id",
    )
    return out.filter("neighbor_id is not null")


def bgp_layer(parsed: DataFrame, snapshot: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """device, neighbor_ip, neighbor_as, local_as, router_id, state of one snapshot's BGP sessions; rows without a neighbour go."""
    f = F.col("fields")
    out = _layer(parsed, "%bgp summary%", snapshot, scope).select(
        F.col("device_name").alias("device"), pick(f, KEYS["bgp_neighbor_ip"]).alias("neighbor_ip"), pick(f, KEYS["bgp_neighbor_as"]).alias("neighbor_as"),
        pick(f, ["local_as"]).alias("local_as"), pick(f, ["router_id"]).alias("router_id"), F.coalesce(pick(f, KEYS["bgp_state"]), F.lit("")).alias("state"), "snapshot_id",
    )
    return out.filter("neighbor_ip is not null")


def vlan_layer(parsed: DataFrame, snapshot: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """device, vlan_id, name, interfaces (a list, from a list or a text) of one snapshot's VLANs; rows without an id go."""
    f = F.col("fields")
    listed = F.regexp_replace(F.coalesce(pick(f, KEYS["vlan_interfaces"]), F.lit("")), r'[\[\]"]', " ")
    out = _layer(parsed, "%vlan%", snapshot, scope).select(
        F.col("device_name").alias("device"), pick(f, KEYS["vlan_id"]).alias("vlan_id"), F.coalesce(pick(f, KEYS["vlan_name"]), F.lit("")).alias("name"), interface_list(listed).alias("interfaces"), "snapshot_id"
    )
    return out.filter("vlan_id is not null")


def physical_layer(links: DataFrame, snapshot: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """The links of one snapshot; with a scope, those that have either end in it."""
    rows = of_snapshot(links, snapshot)
    return rows.filter(F.col("source_device").isin(list(scope)) | F.col("destination_device").isin(list(scope))) if scope else rows


def layer_edges(layer: DataFrame, kind: str) -> DataFrame:
    """src, dst of a layer's graph, each pair once: device and neighbour, or device and VLAN:<id>."""
    far = {"ospf": F.col("neighbor_id"), "bgp": F.col("neighbor_ip"), "vlan": F.concat(F.lit("VLAN:"), "vlan_id") if kind == "vlan" else None, "physical": F.col("destination_device")}[kind]
    return layer.select(F.col("source_device" if kind == "physical" else "device").alias("src"), far.alias("dst")).distinct()


def layer_neighbors(edges: DataFrame, node: str) -> DataFrame:
    """node: what stands next to this node, in either direction, by name."""
    return mirrored(edges).filter(F.col("src") == node).select(F.col("dst").alias("node")).orderBy("node")


def unhealthy_adjacencies(layer: DataFrame) -> DataFrame:
    """OSPF adjacencies that are neither full nor two-way, whatever the role behind the state."""
    return layer.filter(~ospf_sound(F.col("state")))


def vlan_members(layer: DataFrame) -> DataFrame:
    """device, vlan_id, interfaces: all distinct interfaces of a VLAN on a device, by name; ids come by length and then text."""
    members = layer.select("device", "vlan_id", F.explode_outer("interfaces").alias("interface")).distinct()
    out = members.groupBy("device", "vlan_id").agg(F.array_sort(F.collect_set("interface")).alias("interfaces"))
    return out.orderBy("device", F.length("vlan_id"), "vlan_id")


def l2_links(links: DataFrame) -> DataFrame:
    """The link table under the names of the topology layer."""
    names = ["source_device", "source_interface", "destination_device", "destination_interface", "discovery_protocol", "link_status", "snapshot_id"]
    return links.select(*names)


def adjacency_source(df: DataFrame, protocol: str) -> DataFrame:
    """src, sif, dst, dif, status, snapshot_id from links (l2_cdp), BGP neighbours (bgp) or OSPF neighbours (ospf)."""
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    columns = {
        "l2_cdp": ["source_device", "source_interface", "destination_device", "destination_interface", text("link_status", "up")],
        "bgp": ["device_name", text("localhost_ip"), "neighbor", text("remote_ip"), text("bgp_state")],
        "ospf": ["device_name", text("interface"), "neighbor_id", text("ip_address"), text("state")],
    }
    if protocol not in columns:
        raise ValueError(f"unknown protocol: {protocol}")
    named = zip(columns[protocol], ("src", "sif", "dst", "dif", "status"), strict=True)
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in named], "snapshot_id")


def adjacency_table(
    source: DataFrame, devices: DataFrame, *, center: str | None = None, hops: int = 2, roles: Sequence[str] = (), sites: Sequence[str] = (),
    name_like: str | None = None, snapshot_id: str | None = None, max_hosts: int | None = None,
) -> DataFrame:
    """Rows of adjacency_source() in scope: either end by role, site or name, then within `hops` of the centre.

    Without any scope it is an error, as is a table of more than `max_hosts` hosts.
    """
    if not (center or roles or sites or name_like):
        raise ValueError("name a scope: center, roles, sites or name_like")
    out = source if snapshot_id is None else source.filter(F.col("snapshot_id") == snapshot_id)
    if roles or sites or name_like:
        out = adjacency_edges(out, devices, roles=roles, sites=sites, name_like=name_like)
    if center:
        out = nhop_subgraph(out, center, hops)
    if max_hosts is not None and (hosts := adjacency_counts(out).first()["hosts"]) > max_hosts:
        raise ValueError(f"{hosts} hosts are more than {max_hosts}: narrow the scope")
    return out.select(*source.columns)


def adjacency_counts(edges: DataFrame) -> DataFrame:
    """hosts, edges: one row."""
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).agg(F.count_distinct("host").alias("hosts"))
    return ends.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))


def adjacency_metadata(edges: DataFrame, devices: DataFrame) -> DataFrame:
    """hostname, model, os_version, vendor, ip, role, site of the devices that stand in the edges."""
    hosts = edges.select(F.col("src").alias("hostname")).union(edges.select("dst")).distinct()
    known = devices.select("hostname", "model", "os_version", "vendor", F.coalesce("ip_address", F.lit("")).alias("ip"), "role", "site")
    return known.join(hosts, "hostname", "left_semi")


def _address(value: Column) -> Column:
    v4 = value.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return v4 | value.rlike(r"(?i)^(?=.*:)[0-9a-f:]{2,39}(%\w+)?$")


def validate_rows(rows: DataFrame, kind: str) -> DataFrame:
    """rows with `errors`, the list of what is wrong with each (empty: a sound row). kind: bgp, ospf or l2.

    No row is dropped and none stops the job: good and bad ones are told apart by size(errors).
    """
    no = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    checks = {
        "bgp": [("device", no("device")), ("neighbor_ip", ~_address(F.coalesce("neighbor_ip", F.lit("")))), ("neighbor_as", F.col("neighbor_as").try_cast("long").isNull()),
                ("local_as", F.col("local_as").isNotNull() & F.col("local_as").try_cast("long").isNull()), ("state", ~F.coalesce("state", F.lit("")).isin(BGP_STATES))],
        "ospf": [("device", no("device")), ("neighbor_id", no("neighbor_id")), ("neighbor_ip", F.col("neighbor_ip").isNotNull() & ~_address(F.col("neighbor_ip"))), ("interface", no("interface")), ("state", ~F.coalesce("state", F.lit("")).isin(OSPF_STATES))],
        "l2": [*[(c, no(c)) for c in ("source_device", "source_interface", "destination_device", "destination_interface")], ("discovery_protocol", F.col("discovery_protocol").isNotNull() & ~F.col("discovery_protocol").isin(L2_PROTOCOLS))],
    }[kind]
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks])))


def query_topology(parsed: DataFrame, links: DataFrame | None, areas: DataFrame | None = None, concept: str = "all", snapshot: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed layers by name (bgp, ospf, l2), each with `errors`, and absent: the layers whose source was never collected.

    States are canonical. OSPF rows carry the area of their interface (areas: device_name, snapshot_id, interface, area)
    where one is known. Unless one is named, the snapshot is the newest with links, else with BGP sessions.
    """
    bgp_rows, ospf_rows = (parsed.filter(F.col("command").ilike(like)) for like in ("%bgp summary%", "%ospf neighbor%"))
    if snapshot is None:
        base = links if links is not None else parsed.limit(0)
        snapshot = topology_snapshot(base, bgp_rows).first()["snapshot_id"]
    wanted = [c for c in ("bgp", "ospf", "l2") if concept in (c, "all")]
    out = {}
    if "bgp" in wanted:
        out["bgp"] = validate_rows(bgp_layer(parsed, snapshot).withColumn("state", bgp_state(F.col("state"))), "bgp")
    if "ospf" in wanted:
        rows = ospf_layer(parsed, snapshot).withColumn("state", ospf_state(F.trim("state")))
        if areas is None:
            rows = rows.withColumn("area", F.lit(None).cast("string"))
        else:
            known = areas.groupBy(F.col("device_name").alias("device"), "snapshot_id", "interface").agg(F.min("area").alias("area"))
            rows = rows.join(known, ["device", "snapshot_id", "interface"], "left")
        out["ospf"] = validate_rows(rows, "ospf")
    if "l2" in wanted and links is not None:
        out["l2"] = validate_rows(l2_links(of_snapshot(links, snapshot)), "l2")
    none = [("bgp", bgp_rows.limit(1)), ("ospf", ospf_rows.limit(1)), *([("l2", links.limit(1))] if links is not None else [])]
    spark = parsed.sparkSession
    every = spark.createDataFrame([(c,) for c in wanted], "layer string")
    here = reduce(DataFrame.union, [df.select(F.lit(c).alias("layer")) for c, df in none])
    return out, every.join(here, "layer", "left_anti")


def inspect_interfaces(ios: DataFrame, junos: DataFrame, devices: DataFrame | None = None, include_unassigned: bool = False) -> DataFrame:
    """device_name, interface, ip_address, status, proto, snapshot_id from each device's newest snapshot.

    ios: device_name, snapshot_id, interface, ip_address, status, proto; junos: the same with link_state for status. A device
    that yields rows by its IOS output isn't looked up in the other. devices (hostname) narrows; a device with nothing to
    show has one row of nulls. Interfaces without an address are left out unless asked for.
    """
    narrow = lambda df: df if devices is None else df.join(devices.select(F.col("hostname").alias("device_name")), "device_name", "left_semi")

    def newest(df: DataFrame) -> DataFrame:
        last = df.groupBy("device_name").agg(F.max("snapshot_id").alias("snapshot_id"))
        return df.join(last, ["device_name", "snapshot_id"], "left_semi")

    names = ["device_name", "interface", "ip_address", "status", "proto", "snapshot_id"]
    first = newest(narrow(ios)).select(*names)
    second = newest(narrow(junos)).withColumnRenamed("link_state", "status").select(*names)
    if not include_unassigned:
        first = first.filter(~F.lower(F.coalesce("ip_address", F.lit(""))).isin(UNASSIGNED))
        second = second.filter(F.trim(F.coalesce("ip_address", F.lit(""))) != "")
    out = first.unionByName(second.join(first.select("device_name").distinct(), "device_name", "left_anti"))
    if devices is None:
        return out
    return devices.select(F.col("hostname").alias("device_name")).distinct().join(out, "device_name", "left").select(*names)


FACTS = ("platform", "loopback", "local_as", "mgmt_ip", "role")


def inspect_devices(facts: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """hostname, found (the facts that are known, a map), unknown_facts, known (false: not in the inventory) of each device asked for, or of all."""
    held = [c for c in FACTS if c in facts.columns]
    rows = facts.withColumn("known", F.lit(True))
    rows = rows if devices is None else devices.select("hostname").distinct().join(rows, "hostname", "left")
    found = F.map_filter(F.create_map(*[x for c in held for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in held]))
    known = F.coalesce("known", F.lit(False))
    return rows.select("hostname", F.when(known, found).alias("found"), F.when(known, missing).alias("unknown_facts"), known.alias("known"))


def unified_graph(facts: DataFrame, links: DataFrame, ospf: DataFrame, bgp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (the facts) and directed edges: each link both ways, with the OSPF and BGP state between its ends.

    links of one snapshot; ospf: device, neighbor_id, state; bgp: device, neighbor_ip, neighbor_as, state. A neighbour is the
    device whose loopback its id or address is. Of several links between two devices the one of last interface names counts.
    OSPF state holds for both directions, BGP for its own; of several values the last by name counts.
    """
    both = [("source_device", "source_interface", "destination_device", "destination_interface"), ("destination_device", "destination_interface", "source_device", "source_interface")]
    rows = [links.select(*[F.col(c).alias(n) for c, n in zip(ends, ("src", "sif", "dst", "dif"), strict=True)], "discovery_protocol", F.coalesce("link_status", F.lit("unknown")).alias("link_status")) for ends in both]
    every = rows[0].unionByName(rows[1]).filter("src is not null and dst is not null")
    last = F.max(F.struct("sif", "dif", "discovery_protocol", "link_status")).alias("l")
    edges = every.groupBy("src", "dst").agg(last).select("src", "dst", F.col("l.sif").alias("sif"), F.col("l.dif").alias("dif"), F.col("l.discovery_protocol").alias("protocol"), F.col("l.link_status").alias("link_status"))
    at = facts.filter("loopback is not null").groupBy("loopback").agg(F.min("hostname").alias("peer"))
    near = ospf.join(at, F.col("neighbor_id") == F.col("loopback")).select(F.col("device").alias("src"), F.col("peer").alias("dst"), "state")
    states = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "state")).groupBy("src", "dst").agg(F.max("state").alias("ospf_state"))
    raw = bgp.join(at, F.col("neighbor_ip") == F.col("loopback")).select(F.col("device").alias("src"), F.col("peer").alias("dst"), bgp_state(F.coalesce("state", F.lit(""))).alias("state"), "neighbor_as")
    sessions = raw.groupBy("src", "dst").agg(F.max(F.struct("state", "neighbor_as")).alias("b")).select("src", "dst", F.col("b.state").alias("bgp_state"), F.col("b.neighbor_as").alias("bgp_neighbor_as"))
    return facts, edges.join(states, ["src", "dst"], "left").join(sessions, ["src", "dst"], "left")


def cross_layer_anomalies(interfaces: DataFrame, sessions: DataFrame, routes: DataFrame) -> DataFrame:
    """kind, device_name, subject: sessions that stand over an interface that is down, and peers without a route to them.

    interfaces: device_name, interface, status; sessions: device_name, interface, neighbor, state; routes: device_name, network.
    """
    down = interfaces.filter(F.lower("status").isin("down", "admin-down", "administratively down")).select("device_name", "interface").distinct()
    standing = sessions.withColumn("interface", canonical_interface(F.col("interface"))).filter("state = 'Established'")
    over = standing.join(down.withColumn("interface", canonical_interface(F.col("interface"))), ["device_name", "interface"], "left_semi")
    lost = sessions.join(routes.select("device_name", F.col("network").alias("neighbor")), ["device_name", "neighbor"], "left_anti")
    named = lambda df, kind, subject: df.select(F.lit(kind).alias("kind"), "device_name", F.col(subject).alias("subject")).distinct()
    return named(over, "established_over_down_interface", "interface").unionByName(named(lost, "peer_without_route", "neighbor"))
