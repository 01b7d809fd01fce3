"""Queries over the layers of a snapshot, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as net
from ..operators import diff, layers, search, topology, views
from .fixtures import cte, model
from .queries import query

#: One column of the fixture's JSON objects, for DuckDB; blank is none.
J = lambda *keys: "coalesce(" + ", ".join(f"nullif(trim(json_extract_string(parsed_data, '$[0].{k}')), '')" for k in keys) + ")"
LISTS = "outputs WHERE parsed_data <> 'no list'"
NEWEST = lambda command: f"snapshot_id = (SELECT max(snapshot_id) FROM outputs WHERE command = '{command}')"


def _rows(df: DataFrame) -> DataFrame:
    """Equal rows with their number, so that a layer's repeated rows are compared too."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@query(cte("outputs") + f""", l AS (SELECT device_name AS device, {J('NEIGHBOR_ID')} AS neighbor_id, {J('address')} AS neighbor_ip, {J('interface')} AS interface, {J('State')} AS state, snapshot_id
        FROM {LISTS} AND command = 'show ip ospf neighbor' AND {NEWEST('show ip ospf neighbor')})
    SELECT *, count(*) AS n, state NOT IN ('FULL/DR', 'full', '2WAY') AS unhealthy FROM l GROUP BY ALL""")
def ospf_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OSPF adjacencies of the newest snapshot, and which of them are unhealthy."""
    rows = layers.ospf_layer(model(spark, sf_dir, "outputs"))
    bad = layers.unhealthy_adjacencies(rows).withColumn("unhealthy", F.lit(True))
    good = rows.join(bad.select(*rows.columns).distinct(), rows.columns, "left_anti").withColumn("unhealthy", F.lit(False))
    return _rows(bad.unionByName(good))


@query(cte("outputs") + f""", l AS (SELECT device_name AS device, {J('neighbor', 'peer')} AS neighbor_ip, {J('as')} AS neighbor_as, {J('state_pfxrcd')} AS state
        FROM {LISTS} AND command = 'show ip bgp summary' AND {NEWEST('show ip bgp summary')})
    SELECT *, count(*) AS n FROM l GROUP BY ALL""")
def bgp_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(layers.bgp_layer(model(spark, sf_dir, "outputs")).select("device", "neighbor_ip", "neighbor_as", "state"))


@query(cte("outputs") + f""", l AS (SELECT device_name AS device, {J('tag')} AS vlan_id, unnest(['Gi0/' || (pk % 4), 'Gi0/' || (pk % 3)]) AS interface FROM {LISTS}
        AND command = 'show vlan' AND {NEWEST('show vlan')})
    SELECT device, vlan_id, array_to_string(list_sort(list_distinct(list(interface))), ',') AS interfaces FROM l GROUP BY ALL""")
def vlan_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All interfaces of each VLAN on each device."""
    out = layers.vlan_members(layers.vlan_layer(model(spark, sf_dir, "outputs")))
    return out.select("device", "vlan_id", F.array_join("interfaces", ",").alias("interfaces"))


@query(cte("links") + """, l AS (SELECT * FROM links WHERE snapshot_id = (SELECT max(snapshot_id) FROM links)), e AS (SELECT source_device AS a, destination_device AS b
        FROM l UNION SELECT destination_device, source_device FROM l)
    SELECT a AS device, count(DISTINCT b) AS neighbors, (SELECT count(*) FROM l WHERE source_device = a OR destination_device = a) AS links FROM e GROUP BY a""")
def physical_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of the newest snapshot's links with how many neighbours and links each has."""
    rows = layers.physical_layer(model(spark, sf_dir, "links"))
    near = topology.mirrored(layers.layer_edges(rows, "physical")).groupBy(F.col("src").alias("device")).agg(F.count(F.lit(1)).alias("neighbors"))
    ends = rows.select(F.explode(F.array("source_device", "destination_device")).alias("device")).groupBy("device").agg(F.count(F.lit(1)).alias("links"))
    return near.join(ends, "device")


SOURCES_SQL = """u AS (SELECT 'l2_cdp' AS protocol, source_device AS src, source_interface AS sif, destination_device AS dst, destination_interface AS dif, coalesce(link_status, 'up') AS status, snapshot_id
        FROM links
        UNION ALL SELECT 'bgp', device_name, '', neighbor, '', state, snapshot_id FROM sessions UNION ALL SELECT 'ospf', device_name, interface, neighbor, '', state, snapshot_id FROM sessions)"""


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s, none = model(spark, sf_dir, "sessions"), F.lit(None).cast("string")
    bgp = s.select("device_name", none.alias("localhost_ip"), "neighbor", none.alias("remote_ip"), F.col("state").alias("bgp_state"), "snapshot_id")
    ospf = s.select("device_name", "interface", F.col("neighbor").alias("neighbor_id"), none.alias("ip_address"), "state", "snapshot_id")
    return {p: layers.adjacency_source(df, p) for p, df in (("l2_cdp", layers.l2_links(model(spark, sf_dir, "links"))), ("bgp", bgp), ("ospf", ospf))}


@query(cte("links", "sessions") + f", {SOURCES_SQL} SELECT protocol, status, snapshot_id, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst || dif || sif) AS targets FROM u GROUP BY ALL")
def universal_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, BGP and OSPF neighbours under one set of names."""
    every = [df.withColumn("protocol", F.lit(p)) for p, df in _sources(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, every).groupBy("protocol", "status", "snapshot_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct(F.concat("dst", "dif", "sif")).alias("targets"))


SCOPED = """, s AS (SELECT hostname FROM devices WHERE role IN ('core', 'border')),
        l AS (SELECT source_device AS src, source_interface AS sif, destination_device AS dst, destination_interface AS dif, coalesce(link_status, 'up') AS status FROM links
        WHERE snapshot_id = 'snap_19970101_000000_t' AND (source_device IN (SELECT hostname FROM s) OR destination_device IN (SELECT hostname FROM s))),
        near AS (SELECT 'r1' AS node UNION SELECT dst FROM l WHERE src = 'r1' UNION SELECT src FROM l WHERE dst = 'r1'),
    t AS (SELECT * FROM l WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near))"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.adjacency_table(_sources(spark, sf_dir)["l2_cdp"], model(spark, sf_dir, "devices"), center="r1", hops=1, roles=["core", "border"], snapshot_id="snap_19970101_000000_t")


@query(cte("links", "devices") + SCOPED + " SELECT *, count(*) AS n FROM t GROUP BY ALL")
def adjacency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of one year with an end in a role, within one hop of a device."""
    return _rows(_scoped(spark, sf_dir).drop("snapshot_id"))


@query(cte("links", "devices") + SCOPED + """, h AS (SELECT src AS host FROM t UNION SELECT dst FROM t)
    SELECT hostname, model, vendor, coalesce(ip_address, '') AS ip, role, site, (SELECT count(*) FROM h) AS hosts, (SELECT count(*) FROM t) AS edges FROM devices
        WHERE hostname IN (SELECT host FROM h)""")
def adjacency_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the devices in that table, and its size."""
    rows = _scoped(spark, sf_dir)
    known = model(spark, sf_dir, "devices").withColumn("os_version", F.lit(None).cast("string"))
    return layers.adjacency_metadata(rows, known).drop("os_version").crossJoin(F.broadcast(layers.adjacency_counts(rows)))


@query(cte("outputs", "links") + f""", newest AS (SELECT max(snapshot_id) AS snapshot_id FROM outputs WHERE command = 'show ip bgp summary'),
    b AS (SELECT 'bgp' AS layer, device_name AS device, {J('neighbor', 'peer')} AS far, CASE WHEN regexp_full_match({J('state_pfxrcd')}, '[0-9]+') THEN 'Established'
        ELSE {J('state_pfxrcd')} END AS state, NULL AS area FROM {LISTS} AND command = 'show ip bgp summary' AND snapshot_id IN (SELECT snapshot_id FROM newest)),
    o AS (SELECT 'ospf', device_name, {J('NEIGHBOR_ID')}, CASE {J('State')} WHEN 'FULL/DR' THEN 'FULL/DR' WHEN '2WAY' THEN '2-Way' WHEN 'INIT' THEN 'Init'
        ELSE 'Full' END, CASE WHEN ln % 10 = 0 THEN '0' END FROM {LISTS} AND command = 'show ip ospf neighbor' AND snapshot_id IN (SELECT snapshot_id FROM newest)),
    u AS (SELECT * FROM b UNION ALL SELECT * FROM o) SELECT layer, device, far, state, area, CASE WHEN state = 'weird' THEN 'state' ELSE '' END AS errors, count(*) AS n FROM u GROUP BY ALL""")
def query_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed BGP and OSPF rows of the newest snapshot with sessions, canonical states, the area of the interface, and what is wrong with a row."""
    parsed = model(spark, sf_dir, "outputs")
    areas = parsed.filter("ln % 10 = 0").select("device_name", "snapshot_id", F.concat(F.lit("Gi0/"), F.col("ln").cast("string")).alias("interface"), F.lit("0").alias("area")).distinct()
    out, _ = layers.query_topology(parsed, None, areas)
    near = {"bgp": "neighbor_ip", "ospf": "neighbor_id"}
    rows = [df.select(F.lit(c).alias("layer"), "device", F.col(near[c]).alias("far"), "state", F.col("area") if c == "ospf" else F.lit(None).cast("string").alias("area"), F.array_join("errors", ",").alias("errors")) for c, df in out.items()]
    return _rows(rows[0].unionByName(rows[1]))


@query(cte("links") + """ SELECT CASE WHEN discovery_protocol = 'FDP' THEN 'discovery_protocol' ELSE '' END AS errors, link_status, count(*) AS n FROM links GROUP BY ALL""")
def validated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers.validate_rows(layers.l2_links(model(spark, sf_dir, "links")), "l2")
    return rows.groupBy(F.array_join("errors", ",").alias("errors"), "link_status").agg(F.count(F.lit(1)).alias("n"))


def _interfaces(spark: SparkSession, sf_dir: str, command: str, status: str) -> DataFrame:
    f = F.col("fields")
    rows = layers.parsed_rows(model(spark, sf_dir, "outputs").filter(F.col("command") == command))
    return rows.select("device_name", "snapshot_id", *[layers.pick(f, [c]).alias(c) for c in ("interface", "ip_address", status, "proto")]).distinct()


@query(cte("outputs") + f""",
        i AS (SELECT DISTINCT device_name, snapshot_id, {J('interface')} AS interface, {J('ip_address')} AS ip_address, {J('status')} AS status, {J('proto')} AS proto
        FROM {LISTS} AND command = 'show ip interface brief'),
    j AS (SELECT DISTINCT device_name, snapshot_id, {J('interface')} AS interface, {J('ip_address')} AS ip_address, {J('link_state')} AS status, {J('proto')} AS proto
        FROM {LISTS} AND command = 'show interfaces terse'),
    i1 AS (SELECT * FROM i WHERE snapshot_id = (SELECT max(k.snapshot_id) FROM i k WHERE k.device_name = i.device_name) AND coalesce(ip_address, '') NOT IN ('', 'unassigned')),
    j1 AS (SELECT * FROM j WHERE snapshot_id = (SELECT max(k.snapshot_id) FROM j k WHERE k.device_name = j.device_name) AND coalesce(ip_address, '') <> ''
        AND device_name NOT IN (SELECT device_name FROM i1))
    SELECT device_name, interface, ip_address, status, proto, snapshot_id FROM i1 UNION ALL SELECT device_name, interface, ip_address, status, proto, snapshot_id FROM j1""")
def inspect_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addressed interfaces of every device from its newest snapshot, IOS output first."""
    return layers.inspect_interfaces(_interfaces(spark, sf_dir, "show ip interface brief", "status"), _interfaces(spark, sf_dir, "show interfaces terse", "link_state"))


@query(cte("devices") + """, f AS (SELECT hostname, platform, CASE WHEN site LIKE 'A%' THEN NULL ELSE ip_address END AS loopback, role FROM devices),
        want AS (SELECT hostname FROM devices UNION SELECT 'x' || hostname FROM devices WHERE role IS NULL)
    SELECT w.hostname, f.hostname IS NOT NULL AS known, CASE WHEN f.hostname IS NOT NULL THEN concat_ws(',', CASE WHEN f.platform IS NULL THEN 'platform' END, CASE
        WHEN f.loopback IS NULL THEN 'loopback' END, CASE WHEN f.role IS NULL THEN 'role' END) END AS unknown_facts,
        CASE WHEN f.hostname IS NOT NULL THEN coalesce(f.role, 'none') END AS role FROM want w LEFT JOIN f ON w.hostname = f.hostname""")
def inspect_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model(spark, sf_dir, "devices")
    facts = d.select("hostname", "platform", F.when(~F.col("site").startswith("A"), F.col("ip_address")).alias("loopback"), "role")
    want = d.select("hostname").union(d.filter("role is null").select(F.concat(F.lit("x"), "hostname")))
    out = layers.inspect_devices(facts, want)
    return out.select("hostname", "known", F.array_join("unknown_facts", ",").alias("unknown_facts"), F.when(F.col("known"), F.coalesce(F.element_at("found", "role"), F.lit("none"))).alias("role"))


@query(cte("links", "devices", "sessions") + """, f AS (SELECT hostname, '10.0.0.' || substr(hostname, 2) AS loopback FROM devices), l AS (SELECT * FROM links
        WHERE snapshot_id = (SELECT max(snapshot_id) FROM links)),
   
        m AS (SELECT source_device AS src, source_interface AS sif, destination_device AS dst, destination_interface AS dif, discovery_protocol AS p, coalesce(link_status, 'unknown') AS s
        FROM l UNION ALL SELECT destination_device, destination_interface, source_device, source_interface, discovery_protocol, coalesce(link_status, 'unknown') FROM l),
    e AS (SELECT src, dst, sif, dif, p, s FROM m QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY sif DESC, dif DESC, p DESC, s DESC) = 1),
        q AS (SELECT device_name AS src, hostname AS dst, state, remote_as FROM sessions JOIN f ON neighbor = loopback),
    o AS (SELECT src, dst, max(state) AS ospf FROM (SELECT src, dst, state FROM q UNION ALL SELECT dst, src, state FROM q) GROUP BY ALL), b AS (SELECT src, dst, max(CASE
        WHEN state = '12' THEN 'Established' ELSE state END) AS bgp FROM q GROUP BY ALL)
    SELECT e.src, e.dst, sif, dif, p AS protocol, s AS link_status, ospf AS ospf_state, bgp AS bgp_state FROM e LEFT JOIN o ON e.src = o.src AND e.dst = o.dst LEFT
        JOIN b ON e.src = b.src AND e.dst = b.dst""")
def unified_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directed edges of the newest snapshot's links with the OSPF and BGP state between their ends."""
    d, s = model(spark, sf_dir, "devices"), model(spark, sf_dir, "sessions")
    facts = d.select("hostname", F.concat(F.lit("10.0.0."), F.substring("hostname", 2, 9)).alias("loopback"))
    ospf = s.select(F.col("device_name").alias("device"), F.col("neighbor").alias("neighbor_id"), "state")
    bgp = s.select(F.col("device_name").alias("device"), F.col("neighbor").alias("neighbor_ip"), F.col("remote_as").alias("neighbor_as"), "state")
    return layers.unified_graph(facts, layers.physical_layer(model(spark, sf_dir, "links")), ospf, bgp)[1].drop("bgp_neighbor_as")


@query(cte("outputs", "sessions") + f""", d AS (SELECT DISTINCT device_name, replace({J('interface')}, 'Gi', 'GigabitEthernet') AS interface FROM {LISTS}
        AND command = 'show ip interface brief' AND {J('status')} = 'down'),
    s AS (SELECT device_name, {"CASE WHEN interface LIKE 'Gi%' THEN 'GigabitEthernet' || substr(interface, 3) ELSE interface END"} AS interface, neighbor, state
        FROM sessions), r AS (SELECT DISTINCT device_name, neighbor FROM sessions WHERE ln % 2 = 1)
    SELECT DISTINCT 'established_over_down_interface' AS kind, device_name, interface AS subject FROM s WHERE state = 'Estab' AND (device_name, interface) IN (SELECT device_name, interface FROM d)
    UNION ALL SELECT DISTINCT 'peer_without_route', device_name, neighbor FROM s WHERE (device_name, neighbor) NOT IN (SELECT device_name, neighbor FROM r)""")
def cross_layer_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    sessions = s.withColumn("state", net.canonical_state(F.col("state")))
    routes = s.filter("ln % 2 = 1").select("device_name", F.col("neighbor").alias("network"))
    return layers.cross_layer_anomalies(_interfaces(spark, sf_dir, "show ip interface brief", "status"), sessions, routes)


@query(cte("sessions", "devices") + """ SELECT 'role' AS by, coalesce(role, 'none') AS value, count(*) AS devices FROM devices GROUP BY ALL UNION ALL
        SELECT 'platform', platform, count(*) FROM devices GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM devices
    UNION ALL SELECT 'snapshot', snapshot_id, count(DISTINCT device_name) FROM sessions GROUP BY ALL""")
def fleet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices by role, platform, in all, and distinct devices of each snapshot."""
    d = model(spark, sf_dir, "devices").select("hostname", F.coalesce("role", F.lit("none")).alias("role"), "platform", F.lit("all").alias("total"))
    long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("role", "platform", "total")])).alias("x")).groupBy("x.by", "x.value").agg(F.count(F.lit(1)).alias("devices"))
    seen = model(spark, sf_dir, "sessions").groupBy(F.col("snapshot_id").alias("value")).agg(F.count_distinct("device_name").alias("devices")).withColumn("by", F.lit("snapshot"))
    return long.unionByName(seen)


@query(cte("sessions") + """ SELECT device_name, interface, remote_as, count(*) AS sessions, count(*) FILTER (WHERE state LIKE 'FULL%') AS full_sessions FROM sessions GROUP BY ALL""")
def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, and full ones among them, by device, interface and AS."""
    return model(spark, sf_dir, "sessions").groupBy("device_name", "interface", "remote_as").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("state").startswith("FULL")).alias("full_sessions"))


@query(cte("sessions", "links") + """ SELECT 'global' AS choice, '' AS device_name, max(snapshot_id) AS snapshot_id FROM sessions UNION ALL
        SELECT 'topology', '', coalesce((SELECT max(snapshot_id) FROM links), (SELECT max(snapshot_id) FROM sessions))
    UNION ALL SELECT 'sessions', '', max(snapshot_id) FROM sessions UNION ALL SELECT 'device', device_name, max(snapshot_id) FROM sessions GROUP BY device_name""")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot by each rule: of all rows, with links or else sessions (with links and without any), of each device."""
    s, links = model(spark, sf_dir, "sessions"), model(spark, sf_dir, "links")
    one = lambda df, name: df.select(F.lit(name).alias("choice"), F.lit("").alias("device_name"), "snapshot_id").distinct()
    each = s.groupBy("device_name").agg(F.max("snapshot_id").alias("snapshot_id")).select(F.lit("device").alias("choice"), "device_name", "snapshot_id")
    rows = [one(layers.of_snapshot(s), "global"), one(layers.topology_snapshot(links, s), "topology"), one(layers.topology_snapshot(links.filter("snapshot_id is null"), s), "sessions"), each]
    return reduce(DataFrame.unionByName, rows)


@query(cte("sessions", "devices") + """, a AS (SELECT 's' AS t, device_name AS k1, neighbor AS k2, snapshot_id FROM sessions UNION ALL
        SELECT 'd', remote_as, interface, snapshot_id FROM sessions), x AS (SELECT DISTINCT t, k1, k2 FROM a WHERE snapshot_id = 'snap_19960101_000000_t'),
        y AS (SELECT DISTINCT t, k1, k2 FROM a WHERE snapshot_id = 'snap_19960201_000000_t')
    SELECT t AS table_name, 'added' AS change, count(*) AS n, min(k1 || '|' || k2) AS sample FROM (SELECT * FROM y EXCEPT SELECT * FROM x) GROUP BY ALL UNION ALL
        SELECT t, 'removed', count(*), min(k1 || '|' || k2) FROM (SELECT * FROM x EXCEPT SELECT * FROM y) GROUP BY ALL""")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added to and removed from two tables between two snapshots: totals and the first of the samples."""
    s = model(spark, sf_dir, "sessions")
    tables = {"s": (s.select("snapshot_id", "device_name", "neighbor"), ["device_name", "neighbor"]), "d": (s.select("snapshot_id", "remote_as", "interface"), ["remote_as", "interface"])}
    totals, samples = diff.diff_tables(tables, "snap_19960101_000000_t", "snap_19960201_000000_t")
    first = samples.groupBy("table_name", "change").agg(F.min("row_text").alias("sample"))
    return totals.join(first, ["table_name", "change"])


@query(cte("devices", "links", "logs") + """, seen AS (SELECT host, max("timestamp") AS last_seen FROM logs GROUP BY host), linked AS (SELECT source_device AS h
        FROM links UNION SELECT destination_device FROM links)
    SELECT hostname, CASE WHEN last_seen IS NULL THEN 'never' WHEN last_seen < TIMESTAMP '2024-01-30 00:00:00' THEN 'stale'
        ELSE 'fresh' END AS seen, hostname IN (SELECT h FROM linked) AS linked FROM devices LEFT JOIN seen ON hostname = host""")
def device_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that were never seen in the logs or not for a day, and devices without links."""
    d, links = model(spark, sf_dir, "devices").select("hostname"), model(spark, sf_dir, "links")
    seen = model(spark, sf_dir, "logs").groupBy(F.col("host").alias("hostname")).agg(F.max("timestamp").alias("last_seen"))
    stale = search.stale_devices(d.join(seen, "hostname", "left"), "2024-01-31 00:00:00", 24)
    alone = topology.devices_without_links(d, links).withColumn("linked", F.lit(False))
    return stale.join(alone, "hostname", "left").select("hostname", "seen", F.coalesce("linked", F.lit(True)).alias("linked"))


@query(cte("logs") + """ SELECT w AS since, host, count(*) AS n
        FROM logs, (VALUES ('last_1h', INTERVAL 1 HOUR), ('last_24h', INTERVAL 24 HOUR), ('last_7d', INTERVAL 168 HOUR)) v(w, i)
        WHERE CAST("timestamp" AS TIMESTAMP) >= TIMESTAMP '2024-01-31 00:00:00' - i AND CAST("timestamp" AS TIMESTAMP) <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY ALL""")
def log_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by host in each of the named ranges."""
    logs = model(spark, sf_dir, "logs")
    each = [search.since(logs, "timestamp", "2024-01-31 00:00:00", r).groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("since", F.lit(r)) for r in ("last_1h", "last_24h", "last_7d")]
    return reduce(DataFrame.unionByName, each)


_VIEW_COLUMNS = {
    "show ip ospf neighbor": ["NEIGHBOR_ID", "State", "address", "interface"], "show ip bgp summary": ["neighbor", "peer", "as", "state_pfxrcd"], "show vlan": ["tag"],
    "show ip interface brief": ["interface", "ip_address", "status", "proto"], "show interfaces terse": ["interface", "ip_address", "link_state", "proto"],
}
_VIEW_ROWS = " UNION ALL ".join(
    f"SELECT 'v_{c.replace(' ', '_')}_auto' AS name, device_name, snapshot_id, '{x}' AS field, json_extract_string(parsed_data, '$[0].{x}') AS value FROM latest WHERE command = '{c}'"
    for c, columns in _VIEW_COLUMNS.items() for x in columns
)


@query(cte("outputs") + f""", newest AS (SELECT *, max(snapshot_id) OVER (PARTITION BY device_name, command) AS top FROM outputs), latest AS (SELECT * FROM newest
        WHERE snapshot_id = top AND parsed_data <> 'no list') {_VIEW_ROWS}""")
def command_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all views that are built at once from the parsed lists, each with its own typed columns."""
    built = views.build_views(model(spark, sf_dir, "outputs").select("device_name", "command", "snapshot_id", "parsed_data"))
    long = []
    for name, view in sorted(built.items()):
        columns = [c for c in view.columns if c not in ("device_name", "snapshot_id", "interfaces")]
        values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
        long.append(view.select(F.lit(name).alias("name"), "device_name", "snapshot_id", F.inline(values)))
    return reduce(DataFrame.unionByName, long)


_KIND = """CASE WHEN role IN ('core', 'border') THEN 'router' WHEN role IN ('access', 'dist') THEN 'switch'
    WHEN regexp_matches({h}, '(^|[-_.])(fw[0-9]?|firewall|asa|palo|checkpoint)\\b', 'i') THEN 'firewall'
    WHEN regexp_matches({h}, '(^|[-_.])(r[0-9]|router|rtr|rt[0-9]|bgp|asr|edge\\b|border\\b|core\\b)', 'i') THEN 'router' ELSE 'switch' END"""
_KIND_NAMES = {"kind": "hostname", "kind_of_fw": "'x-fw' || substr(hostname, 2)", "kind_of_asr": "'asr' || substr(hostname, 2) || 'k-1'", "kind_of_edge": "'edge' || substr(hostname, 2)"}


@query(cte("devices") + f" SELECT hostname, {', '.join(f'{_KIND.format(h=h)} AS {name}' for name, h in _KIND_NAMES.items())} FROM devices")
def device_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each device by role, else by its name and by three other spellings of it."""
    d = model(spark, sf_dir, "devices")
    return d.select("hostname", *[net.device_kind(F.expr(h), F.col("role")).alias(name) for name, h in _KIND_NAMES.items()])


@query(cte("links", "sessions") + f", {SOURCES_SQL} SELECT protocol, status, CASE protocol WHEN 'bgp' THEN false WHEN 'ospf' THEN false ELSE status = 'up' END AS sound, count(*) AS n FROM u GROUP BY ALL")
def edge_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the status of an edge is sound for its protocol."""
    every = [df.withColumn("protocol", F.lit(p)) for p, df in _sources(spark, sf_dir).items()]
    rows = reduce(DataFrame.unionByName, every)
    return rows.groupBy("protocol", "status", net.edge_sound(F.col("protocol"), F.col("status")).alias("sound")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS k, 'snap_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_w' AS id, date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) AS at, lower(replace(replace(o_orderpriority, ' ', '_'), '/', '_')) AS slug
        FROM orders""")
def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot ids written from times and read back, and slugs."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = net.snapshot_id(F.col("o_orderdate"), "w")
    return o.select(F.col("o_orderkey").alias("k"), name.alias("id"), net.snapshot_time(name).alias("at"), net.command_slug(F.col("o_orderpriority")).alias("slug"))
