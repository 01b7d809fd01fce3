"""Queries over landing, the command catalogue and field values, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as net
from ..operators import catalog, landing, policy, stored, topology, views
from .fixtures import cte, model
from .queries import ORACLES, query

SALT = "s"
TEMPLATES = [
    ("cisco_ios", "show running-config", 0, r"^router ospf (\d+)$", ["process"]), ("cisco_ios", "show version", 0, r"^hostname (\S+)$", ["host"]), ("cisco_ios", "show version", 1, r"^router (\w+) (\d+)$", ["kind", "process"]),
    ("juniper_junos", "show running-config", 0, r"^hostname (r1\d*)$", ["host"]), ("arista_eos", "show ip route", 0, r"^ network (\S+)$", ["network"]),
]
LANDED = """, o AS (SELECT device_name, command, snapshot_id, CASE WHEN platform IS NULL THEN NULL ELSE platform END AS platform, raw_output, seq FROM raw QUALIFY
        row_number() OVER (PARTITION BY device_name, command, snapshot_id ORDER BY seq DESC) = 1),
    l AS (SELECT *, raw_output NOT LIKE 'hostname%' AS broken, CASE
        WHEN platform = 'cisco_ios' AND command IN ('show running-config', 'show version') OR platform = 'juniper_junos'
        AND command = 'show running-config' OR platform = 'arista_eos' AND command = 'show ip route' THEN
            CASE WHEN raw_output NOT LIKE 'hostname%' OR platform = 'juniper_junos' AND NOT regexp_matches(device_name, '^r1[0-9]*$') THEN 'no_rows' ELSE 'ok' END
        ELSE 'no_template' END AS reason FROM o)"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw output for each device, command and snapshot."""
    raw = model(spark, sf_dir, "raw")
    last = raw.groupBy("device_name", "command", "snapshot_id").agg(F.max_by(F.struct("platform", "raw_output"), "seq").alias("r"))
    return last.select("device_name", "command", "snapshot_id", "r.platform", "r.raw_output")


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "platform string, command string, tier int, pattern string, fields array<string>")


BUNDLE = {"bundle_id": "b1", "bundle_sha256": "abc", "collector_name": "c", "collector_version": "2"}


def _landing(spark: SparkSession, sf_dir: str, views: bool = False) -> dict[str, DataFrame]:
    d = model(spark, sf_dir, "devices")
    inventory = d.select("hostname", "ip_address", "platform", "site", "role")
    wanted = spark.createDataFrame([("show ip route",)], "command string")
    return landing.land_snapshot(_outputs(spark, sf_dir), _templates(spark), model(spark, sf_dir, "commands"), inventory, wanted, SALT, bundle=BUNDLE, views=views)


@query(cte("raw") + LANDED + """ SELECT 'outputs' AS part, command AS name, count(*) AS n FROM (SELECT command FROM l QUALIFY
        row_number() OVER (PARTITION BY device_name, command ORDER BY snapshot_id DESC) = 1) GROUP BY ALL
    UNION ALL SELECT 'landed', command, count(*) FROM l GROUP BY ALL UNION ALL SELECT 'parsed', command, count(*) FILTER (WHERE reason = 'ok') FROM l GROUP BY ALL
    UNION ALL SELECT 'silent', 'devices', least(20, count(*)) FROM (SELECT device_name FROM l GROUP BY ALL HAVING NOT bool_or(reason = 'ok')) UNION ALL
        SELECT 'total', 'landed', count(*) FROM l UNION ALL SELECT 'total', 'parsed', count(*) FILTER (WHERE reason = 'ok') FROM l""")
def land_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a landing, views too; counted: outputs kept, landed and parsed by command, silent devices, totals."""
    t = _landing(spark, sf_dir, views=True)
    part = lambda df, part, name, n: df.select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"))
    fills, total = t["fills"], t["totals"]
    rows = [
        part(t["outputs"].groupBy("command").count(), "outputs", F.col("command"), F.col("count")), part(fills, "landed", F.col("command"), F.col("landed")), part(fills, "parsed", F.col("command"), F.col("parsed")),
        part(t["silent"].agg(F.count(F.lit(1)).alias("n")), "silent", F.lit("devices"), F.col("n")), part(total, "total", F.lit("landed"), F.col("landed")), part(total, "total", F.lit("parsed"), F.col("parsed")),
    ]
    return reduce(DataFrame.unionByName, rows)


@query(cte("raw", "devices") + """, r AS (SELECT device_name, platform, row_number() OVER (PARTITION BY device_name ORDER BY snapshot_id DESC) AS n FROM raw),
        h AS (SELECT hostname FROM devices UNION SELECT device_name FROM raw)
    SELECT h.hostname, d.ip_address, d.site, d.role, CASE WHEN d.role IS NOT NULL THEN 'inventory' END AS role_source FROM h LEFT JOIN devices d ON h.hostname = d.hostname""")
def landed_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each device of the inventory or the outputs."""
    return _landing(spark, sf_dir)["devices"].select("hostname", "ip_address", "site", "role", "role_source")


@query(cte("raw") + LANDED + """
    SELECT 'b1' AS bundle_id, 'abc' AS bundle_sha256, 'c' AS collector_name, '2' AS collector_version, snapshot_id, count(DISTINCT device_name) AS devices, count(*) AS outputs,
        2 * count(*) FILTER (WHERE raw_output LIKE 'hostname%') AS replacements, substr(sha256('s'), 1, 8) AS salt_fingerprint, false AS degraded,
        count(*) FILTER (WHERE reason = 'ok') AS ok, count(*) FILTER (WHERE reason = 'no_template') AS no_template FROM l GROUP BY snapshot_id""")
def bundle_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest row of each snapshot with its JSON summary read back."""
    rows = _landing(spark, sf_dir)["bundle_ingests"]
    held = F.from_json("summary", "map<string,long>")
    return rows.select(*[c for c in rows.columns if c != "summary"], *[F.coalesce(F.element_at(held, c), F.lit(0)).alias(c) for c in ("ok", "no_template")])


@query(cte("raw", "commands") + LANDED + """, u AS (SELECT platform, command, count(*) AS n, bool_or(broken) AS error FROM l WHERE reason <> 'ok' GROUP BY ALL),
        c AS (SELECT platform, command, min(parser_type) AS parser_type FROM commands GROUP BY ALL)
    SELECT coalesce(u.platform, '-') AS platform, u.command, n, CASE WHEN error THEN 'parser_error' WHEN u.platform IS NULL THEN 'unclassified'
        WHEN parser_type IS NULL THEN 'no_parser_registered' WHEN parser_type = 'raw_only' THEN 'raw_only' ELSE 'parser_no_match' END AS reason
    FROM u LEFT JOIN c ON u.platform = c.platform AND u.command = c.command""")
def landed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why outputs were not parsed, by platform and command, as a landing reports it."""
    return _landing(spark, sf_dir)["reasons"].select(F.coalesce("platform", F.lit("-")).alias("platform"), "command", "n", "reason")


@query(cte("raw") + LANDED + """
        SELECT device_name, command, snapshot_id, parsed_ok, replace(replace(raw_output, ' 7 secret', ' 7 '), 'community C', 'community ') NOT LIKE '%secret%' AS clean, 'b1' AS bundle_id, 'abc' AS bundle_sha256, 'offline' AS ingested_via
    FROM (SELECT *, reason = 'ok' AS parsed_ok FROM l QUALIFY row_number() OVER (PARTITION BY device_name, command ORDER BY snapshot_id DESC) = 1)""")
def landed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs that stay after a landing: newest of each device and command, redacted and stamped with their bundle."""
    t = _landing(spark, sf_dir)["outputs"]
    return t.select("device_name", "command", "snapshot_id", F.col("parsed_data").isNotNull().alias("parsed_ok"), (~F.col("raw_output").contains("secret")).alias("clean"), "bundle_id", "bundle_sha256", "ingested_via")


@query(ORACLES["link_dedup"])
def landed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that a landing reads from the text of neighbour listings, laid over those of earlier snapshots."""
    n = stored.Scratch(spark).put(model(spark, sf_dir, "neighbors"), "neighbors")  # a join of the lines with themselves, read twice
    devices = model(spark, sf_dir, "devices")
    early = n.filter("snapshot_id < 'snap_1995'")
    entry = F.concat(F.lit("Device ID: "), "peer", F.lit("\nEntry address(es):\nInterface: "), "local_if", F.lit(",  Port ID (outgoing port): "), "peer_if")
    listing = F.array_join(F.collect_list(entry), "\n")  # the neighbours of one device in one snapshot
    late = n.filter("snapshot_id >= 'snap_1995'").groupBy(F.col("device").alias("device_name"), "snapshot_id").agg(listing.alias("raw_output"))
    outputs = late.select("device_name", F.lit("show cdp neighbors detail").alias("command"), "snapshot_id", F.lit("cisco_ios").alias("platform"), "raw_output")
    inventory = devices.select("hostname", "ip_address", "platform", "site", "role")
    wanted = spark.createDataFrame([], "command string")
    known = topology.extract_links(early, devices)
    out = landing.land_snapshot(outputs, _templates(spark), model(spark, sf_dir, "commands"), inventory, wanted, SALT, existing_links=known, views=False)
    return out["links"].select("link_id", "first_snapshot", "snapshot_id")


_PROFILED = {
    "show_ip_ospf_neighbor": ("show ip ospf neighbor", ["State"]), "show_ip_bgp_summary": ("show ip bgp summary", ["neighbor", "peer", "as", "state_pfxrcd"]), "show_vlan": ("show vlan", ["tag", "interfaces"]),
    "show_ip_interface_brief": ("show ip interface brief", ["status", "proto"]), "show_interfaces_terse": ("show interfaces terse", ["link_state", "proto"]),
}
_PROFILE_ROWS = " UNION ALL ".join(
    f"SELECT 'v_{view}_auto' AS view_name, '{c}' AS column_name, json_extract_string(parsed_data, '$[0].{c}') AS value FROM latest WHERE command = '{command}'"
    for view, (command, columns) in _PROFILED.items() for c in columns
)


@query(cte("outputs") + f""", newest AS (SELECT *, max(snapshot_id) OVER (PARTITION BY device_name, command) AS top FROM outputs), latest AS (SELECT * FROM newest
        WHERE snapshot_id = top AND parsed_data <> 'no list'),
    every AS ({_PROFILE_ROWS}), counts AS (SELECT view_name, column_name, value, count(*) AS freq FROM every WHERE value IS NOT NULL GROUP BY ALL),
    few AS (SELECT *, count(*) OVER (PARTITION BY view_name, column_name) AS n,
        array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(value), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> ''))), ' ') AS fingerprint FROM counts)
    SELECT view_name, column_name, value, freq, fingerprint, dense_rank() OVER (PARTITION BY view_name, column_name ORDER BY fingerprint) AS cluster_id FROM few WHERE n <= 30""")
def view_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value profile of all views that the parsed outputs have."""
    return views.profile_views(views.build_views(model(spark, sf_dir, "outputs").select("device_name", "command", "snapshot_id", "parsed_data")))


@query(cte("outputs") + """, v AS (SELECT device_name, snapshot_id, ok, ln, CASE command WHEN 'show ip ospf neighbor' THEN 'State'
        WHEN 'show ip interface brief' THEN 'status' WHEN 'show vlan' THEN 'tag' END AS field FROM outputs WHERE parsed_data <> 'no list'
        AND command IN ('show ip ospf neighbor', 'show ip interface brief', 'show vlan')),
    w AS (SELECT field, CASE field WHEN 'State' THEN json_extract_string(parsed_data, '$[0].State') WHEN 'status' THEN json_extract_string(parsed_data, '$[0].status')
        ELSE json_extract_string(parsed_data, '$[0].tag') END AS value FROM (SELECT o.parsed_data, CASE o.command WHEN 'show ip ospf neighbor' THEN 'State'
        WHEN 'show ip interface brief' THEN 'status' WHEN 'show vlan' THEN 'tag' END AS field FROM outputs o WHERE o.parsed_data <> 'no list') WHERE field IS NOT NULL)
    SELECT field, value, CASE WHEN value = 'full' THEN 'Full' WHEN value = 'FULL/DR' THEN 'Full/DR' WHEN value = '2WAY' THEN '2-Way' WHEN value = 'INIT' THEN 'Init'
        ELSE value END AS canonical, count(*) AS n FROM w GROUP BY ALL
    UNION ALL SELECT 'interfaces', i, i, count(*) FROM (SELECT unnest(['Gi0/' || (pk % 4), 'Gi0/' || (pk % 3)]) AS i FROM outputs WHERE command = 'show vlan' AND parsed_data <> 'no list') GROUP BY ALL
    UNION ALL SELECT 'interface', 'Gi0/' || (pk % 40), 'GigabitEthernet0/' || (pk % 40), count(*) FROM outputs WHERE command = 'show ip interface brief' AND parsed_data <> 'no list' GROUP BY ALL""")
def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of some fields of all parsed rows with its canonical form, list values one by one."""
    rows = landing.normalize_fields(model(spark, sf_dir, "outputs"))
    asked = rows.filter("field in ('State', 'tag') or field = 'status' or (field = 'interfaces' and command = 'show vlan') or (field = 'interface' and command = 'show ip interface brief')")
    return asked.groupBy("field", "value", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query(cte("neighbors") + """ SELECT DISTINCT device, local_if, peer, peer_if, CASE WHEN local_if LIKE '%1' OR local_if LIKE '%3' THEN 'cdp' ELSE 'lldp' END AS protocol, snapshot_id FROM neighbors""")
def raw_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours read back from CDP and LLDP listings that are written from the neighbour table."""
    n = model(spark, sf_dir, "neighbors")
    cdp = F.concat(F.lit("-------------------------\nDevice ID: "), "peer", F.lit("\nEntry address(es):\nInterface: "), "local_if", F.lit(",  Port ID (outgoing port): "), "peer_if", F.lit("\nInterface: Gi9/9,  Port ID (outgoing port): Gi9/8"))
    lldp = F.concat(F.lit("Local Interface  Parent  Chassis  Port  System Name\n"), "local_if", F.lit("  -  00:11:22:33:44:55  "), "peer_if", F.lit("  "), "peer")
    odd = F.col("local_if").rlike("[13]$")
    text = lambda rows, body: rows.select(F.col("device").alias("device_name"), "snapshot_id", body.alias("raw_output"))
    out = landing.raw_neighbors(text(n.filter(odd), cdp), "cdp").unionByName(landing.raw_neighbors(text(n.filter(~odd), lldp), "lldp"))
    return out.select("device", "local_if", "peer", "peer_if", "protocol", "snapshot_id")


@query(cte("raw") + """, f AS (SELECT device_name AS host, command, platform, raw_output FROM raw QUALIFY row_number() OVER (PARTITION BY device_name, command
        ORDER BY seq DESC) = 1), g AS (SELECT host, bool_or(command = 'show ip bgp summary') AS hinted,
        bool_or(command = 'show version' AND raw_output LIKE 'hostname%') AS version FROM f GROUP BY host)
    SELECT host, CASE WHEN hinted THEN 'juniper_junos' WHEN version AND regexp_matches(host, '^r1') THEN 'arista_eos' WHEN version THEN 'cisco_ios' END AS platform,
        CASE WHEN hinted AND version THEN 'template-version' WHEN hinted THEN 'filename-signature' WHEN version THEN 'template-version' ELSE 'unknown' END AS confidence FROM g""")
def discover_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw")
    files = raw.groupBy(F.col("device_name").alias("host"), "command").agg(F.max_by("raw_output", "seq").alias("text"))
    templates = spark.createDataFrame([("arista_eos", "show version", r"^hostname r1", 0), ("cisco_ios", "show version", r"^hostname ", 1), ("juniper_junos", "show version", r"^router ospf", 2)], "platform string, command string, pattern string, priority int")
    signatures = spark.createDataFrame([("show ip bgp summary", "juniper_junos")], "command string, platform string")
    return catalog.discover_platform(files, templates, signatures).select("host", "platform", "confidence")


@query("""WITH c AS (SELECT p_type AS command, p_brand AS platform, CASE p_partkey % 5 WHEN 0 THEN 'ntc' WHEN 1 THEN 'user' WHEN 2 THEN 'custom' WHEN 3 THEN 'learned'
        ELSE 'other' END AS source, p_partkey AS id FROM part), r AS (SELECT *, CASE source WHEN 'ntc' THEN 1 WHEN 'user' THEN 2 WHEN 'custom' THEN 3 WHEN 'learned' THEN 4
        ELSE 0 END AS w FROM c)
    SELECT platform, command, source, id, regexp_matches(lower(command), '^promo|steel$|n/a') AS blacklisted FROM r QUALIFY
        row_number() OVER (PARTITION BY platform, command ORDER BY w DESC, source DESC, id DESC) = 1""")
def merge_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each platform and command out of four sources, and whether the command is blacklisted."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    source = F.element_at(F.array(*map(F.lit, ["ntc", "user", "custom", "learned", "other"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = p.select(F.col("p_type").alias("command"), F.col("p_brand").alias("platform"), source.alias("source"), F.col("p_partkey").alias("id"))
    return catalog.flag_blacklisted(catalog.merge_commands(rows), ["^PROMO", " ", "steel$", "n/a"])


@query(cte("raw", "devices") + """, k AS (SELECT device_name, command, snapshot_id, raw_output FROM raw WHERE device_name IN (SELECT hostname
        FROM devices)), w(protocol, keyword) AS (VALUES ('bgp', 'BGP'), ('ospf', 'route'), ('any', 'show'))
    SELECT protocol, command, count(DISTINCT device_name) AS devices, (SELECT min(device_name) FROM k j WHERE j.command = k.command
        AND j.snapshot_id = (SELECT max(snapshot_id) FROM k i WHERE i.command = k.command)) AS sampled FROM k JOIN w ON contains(lower(command), lower(keyword)) GROUP BY ALL""")
def candidate_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw").withColumn("parsed_data", F.col("device_name"))
    words = spark.createDataFrame([("bgp", "BGP"), ("ospf", "route"), ("any", "show")], "protocol string, keyword string")
    return catalog.candidate_commands(raw, model(spark, sf_dir, "devices"), words).withColumnRenamed("sample", "sampled")


@query(cte("raw") + """, q AS (SELECT DISTINCT p_brand || ' ' || CASE p_size % 3 WHEN 0 THEN 'ECO' ELSE 'x' END AS asked, string_split(lower(p_brand || ' ' ||
        CASE p_size % 3 WHEN 0 THEN 'ECO' ELSE 'x' END), ' ') AS w FROM part), s AS (SELECT DISTINCT p_brand || ' ' || p_type AS command FROM part)
    SELECT asked, min(command) AS command FROM q LEFT JOIN s ON len(list_filter(w, lambda x: NOT contains(lower(command), x))) = 0 GROUP BY asked""")
def match_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first command that holds every word that was asked for."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = p.select(F.concat_ws(" ", "p_brand", F.when(F.col("p_size") % 3 == 0, "ECO").otherwise("x")).alias("asked"))
    return catalog.match_command(p.select(F.concat_ws(" ", "p_brand", "p_type").alias("command")), asked)


@query(cte("raw") + """, k AS (SELECT * FROM raw WHERE raw_output LIKE 'hostname%' AND command <> 'show running-config'),
        s AS (SELECT platform, command, device_name, snapshot_id, raw_output, row_number() OVER (PARTITION BY platform, command
        ORDER BY device_name, snapshot_id, raw_output) AS n FROM k)
    SELECT coalesce(k.platform, '-') AS platform, k.command, count(*) AS outputs, (SELECT array_to_string(list(device_name ORDER BY n), ',') FROM s
        WHERE s.platform IS NOT DISTINCT FROM k.platform AND s.command = k.command AND s.n <= 3) AS sampled FROM k GROUP BY ALL""")
def learn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.learn_candidates(model(spark, sf_dir, "raw"))
    return out.select(F.coalesce("platform", F.lit("-")).alias("platform"), "command", "outputs", F.array_join(F.col("samples.device_name"), ",").alias("sampled"))


@query(cte("raw") + LANDED + """, g AS (SELECT * FROM l WHERE raw_output LIKE 'hostname%' AND command <> 'show running-config')
        SELECT coalesce(platform, '-') AS platform, command, count(*) AS samples, round(avg((reason = 'ok')::INT), 6) AS share, avg((reason = 'ok')::INT) >= 0.7 AS passes FROM g
        GROUP BY ALL""")
def parser_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each platform's learnable outputs the templates read."""
    out = catalog.validate_learned(_outputs(spark, sf_dir), _templates(spark))
    return out.select(F.coalesce("platform", F.lit("-")).alias("platform"), "command", "samples", F.round("share", 6).alias("share"), "passes")


@query(cte("raw") + LANDED + """ SELECT device_name, command, snapshot_id, reason, CASE WHEN reason = 'ok' THEN CASE
        WHEN platform = 'arista_eos' THEN regexp_extract(raw_output, ' network ([0-9.]+)', 1) WHEN platform = 'cisco_ios'
        AND command = 'show running-config' THEN regexp_extract(raw_output, 'router ospf ([0-9]+)', 1) ELSE device_name END END AS first_value FROM l""")
def parse_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output read by the first template tier that yields rows."""
    from ..operators.text import parse_outputs as parse

    out = parse(_outputs(spark, sf_dir), _templates(spark))
    first = F.get(F.map_values(F.get(F.from_json("records", "array<map<string,string>>"), F.lit(0))), F.lit(0))
    return out.select("device_name", "command", "snapshot_id", "reason", first.alias("first_value"))


@query("""WITH
        v AS (SELECT '10.' || (o_custkey % 256) || '.' || (o_orderkey % 300) || '.0' || (o_orderkey % 2) AS ip, '2001:DB8:' || printf('%04x', o_custkey % 16) || ':0:0::' || (o_orderkey % 9) AS six, 1 + o_custkey % 65535 AS a, o_orderkey % 7 AS b, o_orderkey AS k
        FROM orders)
    SELECT k, ip || '/24' AS ip, printf('2001:db8%s::%s', CASE (SELECT printf('%x', CAST('0x' || string_split(six, ':')[3] AS INT))) WHEN '0' THEN ''
        ELSE ':' || printf('%x', CAST('0x' || string_split(six, ':')[3] AS INT)) END, CASE WHEN string_split(six, '::')[2] = '0' THEN ''
        ELSE string_split(six, '::')[2] END) AS six, CAST(b * 65536 + a AS VARCHAR) AS asn FROM v""")
def address_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4, IPv6 and dotted AS numbers in canonical form. Octets with leading zeros are no addresses and stay."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ip = F.concat(F.lit("10."), F.col("o_custkey") % 256, F.lit("."), F.col("o_orderkey") % 300, F.lit(".0"), F.col("o_orderkey") % 2, F.lit("/24"))
    six = F.concat(F.lit("2001:DB8:"), F.lpad(F.lower(F.hex(F.col("o_custkey") % 16)), 4, "0"), F.lit(":0:0::"), F.col("o_orderkey") % 9)
    asn = F.concat(F.col("o_orderkey") % 7, F.lit("."), 1 + F.col("o_custkey") % 65535)
    return o.select(F.col("o_orderkey").alias("k"), net.normalised("ip_address", ip).alias("ip"), net.canonical_ip(six).alias("six"), net.normalised("remote_as", asn).alias("asn"))


@query("""WITH i AS (SELECT 'r' || l_suppkey AS device_name, l_linenumber AS pos, CASE l_partkey % 4 WHEN 0 THEN 'Loopback' || (l_partkey % 3)
        WHEN 1 THEN 'lo0.' || (l_partkey % 2) ELSE 'Gi0/' || l_linenumber END AS interface, CASE WHEN l_partkey % 5 = 0 THEN 'unassigned'
        ELSE '10.0.' || (l_partkey % 9) || '.1/32' END AS ip_address, CASE WHEN l_orderkey % 3 = 0 THEN 'down' ELSE 'Up' END AS status FROM lineitem)
    SELECT device_name, split_part(ip_address, '/', 1) AS loopback FROM i WHERE status = 'Up' AND interface NOT LIKE 'Gi%' AND ip_address <> 'unassigned' QUALIFY
        row_number() OVER (PARTITION BY device_name ORDER BY pos, interface, ip_address) = 1""")
def loopbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first loopback of each device that is up and has an address."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("Loopback"), F.col("l_partkey") % 3)).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("lo0."), F.col("l_partkey") % 2)).otherwise(F.concat(F.lit("Gi0/"), "l_linenumber"))
    ip = F.when(F.col("l_partkey") % 5 == 0, "unassigned").otherwise(F.concat(F.lit("10.0."), F.col("l_partkey") % 9, F.lit(".1/32")))
    status = F.when(F.col("l_orderkey") % 3 == 0, "down").otherwise("Up")
    return landing.loopbacks(x.select(F.concat(F.lit("r"), "l_suppkey").alias("device_name"), F.col("l_linenumber").alias("pos"), name.alias("interface"), ip.alias("ip_address"), status.alias("status")))


@query(cte("raw") + """, t AS (SELECT device_name, snapshot_id, 'router-id 10.0.0.' || (seq % 200) || chr(10) || 'router bgp ' || (64512 + seq % 50) AS x, seq FROM raw
        WHERE seq % 3 <> 0)
        SELECT device_name, max_by('10.0.0.' || (seq % 200), snapshot_id || '10.0.0.' || (seq % 200)) AS router_id, max_by((64512 + seq % 50)::VARCHAR, snapshot_id || (64512 + seq % 50)) AS local_as
        FROM t GROUP BY device_name""")
def ids_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router id and AS number out of each device's newest text."""
    raw = model(spark, sf_dir, "raw")
    body = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("router-id 10.0.0."), F.col("seq") % 200, F.lit("\nrouter bgp "), 64512 + F.col("seq") % 50)).otherwise("nothing here")
    return landing.ids_of_text(raw.select("device_name", "snapshot_id", body.alias("raw_output")))


@query(cte("devices") + """, p(platform, vendor) AS (VALUES ('cisco-ios', 'Cisco Systems'), ('arista', 'Arista Networks'))
        SELECT hostname, coalesce(p.vendor, upper(substr(d.platform, 1, 1)) || lower(substr(d.platform, 2))) AS vendor, CASE d.model WHEN 'M1-1' THEN '-'
        ELSE d.model END AS model, 'v' || length(d.hostname) AS os_version FROM devices d LEFT JOIN p ON d.platform = p.platform""")
def device_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor by the platform's profile; model and version by the first field that has one."""
    d = model(spark, sf_dir, "devices")
    profiles = spark.createDataFrame([("cisco-ios", "Cisco Systems"), ("arista", "Arista Networks")], "platform string, vendor string")
    listed = F.concat(F.lit('["'), "model", F.lit('", "other"]'))
    fields = F.create_map(F.lit("Hardware"), F.when(F.col("model") == "M1-1", "[]").otherwise(listed), F.lit("MODEL"), F.lit("-"), F.lit("version"), F.lit(" "), F.lit("OS_version"), F.concat(F.lit("v"), F.length("hostname")))
    out = landing.vendor_by_profile(d.select("hostname", "platform", fields.alias("fields")), profiles)
    return out.select("hostname", "vendor", landing.pick_model(F.col("fields")).alias("model"), landing.pick_os_version(F.col("fields")).alias("os_version"))


@query("""WITH r AS (SELECT CASE l_partkey % 6 WHEN 0 THEN '0.0.0.0' ELSE '10.' || (l_partkey % 50) || '.0.0' END AS network, CASE WHEN l_partkey % 9 = 0 THEN NULL
        ELSE (l_partkey % 4) * 8 END AS length FROM lineitem)
    SELECT network || CASE WHEN length IS NULL THEN '' ELSE '/' || length END AS prefix, coalesce(network = '0.0.0.0' AND length = 0, false) AS is_default, count(*) AS n FROM r GROUP BY ALL""")
def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    network = F.when(F.col("l_partkey") % 6 == 0, "0.0.0.0").otherwise(F.concat(F.lit("10."), F.col("l_partkey") % 50, F.lit(".0.0")))
    length = F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") % 4 * 8)
    rows = x.select(network.alias("network"), length.alias("length"))
    out = rows.select(landing.prefix_text(F.col("network"), F.col("length")).alias("prefix"), F.coalesce(landing.is_default_route(F.col("network"), F.col("length")), F.lit(False)).alias("is_default"))
    return out.groupBy("prefix", "is_default").agg(F.count(F.lit(1)).alias("n"))


@query(cte("raw") + """,
        c AS (SELECT device_name AS device, seq, 'RM' || (seq % 3) AS policy, '10.0.0.' || (regexp_extract(raw_output, 'neighbor 10.0.0.([0-9]+)', 1)) AS neighbor FROM raw
        WHERE raw_output LIKE 'hostname%' AND command = 'show running-config' QUALIFY row_number() OVER (PARTITION BY device_name ORDER BY snapshot_id DESC, seq DESC) = 1),
    n AS (SELECT DISTINCT device, unnest(['10.0.0.1', '10.0.0.2', '10.0.0.3']) AS neighbor FROM c) SELECT n.device, n.neighbor, d AS direction, CASE
        WHEN d = 'in' THEN c.policy END AS policy, CASE WHEN d = 'in' AND c.policy IS NOT NULL THEN 2 ELSE 0 END AS clauses FROM n CROSS JOIN (VALUES ('in'), ('out')) x(d) LEFT
        JOIN c ON n.device = c.device AND n.neighbor = c.neighbor""")
def policy_of_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy, and how many clauses it has, of each of three neighbours in either direction."""
    raw = model(spark, sf_dir, "raw").filter("raw_output like 'hostname%' and command = 'show running-config'")
    last = raw.groupBy("device_name").agg(F.max_by("raw_output", F.struct("snapshot_id", "seq")).alias("raw_output"))
    ends = F.explode(F.array(*map(F.lit, ["10.0.0.1", "10.0.0.2", "10.0.0.3"])))
    asked = last.select("device_name", ends.alias("neighbor")).withColumn("direction", F.explode(F.array(F.lit("in"), F.lit("out"))))
    out = policy.policies_of_neighbors(asked, last)
    return out.groupBy(F.col("device_name").alias("device"), "neighbor", "direction", "policy").agg(F.count("action").alias("clauses"))
