"""The registered queries of the snapshot engine and, for each, the same result as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as net
from ..operators import diff, policy, report, search, stored, tables, text, topology, views
from ..streaming import logs as streams
from .fixtures import cte, model

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"


def query(oracle: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


STATE_SQL = """CASE WHEN state = 'Estab' THEN 'Established' WHEN state = 'FULL/DR' THEN 'Full/DR' WHEN state = 'connected' THEN 'up'
        WHEN state = 'administratively down' THEN 'admin-down' WHEN state = 'Idle' THEN 'Idle' END"""
IF_SQL = "CASE WHEN interface LIKE 'Gi%' THEN 'GigabitEthernet' || substr(interface, 3) ELSE interface END"


@query(cte("sessions") + f""", latest AS (SELECT *, max(snapshot_id) OVER (PARTITION BY device_name) AS newest FROM sessions)
    SELECT device_name, count(*) AS sessions, count(DISTINCT neighbor) AS neighbors, min({STATE_SQL}) AS first_state FROM latest
    WHERE snapshot_id = newest AND NOT starts_with(lower(coalesce({STATE_SQL}, state)), 'established') AND NOT regexp_full_match(state, '[0-9,]+') GROUP BY device_name""")
def unhealthy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are not established in each device's latest snapshot."""
    rows = views.latest_snapshots(model(spark, sf_dir, "sessions").withColumn("command", F.lit("show ip bgp summary")))
    named = F.coalesce(net.canonical_state(F.col("state")), F.col("state"))
    bad = rows.filter(net.bgp_unsound(named))
    return bad.groupBy("device_name").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("neighbor").alias("neighbors"), F.min(net.canonical_state(F.col("state"))).alias("first_state"))


@query(cte("raw") + " SELECT device_name, command, snapshot_id, seq FROM raw QUALIFY row_number() OVER (PARTITION BY device_name, command ORDER BY snapshot_id DESC, seq DESC) = 1")
def latest_snapshot_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw").select("device_name", "command", "snapshot_id", "seq")
    return tables.latest_per_key(raw, ["device_name", "command"], [F.desc("snapshot_id"), F.desc("seq")])


@query(cte("raw") + """
        SELECT snapshot_id, min(updated_at) AS captured_at, count(DISTINCT device_name) AS devices, count(*) AS outputs, epoch(max(updated_at) - min(updated_at)) AS duration_s
        FROM raw GROUP BY snapshot_id""")
def snapshot_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshot_metadata(model(spark, sf_dir, "raw").withColumnRenamed("updated_at", "ingested_at"))


@query(cte("raw") + """ SELECT device_name, command, snapshot_id, seq FROM raw WHERE seq % 2 = 0 OR trim(raw_output) <> ''
    QUALIFY row_number() OVER (PARTITION BY device_name, command ORDER BY updated_at DESC, seq DESC) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw")
    out = tables.upsert_latest(raw.filter("seq % 2 = 0"), raw.filter("seq % 2 <> 0"), ["device_name", "command"], [F.desc("updated_at"), F.desc("seq")], "raw_output")
    return out.select("device_name", "command", "snapshot_id", "seq")


@query(cte("devices") + """, e AS (SELECT hostname, site, role, platform FROM devices WHERE length(hostname) % 2 = 0 OR role IS NOT NULL), i AS (SELECT hostname, CASE
        WHEN role = 'core' THEN NULL ELSE upper(site) END AS site, CASE WHEN role = 'wan' THEN 'border' ELSE role END AS role, CAST(NULL AS VARCHAR) AS platform FROM devices
        WHERE role IS NULL OR role <> 'edge')
    SELECT coalesce(i.hostname, e.hostname) AS hostname, coalesce(i.site, e.site) AS site, coalesce(i.role, e.role) AS role, coalesce(i.platform, e.platform) AS platform
        FROM e FULL JOIN i ON e.hostname = i.hostname""")
def device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model(spark, sf_dir, "devices")
    old = d.filter("length(hostname) % 2 = 0 or role is not null").select("hostname", "site", "role", "platform")
    new = d.filter("role is null or role <> 'edge'").select("hostname", F.when(F.coalesce("role", F.lit("")) != "core", F.upper("site")).alias("site"), F.when(F.col("role") == "wan", "border").otherwise(F.col("role")).alias("role"), F.lit(None).cast("string").alias("platform"))
    return tables.merge_devices(old, new)


@query(cte("sessions") + """,
        l AS (SELECT md5(device_name || '|' || neighbor) AS link_id, seen AS first_seen, seen AS last_seen, interface AS link_type, snapshot_id, state AS link_status, remote_as AS discovery_protocol, CAST(ok AS VARCHAR) || '/' || CAST(ln AS VARCHAR) || '/' || CAST(seen AS VARCHAR) || state || interface AS seq
        FROM sessions)
   
        SELECT link_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, min_by(link_type, seq) AS link_type, max_by(snapshot_id, seq) AS snapshot_id, max_by(discovery_protocol, seq) AS discovery_protocol, max_by(link_status, seq) AS link_status
        FROM l GROUP BY link_id""")
def link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    seq = F.concat(F.col("ok").cast("string"), F.lit("/"), F.col("ln").cast("string"), F.lit("/"), F.date_format("seen", "yyyy-MM-dd HH:mm:ss"), "state", "interface")
    links = s.select(F.md5(F.concat_ws("|", "device_name", "neighbor")).alias("link_id"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.col("interface").alias("link_type"), "snapshot_id", F.col("state").alias("link_status"), F.col("remote_as").alias("discovery_protocol"), seq.alias("seq"))
    return tables.merge_links(links)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session as an output of its own: a JSON list of one object."""
    s = model(spark, sf_dir, "sessions")
    one = F.to_json(F.array(F.struct("neighbor", "state", "interface")))
    return s.select("device_name", "snapshot_id", one.alias("parsed_data"), F.lit("show ip bgp summary").alias("command"))


@query(cte("sessions") + """, latest AS (SELECT *, max(snapshot_id) OVER (PARTITION BY device_name) AS newest FROM sessions)
    SELECT device_name, snapshot_id, neighbor, state, interface FROM latest WHERE snapshot_id = newest""")
def json_explode_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.explode_parsed(_parsed(spark, sf_dir), ["neighbor", "state", "interface"])


@query(cte("sessions") + """, long AS (SELECT 'state' AS column_name, state AS value FROM sessions UNION ALL SELECT 'interface', interface FROM sessions UNION ALL
        SELECT 'remote_as', remote_as FROM sessions), c AS (SELECT column_name, value, count(*) AS freq FROM long GROUP BY ALL),
   
        f AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(value), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> ''))), ' ') AS fingerprint, count(*) OVER (PARTITION BY column_name) AS n
        FROM c)
    SELECT 'sessions' AS view_name, column_name, value, freq, fingerprint, dense_rank() OVER (PARTITION BY column_name ORDER BY fingerprint) AS cluster_id FROM f WHERE n <= 30""")
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.value_profile(model(spark, sf_dir, "sessions"), "sessions", ["state", "interface", "remote_as"])


@query(cte("sessions") + f""" SELECT state, {STATE_SQL} AS canonical, {IF_SQL} AS interface, count(*) AS n FROM sessions GROUP BY ALL""")
def state_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    return s.groupBy("state", net.canonical_state(F.col("state")).alias("canonical"), net.canonical_interface(F.col("interface")).alias("interface")).agg(F.count(F.lit(1)).alias("n"))


@query(cte("devices") + """ SELECT hostname, CASE platform WHEN 'cisco-ios' THEN 'cisco_ios' WHEN 'JunOS' THEN 'juniper_junos' WHEN 'nx-os' THEN 'cisco_nxos'
        WHEN 'arista' THEN 'arista_eos' ELSE 'mikrotik_ros' END AS platform,
    CASE WHEN coalesce(role, '') = 'edge' OR role IN ('core', 'border', 'access', 'dist', 'wan') THEN role END AS role_of_name, CASE lower(coalesce(role, ''))
        WHEN 'access' THEN 0 WHEN 'dist' THEN 1 WHEN 'wan' THEN 2 WHEN 'core' THEN 3 ELSE 1 END AS stage FROM devices""")
def role_from_hostname(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model(spark, sf_dir, "devices")
    host = F.concat(F.lit("Site1-"), F.upper(F.coalesce("role", F.lit("coreless"))), F.lit("-01.core.example.net"))
    return d.select("hostname", net.canonical_platform(F.col("platform")).alias("platform"), net.role_of_host(host).alias("role_of_name"), net.rollout_stage(F.col("role")).alias("stage"))


@query(cte("neighbors", "devices") + """, r AS (SELECT n.*, lower(regexp_extract(peer, '^([A-Za-z0-9]+)', 1)) AS host FROM neighbors n),
        k AS (SELECT *, replace(local_if, 'Gi0', 'GigabitEthernet0') AS lif FROM r WHERE device <> host),
    i AS (SELECT *, md5(least(lower(device || ':' || lif), lower(host || ':' || peer_if)) || '|' || greatest(lower(device || ':' || lif), lower(host || ':' || peer_if))) AS link_id FROM k)
    SELECT link_id, min(snapshot_id) AS first_snapshot, max(snapshot_id) AS snapshot_id FROM i WHERE host IN (SELECT hostname FROM devices) GROUP BY link_id""")
def link_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = topology.extract_links(model(spark, sf_dir, "neighbors"), model(spark, sf_dir, "devices"))
    return links.select("link_id", "first_snapshot", "snapshot_id")


@query(cte("neighbors", "devices") + """, raw AS (SELECT DISTINCT peer AS raw FROM neighbors) SELECT raw, lower(regexp_extract(raw, '^([A-Za-z0-9]+)', 1)) AS hostname,
        CASE WHEN raw LIKE '%.%' THEN 3 WHEN raw LIKE '%-%' THEN 4 ELSE 1 END AS tier FROM raw WHERE lower(regexp_extract(raw, '^([A-Za-z0-9]+)', 1)) IN (SELECT hostname
        FROM devices)""")
def hostname_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.resolve_hostnames(model(spark, sf_dir, "neighbors").select(F.col("peer").alias("raw")), model(spark, sf_dir, "devices"))


@query(cte("sessions") + """, ios AS (SELECT DISTINCT device_name, interface FROM sessions WHERE interface LIKE 'Gi%' AND state <> 'Idle'),
        jun AS (SELECT DISTINCT device_name, interface FROM sessions WHERE interface LIKE 'ge%') SELECT * FROM ios UNION ALL SELECT * FROM jun
        WHERE device_name NOT IN (SELECT device_name FROM ios)""")
def interface_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions").select("device_name", "interface", "state")
    ios = s.filter("interface like 'Gi%' and state <> 'Idle'").select("device_name", "interface").distinct()
    junos = s.filter("interface like 'ge%'").select("device_name", "interface").distinct()
    return tables.prefer_first(ios, junos, "device_name")


_TWO = "(SELECT min(snapshot_id) FROM sessions WHERE snapshot_id >= 'snap_1995')", "(SELECT max(snapshot_id) FROM sessions)"


def _bounds(df: DataFrame) -> tuple[str, str]:
    """The earliest and the latest snapshot id: one row."""
    return tuple(df.agg(F.min(F.when(F.col("snapshot_id") >= "snap_1995", F.col("snapshot_id"))), F.max("snapshot_id")).first())


@query(cte("sessions") + f""", a AS (SELECT device_name, neighbor, max(state) AS s FROM sessions WHERE snapshot_id = {_TWO[0]} GROUP BY ALL),
        b AS (SELECT device_name, neighbor, max(state) AS s FROM sessions WHERE snapshot_id = {_TWO[1]} GROUP BY ALL)
    SELECT coalesce(a.device_name, b.device_name) AS device_name, coalesce(a.neighbor, b.neighbor) AS neighbor, CASE WHEN a.s IS NULL THEN 'added'
        WHEN b.s IS NULL THEN 'removed' END AS change FROM a FULL JOIN b ON a.device_name = b.device_name AND a.neighbor = b.neighbor WHERE a.s IS NULL OR b.s IS NULL""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    return diff.diff_snapshots(s, ["device_name", "neighbor"], *_bounds(s))


_PAIRS = """, cfg AS (SELECT *, row_number() OVER (PARTITION BY device_name, command ORDER BY snapshot_id DESC, seq DESC) AS p FROM raw WHERE command = 'show running-config')"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = model(spark, sf_dir, "raw").filter("command = 'show running-config'")
    from pyspark.sql import Window

    ranked = raw.withColumn("p", F.row_number().over(Window.partitionBy("device_name", "command").orderBy(F.desc("snapshot_id"), F.desc("seq"))))
    return ranked.filter("p = 2"), ranked.filter("p = 1")


@query(cte("raw") + _PAIRS + """, l AS (SELECT device_name, p, unnest(string_split(raw_output, chr(10))) AS line FROM cfg WHERE p <= 2),
        c AS (SELECT device_name, line, sum(CASE WHEN p = 1 THEN 1 ELSE -1 END) AS d FROM l GROUP BY ALL)
    SELECT device_name, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM c GROUP BY device_name""")
def config_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _pairs(spark, sf_dir)
    return diff.config_line_changes(old, new, ["device_name"])


_OUTPUTS = ", outputs AS (SELECT *, seq % 3 = 0 AS parsed, seq % 97 = 0 AS error FROM raw)"
_REASON = "CASE WHEN bool_or(o.error) THEN 'parser_error' WHEN o.platform IS NULL THEN 'unclassified' WHEN any_value(c.parser_type) IS NULL THEN 'no_parser_registered' WHEN any_value(c.parser_type) = 'raw_only' THEN 'raw_only' ELSE 'parser_no_match' END"
_UNPARSED = cte("raw", "commands") + _OUTPUTS + f", reasons AS (SELECT o.platform, o.command, count(*) AS n, {_REASON} AS reason FROM outputs o LEFT JOIN commands c ON o.platform = c.platform AND o.command = c.command WHERE NOT parsed GROUP BY o.platform, o.command)"


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir, "raw").withColumn("parsed", F.col("seq") % 3 == 0).withColumn("error", F.col("seq") % 97 == 0)


@query(_UNPARSED + " SELECT * FROM reasons")
def unparsed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unparsed(_outputs(spark, sf_dir), model(spark, sf_dir, "commands"))


@query(_UNPARSED + " SELECT platform, command, n, reason, command = 'show version' AS wanted FROM reasons WHERE reason IN ('no_parser_registered', 'parser_no_match') ORDER BY wanted DESC, n DESC, command, platform LIMIT 15")
def learn_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = report.unparsed(_outputs(spark, sf_dir), model(spark, sf_dir, "commands"))
    return report.learn_queue(reasons, spark.sql("select 'show version' as command"))


@query(cte("raw") + _OUTPUTS + " SELECT device_name FROM outputs GROUP BY device_name HAVING NOT bool_or(parsed) ORDER BY 1 LIMIT 20")
def silent_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.silent_devices(_outputs(spark, sf_dir))


@query(cte("raw") + _OUTPUTS + " SELECT count(*) AS landed, count(*) FILTER (WHERE parsed) AS parsed, count(*) FILTER (WHERE NOT parsed) AS unparsed, round_even(100.0 * count(*) FILTER (WHERE parsed) / count(*), 1) AS percent FROM outputs")
def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_outputs(spark, sf_dir))


@query(cte("logs") + f""" SELECT "timestamp", host, severity, message, false AS widened FROM logs WHERE contains(lower(message), 'error')
        AND "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND lower(severity) = 'error' ORDER BY "timestamp" DESC, host, message LIMIT 50""")
def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_logs(model(spark, sf_dir, "logs"), "Error", AS_OF, severity="error")


@query(cte("raw") + """ SELECT device_name, command, snapshot_id, substr(raw_output, greatest(instr(lower(raw_output), 'match community c3') - 200, 1), 1200) AS excerpt
        FROM raw WHERE contains(lower(raw_output), 'match community c3') ORDER BY snapshot_id DESC, device_name, command, excerpt LIMIT 50""")
def evidence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_evidence(model(spark, sf_dir, "raw"), "match community C3")


@query(cte("raw") + """, w AS (SELECT device_name, seq, length(raw_output) AS size, sum(length(raw_output)) OVER (PARTITION BY device_name
        ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY device_name ORDER BY seq DESC) AS n FROM raw) SELECT device_name, seq, size FROM w
        WHERE s <= 1000 OR n = 1""")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw").select("device_name", "seq", F.length("raw_output").cast("long").alias("size"))
    return search.within_budget(raw, ["device_name"], [F.desc("seq")], F.col("size"), 1000)


@query(cte("raw") + r"""
        SELECT device_name, seq, regexp_extract(raw_output, '(?m)^router ospf (\d+)', 1) AS ospf, regexp_extract(raw_output, '(?m)^ network (\S+)', 1) AS network, len(regexp_extract_all(raw_output, '(?m)^route-map .*$')) AS stanzas
        FROM raw""")
def config_regex_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = model(spark, sf_dir, "raw").select("device_name", "seq", text.config_facts(F.col("raw_output")).alias("f"))
    return facts.select("device_name", "seq", "f.ospf", "f.network", F.size("f.route_maps").cast("long").alias("stanzas"))


@query(cte("sessions", "devices") + """ SELECT device_name, snapshot_id, neighbor AS peer, state AS status FROM sessions WHERE device_name IN (SELECT hostname
        FROM devices WHERE vendor = 'cisco') AND state <> 'Idle' UNION ALL SELECT device_name, snapshot_id, neighbor, interface FROM sessions
        WHERE device_name IN (SELECT hostname FROM devices WHERE vendor = 'juniper')""")
def recipe_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    recipe = lambda vendor, fields, when, where=None: {"concept": "bgp", "command": "summary", "vendor_hint": vendor, "field_mappings": fields, "filter_expr": where, "discovered_at": when}
    recipes = [recipe("cisco", {"neighbor": "peer", "state": "status"}, 2, "state <> 'Idle'"), recipe("cisco", {"neighbor": "peer", "state": "status"}, 1), recipe("juniper", {"neighbor": "peer", "interface": "status"}, 1), recipe("arista", {"absent": "peer"}, 1)]
    return views.recipe_view({"summary": s}, recipes, model(spark, sf_dir, "devices"), "bgp")


@query(cte("devices") + """, p(protocol) AS (VALUES ('bgp'), ('ospf'), ('lldp')), r(concept, vendor_hint) AS (VALUES ('bgp', 'universal'), ('ospf', 'cisco'))
        SELECT DISTINCT protocol, vendor FROM devices, p WHERE NOT EXISTS (SELECT 1 FROM r WHERE concept = protocol AND (vendor_hint = vendor OR vendor_hint = 'universal'))""")
def recipe_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = spark.sql("select * from values ('bgp'), ('ospf'), ('lldp') as t(protocol)")
    recipes = spark.sql("select * from values ('bgp', 'universal'), ('ospf', 'cisco') as t(concept, vendor_hint)")
    return views.recipe_gaps(intent, model(spark, sf_dir, "devices"), recipes)


_FACTS = """, s AS (SELECT device_name AS device, CASE WHEN ln = 1 THEN '10.9.' || device_name END AS loopback, CASE
        WHEN ln = 2 THEN remote_as END AS local_as, neighbor AS peer_ip, remote_as FROM sessions)"""


def _fact_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    return s.select(F.col("device_name").alias("device"), F.when(F.col("ln") == 1, F.concat(F.lit("10.9."), "device_name")).alias("loopback"), F.when(F.col("ln") == 2, F.col("remote_as")).alias("local_as"), F.col("neighbor").alias("peer_ip"), "remote_as", "state")


@query(cte("devices", "sessions") + _FACTS + """, o AS (SELECT device AS hostname, min(loopback) AS l, min(local_as) AS a FROM s GROUP BY device),
        t AS (SELECT peer_ip, min(remote_as) AS told FROM s GROUP BY peer_ip), b AS (SELECT d.hostname, d.platform, d.role, coalesce(CASE
        WHEN length(d.hostname) % 2 = 0 THEN '10.0.0.' || substr(d.hostname, 2) END, o.l) AS loopback, o.a FROM devices d LEFT JOIN o ON d.hostname = o.hostname)
    SELECT hostname, platform, loopback, coalesce(a, told) AS local_as, role FROM b LEFT JOIN t ON b.loopback = t.peer_ip""")
def facts_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model(spark, sf_dir, "devices").withColumn("loopback", F.when(F.length("hostname") % 2 == 0, F.concat(F.lit("10.0.0."), F.substring("hostname", 2, 9))))
    return topology.device_facts(d, _fact_sessions(spark, sf_dir))


@query(cte("edges", "sessions") + """, f AS (SELECT DISTINCT dst, '10.0.0.' || substr(dst, 2) AS peer_ip FROM edges),
        s AS (SELECT s.device_name AS src, f.dst, max(s.state) AS bgp_state FROM sessions s JOIN f ON s.neighbor = f.peer_ip GROUP BY ALL) SELECT e.src, e.dst, s.bgp_state
        FROM edges e LEFT JOIN s ON e.src = s.src AND e.dst = s.dst""")
def edge_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model(spark, sf_dir, "edges")
    facts = e.select(F.col("dst").alias("hostname")).distinct().withColumn("loopback", F.concat(F.lit("10.0.0."), F.substring("hostname", 2, 9)))
    return topology.overlay(e, facts, _fact_sessions(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, written once, for what reads them more than once: deriving them is a join of the lines with themselves."""
    return stored.Scratch(spark).put(model(spark, sf_dir, "edges"), "edges")


@query(cte("edges") + """, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), c AS (SELECT min(src) AS n FROM edges), r1 AS (SELECT n
        FROM c UNION SELECT dst FROM both_ways WHERE src IN (SELECT n FROM c)), r2 AS (SELECT n FROM r1 UNION SELECT dst FROM both_ways WHERE src IN (SELECT n
        FROM r1)), r3 AS (SELECT n FROM r2 UNION SELECT dst FROM both_ways WHERE src IN (SELECT n FROM r2)) SELECT * FROM edges WHERE src IN (SELECT n FROM r3)
        AND dst IN (SELECT n FROM r3)""")
def nhop_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return topology.nhop_subgraph(e, e.agg(F.min("src")).first()[0] or "", 3)


_BLAST = """,
    k AS (SELECT src AS gone, row_number() OVER (ORDER BY count(*) DESC, src) AS place FROM edges GROUP BY src QUALIFY place <= 3),
    scenarios AS (SELECT CASE place WHEN 3 THEN 'links of ' ELSE '' END || gone AS scenario, gone, place FROM k UNION ALL SELECT 'none', '', 3),
    nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    n AS (SELECT scenario, node FROM scenarios, nodes WHERE place = 3 OR node <> gone),
    b AS (SELECT scenario, src, dst FROM scenarios, (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) WHERE src <> gone AND dst <> gone),
    reach AS (SELECT scenario, node, node AS seen FROM n UNION SELECT r.scenario, r.node, b.dst FROM reach r JOIN b ON r.seen = b.src AND r.scenario = b.scenario),
    c AS (SELECT scenario, node, min(seen) AS root FROM reach GROUP BY ALL), z AS (SELECT scenario, root, count(*) AS size FROM c GROUP BY ALL),
    t AS (SELECT scenario, count(*) AS components, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS isolated FROM z GROUP BY scenario)
    SELECT t.*, o.components AS components_before, o.largest AS largest_before FROM t JOIN t o ON o.scenario = 'none' WHERE t.scenario <> 'none'"""


@query("WITH RECURSIVE" + cte("edges")[4:] + _BLAST)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two busiest devices removed, each in a scenario of its own, and all links of the third one, with what was before."""
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    busiest = [r["src"] for r in e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(3).collect()]
    gone = spark.createDataFrame([(h, h) for h in busiest[:2]], "scenario string, device string")
    third = F.lit(busiest[2] if len(busiest) > 2 else None).cast("string")
    links = e.filter((F.col("src") == third) | (F.col("dst") == third)).select(F.concat(F.lit("links of "), third).alias("scenario"), "src", "dst")
    return topology.blast_radius(nodes, e, gone, links)


_BFS = """, mirrored AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), degrees AS (SELECT src AS node, count(*) AS degree FROM mirrored GROUP BY src),
    comps(node, comp) USING KEY (node) AS (
        SELECT node, node FROM degrees
        UNION SELECT b.dst, min(c.comp) FROM comps c JOIN mirrored b ON b.src = c.node JOIN recurring.comps r ON r.node = b.dst WHERE c.comp < r.comp GROUP BY b.dst),
    roots AS (SELECT arg_min(node, (-degree, node)) AS node FROM comps JOIN degrees USING (node) GROUP BY comp),
    levels(node, root, depth, slot) USING KEY (node) AS (
        SELECT node, node, 0, 0::BIGINT FROM roots
        UNION SELECT node, root, depth, row_number() OVER (PARTITION BY root ORDER BY parent, node) - 1
        FROM (SELECT b.dst AS node, l.root, l.depth + 1 AS depth, min(l.slot) AS parent FROM levels l JOIN mirrored b ON b.src = l.node WHERE b.dst NOT IN (SELECT node
        FROM recurring.levels) GROUP BY ALL))
    SELECT node, root, depth, slot FROM levels"""


@query("WITH RECURSIVE" + cte("edges")[4:] + _BFS)
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and place of each device from its component's busiest one."""
    e = _edges(spark, sf_dir)
    return topology.bfs_levels(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


_CLAUSES = r""",
    t AS (SELECT seq, string_split(raw_output, chr(10)) AS lines FROM raw), l AS (SELECT seq, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t),
    tops AS (SELECT *, lead(i) OVER (PARTITION BY seq ORDER BY i) AS after FROM l WHERE NOT regexp_matches(line, '^\s+\S')),
    heads AS (SELECT * FROM tops WHERE line LIKE 'route-map %'),
    body AS (SELECT h.seq, h.i, string_agg(CASE WHEN l.line LIKE ' match%' THEN trim(l.line) END, ';' ORDER BY l.i) AS matches, string_agg(CASE
        WHEN l.line LIKE ' set%' THEN trim(l.line) END, ';' ORDER BY l.i) AS sets
        FROM heads h JOIN l ON l.seq = h.seq AND l.i > h.i AND (h.after IS NULL OR l.i < h.after) GROUP BY ALL)
   
        SELECT h.seq, regexp_extract(line, '^route-map (\S+)', 1) AS policy, regexp_extract(line, '(permit|deny)', 1) AS action, CAST(regexp_extract(line, '(\d+)$', 1) AS INT) AS clause, h.i - 1 AS place, coalesce(matches, '') AS matches, coalesce(sets, '') AS sets
    FROM heads h LEFT JOIN body b ON h.seq = b.seq AND h.i = b.i"""


@query(cte("raw") + _CLAUSES)
def route_map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stanza of every captured text, with its match and set lines."""
    raw = model(spark, sf_dir, "raw").select(F.col("seq").alias("key"), "raw_output")
    maps = policy.route_maps(raw, keys=("key",))
    return maps.select(F.col("key").alias("seq"), "policy", "action", F.col("seq").alias("clause"), "place", F.array_join("matches", ";").alias("matches"), F.array_join("sets", ";").alias("sets"))


@query(cte("raw") + """ SELECT seq AS request, CASE WHEN seq % 4 = 3 THEN 10 ELSE 20 END AS seq, CASE WHEN seq % 4 = 3 THEN 'permit' ELSE 'deny' END AS outcome FROM raw
        WHERE raw_output LIKE 'hostname%'""")
def policy_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each captured policy asked about a route of community C3."""
    raw = model(spark, sf_dir, "raw").select(F.col("seq").alias("device"), "raw_output")
    maps = policy.route_maps(raw, keys=("device",))
    asked = policy.bindings(raw, keys=("device",)).select(F.col("device").alias("request"), "device", "policy")
    truth = asked.select("request", F.lit("match community C3").alias("condition"), F.lit(True).alias("holds"))
    return policy.policy_walk(maps, asked, truth)


@query(cte("raw") + """ SELECT seq AS request, 10 AS clause, CASE WHEN seq % 4 = 3 THEN 'all match lines hold'
        ELSE 'fails: match community C' || (seq % 4) END AS reason, seq % 4 = 3 AS won, CASE WHEN seq % 4 = 3 THEN 'set metric ' || (seq % 50) ELSE '' END AS sets
        FROM raw WHERE raw_output LIKE 'hostname%'
    UNION ALL SELECT seq, 20, 'no match lines', true, '' FROM raw WHERE raw_output LIKE 'hostname%' AND seq % 4 <> 3""")
def policy_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each clause of each captured policy decides a route of community C3, or does not."""
    raw = model(spark, sf_dir, "raw").select(F.col("seq").alias("device"), "raw_output")
    asked = policy.bindings(raw, keys=("device",)).select(F.col("device").alias("request"), "device", "policy")
    truth = asked.select("request", F.lit("match community C3").alias("condition"), F.lit(True).alias("holds"))
    out = policy.policy_trace(policy.route_maps(raw, keys=("device",)), asked, truth)
    return out.select("request", F.col("seq").alias("clause"), "reason", "won", F.array_join("sets", ",").alias("sets"))


@query(cte("devices") + """, s AS (SELECT hostname, role, CASE lower(coalesce(role, '')) WHEN 'access' THEN 0 WHEN 'dist' THEN 1 WHEN 'wan' THEN 2 WHEN 'core' THEN 3
        ELSE 1 END AS stage FROM devices WHERE model LIKE 'M1%') SELECT *, row_number() OVER (PARTITION BY stage ORDER BY role NULLS FIRST, hostname) AS place FROM s""")
def rollout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rollout_plan(model(spark, sf_dir, "devices"), "M1%").withColumn("place", F.col("place").cast("long"))


@query("""WITH e AS (SELECT doc_id, source, sha256(lang || chr(10) || text) AS hash FROM documents WHERE doc_id % 5 <> 0), i AS (SELECT doc_id, source, sha256(CASE
        WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END || chr(10) || text) AS new_hash FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(e.doc_id, i.doc_id) AS doc_id, CASE WHEN e.hash IS NULL THEN 'insert' WHEN i.new_hash IS NULL THEN CASE WHEN e.source IN (SELECT source
        FROM i) THEN 'prune' ELSE 'kept' END WHEN hash = new_hash THEN 'unchanged' ELSE 'update' END AS action FROM e FULL JOIN i ON e.doc_id = i.doc_id""")
def content_hash_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    old = d.filter("doc_id % 5 <> 0").select("doc_id", "source", F.sha2(F.concat_ws("\n", "lang", "text"), 256).alias("hash"))
    new = d.filter("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return tables.sync_by_hash(old, new, "doc_id", ["lang", "text"], "source")


@query(cte("devices", "raw") + """ SELECT hostname AS name, coalesce(role, '') AS role, site, 'active' AS status, (SELECT max(snapshot_id) FROM raw) AS snapshot_id FROM devices""")
def inventory_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.inventory_shape(model(spark, sf_dir, "devices"), model(spark, sf_dir, "raw"))


_STRUCTURE = r"""
    WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'r' || seq, raw_output FROM raw),
    l AS (SELECT id, string_split(text, chr(10)) AS lines FROM t),
    f AS (SELECT *, list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS full_lines FROM l),
    w AS (SELECT *, list_transform(full_lines, lambda x: len(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+'))) AS words,
        list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS marks FROM f),
    n AS (SELECT id, count(*) FILTER (WHERE mark AND NOT coalesce(before, false)) AS blocks
        FROM (SELECT id, mark, lag(mark) OVER (PARTITION BY id ORDER BY pos) AS before FROM (SELECT id, unnest(marks) AS mark, generate_subscripts(marks, 1) AS pos FROM w)) GROUP BY id)
    SELECT id, len(lines) AS line_count, len(full_lines) AS non_blank, list_max(list_transform(lines, lambda x: length(x))) AS max_line,
        CASE WHEN len(full_lines) <= 1 THEN 0 ELSE blocks END AS blocks, len(list_filter(full_lines, lambda x: starts_with(x, '  '))) AS indented,
        len(list_filter(full_lines, lambda x: regexp_matches(x, '^\s{2,}[A-Za-z][A-Za-z0-9 _-]*:\s*\S'))) >= 3 AS key_values,
        len(words) >= 3 AND len(list_filter(range(1, greatest(len(words) - 1, 2)), lambda i: list_max(words[i:i + 4]) - list_min(words[i:i + 4]) <= 1
        AND list_min(words[i:i + 4]) >= 3)) > 0 AS aligned,
        coalesce(regexp_matches(full_lines[1], '(%\s*Invalid|Error:|Unknown command|Permission denied|not found)', 'i'), false) AS error,
        len(list_filter(full_lines[1:20], lambda x: regexp_matches(x, '^(!|interface |router |hostname |vrf |line |ip route|version )'))) >= 5 AS config
    FROM w JOIN n USING (id)"""


@query(cte("raw") + "," + _STRUCTURE.strip().removeprefix("WITH"))
def text_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the documents' and the outputs' texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.unionByName(model(spark, sf_dir, "raw").select(F.concat(F.lit("r"), "seq").alias("id"), F.col("raw_output").alias("text")))
    counts = ("line_count", "non_blank", "max_line", "blocks", "indented")
    s = texts.select("id", text.structure(F.col("text")).alias("s"))
    return s.select("id", *[F.col(f"s.{c}").cast("long").alias(c) for c in counts], *[f"s.{c}" for c in ("key_values", "aligned", "error", "config")])


@query(cte("raw") + r""" SELECT seq, CASE WHEN raw_output LIKE 'hostname%' THEN regexp_extract(raw_output, '(?s)(router ospf \d+\n network \S+)\n!', 1) ELSE '' END AS section FROM raw""")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir, "raw").select("seq", diff.extract_sections(F.col("raw_output"), ["router ospf"]).alias("section"))


@query(cte("raw") + """ SELECT seq, CASE
        WHEN raw_output LIKE 'hostname%' THEN replace(raw_output, regexp_extract(raw_output, 'password 7 (secret[0-9]+)', 1), 'removed_' || substr(sha256('pepper' || regexp_extract(raw_output, 'password 7 (secret[0-9]+)', 1)), 1, 12))
        ELSE raw_output END AS redacted, CASE WHEN raw_output LIKE 'hostname%' AND seq % 4 >= 0 THEN 1 + (CASE WHEN raw_output LIKE '%community %' THEN 1 ELSE 0 END)
        ELSE 0 END AS findings
        FROM raw""".replace("THEN replace(raw_output,", "THEN replace(replace(raw_output, 'community C' || CAST(seq % 4 AS VARCHAR), 'community removed_' || substr(sha256('pepper' || 'C' || CAST(seq % 4 AS VARCHAR)), 1, 12)),"))
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw")
    return raw.select("seq", text.redact_text(F.col("raw_output"), "pepper").alias("redacted"), text.redact_findings(F.col("raw_output")).alias("findings"))


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query(cte("logs") + """ SELECT date_trunc('hour', "timestamp") AS window_start, host, severity, count(*) AS n FROM logs GROUP BY ALL""")
def syslog_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.severity_windows(model(spark, sf_dir, "logs"))


@query(cte("logs") + """, g AS (SELECT host, "timestamp" AS t, CASE WHEN "timestamp" >= lag("timestamp") OVER (PARTITION BY host
        ORDER BY "timestamp") + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM logs), s AS (SELECT *, sum(new) OVER (PARTITION BY host
        ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT host, min(t) AS started, max(t) + INTERVAL 30 MINUTES AS ended, count(*) AS n FROM s GROUP BY host, k""")
def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.host_sessions(model(spark, sf_dir, "logs"))


@query(cte("raw") + """ SELECT seq, length(trim(raw_output)) < 30 OR contains(lower(raw_output), '% invalid') AS is_error, raw_output LIKE 'hostname%'
        AND command <> 'show running-config' AS learnable FROM raw""")
def cli_error_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw")
    return raw.select("seq", text.is_cli_error(F.col("raw_output")).alias("is_error"), text.is_learnable(F.col("command"), F.col("raw_output")).alias("learnable"))


@query(cte("logs") + """, f AS (SELECT host, severity, lag(severity) OVER (PARTITION BY host ORDER BY "timestamp", severity) AS b FROM logs)
        SELECT host, count(*) AS flaps FROM f WHERE b <> severity GROUP BY host""")
def state_flaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.session_flaps(model(spark, sf_dir, "logs"), ["host"], "timestamp", "severity")


@query(cte("commands", "devices") + """, own AS (SELECT CASE platform WHEN 'arista' THEN 'arista_eos' ELSE platform END AS p FROM devices WHERE hostname = 'r3')
        SELECT platform, command, parser_type <> 'raw_only' AS has_template FROM commands, own WHERE NOT blacklisted AND contains(lower(command), 'ip') AND platform IN (p, '*')
        ORDER BY CASE WHEN platform = p THEN 0 ELSE 1 END, command, platform LIMIT 20""")
def search_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model(spark, sf_dir, "devices").withColumn("platform", net.canonical_platform(F.col("platform")))
    return search.search_commands(model(spark, sf_dir, "commands"), d, "IP", device="r3")


@query(cte("devices") + """ SELECT hostname AS claim, hostname AS device, role IS DISTINCT FROM 'core' AS device_known, (SELECT count(*) FROM devices o
        WHERE o.role IS DISTINCT FROM 'core'
        AND CAST(floor(CAST(substr(o.hostname, 2) AS INT) / 16) AS INT) = CAST(floor(CAST(substr(d.hostname, 2) AS INT) / 16) AS INT)) AS in_use FROM devices d""")
def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model(spark, sf_dir, "devices")
    claims = d.select(F.col("hostname").alias("claim"), F.col("hostname").alias("device"), F.concat("ip_address", F.lit("/28")).alias("subnet"))
    used = d.filter("role is null or role <> 'core'").select(F.col("hostname").alias("device_name"), "ip_address")
    return search.plan_check(claims, used)


@query(cte("sessions") + """, p AS (SELECT device_name AS device, neighbor AS prefix, remote_as AS neighbor_as, ok, ln, ok % 3 AS weight, ln * 10 AS med FROM sessions),
        m AS (SELECT *, min(med) OVER (PARTITION BY device, prefix, neighbor_as) AS least FROM p) SELECT device, prefix, weight, med, ok AS router_id FROM m WHERE med = least
        QUALIFY row_number() OVER (PARTITION BY device, prefix ORDER BY weight DESC, ok) = 1""")
def best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model(spark, sf_dir, "sessions")
    same = {c: F.lit(v) for c, v in {"local_pref": 100, "is_local": False, "as_path_len": 1, "origin": 0, "is_internal": False, "igp_metric": 0, "valid": True}.items()}
    paths = s.select(F.col("device_name").alias("device"), F.col("neighbor").alias("prefix"), F.col("remote_as").alias("neighbor_as"), (F.col("ok") % 3).alias("weight"), (F.col("ln") * 10).alias("med"), F.col("ok").alias("router_id")).withColumns(same)
    return policy.best_path(paths).select("device", "prefix", "weight", "med", "router_id")
