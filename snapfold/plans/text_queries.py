"""Queries over captured text: state templates, unified diffs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import diff, learned, policy, stored, text, textfsm
from .fixtures import cte, model
from .queries import query

PORTS = r"""
Value Filldown ROUTER (\S+)
Value PORT (\S+)
Value Required STATUS (up|down)
Value List MEMBERS (\d+)

Start
  ^Router ${ROUTER} -> Ports

Ports
  ^Port -> Continue.Record
  ^Port ${PORT}
  ^  status ${STATUS}
  ^  member ${MEMBERS}
  ^Summary -> Record Summary

Summary
  ^ checked ${STATUS} -> Record
"""


def _port_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of each order's items as ports: a third ends in a summary, a fifth of the ports has no status."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    status = F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("\n  status "), F.when(F.col("l_partkey") % 2 == 0, "up").otherwise("down")))
    second = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("\n  member "), F.col("l_suppkey"))).otherwise("")
    port = F.concat(F.lit("Port Gi0/"), "l_linenumber", status, F.lit("\n  member "), "l_partkey", second)
    ports = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", port.alias("port")))).alias("ports"))  # the items of one order
    end = F.when(F.col("l_orderkey") % 3 == 0, "\nSummary\n checked up\n checked maybe").otherwise("")
    router = F.concat(F.lit("noise\nRouter r"), F.col("l_orderkey") % 97, F.lit("\n"))
    return ports.select("l_orderkey", F.concat(router, F.array_join("ports.port", "\n"), end).alias("raw_output"))


@query("""SELECT l_orderkey AS k, 'r' || l_orderkey % 97 AS router, 'Gi0/' || l_linenumber AS port, CASE WHEN l_partkey % 2 = 0 THEN 'up' ELSE 'down' END AS status,
        l_partkey || CASE WHEN l_partkey % 3 = 0 THEN ',' || l_suppkey ELSE '' END AS members FROM lineitem WHERE l_partkey % 5 <> 0
    UNION ALL SELECT DISTINCT l_orderkey, 'r' || l_orderkey % 97, '', 'up', '' FROM lineitem WHERE l_orderkey % 3 = 0""")
def state_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a template of three states, with a filldown, a required and a list value, through parse_outputs."""
    raw = _port_texts(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("device_name"), F.lit("ios").alias("platform"), F.lit("show ports").alias("command"), F.lit("s").alias("snapshot_id"), "raw_output")
    templates = spark.createDataFrame([("ios", "show ports", 0, None, None, textfsm.template_of(PORTS))], f"platform string, command string, tier int, pattern string, fields array<string>, fsm {textfsm.TEMPLATE}")
    rows = text.parse_outputs(raw, templates).filter("reason = 'ok'").select(F.col("device_name").cast("long").alias("k"), F.explode(F.from_json("records", "array<struct<router:string,port:string,status:string,members:array<string>>>")).alias("r"))
    return rows.select("k", "r.router", "r.port", "r.status", F.array_join("r.members", ",").alias("members"))


#: The last two configurations of each device, line by line. Lines of these texts stand at one place in either text, or differ.
_DIFF = """,
    c AS (SELECT device_name, raw_output, row_number() OVER (PARTITION BY device_name ORDER BY snapshot_id DESC, seq DESC) AS p FROM raw WHERE command = 'show running-config'),
    pairs AS (SELECT o.device_name, o.raw_output AS old, n.raw_output AS new FROM c o JOIN c n ON o.device_name = n.device_name AND o.p = 2 AND n.p = 1),
    sides AS (SELECT device_name, string_split(old, chr(10)) AS a, string_split(new, chr(10)) AS b FROM pairs WHERE old <> new),
    places AS (SELECT device_name, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM sides),
    met AS (SELECT device_name, i, a[i] AS x, b[i] AS y, coalesce(a[i] = b[i], false) AS same FROM places),
    gaps AS (SELECT *, count(*) FILTER (WHERE same) OVER (PARTITION BY device_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM met),
    lines AS (
        SELECT device_name, gap, 2 AS kind, ' ' AS sign, i AS old_no, i AS new_no, i, x AS line FROM gaps WHERE same
        UNION ALL SELECT device_name, gap, 0, '-', i, NULL, i, x FROM gaps WHERE NOT same AND x IS NOT NULL
        UNION ALL SELECT device_name, gap, 1, '+', NULL, i, i, y FROM gaps WHERE NOT same AND y IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY device_name ORDER BY gap, kind, i) AS place FROM lines),
    near AS (
        SELECT *, coalesce(place - max(CASE WHEN sign <> ' ' THEN place END) OVER (PARTITION BY device_name ORDER BY place) <= 3, false)
            OR coalesce(min(CASE WHEN sign <> ' ' THEN place END) OVER (PARTITION BY device_name ORDER BY place ROWS BETWEEN CURRENT ROW
        AND UNBOUNDED FOLLOWING) - place <= 3, false) AS kept FROM placed),
    starts AS (SELECT *, kept AND NOT coalesce(lag(kept) OVER (PARTITION BY device_name ORDER BY place), false) AS first FROM near),
    hunks AS (SELECT *, sum(first::INT) OVER (PARTITION BY device_name ORDER BY place) AS hunk FROM starts)
"""


def _config_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = model(spark, sf_dir, "raw").filter("command = 'show running-config'")
    newest = Window.partitionBy("device_name").orderBy(F.desc("snapshot_id"), F.desc("seq"))
    last = raw.withColumn("p", F.row_number().over(newest)).filter("p <= 2").groupBy("device_name").agg(F.max(F.when(F.col("p") == 2, F.col("raw_output"))).alias("old"), F.max(F.when(F.col("p") == 1, F.col("raw_output"))).alias("new"), F.max("p").alias("p"))
    return last.filter("p = 2").select("device_name", "old", "new")


@query(cte("raw") + _DIFF + " SELECT device_name, hunk, place, sign, old_no, new_no, line FROM hunks WHERE kept")
def config_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified diff of each device's last two configurations, line by line."""
    return diff.diff_rows(_config_pairs(spark, sf_dir), "old", "new")


@query(cte("raw") + _DIFF + """, texts AS (
        SELECT device_name, hunk, count(*) AS n, string_agg(sign || line, chr(10) ORDER BY place) AS body, count(*) FILTER (WHERE sign = '+') AS added, count(*) FILTER (WHERE sign = '-') AS removed,
            min(old_no) AS old_first, count(old_no) AS old_n, min(new_no) AS new_first, count(new_no) AS new_n FROM hunks WHERE kept GROUP BY ALL),
    heads AS (SELECT *, '@@ -' || old_first || CASE old_n WHEN 1 THEN '' ELSE ',' || old_n END || ' +' || new_first || CASE new_n WHEN 1 THEN '' ELSE ',' || new_n END || ' @@' AS head FROM texts),
    whole AS (SELECT device_name, '--- ' || chr(10) || '+++ ' || chr(10) || string_agg(head || chr(10) || body, chr(10)
        ORDER BY hunk) AS diff, sum(n + 1) + 2 AS n, sum(added) AS added, sum(removed) AS removed FROM heads GROUP BY device_name)
    SELECT device_name, coalesce(diff, '') AS diff, coalesce(n, 0)::BIGINT AS full_line_count, coalesce(added, 0)::BIGINT AS added, coalesce(removed, 0)::BIGINT AS removed,
        (coalesce(added, 0) + coalesce(removed, 0)) || ' lines changed (' || CASE WHEN coalesce(added, 0) >= coalesce(removed, 0) THEN '+'
        ELSE '' END || (coalesce(added, 0) - coalesce(removed, 0)) || ')' AS summary
    FROM pairs LEFT JOIN whole USING (device_name)""")
def config_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs of each device's last two configurations, put together from their rows."""
    return diff.unified_diffs(_config_pairs(spark, sf_dir), "old", "new")


def clauses_of(body: str, hint: str | None = None) -> list[dict[str, str | None]]:
    """A parser as one that was learned: the clauses of route maps with what each matches and sets."""
    rows: list[dict[str, str | None]] = []
    if not body.startswith("hostname"):
        raise ValueError("no configuration")
    for line in body.split("\n"):
        word, _, rest = line.strip().partition(" ")
        if word == "route-map":
            name, action, seq = rest.split(" ")
            rows.append({"Policy": name, "Action": action, "Seq": seq})
        elif word in ("match", "set") and rows:
            rows[-1][word] = rest
    return rows


@query(cte("raw") + """, c AS (SELECT seq, raw_output, 'RM' || (seq % 3) AS policy FROM raw WHERE raw_output LIKE 'hostname%')
    SELECT seq AS k, policy, 'permit' AS action, '10' AS seq, 'community C' || (seq % 4) AS "match", 'metric ' || (seq % 50) AS "set", NULL AS _error FROM c
    UNION ALL SELECT seq, policy, 'deny', '20', NULL, NULL, NULL FROM c
    UNION ALL SELECT seq, NULL, NULL, NULL, NULL, NULL, 'ValueError: no configuration' FROM raw WHERE raw_output NOT LIKE 'hostname%'""")
def learned_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a learned parser, called as a table function on each text."""
    learned.register_parser(spark, "route_map_clauses", clauses_of)
    raw = model(spark, sf_dir, "raw").select(F.col("seq").alias("k"), "raw_output")
    return learned.parse_learned(raw, "route_map_clauses", ["policy", "action", "seq", "match", "set", "_error"])


@query(cte("raw") + """,
    r AS (SELECT seq AS k, seq % 7 AS octet, 8 + seq % 25 AS bits, seq % 4 AS denied, 64512 + seq % 5 AS peer FROM raw),
    m AS (SELECT *, CASE WHEN octet = denied AND bits BETWEEN 16 AND 24 THEN false ELSE bits BETWEEN 16 AND 28 END AS listed, bits = 32 AND octet = 5 AS host, peer IN (64513, 64515) AS by_path FROM r)
    SELECT k, CASE WHEN listed OR host THEN 10 WHEN by_path THEN 20 END AS seq, CASE WHEN listed OR host THEN 'permit' WHEN by_path THEN 'deny' ELSE 'implicit_deny' END AS outcome FROM m""")
def policy_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy over prefix lists and AS path lists says to a route, each list read from the captured text."""
    raw = model(spark, sf_dir, "raw").select(F.col("seq").alias("device"), "raw_output")
    lists = ["\nip prefix-list PL seq 10 permit 10.0.0.0/8 ge 16 le 28\nip prefix-list PL seq 5 deny 10.", "denied", ".0.0/16 le 24\nip prefix-list HOST permit 10.5.0.0/16 ge 32\nip as-path access-list 7 deny _64514_\nip as-path access-list 7 permit ^6451[345]_"]
    maps = "\nroute-map PX permit 10\n match ip address prefix-list PL HOST\nroute-map PX deny 20\n match as-path 7\n"
    body = F.concat("raw_output", F.lit(lists[0]), F.col("device") % 4, F.lit(lists[2] + maps))
    raw = raw.select("device", body.alias("raw_output"))
    prefix = F.concat(F.lit("10."), F.col("device") % 7, F.lit(".9.1/"), 8 + F.col("device") % 25)
    path = F.concat(64512 + F.col("device") % 5, F.when(F.col("device") % 5 == 3, " 64999").otherwise(" 64514"))
    path = F.when(F.col("device") % 5 == 1, "64513").otherwise(path)
    asked = raw.select(F.col("device").alias("request"), "device", F.lit("PX").alias("policy"), prefix.alias("prefix"), path.alias("as_path"))
    keys = ("device",)
    clauses = stored.Scratch(spark).put(policy.route_maps(raw, keys=keys).filter("policy = 'PX'"), "clauses")
    truth = policy.resolve_matches(asked, clauses, policy.prefix_lists(raw, keys=keys), policy.as_path_lists(raw, keys=keys))
    return policy.policy_walk(clauses, asked, truth).select(F.col("request").alias("k"), "seq", "outcome")
